"""Versions of a database: Parquet operation logs, published by a manifest per version.

`<root>/<workspace>/commit-log/<version>.json` names the files of each table; a file of that name can be created once, so
of two writers one wins and the other resolves its batch anew. Readers pin a version and need no lock. A version is
whole or absent, so there is no torn tail to recover."""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Callable
from dataclasses import asdict, dataclass, field, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import errors as E
from ..schema import DatabaseSchema, TableSchema
from ..sources.shared import Files
from .batch import op_schema
from .replay import compacted, live, live_from

RETRIES = 50


@dataclass
class TableState:
    signature: str
    logs: list[str] = field(default_factory=list)
    ops: int = 0
    snapshot: str | None = None
    after_snapshot: int = 0  # of the logs, how many the snapshot holds
    snapshot_files: dict[str, int] = field(default_factory=dict)  # lengths, to tell a damaged one


@dataclass
class State:
    version: int = 0
    next_tx: int = 1
    tables: dict[str, TableState] = field(default_factory=dict)


class Store:
    def __init__(self, spark: SparkSession, root: str, schema: DatabaseSchema):
        self.spark, self.root, self.schema = spark, root.rstrip("/"), schema
        self.files = Files(spark)
        self.sound: dict[str, bool] = {}  # snapshots looked at
        self.held: dict[str, tuple[TableState, DataFrame]] = {}

    def _manifest(self, version: int) -> str:
        return f"{self.root}/commit-log/{version:020d}.json"

    def state(self, version: int | None = None) -> State:
        """The newest version, or a given one."""
        if version is None:
            names = [n for n in self.files.names(f"{self.root}/commit-log") if n.endswith(".json") and not n.startswith(".")]
            if not names:
                return State()
            number = names[-1].removesuffix(".json")
            if not number.isdigit():
                raise E.CorruptData(f"bad workspace revision: {names[-1]}")
            version = int(number)
        text = self.files.read(self._manifest(version))
        try:
            raw = json.loads(text)
            return State(raw["version"], raw["next_tx"], {k: TableState(**v) for k, v in raw["tables"].items()})
        except (ValueError, TypeError, KeyError, AttributeError) as e:
            raise E.CorruptData(f"bad workspace revision: {e}") from None

    def versions(self) -> list[int]:
        return [int(n.removesuffix(".json")) for n in self.files.names(f"{self.root}/commit-log") if n.endswith(".json") and not n.startswith(".")]

    def publish(self, state: State) -> None:
        self.files.publish(self._manifest(state.version), json.dumps(asdict(state)))

    def commit(self, make: Callable[[State], State]) -> State:
        """make(state) gives the next state from the newest; on a conflict it is asked again."""
        for _ in range(RETRIES):
            new = make(self.state())
            try:
                self.publish(new)
                return new
            except E.CommitConflict:
                continue
        raise E.CommitConflict(f"no version could be published in {RETRIES} tries")

    def table_state(self, state: State, table: TableSchema) -> TableState:
        """The table's entry; its stored schema must be the declared one."""
        entry = state.tables.get(table.name)
        if entry is None:
            return TableState(table.signature())
        if entry.signature != table.signature():
            raise E.CorruptData(f"stored schema of table `{table.name}` differs from the declared one")
        return entry

    def ops(self, state: State, table: TableSchema, since: int = 0) -> DataFrame:
        logs = self.table_state(state, table).logs[since:]
        if not logs:
            return self.spark.createDataFrame([], op_schema(table))
        return self.spark.read.schema(op_schema(table)).parquet(*(f"{self.root}/{p}" for p in logs))

    def usable(self, entry: TableState) -> bool:
        """Whether the table's snapshot is there with all its files in their lengths. Looked at once for each."""
        if entry.snapshot is None:
            return False
        if entry.snapshot not in self.sound:
            there = self.files.sizes(f"{self.root}/{entry.snapshot}")
            self.sound[entry.snapshot] = bool(entry.snapshot_files) and all(there.get(n) == size for n, size in entry.snapshot_files.items())
        return self.sound[entry.snapshot]

    def live(self, state: State, table: TableSchema) -> DataFrame:
        """The live table of a version: its snapshot and the operations after it, or all operations where there is no
        snapshot or it is damaged. A table that is held in memory is taken from there."""
        entry, fields = self.table_state(state, table), list(table.fields)
        if table.name in self.held and self.held[table.name][0] == entry:
            return self.held[table.name][1]
        if not self.usable(entry):
            return live(self.ops(state, table), fields)
        snapshot = self.spark.read.schema(table.struct(nullable=True)).parquet(f"{self.root}/{entry.snapshot}")
        if entry.after_snapshot == len(entry.logs):
            return snapshot
        return live_from(snapshot, self.ops(state, table, entry.after_snapshot), fields)

    def hold(self, state: State, table: TableSchema) -> DataFrame:
        """Persists the live table of a version; reads of it need no replay until another version is held."""
        entry = self.table_state(state, table)
        rows = self.live(state, table)
        if table.name not in self.held or self.held[table.name][0] != entry:
            old = self.held.get(table.name)
            self.held[table.name] = (entry, rows.persist())
            if old:
                old[1].unpersist()
        return self.held[table.name][1]

    def let_go(self, table: TableSchema) -> None:
        if held := self.held.pop(table.name, None):
            held[1].unpersist()

    def new_path(self, table: TableSchema, kind: str) -> str:
        return f"{table.name}/{kind}-{uuid.uuid4().hex}"

    def with_log(self, state: State, table: TableSchema, path: str, count: int) -> State:
        entry = self.table_state(state, table)
        tables = dict(state.tables) | {table.name: replace(entry, logs=[*entry.logs, path], ops=entry.ops + count)}
        return State(state.version + 1, state.next_tx + count, tables)

    def _drop(self, written: list[str]) -> None:
        """Deletes what a try has written that another writer overtook."""
        for path in written:
            self.files.delete(f"{self.root}/{path}")
        written.clear()

    def vacuum(self, keep: int = 10, older_than: float = 7 * 86400) -> int:
        """Deletes versions before the newest `keep` and the files that no kept version names; returns how many files.
        Files younger than `older_than` seconds stay, as a writer may be about to publish them."""
        versions = self.versions()
        kept = [self.state(v) for v in versions[-keep:]]
        named = {p for s in kept for t in s.tables.values() for p in [*t.logs, t.snapshot] if p}
        limit, gone = time.time() - older_than, 0
        for version in versions[:-keep]:
            self.files.delete(self._manifest(version))
            gone += 1
        for table in {n for s in kept for n in s.tables} | set(self.schema.tables):
            for name in self.files.names(f"{self.root}/{table}"):
                path = f"{table}/{name}"
                if path not in named and self.files.modified(f"{self.root}/{path}") <= limit:
                    self.files.delete(f"{self.root}/{path}")
                    gone += 1
        return gone

    def refresh_snapshot(self, table: TableSchema) -> State:
        """Writes the live table, sorted by id so that files' ranges of ids prune reads."""

        written: list[str] = []

        def make(state: State) -> State:
            self._drop(written)
            entry = self.table_state(state, table)
            path = self.new_path(table, "snapshot")
            written.append(path)
            self.live(state, table).orderBy("id").write.parquet(f"{self.root}/{path}")
            files = {n: size for n, size in self.files.sizes(f"{self.root}/{path}").items() if not n.startswith((".", "_"))}
            tables = dict(state.tables) | {table.name: replace(entry, snapshot=path, after_snapshot=len(entry.logs), snapshot_files=files)}
            return State(state.version + 1, state.next_tx, tables)

        return self.commit(make)

    def compact(self, table: TableSchema) -> dict[str, int]:
        """Replaces the table's log by its live rows as puts with fresh transaction ids, in the order of id."""
        report: dict[str, int] = {}
        written: list[str] = []

        def make(state: State) -> State:
            self._drop(written)
            entry = self.table_state(state, table)
            path = self.new_path(table, "log")
            written.append(path)
            fresh = compacted(self.live(state, table), list(table.fields), state.next_tx)
            fresh.write.parquet(f"{self.root}/{path}")
            fresh.release()
            rows = self.spark.read.schema(op_schema(table)).parquet(f"{self.root}/{path}").count()
            report.update(rows=rows, ops_before=entry.ops, ops_after=rows, logs_before=len(entry.logs), logs_after=1)
            tables = dict(state.tables) | {table.name: TableState(entry.signature, [path], rows)}
            return State(state.version + 1, state.next_tx + rows, tables)

        self.commit(make)
        return report

    def next_tx_of_logs(self, state: State, table: TableSchema) -> int:
        """The largest transaction id in the table's log plus one, or 1."""
        return (self.ops(state, table).agg(F.max("tx_id")).first()[0] or 0) + 1
