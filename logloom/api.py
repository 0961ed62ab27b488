"""The database: reads are plans over a version's live table, writes are batches that become a new version."""

from __future__ import annotations

import json
import math
from collections.abc import Callable, Iterable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import errors as E
from .functions.values import float_text, key_text, text_of, typed_key
from .operators import batch, small
from .operators.replay import numbered
from .operators.store import State, Store
from .plans.request import MAX_LIMIT, Op, Page, Plan, change, compile_read, key_of, matching, page_of, selector, table_of
from .schema import DatabaseSchema, TableSchema, check_workspace, parse_schema


@dataclass(frozen=True)
class AppendResult:
    tx_id: int
    operation: str
    bytes_written: int


@dataclass(frozen=True)
class DatabaseOptions:
    root: str
    workspace: str
    schema: DatabaseSchema
    snapshot_every: int | None = 64  # logs between snapshots; None: only on demand

    def __post_init__(self):
        check_workspace(self.workspace)


def encoded_line(table: TableSchema, tx_id: int, op: str, row: dict[str, object]) -> str:
    def cell(value: object) -> str:
        return key_text(value).replace("\\", "\\\\").replace("\t", "\\t").replace("\n", "\\n").replace("\r", "\\r")

    values = [cell(row[f]) for f in table.fields] if op == "R" else [cell(row["id"])]
    return "\t".join([op, str(tx_id), *values])


class _Nothing(Exception):
    pass


def _nothing() -> list[tuple]:
    raise _Nothing


@dataclass(frozen=True)
class WriteSnapshot:
    """The table as a batch that is being made sees it."""

    database: Database
    state: State
    table: TableSchema

    def live(self) -> DataFrame:
        return self.database.store.live(self.state, self.table)

    def get_unique_lookup(self, lookup: str, key: object) -> dict | None:
        got = compile_read(selector.one(self.table.name, lookup, key), self.database.schema, self.live()).collect()
        return got[0].asDict() if got else None


class Database:
    def __init__(self, spark: SparkSession, options: DatabaseOptions):
        self.spark, self.options = spark, options
        self.store = Store(spark, f"{options.root.rstrip('/')}/{options.workspace}", options.schema)

    @classmethod
    def open(cls, spark: SparkSession, root: str, workspace: str, schema: DatabaseSchema | str) -> Database:
        """Touches no file. schema: a DatabaseSchema or its text."""
        return cls(spark, DatabaseOptions(root, workspace, parse_schema(schema) if isinstance(schema, str) else schema))

    @property
    def schema(self) -> DatabaseSchema:
        return self.options.schema

    @property
    def workspace(self) -> str:
        return self.options.workspace

    @property
    def store_root(self) -> str:
        return self.store.root

    def init(self) -> None:
        """Publishes the first version, if there is none; checks the stored schemas and the unique lookups' keys."""
        state = self.store.state()
        if state.version == 0:
            try:
                self.store.publish(State(1, state.next_tx, state.tables))
            except E.CommitConflict:
                pass
        for table in self.schema.tables.values():
            if self.store.table_state(state, table).logs:
                from .operators.replay import unique_violations

                if table.unique_lookups and (bad := unique_violations(self.store.live(state, table), table).limit(1).collect()):
                    raise E.CorruptData(f"unique lookup `{bad[0].field}` of table `{table.name}` has a key of several rows")

    # Reading ---------------------------------------------------------------------------------------------------------

    def live(self, table: str, version: int | None = None) -> DataFrame:
        """The live table, of the newest or a given version, as a DataFrame."""
        return self.store.live(self.store.state(version), self.schema.table(table))

    def log(self, table: str, version: int | None = None) -> DataFrame:
        return self.store.ops(self.store.state(version), self.schema.table(table))

    def read_table(self, table: str) -> DataFrame:
        return self.live(table).orderBy("id")

    def frame(self, plan: Plan) -> DataFrame:
        """A reading plan as a lazy DataFrame."""
        table = table_of(self.schema, plan)
        return compile_read(plan, self.schema, self.live(table.name))

    def execute(self, plan: Plan):
        """A row or None, a Page, a count, or an AppendResult."""
        table = table_of(self.schema, plan)
        if plan.op in (Op.INSERT, Op.UPSERT, Op.PATCH, Op.REMOVE):
            return self.write_many([plan])[0]
        rows = self.live(table.name)
        if plan.op is Op.GET:
            got = compile_read(plan, self.schema, rows).collect()
            return got[0].asDict() if got else None
        if plan.op is Op.COUNT:
            return compile_read(plan, self.schema, rows).first().n
        return page_of(plan, self.schema, rows)

    get = execute

    def get_by_id(self, table: str, key: str) -> dict | None:
        return self.execute(selector.id(table, key))

    def get_by(self, table: str, lookup: str, key: object) -> dict | None:
        return self.execute(selector.one(table, lookup, key))

    def get_many_by(self, table: str, lookup: str, key: object) -> list[dict]:
        """Up to 1000 rows; more are left out, as a page's would be."""
        return self.execute(selector.many(table, lookup, key)).rows

    def get_page_by(self, table: str, lookup: str, key: object, limit: int | None = None, cursor: str | None = None) -> Page:
        return self.execute(Plan(Op.FIND, table, lookup, key, limit=limit, cursor=cursor))

    def get_by_lookup(self, table: str, lookup: str, key: object) -> DataFrame:
        """All rows of a key, in the order of id."""
        schema = self.schema.table(table)
        return matching(self.live(table), schema, *key_of(schema, Plan(Op.FIND, table, lookup, key))).orderBy("id")

    def get_each(self, table: str, lookup: str, keys: Iterable[object] | DataFrame) -> DataFrame:
        """Many gets in one job: the rows of any of the keys of a unique lookup. A list becomes one pushed-down
        predicate; a DataFrame of one column of key texts is joined."""
        schema = self.schema.table(table)
        key_of(schema, Plan(Op.GET, table, lookup, ""), unique=True)
        rows, kind = self.live(table), schema.fields[lookup]
        if isinstance(keys, DataFrame):
            return rows.join(keys.select(F.col(keys.columns[0]).alias("_key")).distinct(), text_of(F.col(lookup), kind) == F.col("_key"), "left_semi")
        typed = [v for k in keys if (v := typed_key(kind, k)) is not None]
        return rows.where(F.col(lookup).isin(typed)) if typed else rows.limit(0)

    def scan(self, table: str, limit: int | None = None, cursor: str | None = None) -> Page:
        return self.execute(Plan(Op.SCAN, table, limit=limit, cursor=cursor))

    def count(self, table: str, lookup: str | None = None, key: object = None) -> int:
        return self.execute(selector.count(table, lookup, key))

    # Writing ---------------------------------------------------------------------------------------------------------

    def write(self, plan: Plan) -> AppendResult:
        return self.write_many([plan])[0]

    def insert(self, table: str, row: dict) -> AppendResult:
        return self.write(change.add(table, row))

    def upsert(self, table: str, row: dict) -> AppendResult:
        return self.write(change.set(table, row))

    put = upsert

    def patch_by_id(self, table: str, key: str, values: dict) -> AppendResult:
        return self.write(change.edit_id(table, key, values))

    def insert_many(self, table: str, rows: Iterable[dict]) -> list[AppendResult]:
        return self.write_many([change.add(table, r) for r in rows])

    def write_many(self, plans: list[Plan]) -> list[AppendResult]:
        """All changes of one table or none. Inserts stand alone; each row may be touched once; every change sees the
        table as it was before."""
        if not plans:
            return []
        if any(p.table != plans[0].table for p in plans):
            raise E.InvalidPlan("write_many changes must all belong to the same table")
        if any(p.op is Op.INSERT for p in plans) and any(p.op is not Op.INSERT for p in plans):
            raise E.InvalidPlan("write_many insert changes cannot be mixed with other changes; use insert_many")
        table = table_of(self.schema, plans[0])
        rows = [self._change(table, i, p) for i, p in enumerate(plans)]
        return self._append(table, rows)

    def _change(self, table: TableSchema, seq: int, plan: Plan) -> tuple:
        kinds = {Op.INSERT: batch.INSERT, Op.UPSERT: batch.UPSERT, Op.PATCH: batch.PATCH, Op.REMOVE: batch.REMOVE}
        if plan.op not in kinds:
            raise E.InvalidPlan("write_many only accepts state changes")
        lookup = key = None
        if plan.op in (Op.INSERT, Op.UPSERT):
            table.check_row(plan.value)
        else:
            lookup, key = key_of(table, plan, unique=True)
        if plan.op is Op.PATCH:
            if not plan.value:
                raise E.InvalidPlan("patch value cannot be empty")
            if "id" in plan.value:
                raise E.InvalidPlan("patch cannot change id")
            for f in sorted(plan.value):
                if f not in table.fields:
                    raise E.InvalidPlan(f"unknown field `{f}` for table `{table.name}`")
                table.check_value(f, plan.value[f])
        values = plan.value if plan.op is not Op.REMOVE else {}
        return (seq, kinds[plan.op], lookup, key, *(values.get(f) for f in table.fields))

    def delete_by_id(self, table: str, key: str) -> AppendResult:
        """A tombstone, whether the id is live or not."""
        schema = self.schema.table(table)
        return self._append(schema, [(0, batch.TOMBSTONE, None, None, *(key if f == "id" else None for f in schema.fields))])[0]

    append_delete_id = delete_by_id

    def delete(self, table: str, row: dict) -> AppendResult:
        """A tombstone of the row's id; its other fields are not looked at."""
        schema = self.schema.table(table)
        if "id" not in row:
            raise E.MissingField(table, "id")
        schema.check_value("id", row["id"])
        return self.delete_by_id(table, row["id"])

    def apply(self, operation: str, table: str, row: dict) -> AppendResult:
        """`put` or `delete`; either way the whole row is checked."""
        self.schema.table(table).check_row(row)
        return self.put(table, row) if operation == "put" else self.delete(table, row)

    def append_many(self, table: str, operations: list[tuple[str, dict]]) -> list[AppendResult]:
        """Raw puts and deletes, without a check for earlier rows."""
        schema = self.schema.table(table)
        rows = []
        for seq, (operation, row) in enumerate(operations):
            if operation == "put":
                schema.check_row(row)
            else:
                schema.check_value("id", row.get("id"))
            rows.append((seq, batch.UPSERT if operation == "put" else batch.TOMBSTONE, None, None, *(row.get(f) for f in schema.fields)))
        return self._append(schema, rows) if rows else []

    def _append(self, table: TableSchema, rows: list[tuple]) -> list[AppendResult]:
        if len(rows) <= small.SMALL:
            return self._append_small(table, lambda state: rows)
        frame = self.spark.createDataFrame(rows, batch.change_schema(table))
        state, path = self._commit(table, frame, len(rows), dense=True)
        return self._results(table, path)

    def _append_small(self, table: TableSchema, rows_of: Callable[[State], list[tuple]]) -> list[AppendResult]:
        """A batch that the driver holds: one job reads the rows it can touch, one writes its operations."""
        names = batch.change_schema(table).names
        written: list[str] = []
        told: list[AppendResult] = []

        def make(state: State) -> State:
            for old in written:  # of a try that lost
                self.store.files.delete(f"{self.store.root}/{old}")
            written.clear()
            changes = [dict(zip(names, r)) for r in rows_of(state)]
            ops = small.resolve(changes, small.touched(changes, self.store.live(state, table), table), table)
            written.append(self.store.new_path(table, "log"))
            lines = [(state.next_tx + i, o["op"], *(o[f] for f in table.fields)) for i, o in enumerate(ops)]
            self.spark.createDataFrame(lines, batch.op_schema(table)).coalesce(1).write.parquet(f"{self.store.root}/{written[0]}")
            told[:] = [AppendResult(tx, "put" if op == "R" else "delete", len(encoded_line(table, tx, op, dict(zip(table.fields, values))).encode()) + 1) for tx, op, *values in lines]
            return self.store.with_log(state, table, written[0], len(lines))

        self._keep_up(table, self.store.commit(make))
        return told

    def resolve_and_append(self, table: str, resolver: Callable[[WriteSnapshot], list[Plan]]) -> list[AppendResult]:
        """The changes that the resolver makes of the table as it is: if another writer comes first, it is asked again
        with the table as it is then. No changes write nothing."""
        schema = self.schema.table(table)

        def rows_of(state: State) -> list[tuple]:
            plans = resolver(WriteSnapshot(self, state, schema))
            if any(p.table != table for p in plans):
                raise E.InvalidPlan("write_many changes must all belong to the same table")
            return [self._change(schema, i, p) for i, p in enumerate(plans)]

        try:
            return self._append_small(schema, lambda state: rows_of(state) or _nothing())
        except _Nothing:
            return []

    def _keep_up(self, table: TableSchema, state: State) -> None:
        """A new snapshot once snapshot_every logs came after the last."""
        entry = self.store.table_state(state, table)
        if self.options.snapshot_every and len(entry.logs) - entry.after_snapshot >= self.options.snapshot_every:
            self.store.refresh_snapshot(table)

    def write_frame(self, table: str, changes: DataFrame) -> int:
        """A batch of any size: changes (seq, kind, lookup, key, fields), of which columns that are not there are
        null. Returns how many operations were written."""
        return self._write_frame(table, changes, dense=False)

    def _write_frame(self, table: str, changes: DataFrame, dense: bool) -> int:
        """dense: seq counts from 0 without gaps, and each change is one operation, so it numbers the operations too."""
        schema = self.schema.table(table)
        want = batch.change_schema(schema)
        full = changes.select(*(F.col(f.name).cast(f.dataType) if f.name in changes.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in want.fields))
        kinds = {r.kind: r.n for r in full.groupBy("kind").agg(F.count(F.lit(1)).alias("n")).collect()}
        if unknown := set(kinds) - {batch.INSERT, batch.UPSERT, batch.PATCH, batch.REMOVE, batch.TOMBSTONE}:
            raise E.InvalidPlan(f"unknown changes: {sorted(map(str, unknown))}")
        if batch.INSERT in kinds and len(kinds) > 1:
            raise E.InvalidPlan("write_many insert changes cannot be mixed with other changes; use insert_many")
        count = sum(kinds.values())
        if count:
            self._keep_up(schema, self._commit(schema, full, count, dense)[0])
        return count

    def insert_frame(self, table: str, rows: DataFrame, order: str = "id") -> int:
        return self._write_rows(table, rows, order, batch.INSERT)

    def upsert_frame(self, table: str, rows: DataFrame, order: str = "id") -> int:
        return self._write_rows(table, rows, order, batch.UPSERT)

    def _write_rows(self, table: str, rows: DataFrame, order: str, kind: str) -> int:
        told = numbered(rows, [order], "seq")
        try:
            return self._write_frame(table, told.withColumn("kind", F.lit(kind)), dense=True)
        finally:
            told.release()

    def write_together(self, plans: list[Plan]) -> dict[str, list[AppendResult]]:
        """Changes of several tables as one version: all of them or none. The rules of write_many hold in each table;
        transaction ids go by table, in the order in which the tables first occur."""
        by_table: dict[str, list[Plan]] = {}
        for p in plans:
            by_table.setdefault(p.table, []).append(p)
        rows = {}
        for name, own in by_table.items():
            if any(p.op is Op.INSERT for p in own) and any(p.op is not Op.INSERT for p in own):
                raise E.InvalidPlan("write_many insert changes cannot be mixed with other changes; use insert_many")
            table = table_of(self.schema, own[0])
            rows[name] = [self._change(table, i, p) for i, p in enumerate(own)]
        if not rows:
            return {}
        written: dict[str, str] = {}

        def make(state: State) -> State:
            for old in written.values():
                self.store.files.delete(f"{self.store.root}/{old}")
            written.clear()
            now = state
            try:
                for name, changes in rows.items():
                    table = self.schema.table(name)
                    written[name] = self.store.new_path(table, "log")
                    frame = self.spark.createDataFrame(changes, batch.change_schema(table))
                    self._write_log(table, frame, state, now.next_tx, written[name], dense=True)
                    now = self.store.with_log(now, table, written[name], len(changes))
            except E.EngineError:
                for old in written.values():
                    self.store.files.delete(f"{self.store.root}/{old}")
                raise
            return State(state.version + 1, now.next_tx, now.tables)

        self.store.commit(make)
        return {name: self._results(self.schema.table(name), path) for name, path in written.items()}

    def _results(self, table: TableSchema, path: str) -> list[AppendResult]:
        ops = self.spark.read.schema(batch.op_schema(table)).parquet(f"{self.store.root}/{path}").orderBy("tx_id").collect()  # as many as were given
        return [AppendResult(r.tx_id, "put" if r.op == "R" else "delete", len(encoded_line(table, r.tx_id, r.op, r.asDict()).encode()) + 1) for r in ops]

    def _write_log(self, table: TableSchema, changes: DataFrame, state: State, next_tx: int, path: str, dense: bool) -> None:
        """Writes the operations that changes stand for in a version, and checks what was written."""
        target = f"{self.store.root}/{path}"
        rows = self.store.live(state, table)
        ops = batch.resolve(changes, rows, table)
        tx = ops.withColumn("tx_id", F.col("seq") + next_tx) if dense else numbered(ops, ["seq"], "tx_id", next_tx)
        tx.select("tx_id", "op", *table.fields, "seq", "kind").write.parquet(target)
        if not dense:
            tx.release()
        stored = self.spark.read.schema(batch.op_schema(table).add("seq", "long").add("kind", "string")).parquet(target)
        batch.raise_first(batch.violations(changes, stored.select("seq", "kind", "op", *table.fields), rows, table), table)

    def _commit(self, table: TableSchema, changes: DataFrame, count: int, dense: bool) -> tuple[State, str]:
        """Writes the operations, checks what was written against the version it was resolved for, publishes."""
        written: list[str] = []

        def make(state: State) -> State:
            for old in written:  # of a try that lost
                self.store.files.delete(f"{self.store.root}/{old}")
            written[:] = [self.store.new_path(table, "log")]
            try:
                self._write_log(table, changes, state, state.next_tx, written[0], dense)
            except E.EngineError:
                self.store.files.delete(f"{self.store.root}/{written[0]}")
                raise
            return self.store.with_log(state, table, written[0], count)

        return self.store.commit(make), written[0]

    def write_batch(self, changes: WriteBatch) -> list[AppendResult]:
        return self.write_many(changes.plans)

    # Maintenance -----------------------------------------------------------------------------------------------------

    def rebuild_cache(self, table: str) -> None:
        self.store.refresh_snapshot(self.schema.table(table))

    refresh_snapshot = rebuild_cache

    def snapshot_is_fresh(self, table: str) -> bool:
        """Whether reads of the table need no operation after its snapshot."""
        entry = self.store.table_state(self.store.state(), self.schema.table(table))
        return entry.snapshot is not None and entry.after_snapshot == len(entry.logs)

    def ensure_current(self, table: str) -> None:
        """A new snapshot, unless the table has a sound one with all its operations."""
        entry = self.store.table_state(self.store.state(), self.schema.table(table))
        self.store.sound.pop(entry.snapshot, None)
        if not self.store.usable(entry) or not self.snapshot_is_fresh(table):
            self.store.refresh_snapshot(self.schema.table(table))

    def hold(self, table: str) -> DataFrame:
        """Keeps the newest live table in memory for reads, until another version is written or held."""
        return self.store.hold(self.store.state(), self.schema.table(table))

    def let_go(self, table: str) -> None:
        self.store.let_go(self.schema.table(table))

    def vacuum(self, keep: int = 10, older_than: float = 7 * 86400) -> int:
        """Deletes old versions and the files that no kept one names."""
        return self.store.vacuum(keep, older_than)

    def compact(self, table: str) -> dict[str, int]:
        return self.store.compact(self.schema.table(table))

    compact_table = compact

    def export_segments(self, table: str, folder: str) -> int:
        from .sources.segments import write_segments

        return write_segments(self.log(table), folder, self.schema.table(table), self.schema.stored_hash())

    # Tables as attributes --------------------------------------------------------------------------------------------

    def __getattr__(self, name: str) -> Table:
        if name.startswith("_") or name not in self.__dict__.get("options", DatabaseOptions("", "x", DatabaseSchema())).schema.tables:
            raise AttributeError(name)
        return Table(self, name)

    def execute_json(self, request: str, require_hash: bool = False) -> str:
        """A request as the wire has it: integers are decimal strings or JSON integers, floats are finite.
        require_hash: a request must carry the hash of the schema that it was made for, or ClientError is raised."""
        try:
            asked = json.loads(request)
            if require_hash and not isinstance(asked.get("schema_hash"), str):
                raise E.ClientError("bridge_failed", "invalid bridge request: missing field `schema_hash`")
            return json.dumps({"ok": True, "result": _wire(self, asked)})
        except E.ClientError:
            raise
        except E.EngineError as e:
            return json.dumps({"ok": False, "error": {"code": e.code, "message": str(e)}})
        except (ValueError, TypeError, KeyError) as e:
            return json.dumps({"ok": False, "error": {"code": "invalid_value", "message": str(e)}})


class WriteBatch:
    """Changes of one table, gathered one by one: new rows only, or puts, edits and removals."""

    def __init__(self, table: str, insert_only: bool = False):
        self.table, self.insert_only, self.plans = table, insert_only, []

    @classmethod
    def inserts(cls, table: str) -> WriteBatch:
        return cls(table, insert_only=True)

    def push(self, plan: Plan) -> WriteBatch:
        if plan.table != self.table:
            raise E.InvalidInput(f"a batch of `{self.table}` cannot take a change of `{plan.table}`")
        if (plan.op is Op.INSERT) != self.insert_only:
            raise E.InvalidInput("a batch of inserts takes inserts only, and no other batch takes any")
        self.plans.append(plan)
        return self


class _Names:
    """db.table.by.lookup(key) and db.table.key.lookup(key)."""

    def __init__(self, table: Table, unique_only: bool):
        self._table, self._unique_only = table, unique_only

    def __getattr__(self, lookup: str):
        schema = self._table.schema
        if not schema.is_lookup(lookup) or self._unique_only and not schema.is_unique(lookup):
            raise AttributeError(lookup)
        if self._unique_only:
            return lambda key: Key(schema.name, lookup, key)
        make = selector.one if schema.is_unique(lookup) else selector.many
        return lambda key: make(schema.name, lookup, key)


@dataclass(frozen=True)
class Key:
    """A row of a table by a unique lookup; it cannot name a row of another table."""

    table: str
    lookup: str
    key: object


class Table:
    def __init__(self, database: Database, name: str):
        self.database, self.name, self.schema = database, name, database.schema.table(name)
        self.by, self.key = _Names(self, False), _Names(self, True)

    def _key(self, key: Key | str) -> Key:
        key = key if isinstance(key, Key) else Key(self.name, "id", key)
        if key.table != self.name:
            raise E.InvalidPlan(f"a key of `{key.table}` cannot target `{self.name}`")
        return key

    def all(self) -> Plan:
        return selector.all(self.name)

    def add(self, row: dict) -> Plan:
        return change.add(self.name, row)

    def set(self, row: dict) -> Plan:
        return change.set(self.name, row)

    def edit(self, key: Key | str, values: dict) -> Plan:
        k = self._key(key)
        return change.edit(self.name, k.lookup, k.key, values)

    def drop(self, key: Key | str) -> Plan:
        k = self._key(key)
        return change.remove(self.name, k.lookup, k.key)

    def insert(self, row: dict) -> AppendResult:
        return self.database.write(self.add(row))

    def upsert(self, row: dict) -> AppendResult:
        return self.database.write(self.set(row))

    put = upsert

    def patch(self, key: Key | str, values: dict) -> AppendResult:
        return self.database.write(self.edit(key, values))

    def remove(self, key: Key | str) -> AppendResult:
        return self.database.write(self.drop(key))

    def get(self, key: Key | str) -> dict | None:
        k = self._key(key)
        return self.database.get(selector.one(self.name, k.lookup, k.key))

    def find(self, lookup: str, key: object) -> list[dict]:
        return self.database.get_many_by(self.name, lookup, key)

    def scan(self, limit: int | None = None, cursor: str | None = None) -> Page:
        return self.database.scan(self.name, limit, cursor)

    def count(self, lookup: str | None = None, key: object = None) -> int:
        return self.database.count(self.name, lookup, key)

    def frame(self) -> DataFrame:
        return self.database.live(self.name)


def _decode(table: TableSchema, f: str, value: object) -> object:
    if f not in table.fields:
        raise E.UnknownField(table.name, f)
    kind = table.fields[f]
    wrong = E.InvalidValue(f"expected a valid {kind} wire value")
    wrong.code = "type_mismatch"
    if kind in ("id", "text"):
        if not isinstance(value, str):
            raise wrong
        return value
    if kind == "bool":
        if not isinstance(value, bool):
            raise wrong
        return value
    if isinstance(value, bool):
        raise wrong
    if kind == "int":
        if not (isinstance(value, int) or isinstance(value, str) and value.lstrip("+-").isdigit()) or not -(2**63) <= int(value) < 2**63:
            raise wrong
        return int(value)
    if not isinstance(value, int | float) or not math.isfinite(value):
        raise wrong
    return float(value)


def _encode(table: TableSchema, row: dict | None) -> dict | None:
    if row is None:
        return None
    out = {}
    for f, kind in table.fields.items():
        if kind == "float" and not math.isfinite(row[f]):
            raise E.InvalidValue("cannot return a non-finite float")
        out[f] = str(row[f]) if kind == "int" else row[f]
    return out


def _wire(db: Database, request: dict):
    if (h := request.get("schema_hash")) is not None and h != db.schema.declared_hash():
        raise E.SchemaMismatch(f"schema hash {h} is not {db.schema.declared_hash()}")
    op = request.get("op")
    if op == "init":
        db.init()
        return None
    told = lambda r: {"tx_id": str(r.tx_id), "operation": r.operation, "bytes_written": str(r.bytes_written)}
    if op == "write_many":
        return [told(r) for r in db.write_many([_wire_plan(db, {"op": c.get("kind"), **c}) for c in request["changes"]])]
    plan = _wire_plan(db, request)
    table = db.schema.table(plan.table)
    got = db.execute(plan)
    if plan.op is Op.GET:
        return _encode(table, got)
    if plan.op is Op.COUNT:
        return str(got)
    if isinstance(got, Page):
        return {"rows": [_encode(table, r) for r in got.rows], "next_cursor": got.next_cursor}
    return told(got)


def _wire_plan(db: Database, request: dict) -> Plan:
    ops = {"get": Op.GET, "find": Op.FIND, "scan": Op.SCAN, "count": Op.COUNT, "add": Op.INSERT, "set": Op.UPSERT, "edit": Op.PATCH, "remove": Op.REMOVE}
    if request.get("op") not in ops:
        raise E.InvalidPlan(f"unknown operation: {request.get('op')}")
    table, lookup, key = db.schema.table(request.get("table")), request.get("lookup"), request.get("key")
    if lookup is not None:
        if not table.is_lookup(lookup):
            raise E.UnknownLookup(f"unknown lookup `{lookup}` for table `{table.name}`")
        if key is not None:
            key = _decode(table, lookup, key)
            key = float_text(key) if isinstance(key, float) else key
    value = {f: _decode(table, f, v) for f, v in next((request[n] for n in ("row", "patch", "value") if request.get(n)), {}).items()}
    return Plan(ops[request["op"]], table.name, lookup, key, value, request.get("limit"), request.get("cursor"))


__all__ = ["MAX_LIMIT", "AppendResult", "Database", "DatabaseOptions", "Key", "Table", "WriteBatch", "WriteSnapshot"]
