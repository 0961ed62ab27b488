"""A client of the bridge: each request is a process of `python -m logloom bridge`, for callers without Spark."""

from __future__ import annotations

import json
import subprocess
import sys
from dataclasses import dataclass, field
from pathlib import Path

from .errors import ClientError
from .schema import parse_schema


def int64(value: int) -> int:
    """The value, if a signed integer of 64 bits holds it."""
    if not -(2**63) <= value < 2**63:
        raise ClientError("integer_out_of_range", "integer is outside the signed 64-bit range")
    return value


@dataclass(frozen=True)
class UniqueKey:
    table: str
    lookup: str
    value: object


@dataclass
class Client:
    """Reads and writes one workspace. Rows are dicts; integers come back as ints."""

    root: str
    workspace: str
    schema_path: str
    command: list[str] = field(default_factory=lambda: [sys.executable, "-m", "logloom"])

    def __post_init__(self):
        self.schema = parse_schema(Path(self.schema_path).read_text(encoding="utf-8"))

    def invoke(self, **operation):
        request = json.dumps({"schema_hash": self.schema.declared_hash(), **operation})
        args = [*self.command, "bridge", "--root", self.root, "--workspace", self.workspace, "--schema", self.schema_path]
        try:
            done = subprocess.run(args, input=request, capture_output=True, text=True, check=False)
        except OSError as e:
            raise ClientError("bridge_failed", str(e)) from None
        if done.returncode:
            raise ClientError("bridge_failed", done.stderr.strip() or f"the bridge exited with code {done.returncode}")
        try:
            told = json.loads(done.stdout)
        except ValueError:
            raise ClientError("invalid_response", "the bridge returned invalid JSON") from None
        if not told["ok"]:
            raise ClientError(told["error"]["code"], told["error"]["message"])
        return told["result"]

    def _sent(self, table: str, row: dict) -> dict:
        kinds = self.schema.table(table).fields
        return {f: str(int64(v)) if kinds.get(f) == "int" and isinstance(v, int) and not isinstance(v, bool) else v for f, v in row.items()}

    def _got(self, table: str, row: dict | None) -> dict | None:
        kinds = self.schema.table(table).fields
        return row and {f: int(v) if kinds[f] == "int" else v for f, v in row.items()}

    def _target(self, table: str, key: UniqueKey) -> dict:
        if key.table != table:
            raise ClientError("invalid_target", f"key for table {key.table} cannot target table {table}")
        return {"lookup": key.lookup, "key": self._sent(table, {key.lookup: key.value})[key.lookup]}

    def init(self) -> None:
        self.invoke(op="init")

    def get(self, key: UniqueKey) -> dict | None:
        return self._got(key.table, self.invoke(op="get", table=key.table, **self._target(key.table, key)))

    def find(self, table: str, lookup: str, value: object, limit: int | None = None, cursor: str | None = None) -> tuple[list[dict], str | None]:
        page = self.invoke(op="find", table=table, lookup=lookup, key=self._sent(table, {lookup: value})[lookup], limit=limit, cursor=cursor)
        return [self._got(table, r) for r in page["rows"]], page["next_cursor"]

    def scan(self, table: str, limit: int | None = None, cursor: str | None = None) -> tuple[list[dict], str | None]:
        page = self.invoke(op="scan", table=table, limit=limit, cursor=cursor)
        return [self._got(table, r) for r in page["rows"]], page["next_cursor"]

    def count(self, table: str) -> int:
        return int(self.invoke(op="count", table=table))

    def add(self, table: str, row: dict) -> dict:
        return self.invoke(op="add", table=table, row=self._sent(table, row))

    def set(self, table: str, row: dict) -> dict:
        return self.invoke(op="set", table=table, row=self._sent(table, row))

    def edit(self, table: str, key: UniqueKey, patch: dict) -> dict:
        return self.invoke(op="edit", table=table, **self._target(table, key), patch=self._sent(table, patch))

    def remove(self, table: str, key: UniqueKey) -> dict:
        return self.invoke(op="remove", table=table, **self._target(table, key))
