"""Plans: value objects of the eight operations, and the DataFrames that the reading ones become."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field, replace
from enum import Enum

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import errors as E
from ..functions.values import equals, key_text
from ..operators.replay import numbered
from ..schema import DatabaseSchema, TableSchema

# The limits of a page.
DEFAULT_LIMIT, MAX_LIMIT = 100, 1000
#: Pages that begin further on are found by their rows' numbers.
DEEP = 100_000


class Op(str, Enum):
    INSERT, UPSERT, PATCH, REMOVE, GET, FIND, SCAN, COUNT = "insert", "upsert", "patch", "remove", "get", "find", "scan", "count"


@dataclass(frozen=True)
class Plan:
    op: Op
    table: str
    lookup: str | None = None
    key: object = None
    value: dict[str, object] = field(default_factory=dict)
    limit: int | None = None
    cursor: str | None = None

    def with_lookup(self, lookup: str) -> Plan:
        return replace(self, lookup=lookup)

    def with_key(self, key: object) -> Plan:
        return replace(self, key=key)

    def with_value(self, name: str, value: object) -> Plan:
        return replace(self, value=self.value | {name: value})

    def with_values(self, values: dict[str, object]) -> Plan:
        return replace(self, value=self.value | values)

    def with_limit(self, limit: int) -> Plan:
        return replace(self, limit=limit)

    def with_cursor(self, cursor: str | None) -> Plan:
        return replace(self, cursor=cursor)

    page = with_limit


@dataclass
class Page:
    """Rows in the order of id, and the cursor of the next page if there is one."""

    rows: list[dict[str, object]]
    next_cursor: str | None = None

    def __iter__(self) -> Iterator[dict[str, object]]:
        return iter(self.rows)

    def __len__(self) -> int:
        return len(self.rows)


class selector:
    """Builders of reading plans."""

    @staticmethod
    def id(table: str, key: str) -> Plan:
        return Plan(Op.GET, table, "id", key)

    @staticmethod
    def one(table: str, lookup: str, key: object) -> Plan:
        return Plan(Op.GET, table, lookup, key)

    @staticmethod
    def many(table: str, lookup: str, key: object) -> Plan:
        return Plan(Op.FIND, table, lookup, key, limit=MAX_LIMIT)

    @staticmethod
    def all(table: str) -> Plan:
        return Plan(Op.SCAN, table)

    @staticmethod
    def count(table: str, lookup: str | None = None, key: object = None) -> Plan:
        return Plan(Op.COUNT, table, lookup, key)


class change:
    """Builders of writing plans."""

    @staticmethod
    def add(table: str, row: dict[str, object]) -> Plan:
        return Plan(Op.INSERT, table, value=row)

    @staticmethod
    def set(table: str, row: dict[str, object]) -> Plan:
        return Plan(Op.UPSERT, table, value=row)

    @staticmethod
    def edit(table: str, lookup: str, key: object, values: dict[str, object]) -> Plan:
        return Plan(Op.PATCH, table, lookup, key, values)

    @staticmethod
    def edit_id(table: str, key: str, values: dict[str, object]) -> Plan:
        return Plan(Op.PATCH, table, "id", key, values)

    @staticmethod
    def remove(table: str, lookup: str, key: object) -> Plan:
        return Plan(Op.REMOVE, table, lookup, key)

    @staticmethod
    def remove_id(table: str, key: str) -> Plan:
        return Plan(Op.REMOVE, table, "id", key)


def table_of(schema: DatabaseSchema, plan: Plan) -> TableSchema:
    if plan.table not in schema.tables:
        raise E.InvalidPlan(f"unknown table `{plan.table}`")
    return schema.tables[plan.table]


def limit_of(plan: Plan) -> int:
    limit = DEFAULT_LIMIT if plan.limit is None else plan.limit
    if not 1 <= limit <= MAX_LIMIT:
        raise E.InvalidPlan(f"limit must be between 1 and {MAX_LIMIT}")
    return limit


def offset_of(plan: Plan) -> int:
    text = plan.cursor or "0"
    if not (text.isascii() and text.removeprefix("+").isdigit()) or int(text) >= 2**64:
        raise E.InvalidPlan(f"invalid cursor: {plan.cursor}")
    return int(text)


def key_of(table: TableSchema, plan: Plan, unique: bool = False) -> tuple[str, str]:
    """The lookup and the key's text, checked."""
    if plan.lookup is None:
        raise E.InvalidPlan("plan missing lookup")
    if not table.is_lookup(plan.lookup):
        raise E.UnknownLookup(f"unknown lookup `{plan.lookup}` for table `{table.name}`")
    if unique and not table.is_unique(plan.lookup):
        raise E.InvalidPlan(f"lookup `{plan.lookup}` for table `{table.name}` is not unique")
    if plan.key is None:
        raise E.InvalidPlan(f"plan missing key `{plan.lookup}`")
    return plan.lookup, key_text(plan.key)


def matching(rows: DataFrame, table: TableSchema, lookup: str, key: str) -> DataFrame:
    return rows.where(equals(F.col(lookup), table.fields[lookup], key))


def compile_read(plan: Plan, schema: DatabaseSchema, rows: DataFrame, more: int = 0) -> DataFrame:
    """A reading plan over the live rows as a lazy DataFrame. more: rows beyond the page, to see if there are any."""
    table = table_of(schema, plan)
    fields = list(table.fields)
    if plan.op is Op.GET:
        return matching(rows, table, *key_of(table, plan, unique=True)).select(*fields).limit(1)
    if plan.op is Op.COUNT:
        if plan.lookup is not None:
            rows = matching(rows, table, *key_of(table, plan))
        return rows.agg(F.count(F.lit(1)).alias("n"))
    if plan.op is Op.FIND:
        rows = matching(rows, table, *key_of(table, plan))
    elif plan.op is not Op.SCAN:
        raise E.InvalidPlan(f"{plan.op.value} is no reading plan")
    limit, offset = limit_of(plan), offset_of(plan)
    rows = rows.select(*fields)
    if offset <= DEEP:
        return rows.orderBy("id").offset(offset).limit(limit + more)
    return numbered_page(rows, offset, limit + more)


def numbered_page(rows: DataFrame, offset: int, limit: int) -> DataFrame:
    """A page by its rows' numbers. Without them the rows before a page would come to the driver to be dropped."""
    told = numbered(rows, ["id"], "_nth")
    page = told.where((F.col("_nth") >= offset) & (F.col("_nth") < offset + limit)).drop("_nth").orderBy("id")
    page.release = told.release
    return page


def page_of(plan: Plan, schema: DatabaseSchema, rows: DataFrame) -> Page:
    page = compile_read(plan, schema, rows, more=1)
    got = [r.asDict() for r in page.collect()]  # a page at most
    if hasattr(page, "release"):
        page.release()
    limit = limit_of(plan)
    return Page(got[:limit], str(offset_of(plan) + limit) if len(got) > limit else None)
