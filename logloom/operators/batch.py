"""Resolves a batch of changes against the live table by joins, and checks the state it leads to.

changes: (seq, kind, lookup, key, fields): kind is insert, upsert, patch or remove; seq is unique; a patch's fields are
null where it leaves the row as it is, which is no ambiguity, as rows have no nulls. Every change sees the table as it
was before the batch. Nothing is brought to the driver but the first violation."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import errors as E
from ..functions.text import escape
from ..functions.values import text_of
from ..schema import TableSchema

INSERT, UPSERT, PATCH, REMOVE, TOMBSTONE = "insert", "upsert", "patch", "remove", "tombstone"


def change_schema(table: TableSchema) -> T.StructType:
    head = [T.StructField("seq", T.LongType()), T.StructField("kind", T.StringType()), T.StructField("lookup", T.StringType()), T.StructField("key", T.StringType())]
    return T.StructType(head + list(table.struct(nullable=True).fields))


def op_schema(table: TableSchema) -> T.StructType:
    return T.StructType([T.StructField("tx_id", T.LongType()), T.StructField("op", T.StringType()), *table.struct(nullable=True).fields])


def targets(changes: DataFrame, live: DataFrame, table: TableSchema) -> DataFrame:
    """(seq, and the live row's fields as cur_<field>) of the changes that name a row by a unique lookup."""
    found = []
    for lookup in ["id", *table.unique_lookups]:
        named = changes.where(F.col("kind").isin(PATCH, REMOVE) & (F.col("lookup") == lookup)).select("seq", F.col("key").alias("_key"))
        rows = live.select(text_of(F.col(lookup), table.fields[lookup]).alias("_key"), *(F.col(f).alias(f"cur_{f}") for f in table.fields))
        found.append(named.join(rows, "_key").drop("_key"))
    return reduce(DataFrame.unionByName, found)


def resolve(changes: DataFrame, live: DataFrame, table: TableSchema) -> DataFrame:
    """(seq, kind, op, fields): the operations that the changes stand for. A patch is a whole row, a removal an id."""
    fields = list(table.fields)
    whole = changes.where(F.col("kind").isin(INSERT, UPSERT)).select("seq", "kind", F.lit("R").alias("op"), *fields)
    gone = changes.where(F.col("kind") == TOMBSTONE).select("seq", "kind", F.lit("D").alias("op"), "id", *(F.lit(None).cast(f.dataType).alias(f.name) for f in table.struct().fields if f.name != "id"))
    met = changes.where(F.col("kind").isin(PATCH, REMOVE)).join(targets(changes, live, table), "seq")

    def cell(f: str) -> Column:
        if f == "id":
            return F.col("cur_id").alias("id")
        return F.when(F.col("kind") == PATCH, F.coalesce(F.col(f), F.col(f"cur_{f}"))).alias(f)

    keyed = met.select("seq", "kind", F.when(F.col("kind") == PATCH, "R").otherwise("D").alias("op"), *(cell(f) for f in fields))
    return whole.unionByName(gone.select("seq", "kind", "op", *fields)).unionByName(keyed)


def final_state(ops: DataFrame, live: DataFrame, table: TableSchema) -> DataFrame:
    """The live table after the operations of one batch."""
    untouched = live.join(ops.select("id").distinct(), "id", "left_anti")
    return untouched.select(*table.fields).unionByName(ops.where("op = 'R'").select(*table.fields))


def violations(changes: DataFrame, ops: DataFrame, live: DataFrame, table: TableSchema) -> DataFrame:
    """(stage, seq, code, message) of all that forbids the batch. The least stage and seq is what is reported."""

    def say(rows: DataFrame, stage: int, code: str, message: Column) -> DataFrame:
        return rows.select(F.lit(stage).alias("stage"), "seq", F.lit(code).alias("code"), message.alias("message"))

    text = lambda *parts: F.concat(*(F.lit(p) if isinstance(p, str) else p for p in parts))
    keyed = changes.where(F.col("kind").isin(PATCH, REMOVE))
    missing = keyed.join(ops.select("seq"), "seq", "left_anti")
    out = [say(missing, 1, "not_found", text(f"row not found in `{table.name}` for unique lookup `", F.col("lookup"), "`"))]
    puts = ops.where("op = 'R'")
    lacking = F.coalesce(*(F.when(F.col(f).isNull(), F.lit(f)) for f in table.fields))
    out.append(say(puts.where(lacking.isNotNull()), 2, "missing_field", lacking))
    exists = ops.where(F.col("kind") == INSERT).join(live.select("id"), "id", "left_semi")
    out.append(say(exists, 3, "already_exists", text("row `", F.col("id"), f"` already exists in `{table.name}`")))
    twice = ops.groupBy("id").agg(F.max("seq").alias("seq"), F.count(F.lit(1)).alias("n")).where("n > 1")
    out.append(say(twice, 4, "invalid_plan", text("write_many touches row `", F.col("id"), "` more than once")))
    for u in table.unique_lookups:  # keys are equal as their texts are
        key = text_of(F.col(u), table.fields[u]).alias("_key")
        keys = puts.select("seq", key).groupBy("_key").agg(F.min("seq").alias("seq"), F.count(F.lit(1)).alias("n"))
        out.append(say(keys.where("n > 1"), 5, "already_exists", F.lit(f"unique lookup `{u}` key is used by multiple rows in one batch")))
        others = live.join(ops.select("id").distinct(), "id", "left_anti").select(key, F.col("id").alias("_other"))
        used = keys.join(others, "_key")
        out.append(say(used, 5, "already_exists", text(f"unique lookup `{u}` key `", F.col("_key"), "` is already used by row `", F.col("_other"), "`")))
    return reduce(DataFrame.unionByName, out)


def raise_first(found: DataFrame, table: TableSchema) -> None:
    """Raises the first violation, if there is one."""
    first = found.orderBy("stage", "seq").limit(1).collect()
    if first:
        raise_violation(first[0].code, first[0].message, table)


def raise_violation(code: str, message: str, table: TableSchema) -> None:
    if code == "missing_field":
        raise E.MissingField(table.name, message)
    raise {"not_found": E.NotFound, "already_exists": E.AlreadyExists, "invalid_plan": E.InvalidPlan}[code](message)


def line_bytes(ops: DataFrame, table: TableSchema, tx: Column) -> Column:
    """The length in bytes of an operation's line in the text log, its end included."""
    puts = [F.octet_length(escape(text_of(F.col(f), k))) + 1 for f, k in table.fields.items()]
    head = F.length(tx.cast("string")) + 2
    return head + F.when(F.col("op") == "R", reduce(lambda a, b: a + b, puts)).otherwise(F.octet_length(escape(F.col("id"))) + 1) + 1
