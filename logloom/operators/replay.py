"""Replay of an operation log into the live table, and what is built on it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.values import text_of
from ..schema import TableSchema


def live(ops: DataFrame, fields: list[str], latest: list[Column] | None = None, key: str = "id") -> DataFrame:
    """The rows whose last operation is a put. latest: the log's order, latest first (by default tx_id, descending).

    A window's first row is planned as a partial and a final group limit, so one row per key and task is shuffled, and
    a predicate on the key goes below it; predicates on other fields stay above, where they belong."""
    order = latest or [F.desc("tx_id")]
    first = F.row_number().over(Window.partitionBy(key).orderBy(*order))
    return ops.withColumn("_nth", first).where((F.col("_nth") == 1) & (F.col("op") == "R")).select(*fields)


def live_from(snapshot: DataFrame, delta: DataFrame, fields: list[str], latest: list[Column] | None = None) -> DataFrame:
    """live() of snapshot and later operations: untouched rows of the snapshot and the delta's live rows."""
    touched = delta.select("id").distinct()
    return snapshot.select(*fields).join(touched, "id", "left_anti").unionByName(live(delta, fields, latest)).select(*fields)


def lookup_index(rows: DataFrame, table: TableSchema) -> DataFrame:
    """(field, key, id) of each lookup of each row, `id` included."""
    entries = [F.struct(F.lit(f).alias("field"), text_of(F.col(f), table.fields[f]).alias("key")) for f in ["id", *sorted(f for f in table.lookups if f != "id")]]
    return rows.select("id", F.explode(F.array(*entries)).alias("e")).select("e.field", "e.key", "id")


def unique_violations(rows: DataFrame, table: TableSchema) -> DataFrame:
    """(field, key, n): keys of unique lookups that several rows have."""
    index = lookup_index(rows, TableSchema(table.name, table.fields, {f: True for f in table.unique_lookups}))
    return index.where("field <> 'id'").groupBy("field", "key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def repeated(rows: DataFrame, key: str = "id") -> DataFrame:
    """(key, n) of the keys that occur more than once."""
    return rows.groupBy(key).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def numbered(rows: DataFrame, order: list[str], name: str, start: int = 0) -> DataFrame:
    """rows with consecutive numbers in an order, without a window over all rows: rows are dealt into ranges, ranges
    are counted (a row each comes to the driver), and numbers are a range's start, which is joined as a small table,
    and a count within it. The ranges are persisted, so that the numbers are those of the counted ranges; who has
    written the result may call its release()."""
    spark = rows.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranged = rows.repartitionByRange(n, *order).withColumn("_range", F.spark_partition_id()).persist()
    first, total = [], start
    for part, count in sorted((r[0], r[1]) for r in ranged.groupBy("_range").count().collect()):
        first.append((part, total))
        total += count
    starts = spark.createDataFrame(first, "_range int, _first long")  # a row for each range
    own = F.row_number().over(Window.partitionBy("_range").orderBy(*order))
    out = ranged.withColumn("_own", own).join(F.broadcast(starts), "_range").withColumn(name, F.col("_first") + F.col("_own") - 1).drop("_range", "_own", "_first")
    out.release = ranged.unpersist
    return out


def compacted(rows: DataFrame, fields: list[str], next_tx: int) -> DataFrame:
    """The live rows as puts with fresh transaction ids in the order of id: (tx_id, op, fields)."""
    fresh = numbered(rows, ["id"], "tx_id", next_tx)
    out = fresh.select("tx_id", F.lit("R").alias("op"), *fields)
    out.release = fresh.release
    return out
