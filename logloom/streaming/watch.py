"""Change feeds over a database's versions, by Structured Streaming.

The stream is that of the manifests, one for each version, so what a failed batch or a losing writer left behind is
never seen. watch() evaluates a plan on new versions; changes() passes on each version's new operations, which
compaction and snapshots have none of; feed() writes them where a stream of operations can be read from."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.query import StreamingQuery

from ..api import Database
from ..operators.batch import op_schema
from ..operators.store import State
from ..plans.request import Plan, compile_read, table_of
from ..schema import TableSchema


def versions(spark: SparkSession, database: Database) -> DataFrame:
    """A stream of (version, next_tx), a row for each manifest as it appears."""
    rows = spark.readStream.schema("version long, next_tx long").option("pathGlobFilter", "*.json").json(f"{database.store_root}/commit-log")
    return rows


def watch(database: Database, plan: Plan, on_change: Callable[[int, DataFrame], None], checkpoint: str, trigger: dict | None = None) -> StreamingQuery:
    """Calls on_change(version, rows of the plan) for the newest version of each micro-batch."""
    table = table_of(database.schema, plan)

    def each(batch: DataFrame, _: int) -> None:
        newest = batch.agg(F.max("version")).first()[0]
        if newest is not None:
            on_change(newest, compile_read(plan, database.schema, database.live(table.name, newest)))

    return versions(database.spark, database).writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def new_logs(before: State, after: State, table: TableSchema) -> list[str]:
    """The logs that a version adds to a table. A version that replaces them (compaction) adds none."""
    old = before.tables[table.name].logs if table.name in before.tables else []
    new = after.tables[table.name].logs if table.name in after.tables else []
    return new[len(old) :] if new[: len(old)] == old else []


def changes(database: Database, name: str, on_change: Callable[[int, DataFrame], None], checkpoint: str, trigger: dict | None = None) -> StreamingQuery:
    """Calls on_change(version, operations) for each version that has operations of the table, in the versions' order.
    After a failure the versions of the last micro-batch may come again."""
    table, store = database.schema.table(name), database.store

    def each(batch: DataFrame, _: int) -> None:
        seen = sorted(r.version for r in batch.select("version").collect())  # a number for each manifest of the batch
        known = set(store.versions()) if seen else set()
        for version in seen:
            before = store.state(version - 1) if version - 1 in known else State()
            if logs := new_logs(before, store.state(version), table):
                on_change(version, database.spark.read.schema(op_schema(table)).parquet(*(f"{store.root}/{p}" for p in logs)))

    return versions(database.spark, database).writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def feed(database: Database, name: str, folder: str, checkpoint: str, trigger: dict | None = None) -> StreamingQuery:
    """Writes each version's operations to folder/version=N, over what a repeated micro-batch wrote there: a feed
    without repeats, which operations() reads."""
    write = lambda version, ops: ops.write.mode("overwrite").parquet(f"{folder}/version={version}")
    return changes(database, name, write, checkpoint, trigger)


def operations(spark: SparkSession, folder: str, table: TableSchema) -> DataFrame:
    """A stream of the operations (tx_id, op, fields, version) of a feed."""
    schema = T.StructType([*op_schema(table).fields, T.StructField("version", T.LongType())])
    return spark.readStream.schema(schema).parquet(folder)


def live_stream(ops: DataFrame, table: TableSchema) -> DataFrame:
    """The newest operation of each id of a stream of operations, to be written in update mode; a `D` row says that
    the id is gone. State grows with the number of ids, as the live table does."""
    newest = F.max(F.struct("tx_id", "op", *(f for f in table.fields if f != "id"))).alias("last")
    return ops.groupBy("id").agg(newest).select("id", "last.*")
