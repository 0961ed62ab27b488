"""Import and export of the text log: segments of one line per operation, with a preamble of the table's schema.

A segment is `SIX 1 table <name> <hash>`, `@field` and `@lookup` lines, `@data`, then `R <tx> <values>` or `D <tx> <id>`
lines, all tab-separated. Segments are numbered down in base 36, so the oldest is zzz. The log's order is the segments'
from the oldest on, and the lines' in them. Old segments have no preamble, or one line of the fields' names, and lines
without tag. Reading is done whole segment by whole segment (they are about 1 MiB by design), which gives exact line
numbers and shows an unterminated tail."""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterable
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import errors as E
from ..functions.text import escape, let, name_of, parse
from ..functions.values import text_of
from ..schema import KINDS, TableSchema, fnv1a
from .shared import Files

# Fixed values of the format.
MAGIC, VERSION, SUFFIX, SEGMENT_BYTES = "SIX", 1, ".6", 1 << 20
MOVES = 16  # files that the driver names at a time


def preamble(table: TableSchema, schema_hash: str) -> str:
    others = sorted(f for f in table.lookups if f != "id")
    lines = [f"{MAGIC}\t{VERSION}\ttable\t{table.name}\t{schema_hash}"]
    lines += [f"@field\t{f}\t{k}" for f, k in table.fields.items()]
    lines += ["@lookup\tid\tunique"] + [f"@lookup\t{f}\t{'unique' if table.lookups[f] else 'many'}" for f in others]
    return "\n".join([*lines, "@data", ""])


def check_preamble(text: str, table: TableSchema) -> None:
    """A text that begins as a preamble must be the table's own but for the hash, which must be 16 hex digits, so a
    database may gain tables. Other texts are of old segments."""
    want = preamble(table, "0" * 16).split("\n")[:-1]
    got = [line.removesuffix("\r") for line in text.split("\n")[: len(want)]]
    if not got[0].startswith((f"{MAGIC}\t", "@")):
        return
    head, _, stored = got[0].rpartition("\t")
    if head != want[0].rpartition("\t")[0] or not re.fullmatch("[0-9a-fA-F]{16}", stored) or got[1:] != want[1:]:
        raise E.BadMagic(got[0])


def _foreign(head: Column, table: TableSchema) -> Column:
    """Whether check_preamble would refuse a text of the preamble's lines."""
    first, *others = preamble(table, "").split("\n")[:-1]
    own = "\r?\n".join([f"{re.escape(first)}[0-9a-fA-F]{{16}}", *map(re.escape, others)])
    return (F.startswith(head, F.lit(f"{MAGIC}\t")) | F.startswith(head, F.lit("@"))) & ~head.rlike(rf"\A{own}\r?\z")


def encode(ops: DataFrame, table: TableSchema, keep: tuple[str, ...] = ()) -> DataFrame:
    """ops (tx_id, op, fields) as lines, with the columns `keep`."""
    values = [escape(text_of(F.col(f), k)) for f, k in table.fields.items()]
    row = F.concat_ws("\t", F.lit("R"), F.col("tx_id").cast("string"), *values)
    gone = F.concat_ws("\t", F.lit("D"), F.col("tx_id").cast("string"), escape(F.col("id")))
    return ops.select(*keep, F.when(F.col("op") == "R", row).otherwise(gone).alias("line"))


def decode(lines: DataFrame, table: TableSchema, keep: tuple[str, ...] = ()) -> DataFrame:
    """Lines as (keep, tx_id, op, fields, problem); problem is null for a sound line, else it is the error's text. A
    line that does not begin as an operation is a put of transaction 0, as old logs have them."""
    fields = table.struct().fields

    def tagged(parts: Column) -> Column:
        tag, tx = F.get(parts, F.lit(0)), F.get(parts, F.lit(1))
        has = tag.isin("R", "D") & (F.size(parts) >= 2)  # a torn operation is no old row
        number = F.when(~has, F.lit(0).cast("long")).when(tx.rlike(r"\A\+?[0-9]+\z"), tx.try_cast("bigint"))
        return F.struct(number.alias("tx_id"), F.when(has, tag).otherwise("R").alias("op"), F.when(has, F.slice(parts, F.lit(3), F.size(parts))).otherwise(parts).alias("values"), F.when(has & (F.size(parts) < 3), F.lit(True)).otherwise(False).alias("torn"))

    def typed(x: Column) -> Column:
        put = x["op"] == "R"
        cells = [F.when(put | F.lit(f.name == "id"), parse(F.get(x["values"], F.lit(i) if f.name != "id" else F.when(put, F.lit(i)).otherwise(F.lit(0))), f.metadata["kind"])).cast(f.dataType).alias(f.name) for i, f in enumerate(fields)]
        return F.struct(x["tx_id"].alias("tx_id"), x["op"].alias("op"), F.size(x["values"]).alias("n"), x["torn"].alias("torn"), *cells)

    def judged(x: Column) -> Column:
        want = F.when(x["op"] == "R", F.lit(len(fields))).otherwise(F.lit(1))
        count = lambda expected, found: F.concat(F.lit(".6 row column count mismatch: expected "), expected.cast("string"), F.lit(", found "), found.cast("string"))
        bad = F.when(x["torn"], count(F.lit(3), F.lit(2))).when(x["tx_id"].isNull(), ".6 row has invalid tx id").when(x["n"] != want, count(want, x["n"]))
        for f in fields:
            bad = bad.when(((x["op"] == "R") | F.lit(f.name == "id")) & x[f.name].isNull(), f".6 field `{f.name}` is no {f.metadata['kind']} or has a bad escape")
        return F.struct(*(x[c].alias(c) for c in ("tx_id", "op", *table.fields)), bad.alias("problem"))

    # Each step is bound to a variable, so that a predicate on the outcome does not repeat them for each field.
    row = let(let(let(F.split("line", "\t", -1), tagged), typed), judged)
    return lines.select(*keep, row.alias("_row")).select(*keep, "_row.*")


def read_segments(spark: SparkSession, folder: str, table: TableSchema, mode: str = "strict") -> DataFrame:
    """The operations in a folder's segments: (chunk, pos, tx_id, op, fields). The last operation of an id is that of
    the smallest chunk name, and in it the largest pos.

    mode: `strict` fails on an unterminated last line, `recover` leaves it out. A malformed complete line fails when
    it is read, in either mode."""
    files = Files(spark)
    names = [n for n in files.names(folder) if n.endswith(SUFFIX)]
    schema = T.StructType([T.StructField("chunk", T.StringType()), T.StructField("pos", T.LongType()), T.StructField("tx_id", T.LongType()), T.StructField("op", T.StringType()), *table.struct(nullable=True).fields])
    if not names:
        return spark.createDataFrame([], schema)
    whole = _whole(spark, folder)
    headless = len(preamble(table, "0" * 16).split("\n")) - 1
    heads = whole.select("chunk", F.substring_index("value", "\n", headless).alias("head"), (~F.endswith("value", F.lit("\n")) & (F.length("value") > 0)).alias("torn"))
    bad = _foreign(F.col("head"), table) if mode == "recover" else _foreign(F.col("head"), table) | F.col("torn")
    for r in heads.where(bad).orderBy(F.desc("chunk")).limit(1).collect():  # the oldest that is not sound
        check_preamble(r.head, table)
        raise E.CorruptData(f"incomplete tail in segment {r.chunk}")
    sound = decode(_lines(whole, table), table, ("chunk", "pos"))
    checked = F.when(F.col("problem").isNotNull(), F.raise_error(F.concat(F.lit("malformed line in segment "), F.col("chunk"), F.lit(": "), F.col("problem")))).otherwise(F.col("op"))
    return sound.select("chunk", F.col("pos").cast("long").alias("pos"), "tx_id", checked.alias("op"), *table.fields)


def _whole(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.text(f"{folder}/*{SUFFIX}", wholetext=True).select(F.regexp_replace(F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1), r"\.6$", "").alias("chunk"), "value")


def _lines(whole: DataFrame, table: TableSchema) -> DataFrame:
    """(chunk, pos, raw, line) of the operations' lines: complete ones that are not empty, no preamble's and no header.
    line is raw without its carriage returns at the end."""
    tail = F.substring_index("value", "\n", -1)
    complete = F.left("value", F.length("value") - F.length(tail))
    lines = whole.select("chunk", F.posexplode_outer(F.split(complete, "\n", -1)).alias("pos", "line"))  # not outer, a segment is split again for an inferred filter
    line = F.col("line")
    bare = F.when(F.endswith(line, F.lit("\r")), F.regexp_replace(line, r"\r+\z", "")).otherwise(line)
    return lines.select("chunk", "pos", line.alias("raw"), bare.alias("line")).where((line != "") & ~F.startswith(line, F.lit(f"{MAGIC}\t")) & ~F.startswith(line, F.lit("@")) & (line != "\t".join(table.fields)))


def raw_lines(spark: SparkSession, folder: str, table: TableSchema) -> DataFrame:
    """(chunk, pos, line) of a folder's operations as they are written, from the oldest segment on."""
    return _lines(_whole(spark, folder), table).select("chunk", "pos", F.col("raw").alias("line")).orderBy(F.desc("chunk"), "pos")


def source_hash(lines: Iterable[tuple[str, str]]) -> str:
    """The hash that an index is current by: of each operation's segment name, a zero byte and its line with its end.
    lines: (chunk, line) in the log's order. Each step needs the one before, so this is for interchange only."""
    return fnv1a(f"{chunk}\0{line}\n".encode() for chunk, line in lines)


def write_segments(ops: DataFrame, folder: str, table: TableSchema, schema_hash: str, segment_bytes: int = SEGMENT_BYTES) -> int:
    """Writes ops (tx_id, op, fields) in the order of tx_id as segments; returns how many. Operations are dealt into
    ranges, as many as their bytes need, and each range's lines are cut into segments by their running size; a line
    never spans two. The tasks write the segments' texts by range and place, the driver only numbers and names the
    files."""
    spark = ops.sparkSession
    head = preamble(table, schema_hash)
    ranged = ops.repartitionByRange("tx_id").withColumn("task", F.spark_partition_id())
    lines = encode(ranged, table, ("task", "tx_id")).withColumn("size", F.octet_length("line") + 1)
    own = Window.partitionBy("task").orderBy("tx_id").rowsBetween(Window.unboundedPreceding, 0)
    cut = lines.withColumn("local", F.floor((F.sum("size").over(own) - 1) / (segment_bytes - len(head.encode()))))
    ordered = F.sort_array(F.collect_list(F.struct("tx_id", "line")))["line"]
    body = cut.groupBy("task", "local").agg(F.array_join(ordered, "\n").alias("body"))  # about 1 MiB each
    files, work = Files(spark), f"{folder.rstrip('/')}/.writing-{uuid.uuid4().hex}"

    def move(part: str, number: int) -> None:
        (written,) = [f for f in files.names(f"{work}/{part}") if f.startswith("part-")]
        files.move(f"{work}/{part}/{written}", f"{folder.rstrip('/')}/{name_of(number)}{SUFFIX}")

    try:
        body.select(F.concat_ws("-", "task", "local").alias("place"), F.concat(F.lit(head), "body").alias("value")).write.partitionBy("place").text(work)
        parts = [p for p in files.names(work) if p.startswith("place=")]
        parts.sort(key=lambda p: [int(n) for n in p.removeprefix("place=").split("-")])
        if len(parts) > 36**3:
            raise E.InvalidInput("more segments than names")
        with ThreadPoolExecutor(MOVES) as pool:
            list(pool.map(move, parts, range(len(parts))))
        return len(parts)
    finally:
        files.delete(work)


def read_jsonl(spark: SparkSession, path: str, table: TableSchema) -> DataFrame:
    """The old JSON log: lines of {_v, _tx, _op, _ts, table, data}; (tx_id, op, fields) of the table's lines."""
    data = ", ".join(f"`{f}`: {KINDS[k].simpleString()}" for f, k in table.fields.items())
    rows = spark.read.schema(f"_v int, _tx long, _op string, _ts string, `table` string, data struct<{data}>").option("mode", "FAILFAST").json(path)
    op = F.when(F.lower("_op").isin("delete", "d"), "D").otherwise("R")
    return rows.where(F.col("table") == table.name).select(F.col("_tx").alias("tx_id"), op.alias("op"), *(F.col(f"data.{f}").alias(f) for f in table.fields))
