"""What the operators of this subpackage share: shared-folder tables, text batches, the word rule."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def ship(spark: SparkSession) -> None:
    """Sends this package to the executors, once a session, for tasks that cannot import it from a path of theirs."""
    context = spark.sparkContext
    if getattr(context, "_logloom_shipped", False):
        return
    package = Path(__file__).resolve().parents[1]
    archive = Path(tempfile.mkdtemp(prefix="logloom-package-")) / "logloom-package.zip"
    with zipfile.ZipFile(archive, "w") as z:
        for source in sorted(package.rglob("*.py")):
            z.write(source, source.relative_to(package.parent))
    context.addPyFile(str(archive))
    context._logloom_shipped = True


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share. Where none is set, a new local one in local mode; on a
    cluster that is an error, as executors do not see each other's folders."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        held = spark.sparkContext._jsc.sc().getCheckpointDir()
        if held.isDefined():
            return held.get()
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="logloom-")
        spark.sparkContext.setCheckpointDir(folder)
        return spark.sparkContext._jsc.sc().getCheckpointDir().get()
    return folder


def _files(df: DataFrame, path: str):
    at = df.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()), at


def materialize(df: DataFrame, label: str, compression: str | None = None) -> DataFrame:
    """df as a Parquet table in the shared folder: it cuts the lineage and survives the loss of executors. The table
    is deleted when the application ends, if not before."""
    path = f"{shared_dir(df.sparkSession).rstrip('/')}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path, compression=compression)
    fs, at = _files(df, path)
    fs.deleteOnExit(at)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.table_path = path
    return out


def discard(df: DataFrame) -> None:
    """Deletes the files of a table that materialize() wrote and no later plan reads."""
    fs, at = _files(df, df.table_path)
    fs.delete(at, True)


def words_of(text: str) -> list[bytes]:
    """Runs of anything but the white space 0x20 and 0x09 to 0x0D, with A-Z and no other letter in lower case: what
    split() and lower() do to bytes."""
    return text.encode("utf-8", "surrogatepass").lower().split()


def slices(batches: Iterator[pa.RecordBatch], column: str, most: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """The batches in parts whose texts take about `most` bytes together, one row at least."""
    for batch in batches:
        sizes = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False))
        at = 0
        while at < batch.num_rows:
            base = sizes[at - 1] if at else 0
            end = max(at + 1, int(np.searchsorted(sizes, base + most)))
            yield batch.slice(at, end - at)
            at = end


def runs(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """The rows of each run of equal (integer, not null) keys, from batches in the keys' order. One run is held."""
    kept: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        cols = [batch.column(k).to_numpy(zero_copy_only=False) for k in keys]
        cut = np.zeros(batch.num_rows, bool)
        for c in cols:
            cut[1:] |= c[1:] != c[:-1]
        starts = [0, *np.flatnonzero(cut).tolist(), batch.num_rows]
        for at, end in zip(starts, starts[1:]):
            key = tuple(int(c[at]) for c in cols)
            if key != last and kept:
                yield pa.Table.from_batches(kept)
                kept = []
            last = key
            kept.append(batch.slice(at, end - at))
    if kept:
        yield pa.Table.from_batches(kept)


def larger(batches: Iterator[pa.RecordBatch], rows: int = 1 << 18) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of at least so many (but the last), for work whose cost is in the calls."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        held.append(batch)
        if sum(b.num_rows for b in held) >= rows:
            yield from pa.Table.from_batches(held).combine_chunks().to_batches()
            held = []
    if held:
        yield from pa.Table.from_batches(held).combine_chunks().to_batches()


def with_text(docs: DataFrame, id_col: str, text_col: str, *more: str) -> DataFrame:
    """Only the columns an operator needs; a null text is an empty one."""
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"), *more)


def unused(docs: DataFrame, name: str) -> str:
    """The name, or a longer one that no column of docs has."""
    taken = {c.lower() for c in docs.columns}
    while name.lower() in taken:
        name += "_"
    return name


def tasks_for(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
