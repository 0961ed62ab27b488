"""Files in a folder that the driver and all executors share, through the Hadoop file systems of the session."""

from __future__ import annotations

import os
import tempfile
import uuid
from urllib.parse import urlparse

from pyspark.sql import SparkSession

from .. import errors as E


def local_path(path: str) -> str | None:
    """The path in the driver's file system, if it is one of that."""
    url = urlparse(path)
    return url.path if url.scheme in ("", "file") else None


def scratch(spark: SparkSession) -> str:
    """The folder that the driver and all executors share; where none is set, a new local one in local mode."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise E.InvalidInput("spark.checkpoint.dir must name a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="logloom-")
    return folder.rstrip("/")


#: File systems whose rename is one step that fails where the target is. Object stores' are not of this kind.
ATOMIC_RENAME = frozenset({"hdfs", "viewfs", "webhdfs", "swebhdfs", "ofs", "maprfs"})


class Files:
    """The few file operations that the commit protocol needs."""

    def __init__(self, spark: SparkSession):
        self.jvm, self.conf = spark._jvm, spark._jsc.hadoopConfiguration()

    def _at(self, path: str):
        p = self.jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.conf), p

    def names(self, folder: str) -> list[str]:
        fs, p = self._at(folder)
        return sorted(s.getPath().getName() for s in fs.listStatus(p)) if fs.exists(p) else []

    def exists(self, path: str) -> bool:
        fs, p = self._at(path)
        return fs.exists(p)

    def read(self, path: str) -> str:
        fs, p = self._at(path)
        stream = fs.open(p)
        try:
            return self.jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def publish(self, path: str, text: str) -> None:
        """Creates the file with its whole text, or raises CommitConflict if there is one."""
        if local := local_path(path):
            os.makedirs(os.path.dirname(local), exist_ok=True)
            temporary = f"{os.path.dirname(local)}/.{uuid.uuid4().hex}"
            with open(temporary, "w", encoding="utf-8") as f:
                f.write(text)
                f.flush()
                os.fsync(f.fileno())
            try:
                os.link(temporary, local)
            except FileExistsError:
                raise E.CommitConflict(path) from None
            finally:
                os.unlink(temporary)
            return
        fs, p = self._at(path)
        scheme = fs.getUri().getScheme()
        if scheme not in ATOMIC_RENAME:
            raise E.InvalidInput(f"`{scheme}` cannot publish a version in one step; keep the database on one of {sorted(ATOMIC_RENAME)} or a local path")
        temporary = self.jvm.org.apache.hadoop.fs.Path(p.getParent(), f".{uuid.uuid4().hex}")
        out = fs.create(temporary, False)
        try:
            out.write(bytearray(text.encode()))
            out.hsync()
        finally:
            out.close()
        if not fs.rename(temporary, p):  # there is one already
            fs.delete(temporary, False)
            raise E.CommitConflict(path)

    def sizes(self, folder: str) -> dict[str, int]:
        """Files of a folder and their lengths."""
        fs, p = self._at(folder)
        return {s.getPath().getName(): s.getLen() for s in fs.listStatus(p)} if fs.exists(p) else {}

    def modified(self, path: str) -> float:
        fs, p = self._at(path)
        return fs.getFileStatus(p).getModificationTime() / 1000

    def move(self, source: str, target: str) -> None:
        fs, p = self._at(source)
        to = self._at(target)[1]
        fs.mkdirs(to.getParent())
        if fs.exists(to) or not fs.rename(p, to):
            raise E.InvalidInput(f"{target} is there already")

    def delete(self, path: str) -> None:
        fs, p = self._at(path)
        fs.delete(p, True)
