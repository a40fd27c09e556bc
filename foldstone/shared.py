"""The folder that driver and executors share.

Intermediate tables, stream checkpoints and operator ledgers live under the folder that the
cluster names in ``spark.checkpoint.dir``. Only where that setting is absent (a local test
session) is a folder of this process used instead.
"""

from __future__ import annotations

import json
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_LOCAL: dict[str, str] = {}


def shared_root(spark: SparkSession) -> str:
    """The shared folder as a URI, and Spark's checkpoint folder set to it."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        root = _LOCAL.setdefault("root", "file://" + tempfile.mkdtemp(prefix="foldstone-"))
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(root)
    return root.rstrip("/")


def work_dir(spark: SparkSession, purpose: str) -> str:
    """A new folder name below the shared folder and the application's own; nothing is created yet."""
    return f"{shared_root(spark)}/{spark.sparkContext.applicationId}/{purpose}-{uuid.uuid4().hex}"


def clean(spark: SparkSession) -> None:
    """Delete all that this application wrote below the shared folder. Results that are read later are gone with it."""
    Folder(spark, shared_root(spark)).delete(spark.sparkContext.applicationId)


def materialize(df: DataFrame, purpose: str, partition_by: list[str] | None = None) -> DataFrame:
    """Write ``df`` to the shared folder and read it back, cutting its lineage durably."""
    spark = df.sparkSession
    path = work_dir(spark, purpose)
    writer = df.write
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: Schemes of file systems with an atomic rename that refuses an existing target, or (file) with hard links.
ATOMIC = {"file", "hdfs", "viewfs", "ofs", "abfs", "abfss"}


class Folder:
    """File operations on a shared folder through Hadoop's file system, so any scheme works."""

    def __init__(self, spark: SparkSession, path: str):
        self._jvm = spark.sparkContext._jvm
        self.path = path.rstrip("/")
        self._fs = self._path("").getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _path(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)

    def list(self, name: str = "") -> dict[str, int]:
        """Names and sizes of the direct children; empty when the folder is absent."""
        at = self._path(name)
        if not self._fs.exists(at):
            return {}
        return {s.getPath().getName(): s.getLen() for s in self._fs.listStatus(at)}

    def modified(self, name: str) -> float:
        """Time of the last change in seconds."""
        return self._fs.getFileStatus(self._path(name)).getModificationTime() / 1000

    def exists(self, name: str) -> bool:
        return self._fs.exists(self._path(name))

    def read(self, name: str) -> str:
        stream = self._fs.open(self._path(name))
        try:
            return self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def create(self, name: str, text: str) -> bool:
        """Create a file with all of its content, or return False if the name is taken.

        The content is complete before the name appears, and of several writers that want one
        name exactly one gets True: the temporary file is renamed, and Hadoop's rename refuses an
        existing target; on a local disk a hard link gives the same guarantee. File systems whose rename
        isn't atomic (object stores) are refused, as two writers could both win there.
        """
        if self._fs.getScheme() not in ATOMIC:
            raise NotImplementedError(f"{self._fs.getScheme()}: files can't be created exclusively there; use one of {sorted(ATOMIC)}")
        hidden = f"{name.rpartition('/')[0]}/.{uuid.uuid4().hex}.tmp".lstrip("/")
        out = self._fs.create(self._path(hidden), False)
        try:
            out.write(bytearray(text.encode()))
        finally:
            out.close()
        target = self._path(name)
        if self._fs.getScheme() == "file":
            to, of = (self._jvm.java.io.File(p.toUri().getPath()).toPath() for p in (target, self._path(hidden)))
            try:
                self._jvm.java.nio.file.Files.createLink(to, of)
                return True
            except Exception:
                if self._fs.exists(target):
                    return False
                raise
            finally:
                self._fs.delete(self._path(hidden), False)
        try:
            return not self._fs.exists(target) and self._fs.rename(self._path(hidden), target)
        finally:
            if self._fs.exists(self._path(hidden)):
                self._fs.delete(self._path(hidden), False)

    def move(self, name: str, to: str) -> None:
        """Rename a file or folder; the target's parent is made."""
        self._fs.mkdirs(self._path(to.rpartition("/")[0]))
        if not self._fs.rename(self._path(name), self._path(to)):
            raise OSError(f"{self.path}/{name} can't be renamed to {to}")

    def delete(self, name: str) -> None:
        self._fs.delete(self._path(name), True)


def dump(value) -> str:
    return json.dumps(value, sort_keys=True)
