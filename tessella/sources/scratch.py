"""Tables in storage that the driver and all executors share."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own: list[str] = []
#: Whether a query's shuffle files go as soon as it ends.
_CLEANED = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir; if it is unset, a local one, in local mode only."""
    if found := spark.conf.get("spark.checkpoint.dir", None):
        return found.rstrip("/")
    if (held := spark.sparkContext._jsc.sc().getCheckpointDir()).isDefined():
        return held.get().rstrip("/")
    if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if not _own:
        _own.append(tempfile.mkdtemp(prefix="tessella-"))
    return "file://" + _own[0]


class Scratch:
    """Tables in the shared folder that cut a job's lineage; a lost executor reads them again. They go when the application ends."""

    def __init__(self, spark: SparkSession, tag: str):
        self.spark, self.base = spark, f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"

    def _path(self, name: str = ""):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.base}/{name}".rstrip("/"))
        return path, path.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def made(self) -> str:
        """The folder itself, made if it isn't there."""
        path, fs = self._path()
        fs.mkdirs(path)
        fs.deleteOnExit(path)
        return self.base

    def write(self, df: DataFrame, name: str) -> DataFrame:
        """df as a table. Its shuffle files go once it is written: else they stay until the driver happens to collect its garbage."""
        self.made()
        was = self.spark.conf.get(_CLEANED, "false")
        self.spark.conf.set(_CLEANED, "true")
        try:
            df.write.mode("overwrite").parquet(f"{self.base}/{name}")
        finally:
            self.spark.conf.set(_CLEANED, was)
        return self.spark.read.schema(df.schema).parquet(f"{self.base}/{name}")

    def size(self, name: str) -> int:
        """Bytes that a table takes in storage."""
        path, fs = self._path(name)
        return fs.getContentSummary(path).getLength()

    def drop(self, name: str) -> None:
        """For a table that no returned frame reads any more."""
        path, fs = self._path(name)
        fs.delete(path, True)
