"""What keeps Python workers small beside an executor's JVM."""

from __future__ import annotations

import ctypes

from pyspark.sql import SparkSession

#: Bytes of an Arrow batch, about: Spark's 64 MB would lie in the JVM and the worker several times.
BATCH = 8_000_000


def small_batches(spark: SparkSession) -> None:
    """Sets the session's Arrow batches to at most BATCH bytes: the setting is read when a plan runs, not here."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = spark._jsparkSession.sessionState().conf().arrowMaxBytesPerBatch()
    if now <= 0 or now > BATCH:
        spark.conf.set(key, str(BATCH))


def give_back() -> None:
    """Returns what a worker's earlier tasks have freed to the system: Spark keeps workers, and the allocators keep their memory."""
    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):  # glibc's
        trim(0)
