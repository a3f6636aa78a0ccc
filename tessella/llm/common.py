"""Helpers the training-data operators share: shared storage, word rules, bounded samples."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.corpus import spread
from ..sources.scratch import Scratch, shared_dir  # noqa: F401  for the operators
from ..sources.workers import give_back, small_batches  # noqa: F401

#: ASCII white space, the word separator of the word rules.
SPACES = "\t\n\x0b\x0c\r "
def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the folder; a small `documents` is dealt out to all cores.

    Sets the session's Arrow batches to at most 1000 rows, as texts may be long: the setting is read when a plan runs, not here.
    """
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > 1000:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
    df = spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))
    return spread(df) if name == "documents" else df


def id_text(df: DataFrame) -> Column:
    """The id as text: pandas has no integers beside nulls, so ids go through Python as text."""
    return df["doc_id"].cast("string").alias("doc_id")


def id_again(out: DataFrame, df: DataFrame) -> DataFrame:
    """out with its text ids in the type that they have in df."""
    return out.withColumn("doc_id", F.col("doc_id").cast(df.schema["doc_id"].dataType))


def private(name: str) -> str:
    """A column name that no input has."""
    return f"_{name}_{uuid.uuid4().hex}"


def text_or_empty(col: str | Column) -> Column:
    return F.coalesce(F.col(col) if isinstance(col, str) else col, F.lit(""))


def id_crc_mod(doc_id: str | Column, mod: int) -> Column:
    """crc32 of the id as text, modulo mod; null ids count as the text of nothing."""
    col = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.crc32(F.coalesce(col.cast("string"), F.lit("")).cast("binary")) % mod
