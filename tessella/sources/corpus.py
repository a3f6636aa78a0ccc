"""Readers and writers: corpus shards, experiment tables, logs and run outputs."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Ids that each shard has for its rows, more than any file holds.
SHARD_ROWS = 1 << 32
# Fixed value: the validation shard.
VALIDATION = "shard_06542.parquet"
EXPERIMENTS = "commit string, val_bpb string, memory_gb string, status string, description string"


#: Tables below so many bytes in storage are dealt out to all cores: one row group can't be split.
SMALL = 64 << 20


def spread(df: DataFrame) -> DataFrame:
    """A table that is small in storage, dealt out to all cores; larger ones are split by the scan."""
    if int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) >= SMALL:
        return df
    return df.repartition(df.sparkSession.sparkContext.defaultParallelism)


def shard_name(number: int) -> str:
    return f"shard_{number:05d}.parquet"


def list_shards(spark: SparkSession, path: str, pattern: str = "*.parquet") -> DataFrame:
    """(file, size) in order of name; only metadata is read."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(path).select("path", F.col("length").alias("size"))
    return files.select(F.element_at(F.split("path", "/"), -1).alias("file"), "path", "size").orderBy("file")


def total_size(spark: SparkSession, path: str) -> DataFrame:
    return list_shards(spark, path).agg(F.count("*").alias("n_files"), F.sum("size").alias("bytes"))


def read_corpus(spark: SparkSession, path: str, first: int | None = None) -> DataFrame:
    """(session_id, file, text) of the shards, of the first ones by name if asked; ids are shard number * SHARD_ROWS + row."""
    paths = [r["path"] for r in list_shards(spark, path, "shard_*.parquet").select("path", "file").orderBy("file").limit(first).collect()] if first else [path]
    df = spark.read.option("pathGlobFilter", "shard_*.parquet").schema("text string").parquet(*paths)
    number = F.regexp_extract(F.col("_metadata.file_name"), r"shard_(\d+)", 1).cast("long")
    return df.select((number * SHARD_ROWS + F.col("_metadata.row_index")).alias("session_id"), F.col("_metadata.file_name").alias("file"), "text")


def split(corpus: DataFrame, part: str) -> DataFrame:
    """`train` or `val`, by the file's name, so other files aren't read."""
    if part not in ("train", "val"):
        raise ValueError("a split is train or val")
    val = F.col("file") == VALIDATION
    return corpus.where(val if part == "val" else ~val)


def write_shards(docs: DataFrame, path: str, order: str | None = None) -> list[str]:
    """Writes docs (shard, text) as one snappy file for each shard, named by its number; files that are there already are skipped.

    Returns the names of the new files. Shards are written aside and renamed, so a file is whole or not there.
    Within a shard rows keep the order of `order`.
    """
    spark = docs.sparkSession
    at = spark._jvm.org.apache.hadoop.fs.Path
    fs = at(path).getFileSystem(spark._jsc.hadoopConfiguration())
    fs.mkdirs(at(path))
    there = {f.getPath().getName() for f in fs.listStatus(at(path))}
    new = [r["shard"] for r in docs.select("shard").where("shard IS NOT NULL").distinct().collect() if shard_name(r["shard"]) not in there]  # a number for each file
    aside = f"{path}/_aside-{uuid.uuid4().hex}"
    rows = docs.where(F.col("shard").isin(new)).repartition("shard")
    rows = rows.sortWithinPartitions("shard", order) if order else rows.sortWithinPartitions("shard")
    rows.select("shard", "text").write.partitionBy("shard").option("compression", "snappy").parquet(aside)
    for n in new:
        found = [f.getPath() for f in fs.listStatus(at(f"{aside}/shard={n}")) if f.getPath().getName().startswith("part-")]
        if len(found) != 1:
            raise ValueError(f"shard {n} has {len(found)} files: spark.sql.files.maxRecordsPerFile must not split it")
        fs.rename(found[0], at(f"{path}/{shard_name(n)}"))
    fs.delete(at(aside), True)
    return sorted(shard_name(n) for n in new)


def read_experiments(spark: SparkSession, path: str) -> DataFrame:
    """A tab-separated table with a header; all columns as text."""
    return spark.read.csv(path, sep="\t", header=True, schema=EXPERIMENTS)


def append_experiments(rows: DataFrame, path: str) -> None:
    rows.select("commit", "val_bpb", "memory_gb", "status", "description").write.mode("append").csv(path, sep="\t", header=True)


def read_log(spark: SparkSession, path: str) -> DataFrame:
    """(ordinal, line) of one exported file of `hash|subject|time` lines, newest first, so that ordinals ascend with time.

    Lines are read by block: an ordinal is the block's place in the file and the line's number within the task.
    """
    within = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    lines = spark.read.text(path).select((F.col("_metadata.file_block_start") + within).alias("at"), F.col("value").alias("line"))
    return lines.select((-F.col("at")).alias("ordinal"), "line")


def read_outputs(spark: SparkSession, path: str) -> DataFrame:
    """(file, text) of whole text files."""
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_name").alias("file"), F.col("value").alias("text"))


def write_outputs(outputs: DataFrame, path: str) -> None:
    """Adds a text file for each row (name, text), in a folder by its name."""
    outputs.select("name", "text").repartition("name").write.mode("append").partitionBy("name").text(path)


def read_named_outputs(spark: SparkSession, path: str) -> DataFrame:
    """(name, text) of what write_outputs wrote: whole files, the last line feed left out."""
    df = spark.read.schema("value string, name string").text(path, wholetext=True)
    return df.select("name", F.regexp_replace("value", r"\n\z", "").alias("text"))


def exists(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


def write_vocabulary(vocab: DataFrame, path: str) -> None:
    """Written once; a vocabulary that is there stays."""
    vocab.write.mode("ignore").parquet(path)


def read_vocabulary(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("token_id int, token_bytes binary, is_special boolean").parquet(path)


def write_lengths(lengths: DataFrame, path: str) -> None:
    """(token_id, n_bytes), written once."""
    lengths.write.mode("ignore").parquet(path)


def read_lengths(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("token_id int, n_bytes int").parquet(path)


def ensure_ids(ids: DataFrame, wanted: DataFrame) -> DataFrame:
    """ids with those wanted that aren't there, once each."""
    return ids.unionByName(wanted.join(ids, wanted.columns, "left_anti").distinct())
