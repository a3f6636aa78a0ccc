"""A training corpus from `documents`: quality, near copies, contamination, personal data, token ids.

Each stage takes (spark, docs, sf_dir) and works on all that the one before kept; run() writes each
stage's result as Parquet in the shared folder and reads it again for the next.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.llm import bpe, minhash, pii, quality, winnow
from tessella.llm.common import Scratch, private, table


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier scores 0.7 or more; it learns from the stage's own documents that have labels."""
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: shingles of five words, similarity 0.8."""
    return minhash.dedup(docs, words=5, percent=80)


def uncontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which less than a twentieth stands in spans of 13 words from the benchmark."""
    own = {c: private(c) for c in docs.columns if c not in ("doc_id", "text")}  # none that the operator would replace
    found = winnow.decontaminate(docs.withColumnsRenamed(own), table(spark, sf_dir, "benchmark"))
    return found.where(~F.col("contaminated")).select(*(F.col(own.get(c, c)).alias(c) for c in docs.columns))


def redacted(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, each span of personal data replaced by its kind."""
    return pii.redact(docs)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents with token ids for their text, the ids' number, and the digest of the text that they decode to.

    The other columns stay, but for those named n_tokens, ids and decoded_sha256, which are replaced.
    """
    with open(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), "rb") as f:
        codec = bpe.Codec.of(bpe.parse_ranks(f.read()), public_tokenizers.PATTERN)
    added = ("n_tokens", "ids", "decoded_sha256")
    raw = private("raw")
    out = codec.encode(docs.drop(*added), "text", "ids", raw, most=200_000)
    return out.select(*(c for c in docs.columns if c not in ("text", *added)), F.size("ids").cast("long").alias("n_tokens"), "ids", F.sha2(raw, 256).alias("decoded_sha256"))


STAGES = [("quality", good_quality), ("near duplicates", one_of_each), ("decontamination", uncontaminated), ("personal data", redacted), ("token ids", encoded)]
#: The classifier, the random field and the merges have no SQL; tests hold the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch, docs = Scratch(spark, "pipeline"), table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = scratch.write(stage(spark, docs, sf_dir), f"stage{i}")
    return docs
