"""Pre-tokenization, vocabulary training, encoding and decoding of byte-level BPE."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.packing import char_budget
from ..sources.corpus import exists, read_vocabulary, write_vocabulary
from ..sources.scratch import Scratch
from ..sources.workers import small_batches
from . import merges as M

# Letters with one sign before, digits by one or two, signs with line ends, white space; and the special tokens.
SPLIT_PATTERN = r"""'(?i:[sdmt]|ll|ve|re)|[^\r\n\p{L}\p{N}]?+\p{L}+|\p{N}{1,2}| ?[^\s\p{L}\p{N}]++[\r\n]*|\s*[\r\n]|\s+(?!\S)|\s+"""
SPECIAL_TOKENS = tuple(f"<|reserved_{i}|>" for i in range(4))
BOS = SPECIAL_TOKENS[0]
#: Bytes of distinct pre-tokens from which on a further task learns merges.
SHARE = 4_000_000


def pretokens(text: Column, pattern: str = SPLIT_PATTERN) -> Column:
    """All matches; (?U) makes \\s and \\p mean Unicode as in other engines."""
    return F.regexp_extract_all(text, F.lit("(?U)" + pattern), F.lit(0))


def pretoken_counts(docs: DataFrame, text: str = "text", doc_cap: int | None = None) -> DataFrame:
    t = F.substring(text, 1, doc_cap) if doc_cap else F.col(text)
    return docs.select(F.explode_outer(pretokens(t)).alias("token")).where("token IS NOT NULL").groupBy("token").agg(F.count("*").alias("n"))


def _ranks(names: list[bytes]) -> dict[bytes, int]:
    return {n: i for i, n in enumerate(dict.fromkeys(names))}


def learn_merges(counts: list[tuple[bytes, int]], size: int) -> dict[bytes, int]:
    """Ranks of 256 bytes and the most frequent pairs, ties by the smaller ids."""
    words = [w for w, _ in counts]
    share = M.Share(b"".join(words), np.fromiter(map(len, words), np.int64, len(words)), np.array([n for _, n in counts], np.int64), size)
    return _ranks(M.learn(share, size, M.Alone()))


def _slots(spark: SparkSession) -> int:
    """Tasks that the executors can run at once; 1 if executors come and go, as these can't wait for each other."""
    if spark.conf.get("spark.dynamicAllocation.enabled", "false") == "true":
        return 1
    context = spark.sparkContext._jsc.sc()
    return max(1, context.maxNumConcurrentTasks(context.resourceProfileManager().defaultResourceProfile()))


def train_vocabulary(docs: DataFrame, size: int = 8192, doc_cap: int | None = 10_000, order: str | None = None, max_chars: int = 1_000_000_000, share: int = SHARE) -> dict[bytes, int]:
    """Merge ranks; `size` counts the special tokens too. Merging sees every distinct pre-token that has a pair.

    Pre-tokens are counted and merged by executors, about `share` of their bytes in each task; only the ranks come to the driver.
    With `order`, an integer column, learning stops at the document whose capped text reaches `max_chars` characters in that
    order; rows without an order are left out. Else all rows count.
    """
    if order:
        docs = char_budget(docs.select(order, "text"), order, "text", max_chars, doc_cap or max_chars)
    scratch = Scratch(docs.sparkSession, "pretokens")
    words = scratch.write(pretoken_counts(docs, doc_cap=doc_cap).where(F.octet_length("token") > 1).select(F.col("token").cast("binary").alias("token"), "n"), "words")
    size_of = words.agg(F.sum(F.octet_length("token"))).first()[0] or 0
    tasks = min(_slots(docs.sparkSession), max(1, size_of // share))
    learned = words.repartition(tasks).mapInPandas(M.learner(size - len(SPECIAL_TOKENS), M.Peers if tasks > 1 else M.Alone), "rank int, token binary", barrier=tasks > 1)
    names = [bytes(r["token"]) for r in sorted(learned.collect(), key=lambda r: r["rank"])]  # a row for each id
    scratch.drop("words")
    return _ranks(names)


def trained(docs: DataFrame, path: str, **options) -> dict[bytes, int]:
    """The merge ranks kept at `path` as (token_id, token_bytes, is_special); learned from docs and written there if there are none.

    Sets the session's Arrow batches to a few MB, for the texts that are encoded with them.
    """
    spark = docs.sparkSession
    small_batches(spark)
    if not exists(spark, f"{path}/_SUCCESS"):
        write_vocabulary(vocabulary(spark, train_vocabulary(docs, **options)), path)
    rows = read_vocabulary(spark, path).where(~F.col("is_special")).collect()  # a vocabulary is bounded
    return {bytes(r["token_bytes"]): r["token_id"] for r in sorted(rows, key=lambda r: r["token_id"])}


def vocabulary(spark: SparkSession, ranks: dict[bytes, int]) -> DataFrame:
    """(token_id, token_bytes, is_special): special ids come after the merges."""
    rows = [(i, b, False) for b, i in ranks.items()] + [(len(ranks) + k, s.encode(), True) for k, s in enumerate(SPECIAL_TOKENS)]
    return spark.createDataFrame(rows, "token_id int, token_bytes binary, is_special boolean")


def token_lengths(vocab: DataFrame, exact: bool = True) -> DataFrame:
    """(token_id, n_bytes), special tokens 0. Not exact: bytes of the decoded text, where a partial character counts 3."""
    n = F.octet_length("token_bytes" if exact else F.make_valid_utf8(F.col("token_bytes").cast("string")))
    return vocab.select("token_id", F.when(F.col("is_special"), 0).otherwise(n).cast("int").alias("n_bytes"))


def bos_id(ranks: dict[bytes, int]) -> int:
    return len(ranks)


def encoder(ranks: dict[bytes, int], prepend: int | None = None):
    """A vectorized function from texts to ids, the prefix first; null texts are empty."""

    @F.arrow_udf("array<int>")
    def encode(texts: pa.Array) -> pa.Array:
        import tiktoken

        t = tiktoken.Encoding("own", pat_str=SPLIT_PATTERN, mergeable_ranks=ranks, special_tokens={})
        head = [] if prepend is None else [prepend]
        ids = [np.array(head + t.encode_ordinary(x.as_py() or ""), np.int32) for x in texts]  # a list for each would hold a pointer and an object for every id
        ends = np.cumsum([0, *map(len, ids)], dtype=np.int64).astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(ids or [np.empty(0, np.int32)])))

    return encode


def decoded(ids: Column, vocab: DataFrame) -> Column:
    """The text of ids, joined within the row: ids aren't dealt out, and rows of equal keys don't mix."""
    rows = vocab.where(~F.col("is_special")).select("token_id", F.hex("token_bytes").alias("h")).collect()  # a vocabulary is bounded
    pieces = [""] * (max((r["token_id"] for r in rows), default=-1) + 1)
    for r in rows:
        pieces[r["token_id"]] = r["h"]
    held = F.split(F.lit(",".join(pieces)), ",")  # a constant, worked out once as the plan is made
    return F.decode(F.unhex(F.array_join(F.transform(ids, lambda i: F.get(held, i)), "")), "UTF-8")


def decode_ids(docs: DataFrame, ids: str, vocab: DataFrame, key: str) -> DataFrame:
    """(key, text) of the ids of each row: pieces joined in order. Special tokens are left out; no ids, or null, are an empty text."""
    return docs.select(key, F.coalesce(decoded(F.col(ids), vocab), F.lit("")).alias("text"))
