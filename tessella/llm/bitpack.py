"""Token ids as bit-packed blocks.

A block holds the ids of neighbouring documents in ascending id order, each id in the fewest bits
that the vocabulary needs, most significant bit first. A row of the file is one block: its number in
the order of all blocks, the documents' ids and how many ids each has, and the payload. Blocks are
written by Spark as Parquet, so any store will do; a reader finds a document by its block's offsets
and unpacks only its bits.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, id_text, text_or_empty

#: Encodings of words that a worker keeps; beyond that, new words are encoded for their batch alone.
CACHE = 500_000
#: A word of letters and what may stand behind it, each one piece of the tokenizer's pattern.
_SIMPLE = re.compile(r"([A-Za-z\u00C0-\u00D6\u00D8-\u00F6\u00F8-\u024F]+)([!-&(-/:-@\[-`{-~]*)")
FILE_SCHEMA = "part int, seq int, doc_ids array<long>, counts array<int>, n_ids long, before long, width int, payload binary"


def width_of(vocabulary: int) -> int:
    """Bits that hold every id below `vocabulary`."""
    return max(1, (vocabulary - 1).bit_length())


def pack(ids: np.ndarray, width: int) -> bytes:
    """Ids of `width` bits each, the last byte filled with zeros. An id that needs more bits is an error."""
    ids = np.ascontiguousarray(ids, ">u4")
    if len(ids) and int(ids.max()) >> width:
        raise ValueError(f"id {ids.max()} needs more than {width} bits")
    if width == 16:
        return ids.astype(">u2").tobytes()
    bits = np.unpackbits(ids.view(np.uint8).reshape(-1, 4), axis=1)[:, 32 - width :]
    return np.packbits(bits.ravel()).tobytes()


def unpack(payload: bytes, width: int, start: int, count: int) -> np.ndarray:
    """`count` ids from the one numbered `start`, reading only their bytes."""
    if width == 16:
        return np.frombuffer(payload, ">u2", count, start * 2).astype("<u4")
    first, last = start * width // 8, -(-(start + count) * width // 8)
    bits = np.unpackbits(np.frombuffer(payload, np.uint8, last - first, first))
    bits = bits[start * width - first * 8 :][: count * width].reshape(count, width)
    full = np.zeros((count, 32), np.uint8)
    full[:, 32 - width :] = bits
    return np.packbits(full, axis=1).reshape(-1, 4).view(">u4").ravel().astype("<u4")


def byte_characters() -> dict[int, str]:
    """The character that stands for each byte in a byte-level vocabulary: itself if it can be printed, else the next one from 256 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = (b for b in range(256) if b not in set(shown))
    return {b: chr(b) for b in shown} | {b: chr(256 + n) for n, b in enumerate(rest)}


class Words(dict):
    """Encodings of words behind the same white space; what isn't kept yet is encoded when it is asked for."""

    def __init__(self, encode, most: int):
        super().__init__()
        self.encode, self.most = encode, most

    def __missing__(self, word: str) -> bytes:
        got = self.encode(word)
        if len(self) < self.most:
            self[word] = got
        return got


class CachedEncoder:
    """A byte-level tokenizer that encodes each distinct word once and glues the ids together.

    The tokenizer's pattern cuts on both sides of a lone line feed and before a lone space, so for
    texts whose white space is such, the ids of the words, each with its space, are those of the whole.
    Other texts are encoded whole, and so are those that hold a string of an added token, whose id it becomes.
    """

    def __init__(self, model: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(model)
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.feed = self._ids("\n").tobytes()
        self.spaced = Words(lambda w: self._word(w, " "), CACHE)
        self.bare = Words(lambda w: self._word(w, ""), CACHE // 4)
        self.tails = Words(lambda w: self._ids(w).tobytes(), 10_000)
        self.tails[""] = b""
        self.shown = byte_characters()

    def _ids(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, "<u4")

    def _word(self, word: str, lead: str) -> bytes:
        """The ids of a word behind `lead`; letters are one piece of the pattern and go straight to the model."""
        if not (m := _SIMPLE.fullmatch(word)):
            return self._ids(lead + word).tobytes()
        core, end = m.groups()
        if not core.isascii():
            core = core.encode().decode("latin-1").translate(self.shown)
        got = b"".join([t.id.to_bytes(4, "little") for t in self.tokenizer.model.tokenize(self.shown[32] + core if lead else core)])
        return got + self.tails[end] if end else got

    def encode(self, text: str) -> bytes:
        """The ids as little-endian 32-bit integers."""
        feeds, words = text.count("\n"), text.split()
        gaps = text.count(" ") + feeds
        if not words or gaps != len(words) - 1 or sum(map(len, words)) + gaps != len(text) or any(t in text for t in self.added):
            return self._ids(text).tobytes() if text else b""
        spaced, bare, feed, parts = self.spaced.__getitem__, self.bare, self.feed, []
        for line in text.split("\n") if feeds else [text]:
            rest = iter(line.split(" ") if feeds else words)
            parts += (feed, bare[next(rest)])
            parts.extend(map(spaced, rest))
        return b"".join(parts[1:])


@cache
def _encoder(model: str) -> CachedEncoder:
    """One for each worker process, whatever the number of its tasks."""
    return CachedEncoder(model)


def packer(model: str, end_id: int, vocabulary: int, block_ids: int = 1 << 18, block_docs: int = 4096):
    """A mapInPandas function: sorted (doc_id, text) to blocks of at most block_docs documents, closed after block_ids ids."""
    width = width_of(max(vocabulary, end_id + 1))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        encoder, part, seq = _encoder(model), TaskContext.get().partitionId(), 0
        docs, ids, counts, total, before, end = [], [], [], 0, 0, end_id.to_bytes(4, "little")

        def block() -> pd.DataFrame:
            return pd.DataFrame({"part": [part], "seq": [seq], "doc_ids": [docs], "counts": [counts], "n_ids": [total], "before": [before], "width": [width], "payload": [pack(np.frombuffer(b"".join(ids), "<u4"), width)]})

        for frame in frames:
            keys = [None if k is None else int(k) for k in frame["doc_id"]]
            texts = frame["text"].tolist()
            for key, text in zip(keys, texts, strict=True):
                got = encoder.encode(text)
                docs.append(key)
                ids += (got, end)
                counts.append(len(got) // 4 + 1)
                total += counts[-1]
                if total >= block_ids or len(docs) >= block_docs:
                    yield block()
                    docs, ids, counts, before, total, seq = [], [], [], before + total, 0, seq + 1
        if docs:
            yield block()

    return run


def write_ids(docs: DataFrame, scratch: Scratch, model: str, end_id: int, vocabulary: int, name: str = "ids") -> DataFrame:
    """Encodes docs (doc_id, text; null texts are empty) into blocks in ascending doc_id order, null ids first, ties by a hash of the text."""
    d = docs.select("doc_id", text_or_empty("text").alias("text")).withColumn("tie", F.xxhash64("text"))  # range bounds are sampled to the driver, so no texts in them
    n = max(1, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    d = d.repartitionByRange(n, F.col("doc_id").asc_nulls_first(), "tie").sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "tie", "text")
    return scratch.write(d.select(id_text(d), "text").mapInPandas(packer(model, end_id, vocabulary), FILE_SCHEMA), name)


def with_starts(blocks: DataFrame) -> DataFrame:
    """Adds `start`: the ids in all blocks before. A block knows those of its own part, so only a row per part is summed and sent to all tasks."""
    from pyspark.sql import Window

    parts = blocks.groupBy("part").agg(F.sum("n_ids").alias("n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    return blocks.join(F.broadcast(parts), "part").withColumn("start", F.col("base") + F.col("before")).drop("base")


def read_rows(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Blocks with their start to (doc_id, start, n_tokens, ids)."""
    for frame in frames:
        for b in frame.itertuples(index=False):
            at, rows = 0, []
            for key, n in zip(b.doc_ids, b.counts, strict=True):
                rows.append((key, b.start + at, n, unpack(b.payload, b.width, at, n)))
                at += n
            yield pd.DataFrame(rows, columns=["doc_id", "start", "n_tokens", "ids"])


def read_ids(blocks: DataFrame) -> DataFrame:
    """All documents of the blocks with their ids."""
    return _unpacked(blocks, read_rows, "n_tokens long, ids array<long>")


def _unpacked(blocks: DataFrame, read, columns: str) -> DataFrame:
    """(doc_id, start and more columns) of all documents; ids go through Python as text, beside nulls it has no integers."""
    b = with_starts(blocks).select(F.transform("doc_ids", lambda x: x.cast("string")).alias("doc_ids"), "counts", "start", "width", "payload")
    return b.mapInPandas(read, f"doc_id string, start long, {columns}").withColumn("doc_id", F.col("doc_id").cast("long"))


def read_document(blocks: DataFrame, doc_id: int) -> list[int]:
    """One document's ids by random access: only its block is fetched and only its bits unpacked."""
    place = F.array_position("doc_ids", F.lit(doc_id))
    row = blocks.where(place > 0).select(F.aggregate(F.slice("counts", F.lit(1), (place - 1).cast("int")), F.lit(0).cast("long"), lambda a, x: a + x).alias("at"), F.get("counts", (place - 1).cast("int")).alias("n"), "width", "payload").first()
    return [] if row is None else unpack(bytes(row["payload"]), row["width"], row["at"], row["n"]).tolist()


def _digests(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for frame in frames:
        for b in frame.itertuples(index=False):
            ends = np.cumsum(np.asarray(b.counts, np.int64))
            ids = unpack(b.payload, b.width, 0, int(ends[-1]))
            starts = ends - np.asarray(b.counts, np.int64)
            crc = [zlib.crc32(ids[s:e].tobytes()) for s, e in zip(starts.tolist(), ends.tolist(), strict=True)]
            yield pd.DataFrame({"doc_id": list(b.doc_ids), "start": b.start + starts, "n_tokens": np.asarray(b.counts, np.int64), "ids_crc32": crc})


def report(docs: DataFrame, model: str, end_id: int, vocabulary: int) -> DataFrame:
    """Per document, what the written files hold: start, length and checksum of its ids."""
    blocks = write_ids(docs, Scratch(docs.sparkSession, "token-ids"), model, end_id, vocabulary)
    return _unpacked(blocks, _digests, "n_tokens long, ids_crc32 long")
