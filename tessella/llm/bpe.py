"""Byte-level BPE encoding and decoding with higher-order functions.

A word (a match of the pattern) starts as the ids of its bytes. A fold merges, again and again, the
leftmost neighbouring pair of the least rank, looked up in a literal rank map: an array of small maps
from a pair of ids to the id of their concatenation, which is its rank as well. The most frequent
distinct words are folded once and their ids, and the bytes that these decode to, kept in a second
literal map; any other word is folded where it stands. Decoding concatenates binary pieces: those of
the ids of a word, then those of the words.
"""

from __future__ import annotations

import base64
import json
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import private, text_or_empty

#: Buckets of the rank map and of the word map: primes, so that pairs spread.
PAIR_BUCKETS, WORD_BUCKETS = 65_521, 262_139
#: Distinct words that the word map holds, the most frequent ones, each of at most WORD_BYTES.
WORDS, WORD_BYTES = 600_000, 48
#: Longer words are folded with all pairs of the least rank merged in one step.
LONG = 1024
#: The rank of a pair that isn't in the map, above all others, and the bit from which ranks are packed.
NONE, RANK_BIT = 0xFFFF, 42


def parse_ranks(text: bytes) -> dict[bytes, int]:
    """A rank file's lines: a token in base64 and its rank."""
    return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, text.splitlines()) if token}


def _bucket(word: Column) -> Column:
    return F.pmod(F.hash(word), F.lit(WORD_BUCKETS))


def _bind(value: Column, body) -> Column:
    """body of a value that is worked out once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _constant(value, kind: str) -> Column:
    """A literal of arrays and maps; JSON has text keys, so those of maps are cast."""
    row = _session().createDataFrame([(json.dumps(value, ensure_ascii=False),)], "j string")
    return _literal(row.select(F.from_json("j", kind.replace("map<bigint", "map<string")).cast(kind)))


def _session():
    from pyspark.sql import SparkSession

    return SparkSession.getActiveSession()


def _literal(row: DataFrame) -> Column:
    """The one value of a one-row frame as a literal, in Spark's own binary layout.

    Laid out so, it is copied to tasks as bytes; a literal that the parser makes is sent as an
    object for each entry, which takes a task seconds.
    """
    jvm = row.sparkSession._jvm
    value = row._jdf.queryExecution().executedPlan().executeCollect()[0]
    kind = row._jdf.schema().apply(0).dataType()
    literal = jvm.org.apache.spark.sql.catalyst.expressions.Literal(value.get(0, kind), kind)
    return Column(jvm.org.apache.spark.sql.classic.ExpressionUtils.column(literal))


class Fold:
    """The fold of one word, over the rank map and the ids of the bytes."""

    def __init__(self, pairs: Column, bytes_: Column):
        self.pairs, self.bytes_ = pairs, bytes_

    def _rank(self, a: Column, b: Column) -> Column:
        """The rank of two packed parts' pair, in the place where parts hold it."""
        key = F.shiftleft(a.bitwiseAND(F.lit(0xFFFF)), 16).bitwiseOR(b.bitwiseAND(F.lit(0xFFFF)))
        return F.coalesce(F.get(self.pairs, (key % PAIR_BUCKETS).cast("int"))[key], F.lit(NONE << RANK_BIT))

    def _parts(self, ids: Column) -> Column:
        """Packed parts: the rank of a part with the one behind it, its place and its id, so that the least one is the pair to merge."""
        rest = F.transform(ids, lambda x, i: F.shiftleft(i.cast("long"), 16).bitwiseOR(x.cast("long")))
        none = F.lit(NONE << RANK_BIT)
        return _bind(rest, lambda v: F.transform(v, lambda e, i: e.bitwiseOR(F.when(i + 1 < F.size(v), self._rank(e, F.get(v, i + 1))).otherwise(none))))

    def _merge_first(self, word: Column) -> Column:
        """One merge a step: of the leftmost pair of the least rank, whose neighbours' ranks are then looked up."""
        rest_of = lambda e: e.bitwiseAND(F.lit((1 << RANK_BIT) - 1))

        def step(v, _):
            def merged(m, i):
                # The merged part has the pair's rank as its id and the place of its first half.
                new = F.shiftrightunsigned(m, RANK_BIT).bitwiseOR(rest_of(m).bitwiseAND(F.lit(~0xFFFF)))
                right = F.when(i + 1 < F.size(v), self._rank(new, F.get(v, i + 1))).otherwise(F.lit(NONE << RANK_BIT))
                before = F.get(v, i - 2)
                left = F.when(i < 2, F.array().cast("array<bigint>")).otherwise(F.array(rest_of(before).bitwiseOR(self._rank(before, new))))
                return F.concat(F.slice(v, F.lit(1), F.greatest(i - 2, F.lit(0))), left, F.array(new.bitwiseOR(right)), F.slice(v, i + 2, F.size(v)))

            return _bind(F.array_min(v), lambda m: F.when(m >= NONE << RANK_BIT, v).otherwise(_bind(F.array_position(v, m).cast("int"), lambda i: merged(m, i))))

        def fold(ids):
            return F.aggregate(F.sequence(F.lit(2), F.size(ids)), self._parts(ids), step, lambda v: F.transform(v, lambda e: e.bitwiseAND(F.lit(0xFFFF)).cast("int")))

        return _bind(self._byte_ids(word), lambda ids: F.when(F.size(ids) < 2, ids).otherwise(fold(ids)))

    def _merge_all(self, word: Column) -> Column:
        """All pairs of the least rank a step, from left to right: ids are characters of a string, a merge replaces two by one."""
        signs = lambda ids: F.decode(F.unhex(F.array_join(F.transform(ids, lambda i: F.lpad(F.hex(i + 1), 4, "0")), "")), "UTF-16BE")
        ids_of = lambda s: F.transform(F.split(s, ""), lambda c: F.ascii(c) - 1)

        def step(a, _):
            def merged(ids):
                def least(v):
                    at = lambda m: F.array_position(v, m).cast("int")
                    id_ = lambda m: F.shiftrightunsigned(m, RANK_BIT).cast("int")
                    return _bind(F.array_min(v), lambda m: F.when(m >= NONE << RANK_BIT, F.struct(a["s"].alias("s"), F.lit(True).alias("done"))).otherwise(F.struct(F.replace(a["s"], signs(F.slice(ids, at(m), 2)), signs(F.array(id_(m)))).alias("s"), F.lit(False).alias("done"))))

                return _bind(self._parts(ids), least)

            return F.when(a["done"], a).otherwise(_bind(ids_of(a["s"]), merged))

        start = F.struct(signs(self._byte_ids(word)).alias("s"), F.lit(False).alias("done"))
        return F.aggregate(F.sequence(F.lit(2), F.octet_length(word)), start, step, lambda a: ids_of(a["s"]))

    def _byte_ids(self, word: Column) -> Column:
        return F.transform(F.split(F.decode(word.cast("binary"), "ISO-8859-1"), ""), lambda c: F.get(self.bytes_, F.ascii(c)))

    def ids(self, word: Column) -> Column:
        """The ids of one word that isn't empty."""
        return F.when(F.octet_length(word) > LONG, self._merge_all(word)).otherwise(self._merge_first(word))


@dataclass
class Codec:
    """The literals of one rank file and the expressions over them. A literal is named once in an expression, as a variable of all within.

    `little` has for each id the two characters that UTF-16LE writes as its four bytes in little-endian order.
    """

    pairs: Column
    bytes_: Column
    pieces: Column
    little: Column
    pattern: str

    @classmethod
    def of(cls, ranks: dict[bytes, int], pattern: str) -> Codec:
        size = max(ranks.values()) + 1
        if size > 0xD7FF or any(bytes([b]) not in ranks for b in range(256)):
            raise ValueError("ranks must hold all single bytes and stay below 55295")
        pairs: list[dict[str, int]] = [{} for _ in range(PAIR_BUCKETS)]
        pieces = [""] * size
        for token, rank in ranks.items():
            pieces[rank] = token.hex()
            for i in range(1, len(token)):
                if (a := ranks.get(token[:i])) is not None and (b := ranks.get(token[i:])) is not None:
                    key = a << 16 | b
                    pairs[key % PAIR_BUCKETS][str(key)] = rank << RANK_BIT
        little = [chr(i) + "\0" for i in range(size)]
        return cls(_constant(pairs, "array<map<bigint,bigint>>"), _constant([ranks[bytes([b])] for b in range(256)], "array<int>"), _constant(pieces, "array<string>"), _constant(little, "array<string>"), "(?U)" + pattern)

    def words(self, text: str | Column) -> Column:
        """All matches of the pattern, in order."""
        return F.regexp_extract_all(text, F.lit(self.pattern), F.lit(0))

    def coded(self, words: Column, packed: bool, known: Column | None = None) -> Column:
        """struct(x, raw) of each of the words, none of them empty: what `known` has, else by the fold.

        x is the word's ids, or the characters that stand for them if packed; raw the text that the ids decode to.
        """

        def each(pairs, bytes_, pieces, little, known):
            fold = Fold(pairs, bytes_)

            def one(ids):
                x = F.array_join(F.transform(ids, lambda i: F.get(little, i)), "") if packed else ids
                return F.struct(x.alias("x"), F.unhex(F.array_join(F.transform(ids, lambda i: F.get(pieces, i)), "")).cast("string").alias("raw"))

            folded = lambda w: _bind(fold.ids(w), one)
            if known is None:
                return F.transform(words, folded)
            return F.transform(words, lambda w: F.coalesce(F.get(known, _bucket(w))[w], folded(w)))

        held = lambda *a: each(*a, None) if known is None else _bind(known, lambda k: each(*a, k))
        return _bind(self.pairs, lambda p: _bind(self.bytes_, lambda b: _bind(self.pieces, lambda s: _bind(self.little, lambda n: held(p, b, s, n)))))

    def word_map(self, docs: DataFrame, text: str, most: int, packed: bool) -> Column:
        """The most frequent words as `coded`, each folded once: a map whose size `most` and WORD_BYTES bound."""
        # An inner explode would match the pattern twice, once to see that there are words.
        words = docs.select(F.explode_outer(self.words(text)).alias("w")).where(F.octet_length("w") <= WORD_BYTES).groupBy("w").count()
        top = words.orderBy(F.desc("count"), "w").limit(most).repartition(F.col("w")).select("w", F.get(self.coded(F.array("w"), packed), F.lit(0)).alias("s"))
        # One row of at most `most` entries: a map for every bucket, in order.
        maps = top.groupBy(_bucket(F.col("w")).alias("b")).agg(F.map_from_entries(F.collect_list(F.struct("w", "s"))).alias("m"))
        every = docs.sparkSession.range(WORD_BUCKETS).select(F.col("id").cast("int").alias("b")).join(maps, "b", "left")
        empty = F.from_json(F.lit("{}"), f"map<string,struct<x:{'string' if packed else 'array<int>'},raw:string>>")
        all_ = every.agg(F.transform(F.array_sort(F.collect_list(F.struct("b", F.struct(F.map_entries(F.coalesce("m", empty)).alias("e")).alias("s")))), lambda x: F.map_from_entries(x["s"]["e"])).alias("m"))
        return _literal(all_)

    def _over_words(self, docs: DataFrame, text: str, most: int, packed: bool, of) -> DataFrame:
        """docs with the fields of the struct that `of` makes of a text's coded words, in place of columns of their names."""
        t, out = private("text"), private("out")
        docs = docs.withColumn(t, text_or_empty(text))
        known = self.word_map(docs, t, most, packed)
        made = docs.withColumn(out, _bind(self.coded(self.words(t), packed, known), of)).drop(t)
        names = made.schema[out].dataType.names
        return made.select(*(c for c in docs.columns if c not in (t, *names)), f"{out}.*")

    def encode(self, docs: DataFrame, text: str, ids: str, raw: str, most: int = WORDS) -> DataFrame:
        """Adds the ids of the texts' words and the bytes that they decode to; a null text counts as empty, an empty one has no ids."""
        of = lambda c: F.struct(F.flatten(c["x"]).alias(ids), _decoded(c).alias(raw))
        return self._over_words(docs, text, most, False, of)

    def digests(self, docs: DataFrame, text: str, most: int = WORDS) -> DataFrame:
        """Adds n_tokens, and the digests of the ids as little-endian unsigned 32-bit integers and of the bytes that they decode to."""

        def of(c):
            packed = F.encode(F.array_join(c["x"], ""), "UTF-16LE")
            return _bind(packed, lambda p: F.struct(F.shiftright(F.octet_length(p), 2).cast("long").alias("n_tokens"), F.sha2(p, 256).alias("ids_sha256"), F.sha2(_decoded(c), 256).alias("decoded_sha256")))

        return self._over_words(docs, text, most, True, of)

    def decode(self, ids: str | Column) -> Column:
        """The bytes of the pieces of any ids, one after the other."""
        return F.unhex(F.array_join(_bind(self.pieces, lambda p: F.transform(ids, lambda i: F.get(p, i))), ""))


def _decoded(coded: Column) -> Column:
    """The bytes of coded words, one after the other."""
    return F.array_join(coded["raw"], "").cast("binary")  # a field of all structs is taken at once, without a function for each word


def report(docs: DataFrame, ranks: dict[bytes, int], pattern: str) -> DataFrame:
    """Per row of docs (doc_id, text): the number and digest of its ids, and the digest of their decoded bytes."""
    return Codec.of(ranks, pattern).digests(docs.select("doc_id", "text"), "text").drop("text")
