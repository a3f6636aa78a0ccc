"""Language-model scores from a probabilistic suffix tree.

The tree has two layers, both with contexts of variable length that are kept only if their
next-symbol distribution diverges from that of their longest shorter suffix, smoothed towards it by
the Witten-Bell rule, and scored from the longest kept suffix.

Upper layer: a symbol is one of the LISTED most frequent words, the end of the text, or the first two
bytes of any other word. Contexts are suffixes of the text before: the last two bytes of the word
before, that whole word, and the word before it as well. Contexts of listed words, and pairs of the
FAR and NEAR most frequent ones, have a share of P_UPPER or more, so every worker holds them. Any
other word and any other pair of words, below that share too, is a context from MASS occurrences on:
their number grows with the corpus, so their counts stay in a table that is dealt out by ranges of
hashes, and the positions behind them are looked up there, the pair smoothed towards the word. Pairs
whose nearer word isn't listed lie in the range of that word, so one look-up has both; a table of
SLOT_BITS, of one size whatever the corpus, spares most look-ups of pairs that aren't kept. Counts and
look-ups travel as packed arrays, one for each range and some hundred thousand positions. A context
is named by 52 bits of a hash; two that share them would share a distribution.
Lower layer: the bytes of words that aren't listed, the closing space included, in contexts of up to
DEPTH bytes of the same word and its opening space, whose share of all symbols is at least P_MIN; it
gives the rest of a word after its first two bytes, mixed with the word's own count.

The lower layer works on distinct words, each counted once, as it spells words that training texts
don't hold: the counts of all words are gathered first, every distinct word is scored once. At most
1 / P_MIN contexts of each length can have that share, which bounds the tree whatever the corpus.
Counts are summed and cut to the kept contexts in Spark, so that only those of the lower layer and of
listed words come to the driver; counts of words and of the contexts behind all other words have no
bound and stay distributed.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain, compress, repeat

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, give_back, id_again, id_crc_mod, small_batches, text_or_empty

DEPTH, P_MIN, DIVERGENCE = 12, 5e-5, 8.0
#: Listed words, prefixes with a symbol of their own, words that are contexts, and such as pairs.
LISTED, PREFIXES, WHOLE, FAR, NEAR = 1024, 511, 1024, 64, 64
#: Upper contexts are kept from this share of all tokens on.
P_UPPER = 1e-5
#: Words that aren't listed, and pairs, are contexts from so many occurrences on; so many distinct words, or tokens, make a range of hashes.
MASS, RANGE, RANGE_TOKENS = 2, 50_000, 400_000
#: Bits of a code that number the places of a table of bits, which says what may be kept; MOST_BITS of them may number ranges.
SLOT_BITS, MOST_BITS = 26, 20
#: Positions summed at once, counts held before they are passed on, ranges of these in a batch, and look-ups passed on at once.
STEP, HELD_CODES, TOGETHER, ASKED = 250_000, 3_000_000, 32, 400_000
#: Most frequent words that every worker holds, each of at most HELD_BYTES; other words are joined.
HELD, HELD_BYTES = 120_000, 48
FLUSH = 300_000
_M = np.uint64(0x9E3779B97F4A7C15)
#: A code is 52 bits of a context, a bit that marks rare ones, and 11 bits of a symbol. Listed contexts are numbers, spread by an odd factor.
_SLOTS, _LOW52, _ODD = np.uint64(2**20 - 1), np.uint64(2**52 - 1), 0x9E3779B97F4A7 | 1
_BACK, _SYMBOL = pow(_ODD, -1, 2**52), np.uint64(11)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(29))


class Contexts:
    """All positions at which a symbol of some words is predicted, with the hashes of their contexts."""

    def __init__(self, words: list[bytes], weights: np.ndarray):
        self.text = np.frombuffer(b" " + b" ".join(words) + b" ", np.uint8)
        spaces = np.flatnonzero(self.text == 32)
        self.word = np.repeat(np.arange(len(words), dtype=np.int32), np.diff(spaces))
        self.position = np.arange(1, len(self.text), dtype=np.int32)
        self.reach = self.position - spaces.astype(np.int32)[self.word]
        self.symbol = self.text[1:]
        self.weight = weights[self.word].astype(np.float64)

    def walk(self, keep) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(depth, positions, hashes) of what keep(depth, positions, hashes) accepts, which goes on to the next depth."""
        at, h = np.arange(len(self.position)), np.full(len(self.position), 1, np.uint64)
        for d in range(DEPTH + 1):
            if d:
                ok = self.reach[at] >= d
                at, h = at[ok], h[ok]
                h = _mix(h * _M + self.text[self.position[at] - d].astype(np.uint64))
            ok = keep(d, at, h)
            at, h = at[ok], h[ok]
            yield d, at, h


def frequent_contexts(words: list[bytes], counts: np.ndarray, share: float = P_MIN) -> list[tuple[np.ndarray, np.ndarray]]:
    """By depth, the hashes and weights of the contexts that have the share of these words' symbols."""
    c = Contexts(words, counts)
    least, out = share * c.weight.sum(), []

    def keep(d, at, h):
        if not len(h):
            out.append((h, np.empty(0)))
            return np.zeros(0, bool)
        w, slot = c.weight[at], (h & _SLOTS).astype(np.int64)
        maybe = np.flatnonzero(np.bincount(slot, w)[slot] >= least)  # a slot weighs as much as its contexts, or more
        names, inverse = np.unique(h[maybe], return_inverse=True)
        weight = np.bincount(inverse, w[maybe], len(names))
        good = weight >= least
        out.append((names[good], weight[good]))
        ok = np.zeros(len(h), bool)
        ok[maybe] = good[inverse]
        return ok

    for _ in c.walk(keep):
        pass
    return out


def _within(h: np.ndarray, names: np.ndarray) -> np.ndarray:
    out = np.zeros(len(h), bool)
    if not len(names):
        return out
    slots = np.zeros(int(_SLOTS) + 1, bool)  # most of what isn't there is sorted out without a search
    slots[names & _SLOTS] = True
    at = np.flatnonzero(slots[h & _SLOTS])
    out[at] = names[np.minimum(np.searchsorted(names, h[at]), len(names) - 1)] == h[at]
    return out


def context_counts(words: list[bytes], counts: np.ndarray, names: list[np.ndarray]) -> pd.DataFrame:
    """(depth, context, parent, symbol, n) of the given contexts."""
    c, out = Contexts(words, counts), []
    parents = np.zeros(len(c.position), np.uint64)
    for d, at, h in c.walk(lambda d, at, h: _within(h, names[d])):
        if len(h):
            row = np.searchsorted(names[d], h)
            n = np.bincount(row * 256 + c.symbol[at].astype(np.int64), c.weight[at])
            code = np.flatnonzero(n)
            parent = np.zeros(len(names[d]), np.uint64)
            parent[row] = parents[at]
            out.append(pd.DataFrame({"depth": d, "context": names[d][code >> 8].view(np.int64), "parent": parent[code >> 8].view(np.int64), "symbol": (code & 255).astype(np.int32), "n": n[code]}))
        parents[at] = h
    return pd.concat(out) if out else pd.DataFrame({"depth": [], "context": [], "parent": [], "symbol": [], "n": []})


@dataclass
class Tree:
    """Kept contexts by hash: `unseen`, the log of the mass left to the parent, and log probabilities of the symbols seen."""

    contexts: np.ndarray
    unseen: np.ndarray
    pairs: np.ndarray
    logs: np.ndarray

    def score(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(log of the first two bytes, log of all bytes) of each word, natural logs."""
        c = Contexts(words, np.zeros(len(words)))
        n = len(c.position)
        total, states = np.zeros(n), []
        for _, at, h in c.walk(lambda d, at, h: _within(h, self.contexts)):
            states.append((at, h))
        open_ = np.zeros(n, bool)
        done = np.zeros(n, bool)
        for at, h in reversed(states):  # from the longest suffix to the empty one
            todo = ~done[at]
            at, h = at[todo], h[todo]
            open_[at] = True
            key = _mix(h * _M + c.symbol[at])
            if len(self.pairs):
                i = np.minimum(np.searchsorted(self.pairs, key), len(self.pairs) - 1)
                hit = self.pairs[i] == key
                total[at[hit]] += self.logs[i[hit]]
                done[at[hit]] = True
            else:
                hit = np.zeros(len(key), bool)
            miss = at[~hit]
            total[miss] += self.unseen[np.searchsorted(self.contexts, h[~hit])]
        total[~done] -= math.log(257)  # a symbol that was never seen shares the root's rest with all
        return np.bincount(c.word, total * (c.reach <= 2), len(words)), np.bincount(c.word, total, len(words))


def build(counts: pd.DataFrame) -> Tree:
    """The tree of exact context counts (depth, context, parent, symbol, n), shortest first."""
    empty = np.empty(0, np.uint64)
    if not len(counts):
        return Tree(np.array([1], np.uint64), np.zeros(1), empty, np.empty(0))
    probability: dict[tuple[int, int], float] = {}
    back: dict[int, float] = {}
    parent: dict[int, int] = {}
    gains: dict[int, float] = {}
    by_depth: dict[int, list[int]] = {}
    counts = counts.sort_values(["depth", "context"], kind="stable")
    context, symbol, n = counts["context"].to_numpy(), counts["symbol"].to_numpy(), counts["n"].to_numpy()
    starts = np.flatnonzero(np.r_[True, context[1:] != context[:-1]])

    def smoothed(p: int, s: int) -> float:
        rest = 1.0
        while True:
            if (x := probability.get((p, s))) is not None:
                return rest * x
            rest *= back[p]
            if p not in parent:
                return rest / 257
            p = parent[p]

    depth, up = counts["depth"].to_numpy(), counts["parent"].to_numpy()
    for a, b in zip(starts.tolist(), [*starts[1:].tolist(), len(context)], strict=True):
        me, seen = int(context[a]), b - a
        mass, gain = float(n[a:b].sum()), 0.0
        if depth[a]:
            parent[me] = int(up[a])
        back[me] = seen / (mass + seen)
        for s, k in zip(symbol[a:b].tolist(), n[a:b].tolist(), strict=True):
            low = smoothed(parent[me], s) if depth[a] else 1 / 257
            p = (k + seen * low) / (mass + seen)
            probability[me, s] = p
            gain += k * math.log(p / low)
        gains[me] = gain
        by_depth.setdefault(int(depth[a]), []).append(me)
    kept: set[int] = set()
    for d in sorted(by_depth, reverse=True):
        for me in by_depth[d]:
            if d == 0 or gains[me] >= DIVERGENCE or me in kept:
                kept.add(me)
                if d:
                    kept.add(parent[me])
    names = np.array(sorted(kept), np.int64).view(np.uint64)
    names.sort()
    pairs = [(c, s, p) for (c, s), p in probability.items() if c in kept]
    keys = _mix(np.array([x[0] for x in pairs], np.int64).view(np.uint64) * _M + np.array([x[1] for x in pairs], np.uint64))
    order = np.argsort(keys)
    unseen = np.log(np.array([back[int(x)] for x in names.view(np.int64)]))
    return Tree(names, unseen, keys[order], np.log(np.array([x[2] for x in pairs]))[order])


# Over DataFrames.


def tokens_of(text: str) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").lower().split()


def _counted(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Words with their counts in training texts, 0 for those of held-out texts; a null word counts the training texts."""
    give_back()
    seen, ends = Counter(), 0

    def rows(end: int) -> pd.DataFrame:
        return pd.DataFrame({"word": [*seen, None], "c": [*seen.values(), end]})

    for frame in frames:
        for text, held in zip(frame["text"], frame["held_out"], strict=True):
            words = tokens_of(text)
            if held:
                for w in words:  # a set's difference with a Counter would walk through all of the Counter
                    if w not in seen:
                        seen[w] = 0
            else:
                seen.update(words)
                ends += 1
            if len(seen) > FLUSH:
                yield rows(ends)
                seen, ends = Counter(), 0
    if seen or ends:
        yield rows(ends)


def _chunks(frames: Iterator[pd.DataFrame], most: int = 100_000) -> Iterator[tuple[list[bytes], np.ndarray]]:
    words, counts = [], []
    for frame in frames:
        words += frame["word"].tolist()
        counts += frame["c"].tolist()
        if len(words) >= most:
            yield words, np.array(counts, np.float64)
            words, counts = [], []
    if words:
        yield words, np.array(counts, np.float64)


def _candidates(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Contexts with half the share within a chunk, their weight there and the chunk's."""
    for words, counts in _chunks(frames):
        found = frequent_contexts(words, counts, P_MIN / 2)
        total = float(sum((len(w) + 1) * c for w, c in zip(words, counts.tolist(), strict=True)))
        yield pd.DataFrame({"depth": np.repeat(np.arange(len(found)), [len(x) for x, _ in found]), "context": np.concatenate([x for x, _ in found]).view(np.int64), "n": np.concatenate([n for _, n in found]), "chunk": total})


def learn(words: DataFrame, scratch: Scratch) -> Tree:
    """The lower layer of distinct words: candidates of each chunk, their exact counts over all words, then those that reach the share.

    A chunk that doesn't name a context has less than half the share of it. So a context's weight is
    at most what is named and half the share of all other chunks; those for which that reaches the
    share are counted, 2 / P_MIN of each length at most.
    """
    words = words.select("word", F.lit(1).alias("c"))
    total = words.agg(F.sum(F.octet_length("word") + 1)).first()[0] or 0
    found = words.mapInPandas(_candidates, "depth int, context long, n double, chunk double").groupBy("depth", "context").agg(F.sum("n").alias("n"), F.sum("chunk").alias("chunks"))
    got = found.where(F.col("n") + P_MIN / 2 * (total - F.col("chunks")) >= P_MIN * total).select("depth", "context").toPandas()
    names = [np.sort(got.loc[got["depth"] == d, "context"].to_numpy(np.int64).view(np.uint64)) for d in range(DEPTH + 1)]

    def counted(frames):
        for w, c in _chunks(frames):
            yield context_counts(w, c, names)

    table = words.mapInPandas(counted, "depth int, context long, parent long, symbol int, n double")
    table = scratch.write(table.groupBy("depth", "context", "symbol").agg(F.min("parent").alias("parent"), F.sum("n").alias("n")), "spelling")
    kept = table.groupBy("context").agg(F.sum("n").alias("mass")).where(F.col("mass") >= P_MIN * total).select("context")
    got = table.join(kept, "context").select("depth", "context", "parent", "symbol", "n").toPandas()
    scratch.drop("spelling")
    return build(got.astype({"depth": "int8", "symbol": "int16"}))


class Symbols:
    """What the upper layer sees of texts: a number for each token, and its contexts."""

    def __init__(self, listed: list[bytes], prefixes: list[int]):
        self.ids = {w: i for i, w in enumerate(listed, 1)}
        self.end = LISTED + 1
        self.size = LISTED + 2 + PREFIXES
        self.of_prefix = np.zeros(65536, np.int32)
        self.of_prefix[prefixes] = np.arange(len(prefixes)) + LISTED + 2

    def prefix(self, words: list[bytes]) -> np.ndarray:
        """Two bytes as a number; a word of one byte is followed by the space that ends it."""
        return np.array([(w[0] << 8) | (w[1] if len(w) > 1 else 32) for w in words], np.int64)

    def read(self, texts: list[list[bytes]], ids: dict[bytes, int]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(ids, symbols, suffix, whole, pair) of the tokens of some texts, each with its end; contexts that aren't there are -1.

        ids may number more words than the listed ones; listed words come first.
        """
        sizes = np.array([len(t) + 1 for t in texts])
        ends = np.cumsum(sizes) - 1
        number = np.zeros(sizes.sum(), np.int64)
        number[np.delete(np.arange(len(number)), ends)] = np.fromiter(map(ids.get, chain.from_iterable(texts), repeat(0)), np.int64, len(number) - len(texts))
        raw = np.frombuffer(b" ".join([b" ".join([*t, b"\n"]) for t in texts]) + b"  ", np.uint8).astype(np.int64)
        stop = np.flatnonzero(raw == 32)[: len(number)]
        start = np.r_[0, stop[:-1] + 1]
        first = self.of_prefix[(raw[start] << 8) | raw[start + 1]]
        symbol = np.where((number > 0) & (number <= LISTED), number, first)
        symbol[ends] = self.end
        last = np.where(stop - start > 1, (raw[stop - 2] << 8), 32 << 8) | raw[stop - 1]
        begins = np.r_[0, ends[:-1] + 1]
        seen = np.where(number <= LISTED, number, 0)
        suffix, whole, near, far = np.r_[0, last[:-1]], np.r_[0, seen[:-1]], np.r_[0, seen[:-1]], np.r_[0, 0, seen[:-2]]
        suffix[begins], whole[begins], far[begins] = 10, 0, 0
        far[begins[sizes > 1] + 1] = 0
        whole = np.where((whole > 0) & (whole <= WHOLE), whole, -1)
        pair = np.where((far > 0) & (far <= FAR), far * (NEAR + 1) + np.where(near <= NEAR, near, 0), -1)
        return number, symbol, suffix, whole, pair

    def hashes(self, texts: list[list[bytes]], number: np.ndarray, known: np.ndarray) -> np.ndarray:
        """A hash of each token, of those with a number from known; that of an end is 0."""
        out = known[number]
        at = np.delete(np.arange(len(number)), np.cumsum([len(t) + 1 for t in texts]) - 1)
        new = number[at] == 0
        out[at[new]] = word_hashes(compress(chain.from_iterable(texts), new.tolist()), np.count_nonzero(new))
        return out

    def open_codes(self, texts: list[list[bytes]], number: np.ndarray, h: np.ndarray, wanted: np.ndarray, pair: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
        """The codes, without symbols, of the words before the tokens (0 where wanted[its number] is false or none is before), and of the two words before.

        Those of pairs of the FAR and NEAR most frequent words are their numbers' codes.
        """
        rare, pairs = np.zeros(len(number), np.uint64), np.zeros(len(number), np.uint64)
        sizes = np.array([len(t) + 1 for t in texts])
        place = np.arange(len(number)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        at = np.flatnonzero(place > 0)
        at = at[wanted[number[at - 1]]]
        rare[at] = _code(h[at - 1])
        at = np.flatnonzero(place > 1)
        near = number[at - 1]
        mixed = _mix(_mix(h[at - 1] * _M + h[at - 2]))
        top = h[at - 1] >> np.uint64(64 - bits) << np.uint64(64 - bits)
        mixed = np.where((near > 0) & (near <= LISTED), mixed, top | mixed >> np.uint64(bits))
        pairs[at] = np.where(both_frequent(pair[at]), listed_codes(2, np.maximum(pair[at], 0)), _code(mixed))
        return rare, pairs


def both_frequent(pair: np.ndarray) -> np.ndarray:
    """Whether a pair's number names both of its words, not only the farther one."""
    return (pair >= 0) & (pair % (NEAR + 1) > 0)


def word_hashes(words, n: int) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, n)


def _code(h: np.ndarray) -> np.ndarray:
    return ((h >> np.uint64(12)) << np.uint64(1) | np.uint64(1)) << _SYMBOL


def rare_codes(words, n: int) -> np.ndarray:
    return _code(word_hashes(words, n))


def listed_codes(level: int, context: np.ndarray) -> np.ndarray:
    number = ((level + 1) << 28 | context).astype(np.uint64)
    return (number * np.uint64(_ODD) & _LOW52) << np.uint64(12)


def listed_numbers(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(level, context) of listed_codes."""
    number = ((codes >> np.uint64(12)) * np.uint64(_BACK) & _LOW52).astype(np.int64)
    return (number >> 28) - 1, number & 0xFFFFFFF


def _summed(codes: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(codes)
    codes, n = codes[order], n[order]
    first = np.flatnonzero(np.r_[True, codes[1:] != codes[:-1]])[: len(codes)]
    return codes[first], np.add.reduceat(n, first) if len(first) else n


def _added(codes: np.ndarray, n: np.ndarray, held: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Ascending codes and their counts (changed in place) with the codes of held added, and held emptied; what is in order already isn't sorted again."""
    new = np.concatenate(held)
    held.clear()
    new.sort()
    first = np.flatnonzero(np.r_[True, new[1:] != new[:-1]])[: len(new)]
    times, new = np.diff(np.r_[first, len(new)]).astype(n.dtype), new[first]
    if not len(codes):
        return new, times
    at = np.searchsorted(codes, new)
    known = codes[np.minimum(at, len(codes) - 1)] == new
    n[at[known]] += times[known]
    at, new, times = at[~known], new[~known], times[~known]
    return np.insert(codes, at, new), np.insert(n, at, times)


def _ranges(codes: np.ndarray, bits: int) -> tuple[np.ndarray, list[slice]]:
    """The ranges that ascending codes fall into, and the codes of each."""
    where = (codes >> np.uint64(64 - bits)).view(np.int64)
    first = np.flatnonzero(np.r_[True, where[1:] != where[:-1]])[: len(codes)]
    return where[first], [slice(a, b) for a, b in zip(first.tolist(), [*first[1:].tolist(), len(codes)], strict=True)]


def context_codes(symbols: Symbols, bits: int, pairs: bool = False):
    """A mapInPandas function: training texts to packed counts of (context, symbol), a row for each range; each task sums before it emits.

    pairs: those of two words that aren't both among the most frequent ones, too.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        give_back()
        codes, sums, held, n_held = np.empty(0, np.uint64), np.empty(0, np.uint32), [], 0
        unlisted = np.arange(LISTED + 1) == 0
        known = np.r_[np.zeros(1, np.uint64), word_hashes(symbols.ids, len(symbols.ids))]

        def packed() -> Iterator[pd.DataFrame]:
            ranges, parts = _ranges(codes, bits)
            for i in range(0, len(parts), TOGETHER):  # all at once would take several times the counts, here and in the JVM
                some = parts[i : i + TOGETHER]
                yield pd.DataFrame({"bucket": ranges[i : i + TOGETHER], "codes": [codes[x].tobytes() for x in some], "n": [sums[x].astype(np.uint32).tobytes() for x in some]})

        for frame in frames:
            texts = frame["text"][~frame["held_out"].astype(bool)].tolist()
            for i in range(0, len(texts), 256):
                part = [tokens_of(t) for t in texts[i : i + 256]]
                number, symbol, *levels = symbols.read(part, symbols.ids)
                symbol = symbol.astype(np.uint64)
                held += [listed_codes(level, c[ok]) | symbol[ok] for level, c in enumerate(levels) for ok in [c >= 0]]
                rare, both = symbols.open_codes(part, number, symbols.hashes(part, number, known), unlisted, levels[2], bits)
                both[both_frequent(levels[2])] = 0  # counted above
                held += [x[x > 0] | symbol[x > 0] for x in ([rare, both] if pairs else [rare])]
                n_held += len(symbol)
                if n_held > STEP:
                    (codes, sums), n_held = _added(codes, sums, held), 0
                    if len(codes) > HELD_CODES:
                        yield from packed()
                        codes, sums = codes[:0].copy(), sums[:0].copy()
        if held:
            codes, sums = _added(codes, sums, held)
        if len(codes):
            yield from packed()

    return run


def _groups(frames: Iterator[pd.DataFrame], key: str) -> Iterator[tuple[int, pd.DataFrame]]:
    """The rows of each key, of frames in the order of keys."""
    held, now = [], None
    for frame in frames:
        for k, part in frame.groupby(key, sort=False):
            if held and k != now:
                yield now, pd.concat(held)
                held = []
            now = k
            held.append(part)
    if held:
        yield now, pd.concat(held)


def _joined(blobs, kind) -> np.ndarray:
    return np.frombuffer(b"".join(blobs), kind)


def kept_contexts(root: np.ndarray, total: float, held: np.ndarray, bits: int = 8):
    """A mapInPandas function: packed counts in the order of ranges to those of the contexts that diverge from the empty one (root: its probabilities).

    Listed and rare contexts apart (the latter include frequent words' pairs below the share), which of the held words' contexts were
    kept, and the range's part of the table of bits for rare ones.
    """
    logs = np.log(root)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        give_back()
        for bucket, part in _groups(frames, "bucket"):
            codes, n = _summed(_joined(part["codes"], np.uint64), _joined(part["n"], np.uint32).astype(np.float64))
            context = codes >> _SYMBOL
            first = np.flatnonzero(np.r_[True, context[1:] != context[:-1]])
            names, seen, mass = context[first], np.diff(np.r_[first, len(codes)]), np.add.reduceat(n, first)
            gain = np.add.reduceat(n * (np.log(n) - logs[(codes & np.uint64(2047)).astype(np.int64)]), first) - mass * np.log(mass)
            level, number = listed_numbers(names << _SYMBOL)
            rare = ((names & np.uint64(1)) > 0) | (level == 2) & both_frequent(number) & (mass < P_UPPER * total)
            good = (gain >= DIVERGENCE * seen) & (mass >= np.where(rare, MASS, P_UPPER * total))
            some = [np.repeat(good & x, seen) for x in (~rare, rare)]
            found = held[held >> np.uint64(64 - bits) == bucket]
            found = found[np.isin(found >> _SYMBOL, names[good])]
            slots = np.zeros(1 << (SLOT_BITS - bits), bool)
            slots[_slot(names[good & rare] << _SYMBOL) & (len(slots) - 1)] = True
            yield pd.DataFrame({"bucket": bucket, "rare": [False, True], "codes": [codes[x].tobytes() for x in some], "n": [n[x].tobytes() for x in some], "held": [b"", found.tobytes()], "slots": [b"", np.packbits(slots).tobytes()]})

    return run


def _slot(codes: np.ndarray) -> np.ndarray:
    return (codes >> np.uint64(64 - SLOT_BITS)).astype(np.int64)


def _may_be_kept(codes: np.ndarray, slots: np.ndarray) -> np.ndarray:
    at = _slot(codes)
    return slots[at >> 3] >> (7 - (at & 7)).astype(np.uint8) & 1 > 0


class Distributions:
    """Counts of the rare contexts of one range, ascending by code."""

    def __init__(self, codes: np.ndarray, n: np.ndarray):
        self.codes, self.n = codes, n
        context = codes >> _SYMBOL
        first = np.flatnonzero(np.r_[True, context[1:] != context[:-1]])[: len(codes)]
        self.names, self.seen = context[first], np.diff(np.r_[first, len(codes)])
        self.mass = np.add.reduceat(n, first) if len(first) else n
        self.slots = np.zeros(int(_SLOTS) + 1, bool)
        self.slots[self.names & _SLOTS] = True

    def gains(self, codes: np.ndarray, p: np.ndarray) -> np.ndarray:
        """What the log10 probability of each (context, symbol) gains over p, that of its longest listed suffix; 0 if the context isn't kept."""
        out = np.zeros(len(codes))
        context = codes >> _SYMBOL
        at = np.flatnonzero(self.slots[context & _SLOTS])
        if len(at):
            row = np.minimum(np.searchsorted(self.names, context[at]), len(self.names) - 1)
            there = self.names[row] == context[at]
            at, row = at[there], row[there]
            code, p = codes[at], p[at].astype(np.float64)
            i = np.minimum(np.searchsorted(self.codes, code), len(self.codes) - 1)
            n = np.where(self.codes[i] == code, self.n[i], 0)
            out[at] = np.log10((n + self.seen[row] * p) / ((self.mass[row] + self.seen[row]) * p))
        return out


TABLE, ASK, PART, ANSWER = range(4)
#: What one scan of the texts yields: rows of parts, and packed positions to look up; then the answers to these.
MIXED = "kind int, bucket int, row long, doc_id string, held_out boolean, n_tokens long, known long, base double, own double, rest array<binary>, times array<int>, codes binary, pairs binary, rows binary, n binary"


def answered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows in the order of (bucket, kind): parts pass, positions become the sums of their gains for each document."""
    give_back()
    now, table = None, None
    for batch in batches:
        kinds = batch.column("kind").to_numpy()
        if (kinds == PART).any():
            yield batch.filter(pa.array(kinds == PART))
        out = []
        buckets = batch.column("bucket").to_numpy(zero_copy_only=False)
        for i in np.flatnonzero(kinds < PART).tolist():
            codes, n = (np.frombuffer(batch.column(c)[i].as_buffer(), t) for c, t in (("codes", np.uint64), ("n", np.float64 if kinds[i] == TABLE else np.float32)))
            if kinds[i] == TABLE:
                now, table = buckets[i], Distributions(codes, n)
            elif buckets[i] == now:
                gains = table.gains(codes, n)
                gains += table.gains(np.frombuffer(batch.column("pairs")[i].as_buffer(), np.uint64), n * 10**gains)
                rows = np.frombuffer(batch.column("rows")[i].as_buffer(), np.uint32)
                hit = gains != 0
                rows, inverse = np.unique(rows[hit], return_inverse=True)
                if len(rows):
                    out.append((batch.column("row")[i].as_py(), rows.tobytes(), np.bincount(inverse, gains[hit]).astype(np.float32).tobytes()))
        if out:
            first, rows, sums = zip(*out, strict=True)
            given = {"kind": [ANSWER] * len(out), "row": first, "rows": rows, "n": sums}
            yield pa.RecordBatch.from_arrays([pa.array(given[f.name], f.type) if f.name in given else pa.nulls(len(out), f.type) for f in batch.schema], schema=batch.schema)


def answers(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Answers in the order of their first rows to (row, gain)."""
    for first, part in _groups(frames, "row"):
        rows, inverse = np.unique(_joined(part["rows"], np.uint32), return_inverse=True)
        yield pd.DataFrame({"row": rows.astype(np.int64) + first, "s": np.bincount(inverse, _joined(part["n"], np.float32))})


class Upper:
    """Smoothed next-symbol distributions of the kept contexts."""

    def __init__(self, root: np.ndarray, codes: np.ndarray, counts: np.ndarray):
        """root: how often each symbol stands anywhere; codes and their counts: those of the listed contexts that are kept."""
        size = len(root)
        self.root = (root + 0.5) / (root.sum() + 0.5 * size)
        context = ((codes >> np.uint64(12)) * np.uint64(_BACK) & _LOW52).astype(np.int64)
        order = np.argsort(context, kind="stable")
        context, symbols, counts = context[order], (codes & np.uint64(2047)).astype(np.int64)[order], counts[order]
        names, starts = np.unique(context, return_index=True)
        groups = {k: (symbols[a:b], counts[a:b]) for k, a, b in zip(names.tolist(), starts.tolist(), [*starts[1:].tolist(), len(context)], strict=False)}
        self.suffix, self.whole = np.full(65536, -1, np.int32), np.full(WHOLE + 1, -1, np.int32)
        self.pair = np.full((FAR + 1) * (NEAR + 1), -1, np.int32)
        rows: list[list[np.ndarray]] = [[], [], []]
        rests: list[float] = []
        for code, (s, n) in sorted(groups.items()):
            level, context, mass = (code >> 28) - 1, code & 0xFFFFFFF, n.sum()
            row = np.zeros(size, np.float32)
            row[s] = n / (mass + len(s))
            (self.suffix, self.whole, self.pair)[level][context] = len(rows[level])
            rest = len(s) / (mass + len(s))
            if level == 0:
                row += (rest * self.root).astype(np.float32)
            elif level == 2:
                rests.append(rest)
            else:
                row = np.append(row, np.float32(rest))
            rows[level].append(row)
        shape = lambda r, w: np.array(r, np.float32).reshape(-1, w)
        self.suffix_rows, whole, self.pair_rows = shape(rows[0], size), shape(rows[1], size + 1), shape(rows[2], size)
        self.whole_rows, self.whole_rest, self.pair_rest = whole[:, :-1], whole[:, -1], np.array(rests, np.float32)

    def probability(self, symbol: np.ndarray, suffix: np.ndarray, whole: np.ndarray, pair: np.ndarray) -> np.ndarray:
        """That of each symbol in the state of its longest kept suffix of listed words."""
        p = self.root[symbol]
        for names, context, table, rest in ((self.suffix, suffix, self.suffix_rows, None), (self.whole, whole, self.whole_rows, self.whole_rest), (self.pair, pair, self.pair_rows, self.pair_rest)):
            row = names[context]
            at = np.flatnonzero((context >= 0) & (row >= 0))
            row = row[at]
            p[at] = table[row, symbol[at]] + (rest[row] * p[at] if rest is not None else 0)
        return p


def score(docs: DataFrame, held_mod: int = 5, held_is: int = 1) -> DataFrame:
    """The report's columns for every row of docs (doc_id, text); null texts are empty, an empty text is its end alone.

    Rows of equal ids are scored one by one. With nothing to learn from, all counts are 0.
    """
    scratch = Scratch(docs.sparkSession, "suffix-tree")
    small_batches(docs.sparkSession)
    docs = docs.select("doc_id", text_or_empty("text").alias("text"), (id_crc_mod("doc_id", held_mod) == held_is).alias("held_out"))
    words = scratch.write(docs.select("text", "held_out").mapInPandas(_counted, "word binary, c long").groupBy("word").agg(F.sum("c").alias("c")), "words")
    r = words.agg(F.sum("c").alias("n"), F.count_if(F.col("c") > 0).alias("v"), F.sum(F.when(F.col("word").isNull(), F.col("c"))).alias("ends")).first()
    n, v, ends = r["n"] or 0, r["v"], r["ends"] or 0
    scale = n + 0.5 * (v + 1)
    frequent = words.where((F.col("word").isNotNull()) & (F.col("c") > 0) & (F.octet_length("word") <= HELD_BYTES)).orderBy(F.desc("c"), "word")
    first = frequent.limit(LISTED).toPandas()
    listed, least = first["word"].tolist(), (int(first["c"].iloc[-1]), bytes(first["word"].iloc[-1])) if len(first) else (0, b"")
    is_listed = (F.octet_length("word") <= HELD_BYTES) & ((F.col("c") > least[0]) | (F.col("c") == least[0]) & (F.col("word") <= F.lit(bytearray(least[1])))) & (F.col("c") > 0)
    lower = words.where(F.col("word").isNotNull() & ~is_listed)
    stats = lower.groupBy(F.substring("word", 1, 2).alias("prefix")).agg(F.sum("c").alias("c"), F.sum((F.col("c") == 1).cast("long")).alias("once")).orderBy(F.desc("c"), "prefix").toPandas()  # a row for each two bytes
    prefix_number = [(p[0] << 8) | (p[1] if len(p) > 1 else 32) for p in map(bytes, stats["prefix"])]
    symbols = Symbols(listed, prefix_number[:PREFIXES])
    tree = learn(lower.where("c > 0"), scratch)
    # The lower layer's distribution: own counts, and beta of spelling for words that weren't seen.
    other, once = max(1, int(stats["c"].sum())), int(stats["once"].sum())
    beta = (once + 1) / (other + 2)
    mass = np.zeros(symbols.size)
    spelled = np.exp(tree.score([p.to_bytes(2, "big").strip(b" ") for p in prefix_number[:PREFIXES]])[0]) if prefix_number else np.empty(0)
    np.add.at(mass, symbols.of_prefix[prefix_number[:PREFIXES]], (1 - beta) * stats["c"].to_numpy(float)[:PREFIXES] / other + beta * spelled)
    mass[0] = max(1e-9, 1 - mass.sum())

    def scored(frames):
        give_back()
        for w, c in _chunks(frames, 50_000):
            own = (1 - beta) * c / other + beta * np.exp(np.maximum(tree.score(w)[1], -700))
            yield pd.DataFrame({"word": w, "c": c.astype(np.int64), "log": np.log10(np.minimum(1, own / mass[symbols.of_prefix[symbols.prefix(w)]]))})

    lexicon = scratch.write(lower.mapInPandas(scored, "word binary, c long, log double"), "lexicon")
    scratch.drop("words")
    top = lexicon.where((F.col("c") > 0) & (F.octet_length("word") <= HELD_BYTES)).orderBy(F.desc("c"), "word").limit(HELD).toPandas()
    held_words = listed + top["word"].tolist()
    held_base = np.log10((np.r_[ends, first["c"].to_numpy(float), top["c"].to_numpy(float)] + 0.5) / scale)
    held_log = np.r_[np.zeros(len(listed) + 1), top["log"].to_numpy(float)]

    # The upper layer: the empty context from the counts of words, the others from the texts.
    root = np.zeros(symbols.size)
    root[1 : len(listed) + 1], root[symbols.end] = first["c"], ends
    np.add.at(root, symbols.of_prefix[prefix_number], stats["c"])
    bits = min(MOST_BITS, max(8, math.ceil(math.log2(max(1, v) / RANGE)), math.ceil(math.log2(max(1, n) / RANGE_TOKENS))))
    held_codes = np.sort(rare_codes(held_words[LISTED:], len(held_words[LISTED:])))
    counts = docs.select("text", "held_out").mapInPandas(context_codes(symbols, bits, pairs=True), "bucket int, codes binary, n binary").repartition("bucket").sortWithinPartitions("bucket")
    kept = kept_contexts((root + 0.5) / (root.sum() + 0.5 * symbols.size), root.sum(), held_codes, bits)
    contexts = scratch.write(counts.mapInPandas(kept, "bucket int, rare boolean, codes binary, n binary, held binary, slots binary"), "contexts")
    got = contexts.where(~F.col("rare")).select("codes", "n").toPandas()
    upper = Upper(root, _joined(got["codes"], np.uint64), _joined(got["n"], np.float64))
    got = contexts.where("rare").select("bucket", "held", "slots").toPandas()  # as many bits as the table has, and held words' contexts
    found = _joined(got["held"], np.uint64)
    slots = np.zeros((1 << bits, 1 << (SLOT_BITS - bits - 3)), np.uint8)
    slots[got["bucket"].to_numpy(np.int64)] = _joined(got["slots"], np.uint8).reshape(-1, slots.shape[1])
    slots = slots.reshape(-1)
    hashes = np.r_[np.zeros(1, np.uint64), word_hashes(held_words, len(held_words))]
    wanted = np.arange(len(held_words) + 1) == 0  # what isn't held is always looked up
    wanted[LISTED + 1 :] = np.isin(rare_codes(held_words[LISTED:], len(held_words[LISTED:])), found)

    # Within the function it would lie in each worker twice, packed and unpacked.
    shared = docs.sparkSession.sparkContext.broadcast((upper, held_words, held_base, held_log, slots, hashes, wanted))
    n_listed = len(listed)

    def parts(frames):
        give_back()
        upper, held_words, held_base, held_log, slots, hashes, wanted = shared.value
        held = {w: i for i, w in enumerate(held_words, 1)}
        if n_listed < LISTED:  # fewer words than numbers: nothing else is held
            held = dict(symbols.ids)
        asked, n_asked, start = [], 0, 0

        def packed() -> pd.DataFrame:
            codes, pairs, rows, p = (np.concatenate(x) for x in zip(*asked, strict=True))
            asked.clear()
            key = np.where(pairs > 0, pairs, codes)
            order = np.argsort(key)
            codes, pairs, rows, p = codes[order], pairs[order], rows[order], p[order]
            ranges, at = _ranges(key[order], bits)
            empty = {"doc_id": None, "held_out": False, "n_tokens": 0, "known": 0, "base": 0.0, "own": 0.0, "rest": None, "times": None}
            return pd.DataFrame({"kind": ASK, "bucket": ranges, "row": start, "codes": [codes[x].tobytes() for x in at], "pairs": [pairs[x].tobytes() for x in at], "rows": [rows[x].tobytes() for x in at], "n": [p[x].tobytes() for x in at]}).assign(**empty)

        for frame in frames:
            for i in range(0, len(frame), 128):
                part = frame.iloc[i : i + 128]
                texts = [tokens_of(t) for t in part["text"]]
                number, symbol, suffix, whole, pair = symbols.read(texts, held)
                sizes = np.array([len(t) + 1 for t in texts])
                starts = np.cumsum(sizes) - sizes
                known = number > 0
                known[starts + sizes - 1] = ends > 0
                base = np.where(number > 0, held_base[number], 0)
                base[starts + sizes - 1] = held_base[0]
                p = upper.probability(symbol, suffix, whole, pair)
                rare, both = symbols.open_codes(texts, number, symbols.hashes(texts, number, hashes), wanted, pair, bits)
                both[both_frequent(pair) & (upper.pair[pair] >= 0) | ~_may_be_kept(both, slots)] = 0  # what a worker holds, or what isn't kept
                behind = np.flatnonzero((rare > 0) | (both > 0))
                if len(behind):
                    row = part["row"].to_numpy()
                    start = start if asked else int(row[0])
                    rare, both = ((x := c[behind]) | np.where(x > 0, symbol[behind], 0).astype(np.uint64) for c in (rare, both))
                    asked.append((rare, both, np.repeat(row - start, sizes)[behind].astype(np.uint32), p[behind].astype(np.float32)))
                    n_asked += len(behind)
                own = np.log10(p) + held_log[number]
                rest = [Counter(t[j] for j in np.flatnonzero(number[s : s + len(t)] == 0).tolist()) for s, t in zip(starts.tolist(), texts, strict=True)]
                sums = [np.add.reduceat(x, starts) for x in (known.astype(np.int64), base, own)]
                yield pd.DataFrame({"kind": PART, "bucket": part["row"] % (1 << bits), "row": part["row"], "doc_id": part["doc_id"], "held_out": part["held_out"], "n_tokens": sizes, "known": sums[0], "base": sums[1], "own": sums[2], "rest": [list(c) for c in rest], "times": [list(c.values()) for c in rest], "codes": None, "pairs": None, "rows": None, "n": None})
                if n_asked > ASKED:
                    yield packed()
                    n_asked = 0
        if asked:
            yield packed()

    rows = docs.withColumn("row", F.monotonically_increasing_id()).withColumn("doc_id", F.col("doc_id").cast("string"))
    tables = contexts.where(F.col("rare") & (F.octet_length("codes") > 0)).select(F.lit(TABLE).alias("kind"), "bucket", "codes", "n")
    mixed = rows.mapInPandas(parts, MIXED).unionByName(tables, allowMissingColumns=True)
    mixed = scratch.write(mixed.repartition("bucket").sortWithinPartitions("bucket", "kind").mapInArrow(answered, MIXED), "parts")
    scratch.drop("contexts")
    shared.destroy()  # else it stays in the driver, too, until its garbage is collected
    part = id_again(mixed.where(F.col("kind") == PART), docs)
    gains = mixed.where(F.col("kind") == ANSWER).select("row", "rows", "n").repartition("row").sortWithinPartitions("row").mapInPandas(answers, "row long, s double")
    rest = part.select("row", F.explode(F.arrays_zip("rest", "times")).alias("x")).select("row", F.col("x.rest").alias("word"), F.col("x.times").alias("k"))
    looked = rest.join(lexicon, "word").select("row", F.when(F.col("c") > 0, F.col("k")).otherwise(0).alias("k"), (F.col("k") * F.log10((F.col("c") + 0.5) / scale)).alias("b"), (F.col("k") * F.col("log")).alias("s"))
    each = looked.unionByName(gains.select("row", F.lit(0).alias("k"), F.lit(0.0).alias("b"), "s")).groupBy("row").agg(F.sum("k").alias("k"), F.sum("b").alias("b"), F.sum("s").alias("s"))
    zero = lambda c: F.coalesce(c, F.lit(0))
    return part.select("row", "doc_id", "held_out", "n_tokens", "known", "base", "own").join(each, "row", "left").select("doc_id", "held_out", "n_tokens", (F.col("known") + zero("k")).alias("n_known"), F.lit(n).cast("long").alias("train_tokens"), (F.col("base") + zero("b")).alias("base_score"), (F.col("own") + zero("s")).alias("score"))
