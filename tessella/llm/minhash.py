"""Near-duplicate documents by circulant MinHash, banding and exact Jaccard verification.

Two permutations of the 32-bit numbers make every coordinate: the first scatters a document's
shingles, the second is applied after a circular shift by the coordinate's number, and the least
value is the coordinate. Documents that agree in all coordinates of a band share a bucket. Pairs of a
bucket are confirmed on the full sets. A bucket is never expanded into all its pairs: each member is
compared with one pivot, then with the member that has the most links so far. Members that are still
outside their bucket's largest component are held against that component and each other in blocks:
a pair of blocks is one row, its intersections one matrix product, and only links come out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from .common import Scratch, id_again, id_text, private
from .components import components

BANDS, ROWS = 40, 6
#: Documents to a block, blocks to a side of one task's share of the last round, and shingles that are multiplied at once.
BLOCK, GRID, COLUMNS = 128, 16, 8192
#: Shifts and shingles that are handled at once, so that the arrays stay in cache.
_SHIFTS, _SHINGLES = 48, 1024


def _mix64(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_set(text: str | None, words: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word shingles; a text of fewer words is one shingle, one without words none.

    A-Z are lower-cased; words are split at ASCII white space.
    """
    found = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    if not found:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, found), np.uint64, len(found))
    width = min(words, len(h))
    s = np.full(len(h) - width + 1, width, np.uint64)
    for j in range(width):
        s = _mix64(s * np.uint64(0x9E3779B97F4A7C15) + h[j : len(h) - width + 1 + j])
    return np.unique(s)


def signature(shingles: np.ndarray, size: int = BANDS * ROWS) -> np.ndarray:
    """The circulant MinHash coordinates of a set that isn't empty."""
    x = (shingles >> np.uint64(32)).astype(np.uint32)  # the first permutation: a mixed hash's upper half
    x = (x ^ (x >> np.uint32(15))) * np.uint32(0x2C1B3C6D)
    x ^= x >> np.uint32(12)
    out = np.full(size, 0xFFFFFFFF, np.uint32)
    shifts = np.arange(1, size + 1, dtype=np.uint32)[:, None]
    for a in range(0, size, _SHIFTS):
        for b in range(0, len(x), _SHINGLES):
            y = x[None, b : b + _SHINGLES] + shifts[a : a + _SHIFTS]  # modulo 2**32: a circular shift
            y ^= y >> np.uint32(16)
            y *= np.uint32(0x7FEB352D)
            y ^= y >> np.uint32(15)
            y *= np.uint32(0x846CA68B)
            np.minimum(out[a : a + _SHIFTS], y.min(axis=1), out=out[a : a + _SHIFTS])
    return out


def bands(sig: np.ndarray) -> np.ndarray:
    """A 64-bit bucket for each band."""
    rows = sig.reshape(BANDS, ROWS).astype(np.uint64)
    out = np.arange(BANDS, dtype=np.uint64)
    for j in range(ROWS):
        out = _mix64(out * np.uint64(0x9E3779B97F4A7C15) + rows[:, j])
    return out.view(np.int64)


def _signed(words: int):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for key, text in zip(frame["doc_id"], frame["text"], strict=True):
                s = shingle_set(text, words)
                name = xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None
                rows.append((key, len(s), name, bands(signature(s)) if len(s) else None))
            yield pd.DataFrame(rows, columns=["doc_id", "n_shingles", "set_key", "bands"])

    return run


def _sets(words: int):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield pd.DataFrame({"id": frame["doc_id"], "s": [shingle_set(t, words).view(np.int64) for t in frame["text"]]})

    return run


def _block_links(percent: int):
    """Rows of two blocks of sets to the links (u, v) between different components."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for r in frame.itertuples(index=False):
                na, nb = np.asarray(r.na, np.int64), np.asarray(r.nb, np.int64)
                x, y = np.asarray(r.sa, np.int64), np.asarray(r.sb, np.int64)
                common = np.intersect1d(x, y)
                both = np.zeros((len(na), len(nb)), np.float32)
                ends = [(np.repeat(np.arange(len(n)), n), z, np.searchsorted(common, z)) for n, z in ((na, x), (nb, y))]
                ends = [(o[ok], c[ok]) for o, z, c in ends for ok in [common[np.minimum(c, len(common) - 1)] == z if len(common) else np.zeros(len(z), bool)]]
                for at in range(0, len(common), COLUMNS):
                    m = []
                    for (owner, column), n in zip(ends, (na, nb), strict=True):
                        ok = (column >= at) & (column < at + COLUMNS)
                        part = np.zeros((len(n), min(COLUMNS, len(common) - at)), np.float32)
                        part[owner[ok], column[ok] - at] = 1
                        m.append(part)
                    both += m[0] @ m[1].T
                i = both.astype(np.int64)
                linked = (100 * i >= percent * (na[:, None] + nb[None] - i)) & (np.asarray(r.ca)[:, None] != np.asarray(r.cb)[None])
                u, v = np.nonzero(linked)
                yield pd.DataFrame({"u": np.asarray(r.ia)[u], "v": np.asarray(r.ib)[v]})

    return run


def _rest(left: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links between the members of mixed buckets that are in different components.

    A group is the largest component of a bucket with the other members of all such buckets. Only
    those others are queries; they are held against the whole group, in blocks of about BLOCK. The
    grid of a group's block pairs is cut into cells of GRID x GRID, so no task gets a whole group.
    """
    major = left.groupBy("bucket", "component").agg(F.count("*").alias("n")).groupBy("bucket").agg(F.max(F.struct("n", "component")).alias("m")).select("bucket", F.col("m.component").alias("group"))
    g = left.join(major, "bucket").select("group", "id", "component").distinct()
    g = g.withColumn("query", F.col("component") != F.col("group"))
    count = g.groupBy("group").agg(F.count("*").alias("n"), F.count_if(F.col("query")).alias("q"))
    g = g.join(count, "group").join(sets, "id")

    def blocks(rows: DataFrame, own: str, other: str, tag: str) -> DataFrame:
        """Blocks of rows, each in every cell (row, col) of the group's grid in which it meets the other side's blocks."""
        count = lambda n: F.ceil(F.col(n) / BLOCK)
        rows = rows.withColumn("block", F.pmod(F.xxhash64("id"), count(own)))
        rows = rows.groupBy("group", "q", "n", "block").agg(F.collect_list(F.struct("id", "component", "s")).alias("x"))
        mine, met = ("row", "col") if own == "q" else ("col", "row")
        cells = F.explode(F.sequence(F.lit(0).cast("long"), F.floor((count(other) - 1) / GRID)))
        return rows.select("group", F.floor(F.col("block") / GRID).alias(mine), cells.alias(met), F.col("x.id").alias(f"i{tag}"), F.col("x.component").alias(f"c{tag}"), F.transform("x.s", F.size).alias(f"n{tag}"), F.flatten("x.s").alias(f"s{tag}"))

    at = ["group", "row", "col"]
    pairs = blocks(g.where("query"), "q", "n", "a").join(blocks(g, "n", "q", "b"), at).drop(*at)
    return pairs.mapInPandas(_block_links(percent), "u long, v long")


def near_duplicates(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for every row of docs (doc_id, text).

    Documents are linked if 100 * intersection >= percent * union of their shingle sets;
    component_id is the smallest doc_id reachable. Null and empty texts have no shingles and no
    links. Rows of equal ids are one node of the graph. A row with a null id links with nothing;
    its component is null and it is kept. At 0.8 a pair shares no band once in 190,000 times.
    """
    if not isinstance(docs.schema["doc_id"].dataType, IntegralType):
        raise TypeError("doc_id must be an integer: components are named by the smallest one")
    spark = docs.sparkSession
    scratch = Scratch(spark, "minhash")
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    signed = docs.select(id_text(docs), "text").mapInPandas(_signed(words), "doc_id string, n_shingles long, set_key binary, bands array<long>")
    signed = scratch.write(id_again(signed, docs), "signed")
    own = signed.where("doc_id IS NOT NULL AND n_shingles > 0")
    # Equal sets are one node, named by the least id; copies go no further.
    reps = scratch.write(own.groupBy("set_key").agg(F.min("doc_id").alias("rep")), "reps")
    nodes = own.join(reps, (own["set_key"] == reps["set_key"]) & (own["doc_id"] == reps["rep"]), "left_semi").select("doc_id", "bands", "set_key").dropDuplicates(["set_key"])
    member = nodes.select(F.explode("bands").alias("bucket"), F.col("doc_id").alias("id"))
    pivot = member.groupBy("bucket").agg(F.min("id").alias("pivot"), F.max("id").alias("top"), F.count("*").alias("n")).where("pivot < top").drop("top")
    member = scratch.write(member.join(pivot, "bucket"), "member")
    involved = member.select(F.col("id").alias("doc_id")).distinct()
    sets = scratch.write(docs.join(involved, "doc_id", "left_semi").mapInPandas(_sets(words), "id long, s array<long>"), "sets")

    def confirmed(pairs: DataFrame, name: str) -> DataFrame:
        """The links (u, v) among the pairs (a, b, n), n being how many may meet this a.

        One a may meet a third of all rows: its pairs are dealt to parts of about BLOCK, and its set goes to each part once.
        """
        pairs = pairs.select("a", "b", F.pmod(F.xxhash64("b"), F.ceil(F.col("n") / BLOCK)).alias("part"))
        a = pairs.select("a", "part").distinct().join(sets.select(F.col("id").alias("a"), F.col("s").alias("sa")), "a")
        b = sets.select(F.col("id").alias("b"), F.col("s").alias("sb"))
        both = F.size(F.array_intersect("sa", "sb")).cast("long")
        # Sets whose sizes alone rule the link out aren't compared.
        sized = (100 * F.least(F.size("sa"), F.size("sb")) >= percent * F.greatest(F.size("sa"), F.size("sb")))
        joined = pairs.join(b, "b").join(a, ["a", "part"]).where(sized)
        joined = joined.select("a", "b", both.alias("i"), (F.size("sa") + F.size("sb")).cast("long").alias("n"))
        return scratch.write(joined.where(100 * F.col("i") >= percent * (F.col("n") - F.col("i"))).select(F.col("a").alias("u"), F.col("b").alias("v")), name)

    def split(comp: DataFrame) -> DataFrame:
        """The members of buckets that hold more than one component."""
        m = member.join(comp, "id", "left").withColumn("component", F.coalesce("component", "id"))
        mixed = m.groupBy("bucket").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo < hi").select("bucket")
        return m.join(mixed, "bucket")

    def apart(comp: DataFrame, more: DataFrame, turn: int) -> tuple[DataFrame, DataFrame]:
        """The components with more edges, and the members that still meet other components in a bucket."""
        comp = components(comp.select(F.col("id").alias("u"), F.col("component").alias("v")).unionByName(more), scratch, f"cc{turn}_")
        return comp, scratch.write(split(comp), f"left{turn}")

    edges = confirmed(member.where("id != pivot").groupBy(F.col("pivot").alias("a"), F.col("id").alias("b")).agg(F.max("n").alias("n")), "edges1")
    comp = components(edges, scratch, "cc1_")
    left = scratch.write(split(comp), "left1")
    if left.head(1):
        ends = edges.select(F.col("u").alias("id")).unionByName(edges.select(F.col("v").alias("id"))).groupBy("id").agg(F.count("*").alias("links"))
        hub = left.join(ends, "id", "left").groupBy("bucket").agg(F.max(F.struct(F.coalesce("links", F.lit(0)).alias("links"), (-F.col("id")).alias("id"))).alias("h"))
        star = left.join(hub, "bucket").select((-F.col("h.id")).alias("hub"), "id", "component", "pivot", "n").where("id != hub AND hub != pivot AND id != pivot")
        at = left.select(F.col("id").alias("hub"), F.col("component").alias("hub_component")).distinct()
        star = star.join(at, "hub").where("component != hub_component").groupBy(F.col("hub").alias("a"), F.col("id").alias("b")).agg(F.max("n").alias("n"))
        more = confirmed(star, "edges2")
        comp, left = apart(comp, more, 2)
        if left.head(1):
            comp, _ = apart(comp, scratch.write(_rest(left, sets, percent), "edges3"), 3)
    found = signed.select("doc_id", "n_shingles", "set_key").join(reps, "set_key", "left").join(comp.withColumnRenamed("id", "rep"), "rep", "left")
    found = found.select("doc_id", "n_shingles", F.coalesce("component", "rep", "doc_id").alias("component_id"))
    return found.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def dedup(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """One row of each group of near copies, with all its columns: the one of the smallest doc_id, null ids last.

    Rows are told apart even if they share an id or have none. Texts without words are no copies of each other; all stay.
    """
    key, id_ = private("row"), private("id")
    ids = docs.select("doc_id").groupBy("doc_id").count().where("doc_id IS NULL OR count > 1")
    if not ids.head(1):  # each id names a row
        kept = near_duplicates(docs, words, percent).where("kept").select(F.col("doc_id").alias(id_))
        return docs.join(kept, F.col("doc_id") == F.col(id_), "left_semi")
    rows = Scratch(docs.sparkSession, "dedup").write(docs.withColumn(key, F.monotonically_increasing_id()), "rows")
    group = near_duplicates(rows.select(F.col(key).alias("doc_id"), "text"), words, percent).select(F.col("doc_id").alias(id_), "component_id")
    own = rows.select(key, "doc_id").join(group, F.col(key) == F.col(id_))
    first = own.groupBy("component_id").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", key)).alias("first"))
    return rows.join(first.select(F.col(f"first.{key}").alias(id_)), F.col(key) == F.col(id_), "left_semi").drop(key)


REPORT_SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(ws[i:i + least(len(ws), 2) - 1], ' ') AS g
      FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 1, 1) + 1)) AS i FROM w WHERE len(ws) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
i AS (SELECT a.doc_id AS u, b.doc_id AS v, count(*) AS i FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
e AS (SELECT u, v FROM i JOIN n x ON x.doc_id = u JOIN n y ON y.doc_id = v WHERE 100 * i >= 80 * (x.n + y.n - i)),
r(id, c) AS (SELECT doc_id, doc_id FROM w UNION SELECT e.u, r.c FROM r JOIN e ON e.v = r.id)
SELECT w.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, min(r.c) AS component_id, w.doc_id = min(r.c) AS kept
FROM w LEFT JOIN n USING (doc_id) JOIN r ON r.id = w.doc_id GROUP BY w.doc_id, n.n
"""
