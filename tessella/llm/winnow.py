"""Benchmark decontamination by winnowing, in DataFrame functions only.

Words are hashed, k-word grams hashed from those, and of every `ngram - k + 1` neighbouring grams the
least is kept as a fingerprint with its place. A span of `ngram` words that stands in a document and
in an item has the same grams, so both keep the same fingerprint of it: joining the fingerprints
finds every such span. Hits are then extended: each place where a fingerprint met is compared with
all item windows that hold the fingerprint, and the spans of those that are equal are united.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import private, text_or_empty

#: All that is not a word character once A-Z are lower case.
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: A fingerprint is a gram's hash above, its place below these bits.
PLACE_BITS = 24


def words_of(text: str | Column) -> Column:
    """Lower-cased (A-Z) words; null and empty texts have none."""
    low = F.translate(text_or_empty(text), string.ascii_uppercase, string.ascii_lowercase)
    return F.array_remove(F.split(low, SEPARATORS), "")


def _steps(count: Column) -> Column:
    """0 .. count-1, or nothing."""
    return F.when(count > 0, F.sequence(F.lit(0), count - 1)).otherwise(F.array().cast("array<int>"))


def _join(words: Column, start: Column, length: Column | int) -> Column:
    return F.xxhash64(F.array_join(F.slice(words, start + 1, length), " "))


def fingerprints(df: DataFrame, words: str, ngram: int, k: int, out: str = "prints") -> DataFrame:
    """Adds `out`: the distinct fingerprints of `words`, packed as hash and place."""
    window, h, g = ngram - k + 1, private("hashes"), private("grams")
    df = df.withColumn(h, F.transform(words, lambda w: F.xxhash64(w)))
    gram = lambda i: F.xxhash64(*[F.get(h, i + j) for j in range(k)])
    packed = lambda i: F.shiftleft(F.shiftrightunsigned(gram(i), PLACE_BITS), PLACE_BITS).bitwiseOR(i.cast("long").bitwiseAND(F.lit((1 << PLACE_BITS) - 1)))
    df = df.withColumn(g, F.transform(_steps(F.size(h) - (k - 1)), packed))
    least = F.transform(_steps(F.size(g) - (window - 1)), lambda i: F.array_min(F.slice(g, i + 1, window)))
    return df.withColumn(out, F.array_distinct(least)).drop(h, g)


def item_windows(bench: DataFrame, ngram: int, k: int) -> DataFrame:
    """(gram, length, shift, window, item_id): for every fingerprint of an item the windows around it.

    Items of fewer words than `ngram` are one window of their own length, found by its own hash.
    Null ids and items without words are left out; repeated rows count once.
    """
    items = bench.select("item_id", words_of("text").alias("words")).where(F.col("item_id").isNotNull() & (F.size("words") > 0)).distinct()
    n = F.size("words")
    long = fingerprints(items.where(n >= ngram), "words", ngram, k).select("item_id", "words", F.explode_outer("prints").alias("print")).where("print IS NOT NULL")
    place = F.col("print").bitwiseAND(F.lit((1 << PLACE_BITS) - 1)).cast("int")
    long = long.withColumn("place", place).withColumn("j", F.explode(F.sequence(F.greatest(F.lit(0), F.col("place") - (ngram - k)), F.least(F.col("place"), n - ngram))))
    long = long.select(F.shiftrightunsigned("print", PLACE_BITS).alias("gram"), F.lit(ngram).alias("length"), (F.col("place") - F.col("j")).alias("shift"), _join(F.col("words"), F.col("j"), ngram).alias("window"), "item_id")
    whole = F.xxhash64(F.array_join("words", " "))
    short = items.where(n < ngram).select(whole.alias("gram"), n.alias("length"), F.lit(0).alias("shift"), whole.alias("window"), "item_id")
    return long.unionByName(short).distinct()


def hits(docs: DataFrame, bench: DataFrame, ngram: int = 13, k: int = 5) -> DataFrame:
    """Every document with `n_words` and `found`: its distinct (start, length, item_id) that equal an item's window.

    docs has doc_id and text, bench item_id and text; other columns of docs stay, but for those named as the added ones.
    Null and empty texts have no words and no hits. Rows of equal or null ids are told apart by their texts.
    """
    windows = item_windows(bench, ngram, k)
    # Only lengths below ngram: at most ngram - 1 values.
    short = sorted(r[0] for r in windows.where(F.col("length") < ngram).select("length").distinct().collect())
    d = docs.select("doc_id", F.xxhash64("text").alias("own"), words_of("text").alias("words"))
    d = fingerprints(d, "words", ngram, k)
    mask = F.lit((1 << PLACE_BITS) - 1)
    marks = F.transform("prints", lambda p: F.struct(F.shiftrightunsigned(p, PLACE_BITS).alias("gram"), F.lit(ngram).alias("length"), p.bitwiseAND(mask).cast("int").alias("place")))

    def whole(m: int) -> Column:
        """All places of m words with their hashes."""
        return F.transform(_steps(F.size("words") - (m - 1)), lambda i: F.struct(_join(F.col("words"), i, m).alias("gram"), F.lit(m).alias("length"), i.alias("place")))

    for m in short:
        marks = F.concat(marks, whole(m))
    # An inner explode would make Spark test the array's size below, by working it out again in full.
    met = d.select("doc_id", "own", F.explode_outer(marks).alias("m")).where("m IS NOT NULL").select("doc_id", "own", "m.*").join(windows, ["gram", "length"])
    id_, own, near, words = (private(x) for x in ("id", "own", "near", "words"))
    met = met.groupBy(F.col("doc_id").alias(id_), F.col("own").alias(own)).agg(F.collect_set(F.struct((F.col("place") - F.col("shift")).alias("start"), "length", "window", "item_id")).alias(near))
    out = docs.join(met, docs["doc_id"].eqNullSafe(F.col(id_)) & (F.xxhash64(docs["text"]) == F.col(own)), "left").drop(id_, own).withColumn(words, words_of(docs["text"]))
    n = F.size(words)
    # A text of over 2**24 words is tried at every place that has the same low bits.
    turns = F.transform(F.sequence(F.lit(0), F.shiftright(n, PLACE_BITS)), lambda t: F.transform(near, lambda c: c.withField("start", c["start"] + F.shiftleft(t, PLACE_BITS))))
    tried = F.when(n < 1 << PLACE_BITS, F.col(near)).otherwise(F.flatten(turns))
    equal = lambda c: (c["start"] >= 0) & (c["start"] + c["length"] <= n) & (_join(F.col(words), c["start"], c["length"]) == c["window"])
    found = F.transform(F.filter(tried, equal), lambda c: F.struct(c["start"], c["length"], c["item_id"]))
    found = F.when(F.col(near).isNull(), F.array().cast(f"array<struct<start:int,length:int,item_id:{bench.schema['item_id'].dataType.simpleString()}>>")).otherwise(F.array_sort(found))
    return out.withColumns({"n_words": n.cast("long"), "found": found}).drop(near, words)


def covered(found: str | Column) -> Column:
    """How many words lie in one or more of the sorted spans."""
    start = F.struct(F.lit(0).alias("end"), F.lit(0).cast("long").alias("total"))

    def step(a, s):
        end = s["start"] + s["length"]
        return F.struct(F.greatest(a["end"], end).alias("end"), (a["total"] + F.greatest(F.lit(0), end - F.greatest(s["start"], a["end"]))).cast("long").alias("total"))

    return F.aggregate(found, start, step, lambda a: a["total"])


def decontaminate(docs: DataFrame, bench: DataFrame, ngram: int = 13, k: int = 5, share: int = 20) -> DataFrame:
    """Every row of docs with n_words, found, n_hit, items and contaminated (share * n_hit >= n_words, and any hit).

    Null or empty texts: no words, not contaminated. An empty benchmark contaminates nothing.
    Columns of docs that are named as these are replaced.
    """
    out = hits(docs, bench, ngram, k).withColumn("n_hit", covered("found"))
    out = out.withColumn("items", F.array_sort(F.array_distinct(F.transform("found", lambda s: s["item_id"].cast("string")))))
    return out.withColumn("contaminated", (F.col("n_hit") > 0) & (share * F.col("n_hit") >= F.col("n_words")))


def report(docs: DataFrame, bench: DataFrame) -> DataFrame:
    """Per document, the counts and the digest of the items found."""
    out = decontaminate(docs.select("doc_id", "text"), bench)
    return out.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"), "contaminated")


REPORT_SQL = r"""
WITH w AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS ws FROM documents),
b AS (SELECT DISTINCT item_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS ws FROM benchmark WHERE item_id IS NOT NULL),
win AS (SELECT DISTINCT item_id, least(len(ws), 13) AS l, array_to_string(ws[j:j + least(len(ws), 13) - 1], ' ') AS t
        FROM (SELECT item_id, ws, unnest(range(1, greatest(len(ws) - 12, 1) + 1)) AS j FROM b WHERE len(ws) > 0)),
lens AS (SELECT DISTINCT l FROM win),
g AS (SELECT doc_id, l, i, array_to_string(ws[i:i + l - 1], ' ') AS t
      FROM (SELECT doc_id, ws, l, unnest(range(1, len(ws) - l + 2)) AS i FROM w CROSS JOIN lens WHERE len(ws) >= l)),
h AS (SELECT g.doc_id, g.i, g.l, win.item_id FROM g JOIN win ON g.t = win.t AND g.l = win.l),
p AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + l)) AS p FROM h) GROUP BY doc_id),
it AS (SELECT doc_id, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS s FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS s FROM h) GROUP BY doc_id)
SELECT w.doc_id, len(w.ws)::BIGINT AS n_words, coalesce(p.n_hit, 0)::BIGINT AS n_hit, coalesce(it.n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(it.s, '')) AS items_sha256, coalesce(p.n_hit, 0) > 0 AND 20 * coalesce(p.n_hit, 0) >= len(w.ws) AS contaminated
FROM w LEFT JOIN p USING (doc_id) LEFT JOIN it USING (doc_id)
"""
