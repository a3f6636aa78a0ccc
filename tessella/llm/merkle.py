"""Merkle-tree fingerprints of documents, in DataFrame functions only.

A text is cut into paragraphs (lines) and each paragraph into leaves of up to four words (64
characters of a word count as one). A leaf is hashed, a paragraph hashes its leaves, a section
hashes up to eight neighbouring paragraphs and the root hashes the sections. The fingerprint is
`root:sections:paragraphs:leaves` with hashes of 32 bits below the root, so equal roots tell equal
texts and differing branches tell where two texts differ; it grows with the text, as the tree does.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import private, text_or_empty

#: Hexadecimal digits of a hash below the root.
DIGITS = 8
LEAF = r"(?:[^\x09-\x0D\x20]{1,64}[\x09-\x0D\x20]*){1,4}|[\x09-\x0D\x20]+"
SECTION = 8
#: Ids that differ only in their lowest bits make a bucket; a bucket and its next document meet in one task.
BUCKET_BITS = 8
#: Buckets to a group, in bits.
GROUP_BITS = 12


def with_fingerprint(df: DataFrame, text: str, fingerprint: str, leaves: str) -> DataFrame:
    """Adds the fingerprint of the column `text` and its distinct leaf hashes; a null counts as empty."""
    lv, pv, sv = private("leaves"), private("paragraphs"), private("sections")
    para = F.split(text_or_empty(text), "\n")
    df = df.withColumn(lv, F.transform(para, lambda p: F.transform(F.regexp_extract_all(p, F.lit(LEAF), F.lit(0)), F.md5)))
    df = df.withColumn(pv, F.transform(lv, lambda x: F.md5(F.array_join(x, ""))))
    sections = F.sequence(F.lit(0), F.floor((F.size(pv) - 1) / SECTION).cast("int"))
    df = df.withColumn(sv, F.transform(sections, lambda i: F.md5(F.array_join(F.slice(pv, i * SECTION + 1, SECTION), ""))))
    short = lambda xs: F.array_join(F.transform(xs, lambda x: F.substring(x, 1, DIGITS)), ".")
    root = F.sha2(F.array_join(sv, "").cast("binary"), 256)
    leaf_part = F.array_join(F.transform(lv, short), "/")
    df = df.withColumn(fingerprint, F.concat_ws(":", root, short(sv), short(pv), leaf_part))
    df = df.withColumn(leaves, F.array_distinct(F.transform(F.flatten(lv), lambda x: F.substring(x, 1, DIGITS))))
    return df.drop(lv, pv, sv)


def leaves_of(fingerprint: str | Column) -> Column:
    """The distinct leaf hashes that a fingerprint holds."""
    return F.array_distinct(F.array_remove(F.split(F.split(fingerprint, ":")[3], "[./]"), ""))


def likeness(root_a: Column, leaves_a: Column, root_b: Column, leaves_b: Column) -> Column:
    """1 for equal roots, else the shared leaves as a part of the larger tree's."""
    most = F.greatest(F.size(leaves_a), F.size(leaves_b))
    return F.when(root_a == root_b, F.lit(1.0)).when(most == 0, F.lit(0.0)).otherwise(F.size(F.array_intersect(leaves_a, leaves_b)) / most)


def differing_paragraphs(a: Column, b: Column) -> Column:
    """struct(removed, added): 0-based numbers of a's paragraphs that b hasn't and of b's that a hasn't, top down.

    Equal roots end the search, so do sections that stand in both; below the others, paragraphs are
    matched by their hashes wherever they stand, so an inserted one doesn't mark those behind it.
    """
    part = lambda f, i: F.split(F.split(f, ":")[i], "\\.")

    def only(x: Column, y: Column) -> Column:
        sections, paragraphs = part(x, 1), part(x, 2)
        open_ = F.filter(F.sequence(F.lit(0), F.size(sections) - 1), lambda i: ~F.array_contains(part(y, 1), F.get(sections, i)))
        within = F.flatten(F.transform(open_, lambda i: F.sequence(i * SECTION, F.least(i * SECTION + SECTION, F.size(paragraphs)) - 1)))
        return F.filter(within, lambda i: ~F.array_contains(part(y, 2), F.get(paragraphs, i)))

    same, none = F.substring_index(a, ":", 1) == F.substring_index(b, ":", 1), F.array().cast("array<int>")
    return F.struct(F.when(same, none).otherwise(only(a, b)).alias("removed"), F.when(same, none).otherwise(only(b, a)).alias("added"))


def fingerprint(docs: DataFrame) -> DataFrame:
    """Every row of docs, its columns kept, and `fingerprint`, which replaces a column of that name."""
    leaves = private("leaves")
    return with_fingerprint(docs, "text", "fingerprint", leaves).drop(leaves)


def _guests(d: DataFrame) -> DataFrame:
    """The first row (doc_id, text) of every bucket, as `bucket` the one before, for the first one the last.

    Partial minima leave a row per bucket and task before anything is shuffled. Windows run within
    groups of 4096 buckets; only the groups' own ends meet in one task, a row for some million ids.
    """
    from pyspark.sql import Window

    first = d.groupBy("bucket").agg(F.min(F.struct("doc_id", "text")).alias("g")).withColumn("group", F.shiftright("bucket", GROUP_BITS))
    ends = first.groupBy("group").agg(F.max("bucket").alias("last"))
    ends = ends.select("group", F.coalesce(F.lag("last").over(Window.orderBy("group")), F.max("last").over(Window.partitionBy())).alias("end_before"))
    first = first.withColumn("within", F.lag("bucket").over(Window.partitionBy("group").orderBy("bucket")))
    return first.join(ends, "group").select("g.doc_id", "g.text", F.coalesce("within", "end_before").alias("bucket"))


def edit_report(docs: DataFrame) -> DataFrame:
    """Fingerprints of each text and of its edited text, and their likeness.

    The edited text's last floor(n_chars / 2) code points are the first as many of the next
    document, in ascending (doc_id, text) order, after the last the first one; a lone document is its
    own next. A row with a null id has no place in that order and is its own next. Null texts are
    empty. Ids are integers.
    """
    from pyspark.sql import Window

    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty("text").alias("text"))
    lone = with_fingerprint(d.where("doc_id IS NULL"), "text", "fingerprint", "leaves").withColumn("next", F.struct("text", "fingerprint", "leaves"))
    d = d.where("doc_id IS NOT NULL").withColumn("bucket", F.shiftright("doc_id", BUCKET_BITS))
    # A bucket's first row is also a guest at the end of the bucket before.
    rows = d.withColumn("guest", F.lit(False)).unionByName(_guests(d).withColumn("guest", F.lit(True)))
    rows = with_fingerprint(rows.repartition("bucket"), "text", "fingerprint", "leaves")
    w = Window.partitionBy("bucket").orderBy("guest", "doc_id", "text")
    rows = rows.withColumn("next", F.lead(F.struct("text", "fingerprint", "leaves")).over(w)).where(~F.col("guest"))
    rows = rows.select(*lone.columns).unionByName(lone)
    n = F.length("text")
    half = F.floor(n / 2).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), n - half), F.substring("next.text", F.lit(1), half))
    rows = rows.select("doc_id", n.cast("long").alias("n_chars"), "fingerprint", "leaves", "next", edited.alias("edited"))
    rows = with_fingerprint(rows, "edited", "edited_fingerprint", "edited_leaves")
    root = lambda c: F.substring(c, 1, 64)
    like = lambda f, s: likeness(root("fingerprint"), F.col("leaves"), root(f), F.col(s))
    return rows.select("doc_id", "n_chars", F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"), "fingerprint", "edited_fingerprint", like("edited_fingerprint", "edited_leaves").alias("near_edited"), like("next.fingerprint", "next.leaves").alias("near_next"))


def _sql_tree(of: str, name: str) -> str:
    return rf"""
{name}_l AS (SELECT *, list_transform(string_split({of}, chr(10)), lambda p: list_transform(regexp_extract_all(p, '{LEAF}'), lambda c: md5(c))) AS l FROM SRC),
{name}_p AS (SELECT *, list_transform(l, lambda x: md5(array_to_string(x, ''))) AS p FROM {name}_l),
{name}_s AS (SELECT *, list_transform(range(0, (len(p) - 1) // {SECTION} + 1), lambda i: md5(array_to_string(p[i * {SECTION} + 1:i * {SECTION} + {SECTION}], ''))) AS s FROM {name}_p),
{name} AS (SELECT * EXCLUDE (l, p, s), sha256(array_to_string(s, '')) AS root,
  concat_ws(':', sha256(array_to_string(s, '')), array_to_string(list_transform(s, lambda x: x[1:{DIGITS}]), '.'), array_to_string(list_transform(p, lambda x: x[1:{DIGITS}]), '.'),
            array_to_string(list_transform(l, lambda x: array_to_string(list_transform(x, lambda y: y[1:{DIGITS}]), '.')), '/')) AS fp,
  list_distinct(list_transform(flatten(l), lambda x: x[1:{DIGITS}])) AS leaves FROM {name}_s)"""


REPORT_SQL = (
    "WITH d AS (SELECT doc_id, text, CASE WHEN doc_id IS NULL THEN -r ELSE r END AS r, CASE WHEN doc_id IS NULL THEN -r ELSE r % n + 1 END AS nr"
    + " FROM (SELECT doc_id, coalesce(text, '') AS text, row_number() OVER (PARTITION BY doc_id IS NULL ORDER BY doc_id, coalesce(text, '')) AS r, count(doc_id) OVER () AS n FROM documents)),"
    + _sql_tree("text", "a").replace("SRC", "d")
    + ", e AS (SELECT a.doc_id, a.text, a.root, a.fp, a.leaves, b.root AS nroot, b.leaves AS nleaves, left(a.text, (length(a.text) - length(a.text) // 2)::BIGINT) || left(b.text, (length(a.text) // 2)::BIGINT) AS edited"
    + " FROM a JOIN a b ON b.r = a.nr),"
    + _sql_tree("edited", "t").replace("SRC", "(SELECT doc_id, text, edited, nroot, nleaves, root AS aroot, fp AS afp, leaves AS aleaves FROM e)")
    + """
SELECT doc_id, length(text)::BIGINT AS n_chars, sha256(edited) AS edited_sha256, afp AS fingerprint, fp AS edited_fingerprint,
  CASE WHEN aroot = root THEN 1.0::DOUBLE WHEN greatest(len(aleaves), len(leaves)) = 0 THEN 0.0::DOUBLE ELSE len(list_intersect(aleaves, leaves))::DOUBLE / greatest(len(aleaves), len(leaves)) END AS near_edited,
  CASE WHEN aroot = nroot THEN 1.0::DOUBLE WHEN greatest(len(aleaves), len(nleaves)) = 0 THEN 0.0::DOUBLE ELSE len(list_intersect(aleaves, nleaves))::DOUBLE / greatest(len(aleaves), len(nleaves)) END AS near_next
FROM t"""
)
