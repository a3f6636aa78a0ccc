"""Queries that write the test tables in the engine's own formats and read them back: shards, tables, logs, texts, vocabularies."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import reports as R
from ..functions import telemetry as T
from ..functions import tokenize as K
from ..operators import experiments as X
from ..operators import loss as L
from ..operators import sessions as S
from ..sources import corpus as C
from ..sources import generate as G
from ..sources.scratch import Scratch
from .queries import _CLASSED, _EXPERIMENTS, _PARSED, _ranks, experiments, query, sessions, table

# Documents as a corpus: every 21st is the validation shard's, the others fill twenty shards.
_SHARDED = "s AS (SELECT doc_id, text, CASE WHEN doc_id % 21 = 20 THEN 'shard_06542.parquet' ELSE printf('shard_%05d.parquet', (doc_id % 21)::INT) END AS file FROM documents)"


def shards(spark, sf_dir):
    """The folder of the shards that hold all documents."""
    path = Scratch(spark, "corpus").made()
    n = F.col("doc_id") % 21
    C.write_shards(table(spark, sf_dir, "documents").select(F.when(n == 20, G.VAL_SHARD).otherwise(n).cast("int").alias("shard"), "doc_id", "text"), path, order="doc_id")
    return path


@query(f"WITH {_SHARDED} SELECT file, CASE WHEN file = 'shard_06542.parquet' THEN 'val' ELSE 'train' END AS split, count(*)::BIGINT AS n_docs, coalesce(sum(length(text)), 0)::BIGINT AS n_chars, md5(string_agg(md5(coalesce(text, '')), '' ORDER BY doc_id)) AS texts_md5 FROM s GROUP BY file")
def shard_scan(spark, sf_dir):
    """Shards written by number, read by name: of each its part of the split, its documents in order."""
    df = C.read_corpus(spark, shards(spark, sf_dir))
    both = C.split(df, "train").withColumn("split", F.lit("train")).unionByName(C.split(df, "val").withColumn("split", F.lit("val")))
    texts = F.transform(F.array_sort(F.collect_list(F.struct("session_id", F.md5(F.coalesce("text", F.lit(""))).alias("m")))), lambda x: x["m"])
    return both.groupBy("file", "split").agg(F.count("*").alias("n_docs"), F.coalesce(F.sum(F.length("text")), F.lit(0)).alias("n_chars"), F.md5(F.array_join(texts, "")).alias("texts_md5"))


@query(f"WITH {_SHARDED}, f AS (SELECT file, row_number() OVER (ORDER BY file) AS place FROM (SELECT DISTINCT file FROM s)) SELECT file, place, true AS has_bytes FROM f")
def shard_list(spark, sf_dir):
    """The shards' names in order, by metadata alone, with the total of their sizes looked at."""
    path = shards(spark, sf_dir)
    total = C.total_size(spark, path).first()
    listed = C.list_shards(spark, path, "shard_*.parquet")
    from pyspark.sql import Window

    out = listed.withColumn("place", F.row_number().over(Window.orderBy("file")).cast("long"))  # a row for each file
    return out.select("file", "place", ((F.col("size") > 0) & F.lit(total["n_files"] > 0 and total["bytes"] > 0)).alias("has_bytes"))


@query(f"WITH {_SHARDED} SELECT file, count(*)::BIGINT AS n_docs FROM s WHERE file IN (SELECT DISTINCT file FROM s ORDER BY file LIMIT 5) GROUP BY file")
def first_shards(spark, sf_dir):
    return C.read_corpus(spark, shards(spark, sf_dir), first=5).groupBy("file").agg(F.count("*").alias("n_docs"))


@query("SELECT DISTINCT CASE WHEN doc_id % 21 = 20 THEN 'val' ELSE 'train' END AS split, false AS written_again FROM documents")
def shards_written_once(spark, sf_dir):
    """A second write finds every shard there and changes nothing."""
    path, n = shards(spark, sf_dir), F.col("doc_id") % 21
    again = C.write_shards(table(spark, sf_dir, "documents").select(F.when(n == 20, G.VAL_SHARD).otherwise(n).cast("int").alias("shard"), F.lit("other").alias("text")), path)
    df = C.read_corpus(spark, path)
    parts = [C.split(df, s).select(F.lit(s).alias("split"), "text") for s in ("train", "val")]
    return parts[0].unionByName(parts[1]).groupBy("split").agg((F.max(F.col("text") == "other") | F.lit(bool(again))).alias("written_again"))


@query(f"WITH {_EXPERIMENTS} SELECT commit, CASE WHEN ordinal % 5 = 0 THEN NULL ELSE val_bpb END AS val_bpb, status, 'run of ' || night AS description FROM e")
def experiment_table_scan(spark, sf_dir):
    """Experiments appended to a tab-separated table as text, some without a number, read back and normalized."""
    path = Scratch(spark, "experiments").base
    e = experiments(spark, sf_dir)
    value = F.when(F.col("ordinal") % 5 == 0, "n/a").otherwise(F.col("val_bpb").cast("string"))
    C.append_experiments(e.select("commit", value.alias("val_bpb"), F.lit("1.5").alias("memory_gb"), F.concat(F.lit(" "), F.lower("status")).alias("status"), F.concat(F.lit("run of "), F.col("night")).alias("description")), path)
    return X.normalized(C.read_experiments(spark, path)).select("commit", "val_bpb", "status", "description")


@query(f"""WITH {_EXPERIMENTS}, l AS (SELECT ordinal, substr(md5(ordinal::VARCHAR), 1, 8) AS sha, printf('val_bpb=%.6f [change: %s] after', val_bpb, status) AS s FROM e)
SELECT row_number() OVER (ORDER BY ordinal) AS n, sha, {_PARSED} FROM l""")
def log_scan(spark, sf_dir):
    """An exported log, the newest line first, read by lines and parsed in order of time."""
    path = Scratch(spark, "log").base
    e = experiments(spark, sf_dir)
    line = F.concat_ws("|", F.md5(F.col("ordinal").cast("string")), F.format_string("val_bpb=%.6f [change: %s] after", "val_bpb", "status"), F.lit(" 2026-01-01 "))
    e.select("ordinal", line.alias("line")).repartition(1).sortWithinPartitions(F.desc("ordinal")).select("line").write.text(path)  # one file, as the log is
    from pyspark.sql import Window

    got = X.parse_log(C.read_log(spark, path))
    return got.withColumn("n", F.row_number().over(Window.orderBy("ordinal")).cast("long")).drop("ordinal", "timestamp")  # an experiment log is small


_RUN = """'step 1' || chr(10) || 'val_bpb:          ' || printf('%.6f', n * 2.5) || chr(10) || 'val_bpb:          ' || CASE WHEN n = 24 THEN 'nan' ELSE printf('%.6f', n * 2.5 + 0.25) END || chr(10) || 'num_steps: ' || n || chr(10)"""


@query(rf"""WITH o AS (SELECT n_name AS name, n_nationkey AS n, {_RUN} || CASE WHEN n_nationkey % 2 = 0 THEN 'warning' ELSE '' END AS text FROM nation), m AS (SELECT *, regexp_extract_all(text, 'val_bpb:\s+(\d+\.\d+)', 1) AS v, string_split(regexp_replace(text, '\s+$', ''), chr(10)) AS l FROM o)
SELECT name, CASE WHEN v[-1]::DOUBLE <= 50 THEN v[-1]::DOUBLE END AS val_bpb, array_to_string(l[greatest(1, len(l) - 1):], chr(10)) AS tail, (row_number() OVER (ORDER BY n, name))::BIGINT AS place FROM m""")
def run_outputs(spark, sf_dir):
    """Both streams of runs kept as text files, read back whole: the last plausible value, the last lines, in order of the names' numbers."""
    path = Scratch(spark, "outputs").base
    n = F.col("n_nationkey")
    value = F.when(n == 24, "nan").otherwise(F.format_string("%.6f", n * 2.5 + 0.25))
    out = F.concat(F.lit("step 1\nval_bpb:          "), F.format_string("%.6f", n * 2.5), F.lit("\nval_bpb:          "), value, F.lit("\nnum_steps: "), n.cast("string"), F.lit("\n"))
    err = F.when(n % 2 == 0, "warning")
    named = F.concat_ws("_", "n_name", n.cast("string"))
    C.write_outputs(table(spark, sf_dir, "nation").select(named.alias("name"), R.run_log(out, err).alias("text")), path)
    from pyspark.sql import Window

    got = C.read_named_outputs(spark, path)
    place = F.row_number().over(Window.orderBy(R.numeric_suffix(F.col("name")), "name")).cast("long")  # a row for each file
    return got.select(F.regexp_replace("name", r"_\d+$", "").alias("name"), R.plausible_bpb(R.metric(F.col("text"), "val_bpb")).alias("val_bpb"), R.last_lines(F.col("text"), 2).alias("tail"), place.alias("place"))


@query("SELECT doc_id, coalesce(strlen(text), 0)::BIGINT AS n_bytes FROM documents")
def encoded_bytes(spark, sf_dir):
    """The bytes of each document's tokens, by the vocabulary's table of lengths as written and read: those of its text."""
    ranks, path = _ranks(spark, sf_dir), Scratch(spark, "lengths").base
    C.write_lengths(K.token_lengths(K.vocabulary(spark, ranks)), path)
    lengths = F.broadcast(C.read_lengths(spark, path))  # a vocabulary is bounded
    ids = table(spark, sf_dir, "documents").select("doc_id", F.explode_outer(K.encoder(ranks, prepend=K.bos_id(ranks))("text")).alias("token_id"))
    return L.with_lengths(ids, lengths).groupBy("doc_id").agg(F.sum(F.col("n_bytes").cast("long")).alias("n_bytes"))


@query(f"WITH {_CLASSED}, f AS (SELECT * FROM c ORDER BY user_id, day LIMIT 2000), x AS (SELECT label = 'normal' AS is_normal, unnest(regexp_extract_all(text, 'latency_ms=(\\d+)', 1))::INT AS v FROM f) SELECT is_normal, count(*)::BIGINT AS n, sum(v)::BIGINT AS total, max(v)::INT AS most FROM x GROUP BY 1")
def latency_sample(spark, sf_dir):
    """Latencies of the first 2000 sessions, apart by whether the session is normal."""
    v = S.latencies_by_label(S.first_sessions(sessions(spark, sf_dir)))
    return v.groupBy((F.col("label") == "normal").alias("is_normal")).agg(F.count("*").alias("n"), F.sum("latency_ms").alias("total"), F.max("latency_ms").alias("most"))


@query("SELECT shard::INT AS shard, 1000::BIGINT AS n_sessions, 0::BIGINT AS odd_sizes, 0::BIGINT AS odd_gaps, 0::BIGINT AS odd_lines, 1::BIGINT AS most_traces FROM (SELECT unnest(range(20)) AS shard UNION ALL SELECT 6542)")
def generator_grammar(spark, sf_dir):
    """What holds for every generated shard: sessions, their sizes by kind, gaps of 50 to 2000 ms (one more by rounding), the lines' form, one trace for a session."""
    return G.audited(G.generate_corpus(spark))


@query("SELECT user_id, event_id, CASE event_type WHEN 'error' THEN event_type ELSE 'none' END AS kind, 'n/a' AS region FROM events")
def attribute_defaults(spark, sf_dir):
    """Attributes of a line by name, with a value for those that it hasn't."""
    line = F.concat(F.lit("[ts=x] [src=y] a=1"), F.when(F.col("event_type") == "error", F.concat(F.lit(" kind="), F.col("event_type"))).otherwise(""))
    e = table(spark, sf_dir, "events").select("user_id", "event_id", T.attributes(line).alias("attrs"))
    return e.select("user_id", "event_id", T.attribute(F.col("attrs"), "kind", "none").alias("kind"), T.attribute(F.col("attrs"), "region", "n/a").alias("region"))
