"""The queries over the test tables, each with SQL of the same result where SQL can state it.

The tables stand in for the engine's own inputs: `events` for telemetry (a session is a user's day),
`documents` for the corpus, `orders` for experiments (a customer's orders are one history).
"""

from __future__ import annotations

import hashlib
import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import reports as R
from ..functions import telemetry as T
from ..functions import tokenize as K
from ..operators import experiments as X
from ..operators import loss as L
from ..operators import packing as P
from ..operators import sessions as S
from ..sources import generate as G
from ..sources.corpus import ensure_ids, spread
from ..sources.scratch import shared_dir

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    df = spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))
    return spread(df) if name == "documents" else df  # its texts are work; other tables' rows aren't


def sessions(spark, sf_dir):
    return S.sessions_of_events(table(spark, sf_dir, "events"))


def experiments(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    status = F.when(F.col("o_orderstatus") == "F", " keep ").when(F.col("o_orderstatus") == "O", "discard").otherwise("crash")
    raw = o.select(F.col("o_custkey").alias("night"), F.col("o_orderdate").alias("ran_at"), F.col("o_orderkey").alias("ordinal"), F.substring(F.md5(F.col("o_orderkey").cast("string")), 1, 8).alias("commit"), status.alias("status"), F.round(F.col("o_totalprice") / 250000, 6).alias("val_bpb"))
    return X.normalized(raw)


def words(spark, sf_dir):
    """(doc_id, pos, token) of the documents' words."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.filter(F.split("text", "[ \n]+"), lambda w: w != "").alias("w"))
    return d.select("doc_id", F.posexplode("w").alias("pos", "token"))


# Parts of the SQL.
_LINE = """'[ts=' || strftime(ts, '%Y-%m-%dT%H:%M:%S.%g') || 'Z] [src=' || event_type || '] latency_ms=' || floor(value)::INT
 || ' error=' || CASE WHEN event_type = 'error' AND value >= 30 THEN 'timeout' ELSE 'none' END
 || ' level=' || CASE WHEN event_type = 'error' AND value > 100 THEN 'CRITICAL' ELSE 'INFO' END"""
_SESSIONS = f"s AS (SELECT user_id, ts::DATE AS day, string_agg({_LINE}, chr(10) ORDER BY ts, event_id) AS text FROM events GROUP BY ALL)"
_OTHER_HITS = T.ANOMALY_PATTERN.split("|", 1)[1]
_CLASSED = f"""{_SESSIONS},
h AS (SELECT *, (len(regexp_extract_all(text, '{_OTHER_HITS}')) + len(regexp_extract_all(text, 'error=')) - len(regexp_extract_all(text, 'error=none')))::BIGINT AS hits,
      len(regexp_extract_all(text, '\\[ts='))::BIGINT AS n_events FROM s),
c AS (SELECT *, CASE WHEN hits = 0 THEN 'normal' WHEN hits >= 3 THEN 'cascade' ELSE 'anomalous' END AS label FROM h)"""
_EXPERIMENTS = """e AS (SELECT o_custkey AS night, o_orderdate AS ran_at, o_orderkey AS ordinal, substr(md5(o_orderkey::VARCHAR), 1, 8) AS commit,
  CASE o_orderstatus WHEN 'F' THEN 'KEEP' WHEN 'O' THEN 'DISCARD' ELSE 'CRASH' END AS status, round(o_totalprice / 250000, 6) AS val_bpb FROM orders)"""
_WORDS = r"w AS (SELECT doc_id, list_filter(regexp_split_to_array(text, '[ \n]+'), lambda x: x <> '') AS ws FROM documents)"
_TOKENS = f"{_WORDS}, t AS (SELECT doc_id, (unnest(range(0, len(ws))))::INT AS pos, unnest(ws) AS token FROM w)"
_W = "OVER (PARTITION BY night ORDER BY ran_at, ordinal"
_KEYWORDS = "|".join(T.ANOMALY_KEYWORDS)


@query(f"WITH {_CLASSED}, d AS (SELECT unnest(['normal', 'anomalous', 'cascade']) AS label) SELECT label, count(c.user_id)::BIGINT AS n_sessions, round(count(c.user_id) * 100.0 / sum(count(c.user_id)) OVER (), 6)::DOUBLE AS pct FROM d LEFT JOIN c USING (label) GROUP BY label")
def session_label_distribution(spark, sf_dir):
    return S.label_distribution(sessions(spark, sf_dir))


@query(f"WITH {_CLASSED} SELECT user_id, day::VARCHAR AS day, hits, label, n_events FROM c")
def session_classify(spark, sf_dir):
    return S.classified(sessions(spark, sf_dir)).select("user_id", F.col("day").cast("string").alias("day"), "hits", "label", "n_events")


@query(f"WITH {_SESSIONS}, x AS (SELECT unnest(regexp_extract_all(text, '\\[src=([A-Za-z\\-]+)\\]', 1)) AS source FROM s) SELECT source, count(*)::BIGINT AS n_events, round(count(*) * 100.0 / sum(count(*)) OVER (), 6)::DOUBLE AS pct FROM x GROUP BY source")
def source_mix(spark, sf_dir):
    return S.source_mix(sessions(spark, sf_dir))


@query(f"WITH {_CLASSED} SELECT min(n_events) AS least, quantile_cont(n_events::DOUBLE, 0.25) AS p25, quantile_cont(n_events::DOUBLE, 0.5) AS median, quantile_cont(n_events::DOUBLE, 0.75) AS p75, max(n_events) AS most FROM c")
def session_length_quantiles(spark, sf_dir):
    return S.length_quantiles(sessions(spark, sf_dir))


def _histogram_sql(source: str, value: str, bins: int, by: str = "") -> str:
    group, using = (f"{by}, ", f"USING ({by})") if by else ("", "ON true")
    return f"""{source},
r AS (SELECT {group}min({value})::DOUBLE AS a, max({value})::DOUBLE AS b FROM v {'GROUP BY ' + by if by else ''}),
m AS (SELECT {group}CASE WHEN a = b THEN a - 0.5 ELSE a END AS lo, CASE WHEN a = b THEN b + 0.5 ELSE b END AS hi FROM r)
SELECT {group}lo, hi, least(floor(({value}::DOUBLE - lo) * {bins} / (hi - lo)) + 1, {bins})::BIGINT AS bin, count(*)::BIGINT AS n FROM v JOIN m {using} GROUP BY ALL"""


@query(_histogram_sql(f"WITH {_CLASSED}, v AS (SELECT n_events FROM c)", "n_events", 30))
def session_length_histogram(spark, sf_dir):
    return S.histogram(S.classified(sessions(spark, sf_dir)), "n_events", 30)


_LATENCIES = "x AS (SELECT user_id, day, label, regexp_extract_all(text, 'latency_ms=(\\d+)', 1) AS l FROM c), v AS (SELECT user_id, day, label, label = 'normal' AS is_normal, unnest(range(0, len(l)))::INT AS pos, unnest(l)::INT AS latency_ms FROM x)"


@query(f"WITH {_CLASSED}, {_LATENCIES} SELECT user_id, day::VARCHAR AS day, label, pos, latency_ms FROM v")
def latency_extract_by_label(spark, sf_dir):
    return S.latencies_by_label(sessions(spark, sf_dir)).withColumn("day", F.col("day").cast("string"))


@query(_histogram_sql(f"WITH {_CLASSED}, {_LATENCIES}", "latency_ms", 50, "is_normal"))
def latency_histogram(spark, sf_dir):
    return S.histogram(S.latencies_by_label(sessions(spark, sf_dir)).withColumn("is_normal", F.col("label") == "normal"), "latency_ms", 50, ["is_normal"])


@query(f"WITH {_SESSIONS}, x AS (SELECT user_id, day, string_split(text, chr(10)) AS l FROM s), v AS (SELECT user_id, day, unnest(range(0, len(l)))::INT AS event_pos, unnest(l) AS line FROM x) SELECT user_id, day::VARCHAR AS day, event_pos, strptime(regexp_extract(line, '\\[ts=([^\\]]+)Z', 1), '%Y-%m-%dT%H:%M:%S.%g') AS ts, regexp_extract(line, '\\[src=([A-Za-z\\-]+)\\]', 1) AS src, regexp_extract(line, 'latency_ms=(\\d+)', 1)::INT AS latency_ms, regexp_extract(line, 'error=(\\S+)', 1) AS error, regexp_extract(line, 'level=(\\S+)', 1) AS level FROM v")
def event_attributes(spark, sf_dir):
    return S.event_rows(sessions(spark, sf_dir)).drop("attrs").withColumns({"ts": F.col("ts").cast("timestamp_ntz"), "day": F.col("day").cast("string")})


@query(f"WITH {_CLASSED}, r AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY md5(concat_ws('|', user_id, day::VARCHAR, 42)), user_id, day) AS r FROM c) SELECT label, user_id, day::VARCHAR AS day, substr(text, 1, 400) AS shown FROM r WHERE r = 1")
def sample_per_label(spark, sf_dir):
    return S.sample_per_label(sessions(spark, sf_dir)).withColumn("day", F.col("day").cast("string"))


@query("SELECT doc_id FROM documents WHERE regexp_matches(text, 'password=|Licensed under')")
def contains_filter(spark, sf_dir):
    return table(spark, sf_dir, "documents").where(F.col("text").rlike("password=|Licensed under")).select("doc_id")


@query("SELECT doc_id, left(text, 10000) AS text, length(left(text, 10000))::BIGINT AS n FROM documents")
def doc_truncate(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", F.substring("text", 1, 10_000).alias("text"))
    return d.withColumn("n", F.length("text").cast("long"))


@query("SELECT doc_id, chars_before FROM (SELECT doc_id, coalesce(sum(length(left(text, 10000))) OVER (ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS chars_before FROM documents) WHERE chars_before < 1000000000")
def char_budget_scan(spark, sf_dir):
    return P.char_budget(table(spark, sf_dir, "documents"), "doc_id", "text", 1_000_000_000).select("doc_id", "chars_before")


@query("SELECT CASE WHEN doc_id % 21 = 20 THEN 'val' ELSE 'train' END AS split, count(*)::BIGINT AS n_docs, sum(length(text))::BIGINT AS n_chars FROM documents GROUP BY 1")
def split_filter(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    parts = [d.where((F.col("doc_id") % 21 == 20) if s == "val" else (F.col("doc_id") % 21 != 20)).select(F.lit(s).alias("split"), "text") for s in ("train", "val")]
    return parts[0].unionByName(parts[1]).groupBy("split").agg(F.count("*").alias("n_docs"), F.sum(F.length("text")).alias("n_chars"))


@query("SELECT doc_id, len(l)::BIGINT AS n_lines, list_max(list_transform(l, lambda x: length(x)))::BIGINT AS longest, left(l[1], 100) AS first_line, strlen(text)::BIGINT AS n_bytes FROM (SELECT doc_id, text, string_split(text, chr(10)) AS l FROM documents)")
def line_split_counts(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", "text", F.split("text", "\n").alias("l"))
    return d.select("doc_id", F.size("l").cast("long").alias("n_lines"), F.array_max(F.transform("l", F.length)).cast("long").alias("longest"), F.substring(F.get("l", F.lit(0)), 1, 100).alias("first_line"), F.octet_length("text").cast("long").alias("n_bytes"))


@query(f"WITH {_EXPERIMENTS} SELECT night, count(*)::BIGINT AS n_total, count(*) FILTER (status = 'KEEP')::BIGINT AS n_keep, count(*) FILTER (status = 'DISCARD')::BIGINT AS n_discard, count(*) FILTER (status = 'CRASH')::BIGINT AS n_crash, round(count(*) FILTER (status = 'KEEP') / nullif(count(*) FILTER (status = 'KEEP') + count(*) FILTER (status = 'DISCARD'), 0), 6)::DOUBLE AS keep_rate FROM e GROUP BY night")
def experiment_status_counts(spark, sf_dir):
    return X.status_counts(experiments(spark, sf_dir))


@query(f"WITH {_EXPERIMENTS} SELECT status, count(*)::BIGINT AS n FROM e GROUP BY status")
def status_value_counts(spark, sf_dir):
    return X.value_counts(experiments(spark, sf_dir), "status")


@query(f"WITH {_EXPERIMENTS} SELECT night, ordinal, val_bpb, min(val_bpb) {_W} ROWS UNBOUNDED PRECEDING) AS best_so_far FROM e WHERE status = 'KEEP'")
def running_best(spark, sf_dir):
    return X.running_best(experiments(spark, sf_dir)).select("night", "ordinal", "val_bpb", "best_so_far")


@query(f"WITH {_EXPERIMENTS}, k AS (SELECT night, ordinal, val_bpb, lag(val_bpb) {_W}) AS before, row_number() {_W}) AS n FROM e WHERE status = 'KEEP') SELECT night, ordinal, before, round(before - val_bpb, 6) AS delta FROM k WHERE n > 1")
def kept_deltas(spark, sf_dir):
    return X.kept_deltas(experiments(spark, sf_dir)).select("night", "ordinal", "before", "delta")


@query(f"WITH {_EXPERIMENTS}, k AS (SELECT night, val_bpb, lag(val_bpb) {_W}) AS before, row_number() {_W}) AS n FROM e WHERE status = 'KEEP') SELECT night, count(*)::BIGINT AS n_gains, round(sum(round(before - val_bpb, 6)), 6) AS gained FROM k WHERE n > 1 GROUP BY night")
def total_gain(spark, sf_dir):
    return X.kept_deltas(experiments(spark, sf_dir)).groupBy("night").agg(F.count("*").alias("n_gains"), F.round(F.sum("delta"), 6).alias("gained"))


@query(f"WITH {_EXPERIMENTS}, v AS (SELECT *, CASE WHEN status <> 'CRASH' AND val_bpb <= 50 THEN val_bpb END AS v FROM e) SELECT night, ordinal, coalesce(v < coalesce(min(v) {_W} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 'inf'::DOUBLE), false) AS kept FROM v")
def keep_if_better(spark, sf_dir):
    return X.keep_if_better(experiments(spark, sf_dir)).select("night", "ordinal", "kept")


@query(f"WITH {_EXPERIMENTS}, n AS (SELECT *, row_number() {_W}) AS n FROM e WHERE val_bpb IS NOT NULL), b AS (SELECT *, row_number() OVER (PARTITION BY night ORDER BY val_bpb, n) AS r FROM n), g AS (SELECT night, count(*)::BIGINT AS n_runs, arg_min(val_bpb, n) AS first_bpb, max(val_bpb) AS max_bpb FROM n GROUP BY night) SELECT night, n_runs, first_bpb, max_bpb, val_bpb AS best_bpb, n::BIGINT AS best_at, commit AS best_commit, round((first_bpb - val_bpb) / first_bpb * 100, 6) AS gain_pct FROM g JOIN b USING (night) WHERE r = 1")
def best_experiment(spark, sf_dir):
    return X.best_experiment(experiments(spark, sf_dir))


@query(f"WITH {_EXPERIMENTS} SELECT night, ordinal, val_bpb = min(val_bpb) OVER (PARTITION BY night) AS is_best FROM e")
def best_marks(spark, sf_dir):
    return X.marked_best(experiments(spark, sf_dir)).select("night", "ordinal", "is_best")


@query(f"WITH {_EXPERIMENTS} SELECT night, ordinal, commit, val_bpb FROM e ORDER BY val_bpb, ran_at, ordinal LIMIT 5")
def top5_changes(spark, sf_dir):
    return X.top_changes(experiments(spark, sf_dir)).select("night", "ordinal", "commit", "val_bpb")


@query(f"WITH {_EXPERIMENTS}, b AS (SELECT *, lag(val_bpb) {_W}) AS before, (row_number() {_W}))::BIGINT AS n FROM e) SELECT night, n, before, val_bpb FROM b WHERE val_bpb < before - 0.02")
def drop_annotations(spark, sf_dir):
    return X.drops(experiments(spark, sf_dir)).select("night", "n", "before", "val_bpb")


@query(f"WITH {_EXPERIMENTS}, b AS (SELECT *, first_value(val_bpb) {_W}) AS baseline FROM e WHERE status <> 'CRASH') SELECT night, ordinal, baseline, val_bpb FROM b WHERE val_bpb <= baseline + 0.0005")
def below_baseline(spark, sf_dir):
    return X.below_baseline(experiments(spark, sf_dir)).select("night", "ordinal", "baseline", "val_bpb")


@query("WITH f AS (SELECT event_id, user_id, ts, (event_type = 'error')::INT AS bad FROM events), i AS (SELECT *, sum(1 - bad) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS isle FROM f), s AS (SELECT event_id, (sum(bad) OVER (PARTITION BY user_id, isle ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING))::BIGINT AS streak FROM i) SELECT event_id, streak, streak >= 3 AS stopped, least(120 * 2 ^ (streak - 1), 900)::BIGINT AS pause_s FROM s")
def failure_streaks(spark, sf_dir):
    out = X.failure_streaks(table(spark, sf_dir, "events"), "user_id", ["ts", "event_id"], F.col("event_type") == "error", stop=3)
    return out.select("event_id", "streak", "stopped", R.backoff_seconds(F.col("streak")).alias("pause_s"))


@query(f"WITH {_EXPERIMENTS} SELECT night, ordinal, CASE WHEN val_bpb < 0.8 THEN 'excellent' WHEN val_bpb < 1.0 THEN 'strong' WHEN val_bpb < 1.2 THEN 'good' WHEN val_bpb < 1.5 THEN 'fair' ELSE 'weak' END AS verdict, CASE WHEN val_bpb > 1.5 THEN 'basics' WHEN val_bpb > 1.2 THEN 'schedule' WHEN val_bpb > 1.0 THEN 'architecture' ELSE 'fine tuning' END AS next_step FROM e")
def verdict_buckets(spark, sf_dir):
    return X.verdicts(experiments(spark, sf_dir)).select("night", "ordinal", "verdict", "next_step")


@query(f"WITH {_EXPERIMENTS}, m AS (SELECT *, min(val_bpb) OVER (PARTITION BY night) AS lo, max(val_bpb) OVER (PARTITION BY night) AS hi FROM e) SELECT night, string_agg(substr('{R.SPARK_LEVELS}', trunc((1 - (val_bpb - lo) / CASE WHEN hi > lo THEN hi - lo ELSE 1e-9 END) * 7)::INT + 1, 1), '' ORDER BY ran_at, ordinal) AS line FROM m GROUP BY night")
def sparkline(spark, sf_dir):
    return X.sparklines(experiments(spark, sf_dir))


_PARSED = """regexp_extract(s, 'val_bpb=(\\d+\\.\\d+)', 1)::DOUBLE AS val_bpb, try_cast(nullif(regexp_extract(s, 'Δ=([+-]?\\d+\\.\\d+)', 1), '') AS DOUBLE) AS delta,
  coalesce(nullif(regexp_extract(s, '\\[change: ([^\\]]+)\\]', 1), ''), left(s, 60)) AS change, regexp_extract(s, '\\[hypothesis: ([^\\]]+)\\]', 1) AS hypothesis"""


def log_lines(spark, sf_dir):
    e = experiments(spark, sf_dir)
    odd = F.col("ordinal") % 2 == 1
    subject = F.concat(F.format_string("[val_bpb=%.6f] ", "val_bpb"), F.when(odd, F.concat(F.lit("[Δ=-0.0"), (F.col("ordinal") % 90 + 10).cast("string"), F.lit("] [change: swap "), F.col("status"), F.lit("] [hypothesis: less is more]"))).otherwise(F.concat(F.lit("plain note "), F.col("commit"))), F.when(F.col("ordinal") % 7 == 0, "|cut").otherwise(""))
    return e.select("night", "ordinal", F.concat_ws("|", F.md5(F.col("ordinal").cast("string")), subject, F.date_format("ran_at", "yyyy-MM-dd HH:mm:ss")).alias("line"))


@query(f"""WITH {_EXPERIMENTS}, l AS (SELECT night, ordinal, md5(ordinal::VARCHAR) AS h, printf('[val_bpb=%.6f] ', val_bpb) || CASE WHEN ordinal % 2 = 1 THEN '[Δ=-0.0' || (ordinal % 90 + 10) || '] [change: swap ' || status || '] [hypothesis: less is more]' ELSE 'plain note ' || commit END AS s, CASE WHEN ordinal % 7 = 0 THEN 'cut|' ELSE '' END || strftime(ran_at, '%Y-%m-%d %H:%M:%S') AS t FROM e)
SELECT night, ordinal, substr(h, 1, 8) AS sha, {_PARSED}, t AS timestamp FROM l""")
def commit_subject_parse(spark, sf_dir):
    return X.parse_log(log_lines(spark, sf_dir))


@query(f"WITH {_EXPERIMENTS}, r AS (SELECT *, row_number() OVER (PARTITION BY night ORDER BY ran_at DESC, ordinal DESC) AS back FROM e) SELECT night, min(val_bpb) AS best_bpb, count(*)::BIGINT AS n_seen FROM r WHERE back <= 30 AND val_bpb IS NOT NULL GROUP BY night")
def recent_best(spark, sf_dir):
    return X.recent_best(experiments(spark, sf_dir), 30)


@query(f"WITH {_EXPERIMENTS}, n AS (SELECT *, row_number() {_W}) AS n FROM e) SELECT night, ((n - 1) // 60)::BIGINT AS chunk, count(*)::BIGINT AS n_runs, round(avg(val_bpb), 6) AS mean_bpb FROM n GROUP BY ALL")
def display_chunks(spark, sf_dir):
    n = X.numbered(experiments(spark, sf_dir)).withColumn("chunk", F.floor((F.col("n") - 1) / 60))
    return n.groupBy("night", "chunk").agg(F.count("*").alias("n_runs"), F.round(F.avg("val_bpb"), 6).alias("mean_bpb"))


@query("""WITH RECURSIVE n AS (SELECT event_id, user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM events),
r AS (SELECT event_id, user_id, k, 0.1 * value AS m FROM n WHERE k = 1 UNION ALL SELECT n.event_id, n.user_id, n.k, 0.9 * r.m + 0.1 * n.value FROM r JOIN n ON n.user_id = r.user_id AND n.k = r.k + 1)
SELECT event_id, round(m / (1 - 0.9 ^ k), 6) AS ema FROM r""")
def ema_loss(spark, sf_dir):
    return X.ema(table(spark, sf_dir, "events"), "user_id", ["ts", "event_id"], "value").select("event_id", F.round("ema", 6).alias("ema"))


@query("SELECT event_type, min(event_id) AS event_id FROM events GROUP BY event_type")
def stable_distinct(spark, sf_dir):
    return X.distinct_in_order(table(spark, sf_dir, "events"), "event_type", ["event_id"])


# The pattern without look-ahead: texts are cut before the last sign of white space that text follows, where a token ends anyway.
_SPACE = r"\x09-\x0D\x20\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
_PRETOKENS = rf"''(?i:[sdmt]|ll|ve|re)|[^\r\n\p{{L}}\p{{N}}]?\p{{L}}+|\p{{N}}{{1,2}}| ?[^{_SPACE}\p{{L}}\p{{N}}]+[\r\n]*|[{_SPACE}]*[\r\n]|[{_SPACE}]+"


@query(rf"""WITH c AS (SELECT unnest(string_split(regexp_replace(text, '([{_SPACE}])([{_SPACE}][^{_SPACE}])', '\1' || chr(57344) || '\2', 'g'), chr(57344))) AS part FROM documents)
SELECT token, count(*)::BIGINT AS n FROM (SELECT unnest(regexp_extract_all(part, '{_PRETOKENS}')) AS token FROM c) GROUP BY token""")
def pretoken_counts(spark, sf_dir):
    return K.pretoken_counts(table(spark, sf_dir, "documents"))


@query(r"SELECT token, count(*)::BIGINT AS n FROM (SELECT unnest(regexp_extract_all(text, '[^\r\n\pL\pN]?\pL+|\pN{1,2}| ?[^\s\pL\pN]+')) AS token FROM documents) GROUP BY token")
def pretoken_counts_plain(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    return d.select(F.explode(F.regexp_extract_all("text", F.lit(r"[^\r\n\p{L}\p{N}]?\p{L}+|\p{N}{1,2}| ?[^\s\p{L}\p{N}]+"), F.lit(0))).alias("token")).groupBy("token").agg(F.count("*").alias("n"))


def _ranks(spark, sf_dir):
    """The vocabulary of the documents: learned once for each folder, then read."""
    name = hashlib.md5(os.path.abspath(sf_dir).encode()).hexdigest()
    path = f"{shared_dir(spark)}/vocabulary-{spark.sparkContext.applicationId}-{name}"
    return K.trained(table(spark, sf_dir, "documents"), path, size=8192, order="doc_id")


@query()
def bpe_vocab(spark, sf_dir):
    v = K.vocabulary(spark, _ranks(spark, sf_dir))
    return v.join(K.token_lengths(v), "token_id").join(K.token_lengths(v, exact=False).withColumnRenamed("n_bytes", "n_bytes_decoded"), "token_id")


@query()
def encode_docs(spark, sf_dir):
    ranks = _ranks(spark, sf_dir)
    ids = K.encoder(ranks, prepend=K.bos_id(ranks))
    return table(spark, sf_dir, "documents").select("doc_id", ids("text").alias("ids")).select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.md5(F.array_join("ids", ",")).alias("ids_md5"))


@query("SELECT doc_id, md5(text) AS text_md5 FROM documents")
def decode_roundtrip(spark, sf_dir):
    ranks = _ranks(spark, sf_dir)
    d = table(spark, sf_dir, "documents").select("doc_id", F.col("text").isNotNull().alias("there"), K.encoder(ranks, prepend=K.bos_id(ranks))("text").alias("ids"))
    return d.select("doc_id", F.when(F.col("there"), F.md5(K.decoded(F.col("ids"), K.vocabulary(spark, ranks)))).alias("text_md5"))


@query()
def packed_rows(spark, sf_dir):
    ranks = _ranks(spark, sf_dir)
    d = table(spark, sf_dir, "documents").select("doc_id", K.encoder(ranks, prepend=K.bos_id(ranks))("text").alias("ids"))
    rows = P.packed_rows(d, "doc_id", "ids", 256)
    return P.training_pairs(rows).select("pack_group", "row_id", F.size("tokens").alias("n"), F.md5(F.array_join("inputs", ",")).alias("inputs_md5"), F.get("targets", F.lit(255)).alias("last_target"))


@query(f"WITH {_TOKENS} SELECT doc_id, count(*)::BIGINT AS n_tokens, count(*) FILTER (regexp_matches(token, '{_KEYWORDS}'))::BIGINT AS n_anomalous FROM t GROUP BY doc_id")
def token_anomaly_mask(spark, sf_dir):
    t = words(spark, sf_dir)
    m = L.anomaly_mask(t, L.anomaly_tokens(t.select("token")))
    return m.groupBy("doc_id").agg(F.count("*").alias("n_tokens"), F.count_if("is_anomaly").alias("n_anomalous"))


def loss_tokens(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("user_id", "ts", "event_id", F.col("event_type").isin("error", "signup").alias("is_anomaly"), (F.col("value") / 25).alias("nats"))
    return L.weighted_loss(L.cascade_density(e, ["user_id"], ["ts", "event_id"], "is_anomaly"))


_LOSS = """c AS (SELECT event_id, user_id, event_type IN ('error', 'signup') AS is_anomaly, value / 25 AS nats,
  sum((event_type IN ('error', 'signup'))::INT) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING) / 7 > 0.35 AND count(*) OVER (PARTITION BY user_id) >= 7 AS in_cascade FROM events),
l AS (SELECT *, (1 - exp(-nats)) ^ 3 * nats AS focal, (1 - exp(-nats)) ^ 3 * nats * CASE WHEN is_anomaly THEN 4.0 ELSE 1.0 END * CASE WHEN in_cascade THEN 2.5 ELSE 1.0 END AS loss FROM c)"""


@query(f"WITH {_LOSS} SELECT event_id, is_anomaly, in_cascade FROM l")
def cascade_density(spark, sf_dir):
    return loss_tokens(spark, sf_dir).select("event_id", "is_anomaly", "in_cascade")


@query(f"WITH {_LOSS} SELECT event_id, round(focal, 6) AS focal, round(loss, 6) AS loss, round(15 * tanh(nats / 15), 6) AS capped FROM l")
def focal_weighted_loss(spark, sf_dir):
    return loss_tokens(spark, sf_dir).select("event_id", F.round("focal", 6).alias("focal"), F.round("loss", 6).alias("loss"), F.round(R.softcap(F.col("nats")), 6).alias("capped"))


@query(f"WITH {_LOSS} SELECT in_cascade, count(*)::BIGINT AS n_tokens, round(sum(loss), 4) AS loss_sum, round(avg(loss), 6) AS loss_mean FROM l GROUP BY in_cascade")
def loss_reductions(spark, sf_dir):
    r = L.reduced(loss_tokens(spark, sf_dir), ["in_cascade"])
    return r.select("in_cascade", "n_tokens", F.round("loss_sum", 4).alias("loss_sum"), F.round("loss_mean", 6).alias("loss_mean"))


@query(f"WITH {_TOKENS}, v AS (SELECT token, strlen(token)::BIGINT AS n_bytes FROM t GROUP BY token) SELECT doc_id, count(*)::BIGINT AS n_tokens, sum(n_bytes)::BIGINT AS n_bytes FROM t JOIN v USING (token) GROUP BY doc_id")
def token_bytes_join(spark, sf_dir):
    t = words(spark, sf_dir)
    lengths = t.select("token").distinct().withColumn("n_bytes", F.octet_length("token").cast("long"))
    return L.with_lengths(t, lengths, "token").groupBy("doc_id").agg(F.count("*").alias("n_tokens"), F.sum("n_bytes").alias("n_bytes"))


@query(f"""WITH {_WORDS}, p AS (SELECT CASE WHEN doc_id % 21 = 20 THEN 'val' ELSE 'train' END AS split, unnest(ws[:len(ws) - 1]) AS a, unnest(ws[2:]) AS b FROM w WHERE len(ws) > 1),
n AS (SELECT a, b, count(*) AS n FROM p GROUP BY ALL), f AS (SELECT a, sum(n) AS n FROM n GROUP BY a), v AS (SELECT count(DISTINCT b) AS v FROM n),
x AS (SELECT split, strlen(p.b) AS bytes, -ln((n.n + 1) / (f.n + v.v)) AS nats FROM p JOIN n USING (a, b) JOIN f USING (a) CROSS JOIN v)
SELECT split, count(*)::BIGINT AS n_tokens, sum(bytes)::BIGINT AS n_bytes, round(sum(nats) / (ln(2) * sum(bytes)), 6) AS bpb_ce, round(sum((1 - exp(-nats)) ^ 3 * nats) / (ln(2) * sum(bytes)), 6) AS bpb_focal FROM x GROUP BY split""")
def bits_per_byte(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select(F.when(F.col("doc_id") % 21 == 20, "val").otherwise("train").alias("split"), "text")
    b = L.bigram_nats(d, ["split"]).withColumn("bytes", F.octet_length("token"))
    return b.groupBy("split").agg(F.sum("n").alias("n_tokens"), F.sum(F.col("n") * F.col("bytes")).alias("n_bytes"), F.round(L.bits_per_byte(F.col("nats"), F.col("bytes"), F.col("n")), 6).alias("bpb_ce"), F.round(L.bits_per_byte(R.focal(F.col("nats")), F.col("bytes"), F.col("n")), 6).alias("bpb_focal"))


@query("SELECT i AS step, printf('step %05d', i) AS shown, round(1 / (1 + exp(-i / 10.0)), 6)::DOUBLE AS sigmoid, round(0.2 * (1 - i / 100.0), 6)::DOUBLE AS decay, (ceil(i * 64 / 128.0) * 128)::BIGINT AS dim, round(CASE WHEN i / 100.0 > 1 - 0.65 THEN (1 - i / 100.0) / 0.65 ELSE 1.0 END, 6)::DOUBLE AS rate, round((1 - least(i / 300.0, 1)) * 0.85 + least(i / 300.0, 1) * 0.95, 6)::DOUBLE AS momentum FROM range(0, 101) t(i)")
def lr_schedule(spark, sf_dir):
    p = F.col("step") / 100
    out = {"shown": F.format_string("step %05d", "step"), "sigmoid": F.round(R.sigmoid(F.col("step") / 10), 6), "decay": F.round(R.weight_decay(p, 0.2), 6), "dim": R.rounded_dim(F.col("step")), "rate": F.round(R.schedule(p), 6), "momentum": F.round(R.momentum(F.col("step")), 6)}
    return spark.range(101).select(F.col("id").alias("step")).select("step", *[c.alias(k) for k, c in out.items()])


@query("SELECT user_id, event_id, round(32768 / nullif(value, 0), 4) AS tokens_per_s, round(32768 / nullif(value, 0) * 6e7 / 989.5e12 * 100, 8) AS mfu_percent, round(coalesce(sum(CASE WHEN k > 10 THEN value END) OVER (PARTITION BY user_id ORDER BY k ROWS UNBOUNDED PRECEDING), 0), 4) AS trained_s FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM events)")
def throughput_metrics(spark, sf_dir):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    s = table(spark, sf_dir, "events").select(F.col("user_id").alias("run"), F.row_number().over(w).alias("step"), F.col("value").alias("dt"), "event_id")
    out = L.throughput(s, 32_768, 6e7)
    return out.select(F.col("run").alias("user_id"), "event_id", F.round("tokens_per_s", 4).alias("tokens_per_s"), F.round("mfu_percent", 8).alias("mfu_percent"), F.round("trained_s", 4).alias("trained_s"))


@query("SELECT doc_id, epoch FROM documents CROSS JOIN range(1, 3) t(epoch)")
def epoch_scan(spark, sf_dir):
    return P.epochs(table(spark, sf_dir, "documents").select("doc_id"), 2).withColumn("epoch", F.col("epoch").cast("long"))


@query("SELECT doc_id FROM labels UNION SELECT doc_id FROM documents")
def union_if_absent(spark, sf_dir):
    return ensure_ids(table(spark, sf_dir, "labels").select("doc_id").distinct(), table(spark, sf_dir, "documents").select("doc_id"))


@query("SELECT (l_orderkey % 97)::VARCHAR AS shape, count(DISTINCT l_partkey)::BIGINT AS n_names, sum(l_linenumber)::BIGINT AS n FROM lineitem GROUP BY 1")
def parameter_groups(spark, sf_dir):
    p = table(spark, sf_dir, "lineitem").groupBy((F.col("l_orderkey") % 97).cast("string").alias("shape"), F.col("l_partkey").alias("name")).agg(F.sum("l_linenumber").alias("n"))
    return L.parameter_groups(p).select("shape", F.size("names").cast("long").alias("n_names"), "n")


@query()
def generate_corpus(spark, sf_dir):
    return G.generate_corpus(spark)


@query()
def generator_rates(spark, sf_dir):
    g = G.generate_corpus(spark).withColumn("label", T.session_label(T.anomaly_hits(F.col("text"))))
    return S.with_share(g.groupBy("kind", "label").agg(F.count("*").alias("n_sessions")), "n_sessions", "pct")
