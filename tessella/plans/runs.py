"""Queries over experiment runs: their texts, gains, commits, metrics and reports."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import reports as R
from ..operators import experiments as X
from ..operators import loss as L
from .queries import _EXPERIMENTS, _W, experiments, query, table

# A response for every customer: what is changed, and code in one of three forms.
_RESPONSE = """CASE c_custkey % 3 WHEN 0 THEN 'Well.' || chr(10) || 'Proposed change: raise the rate for ' || c_name || ' a little...' WHEN 1 THEN 'i am trying a new schedule, ' || c_name || chr(10) ELSE 'so' || chr(10) || '  nothing said that a pattern finds  ' END
 || chr(10) || CASE c_custkey % 4 WHEN 0 THEN '```python' || chr(10) || 'a = 1' || chr(10) || '```' || chr(10) || '```python ' || chr(10) || '  b = ' || c_custkey || chr(10) || '```' WHEN 1 THEN '```' || chr(10) || 'def f(): return ' || c_custkey || chr(10) || '```' WHEN 2 THEN '```' || chr(10) || 'prose' || chr(10) || '```' ELSE 'no code' END"""


def responses(spark, sf_dir):
    c, key, nl = table(spark, sf_dir, "customer"), F.col("c_custkey"), F.lit("\n")
    said = F.when(key % 3 == 0, F.concat(F.lit("Well.\nProposed change: raise the rate for "), F.col("c_name"), F.lit(" a little..."))).when(key % 3 == 1, F.concat(F.lit("i am trying a new schedule, "), F.col("c_name"), nl)).otherwise("so\n  nothing said that a pattern finds  ")
    code = F.when(key % 4 == 0, F.concat(F.lit("```python\na = 1\n```\n```python \n  b = "), key, F.lit("\n```"))).when(key % 4 == 1, F.concat(F.lit("```\ndef f(): return "), key, F.lit("\n```"))).when(key % 4 == 2, "```\nprose\n```").otherwise("no code")
    return c.select("c_custkey", F.concat(said, nl, code).alias("text"))


_STRIP = "regexp_replace({}, '^\\s+|\\s+$', '', 'g')"
_LAST = "nullif({}, '')"


@query(f"""WITH r AS (SELECT c_custkey, {_RESPONSE} AS text FROM customer),
x AS (SELECT c_custkey, regexp_extract_all(text, '(?s){R.TAGGED_BLOCK}', 1) AS a, regexp_extract_all(text, '(?s){R.ANY_BLOCK}', 1) AS b FROM r),
y AS (SELECT c_custkey, {_STRIP.format("a[-1]")} AS a, {_STRIP.format("b[-1]")} AS b FROM x)
SELECT c_custkey, coalesce(a, CASE WHEN contains(b, 'import torch') OR contains(b, 'def ') THEN b END) AS code FROM y""")
def code_blocks(spark, sf_dir):
    return responses(spark, sf_dir).select("c_custkey", R.code_block(F.col("text")).alias("code"))


_P = [p.replace("'", "''") for p in R.SUMMARY_PATTERNS]


@query(f"""WITH r AS (SELECT c_custkey, {_RESPONSE} AS text FROM customer),
x AS (SELECT c_custkey, nullif(regexp_extract(text, '(?i){_P[0]}', 1), '') AS a, nullif(regexp_extract(text, '(?i){_P[1]}', 1), '') AS b, list_filter(list_transform(string_split(string_split(text, '```python')[1], chr(10)), lambda l: trim(l)), lambda l: length(l) > 20) AS l FROM r)
SELECT c_custkey, coalesce(rtrim(trim(a), '.'), rtrim(trim(b), '.'), left(l[-1], 80), 'see response log') AS summary FROM x""")
def change_summaries(spark, sf_dir):
    return responses(spark, sf_dir).select("c_custkey", R.change_summary(F.col("text")).alias("summary"))


@query(f"""WITH {_EXPERIMENTS}, k AS (SELECT night, ran_at, ordinal, val_bpb, lag(val_bpb) {_W}) AS before, row_number() {_W}) AS n FROM e WHERE status = 'KEEP'), d AS (SELECT *, round(before - val_bpb, 6) AS delta FROM k WHERE n > 1)
SELECT night, ordinal, delta, (row_number() OVER (PARTITION BY night ORDER BY delta DESC NULLS LAST, ran_at, ordinal))::BIGINT AS rank FROM d""")
def ranked_gains(spark, sf_dir):
    return X.ranked_gains(experiments(spark, sf_dir)).select("night", "ordinal", "delta", "rank")


def described(spark, sf_dir):
    """Experiments with four digits, so that printing doesn't round, and a description."""
    e = experiments(spark, sf_dir).withColumn("val_bpb", F.floor(F.col("val_bpb") * 10000) / 10000)
    return e.withColumn("description", F.concat(F.lit("swap "), F.repeat(F.lower("status"), 9), F.lit(" in run "), F.col("ordinal")))


_DESCRIBED = f"{_EXPERIMENTS}, x AS (SELECT * REPLACE (floor(val_bpb * 10000) / 10000 AS val_bpb), 'swap ' || repeat(lower(status), 9) || ' in run ' || ordinal AS description FROM e)"


@query(f"""WITH {_DESCRIBED}, v AS (SELECT *, CASE WHEN status <> 'CRASH' AND val_bpb <= 50 THEN val_bpb END AS v FROM x), b AS (SELECT *, least(coalesce(min(v) {_W} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.8), 0.8) AS best FROM v),
k AS (SELECT *, least(coalesce(min(val_bpb) OVER (PARTITION BY night ORDER BY ran_at, ordinal ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.8), 0.8) AS before, (row_number() {_W}))::BIGINT AS n FROM b WHERE v < best)
SELECT night, ordinal, n, printf('[val_bpb=%.4f] [Δ=%+.4f] [change: %s] [exp: %d]', val_bpb, val_bpb - before, left(description, 60), n) AS subject FROM k""")
def commit_subjects(spark, sf_dir):
    return X.commit_rows(described(spark, sf_dir), 0.8).select("night", "ordinal", "n", "subject")


@query(f"""WITH {_DESCRIBED}, r AS (SELECT *, (row_number() OVER (PARTITION BY night ORDER BY val_bpb, ran_at, ordinal))::BIGINT AS rank FROM x WHERE val_bpb IS NOT NULL)
SELECT night, rank, printf('%2d. %s  %.4f  %s', rank, left(commit, 8), val_bpb, CASE WHEN length(description) > 45 THEN left(description, 42) || '...' ELSE description END) AS shown FROM r WHERE rank <= 5""")
def report_lines(spark, sf_dir):
    return X.report_lines(described(spark, sf_dir)).select("night", "rank", "shown")


def steps(spark, sf_dir):
    """Each user's events as the steps of a run."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("run"), F.row_number().over(w).alias("step"), F.col("value").alias("dt"))


_STEPS = "s AS (SELECT user_id AS run, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS step, value AS dt FROM events)"


@query(f"""WITH {_STEPS}, g AS (SELECT run, coalesce(sum(CASE WHEN step > 10 THEN dt END), 0) AS t, sum(dt) AS a, count(*) AS n FROM s GROUP BY run)
SELECT run, round(t, 4) AS training_seconds, round(a, 4) AS total_seconds, n::BIGINT AS num_steps, round(CASE WHEN t > 0 THEN 100 * 6e7 * 32768 * (n - 10) / t / 989.5e12 ELSE 0 END, 8) AS mfu_percent, round(32768 * n / 1e6, 6)::DOUBLE AS total_tokens_m FROM g""")
def run_summary(spark, sf_dir):
    out = L.run_summary(steps(spark, sf_dir), 32_768, 6e7)
    return out.select("run", "num_steps", *[F.round(c, d).alias(c) for c, d in (("training_seconds", 4), ("total_seconds", 4), ("mfu_percent", 8), ("total_tokens_m", 6))])


@query(f"""WITH {_STEPS}, b AS (SELECT *, coalesce(sum(CASE WHEN step > 10 THEN dt END) OVER (PARTITION BY run ORDER BY step ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before, coalesce(sum(CASE WHEN step > 10 THEN dt END) OVER (PARTITION BY run ORDER BY step ROWS UNBOUNDED PRECEDING), 0) AS done FROM s)
SELECT run, step::INT AS step, round(100 * least(before / 300, 1), 4) AS done_percent, round(dt * 1000, 2) AS dt_ms, floor(32768 / nullif(dt, 0))::BIGINT AS tokens_per_s, round(greatest(0, 300 - done), 4) AS remaining_s FROM b""")
def progress_rows(spark, sf_dir):
    out = L.progress_rows(steps(spark, sf_dir), 32_768, 6e7, 300.0)
    return out.select("run", "step", F.round("done_percent", 4).alias("done_percent"), F.round("dt_ms", 2).alias("dt_ms"), "tokens_per_s", F.round("remaining_s", 4).alias("remaining_s"))


@query("""WITH d AS (SELECT unnest(range(1, 13)) AS depth), s AS (SELECT depth, (ceil(depth * 64 / 128.0) * 128)::BIGINT AS dim FROM d)
SELECT depth, dim, (8192 * dim * 2 + 8192 * dim * (depth // 2) + 12 * dim * dim * depth + 34 * depth)::BIGINT AS n_parameters, (6 * (8192 * dim + 12 * dim * dim * depth + 32 * depth) + 12 * dim * 2048 * depth)::BIGINT AS flops_per_token FROM s""")
def model_costs(spark, sf_dir):
    rows = []
    for depth in range(1, 13):
        dim = -(-depth * 64 // 128) * 128
        rows.append((depth, dim, L.model_size(8192, depth, dim)["total"], L.flops_per_token(8192, depth, dim, dim // 128, 2048)))
    return spark.createDataFrame(rows, "depth long, dim long, n_parameters long, flops_per_token long")


@query("""WITH t AS (SELECT l_orderkey // 32 AS row_id, l_partkey % 97 AS token_id, l_quantity / 10 AS nats FROM lineitem), v AS (SELECT token_id, token_id % 6 AS n_bytes FROM (SELECT unnest(range(97)) AS token_id)), x AS (SELECT * FROM t JOIN v USING (token_id) WHERE row_id < 100000 // (4 * 32) * 4)
SELECT count(*)::BIGINT AS n_tokens, sum(n_bytes)::BIGINT AS n_bytes, round(sum(CASE WHEN n_bytes > 0 THEN nats END) / (ln(2) * sum(n_bytes)), 6) AS bpb_ce, round(sum(CASE WHEN n_bytes > 0 THEN (1 - exp(-nats)) ^ 3 * nats END) / (ln(2) * sum(n_bytes)), 6) AS bpb_focal FROM x""")
def evaluated_budget(spark, sf_dir):
    """Bits per byte of a (row_id, token_id, nats) table over a budget of tokens, by the vocabulary's lengths."""
    t = table(spark, sf_dir, "lineitem").select(F.floor(F.col("l_orderkey") / 32).alias("row_id"), F.col("l_linenumber").alias("pos"), (F.col("l_partkey") % 97).cast("int").alias("token_id"), (F.col("l_quantity").cast("double") / 10).alias("nats"))
    v = spark.range(97).select(F.col("id").cast("int").alias("token_id"), (F.col("id") % 6).cast("int").alias("n_bytes"))
    out = L.evaluated(t, v, 100_000, 32, 4)
    return out.select("n_tokens", F.col("n_bytes").cast("long").alias("n_bytes"), F.round("bpb_ce", 6).alias("bpb_ce"), F.round("bpb_focal", 6).alias("bpb_focal"))
