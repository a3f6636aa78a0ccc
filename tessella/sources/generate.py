"""A seeded corpus of session documents, generated where it is used."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# Source weights, rates, session sizes, gaps in ms, latency parameters.
SOURCES = (("APMTracer", 25), ("NetIntel", 15), ("LogStream", 25), ("OTel", 20), ("WANController", 10), ("APMTracer-BizTxn", 5))
CASCADE_RATE, ANOMALY_RATE = 0.03, 0.06
SIZES = {"normal": (8, 25), "anomalous": (10, 40), "cascade": (20, 60)}
GAP_MS, LATENCY_LOG, SPIKE = (50, 2000), (4.4, 0.6), (1800, 32000)
LEVELS = (("DEBUG", 30), ("INFO", 50), ("WARN", 15), ("ERROR", 4), ("CRITICAL", 1))
HEALTH = (("NORMAL", 70), ("SLOW", 15), ("VERY_SLOW", 8), ("STALL", 4), ("ERROR", 3))
KINDS = ("timeout", "oom", "circuit_open", "rate_limited", "connection_refused", "ssl_handshake_fail", "dns_nxdomain", "memory_leak", "thread_pool_exhausted")
OPERATIONS = ("http.request", "db.query", "db.write", "db.transaction", "cache.get", "cache.set", "rpc.call", "queue.publish", "queue.consume", "auth.validate", "llm.completion", "embedding.encode")
METHODS = ("GET", "POST", "PUT", "DELETE", "PATCH")
LINKS = ("mpls→inet", "inet→mpls", "mpls→mpls", "inet→inet", "4g→mpls", "lte→inet")
MESSAGES = {"DEBUG": "handler_entered", "INFO": "request_completed", "WARN": "cache_miss_rate_elevated", "ERROR": "upstream_timeout", "CRITICAL": "circuit_breaker_open"}
ALERTS = ("token_expired", "pii_leak_detected", "policy_violation", "cost_explosion", "oom_kill", "disk_full", "llm_jailbreak_attempt", "prompt_injection_detected", "data_exfil_blocked", "api_key_exposed")
# The reference's shards: training ones, the validation one, sessions of each, and the seeds.
TRAIN_SHARDS, VAL_SHARD, SHARD_ROWS, TRAIN_SEED, VAL_SEED = 20, 6542, 1000, 42, 99999
SERVICES = (
    "payment-gateway", "auth-service", "user-api", "inventory-db", "recommendation-engine", "notification-svc", "checkout-flow", "search-index", "order-processor",
    "analytics-pipeline", "fraud-detector", "cart-service", "shipping-estimator", "tax-calculator", "session-manager", "cdn-edge", "api-gateway", "queue-worker",
    "llm-inference", "embedding-service", "vector-db", "prompt-router", "cost-tracker", "pii-scanner", "policy-enforcer", "rate-limiter",
)
HOSTS = tuple(f"{name}-{i:02d}" for name, n in (("web", 19), ("db", 9), ("gpu-node", 7), ("cache", 5), ("k8s-worker", 11)) for i in range(1, n + 1))
REGIONS = ("us-east-1", "us-west-2", "eu-west-1", "ap-southeast-1", "eu-central-1")
SITES = tuple(f"branch-{i:02d}" for i in range(1, 16))
SPANS, START_MS, SESSION_GAP_MS = (3, 12), 1767225600000, (1000, 30000)


class Draw:
    """Uniform numbers that depend on a key and the seed alone, whatever the partitioning."""

    def __init__(self, seed: int, *keys: str | Column):
        self.seed, self.keys, self.n = seed, keys, 0

    def uniform(self, lo: float = 0.0, hi: float = 1.0) -> Column:
        self.n += 1
        h = F.xxhash64(*self.keys, F.lit(self.seed * 1000 + self.n))
        return lo + (F.shiftrightunsigned(h, 11) / float(1 << 53)) * (hi - lo)

    def integer(self, lo: int, hi: int) -> Column:
        return F.floor(self.uniform(lo, hi + 1)).cast("int")

    def normal(self) -> Column:
        return F.sqrt(-2 * F.log(1 - self.uniform())) * F.cos(2 * 3.141592653589793 * self.uniform())

    def choice(self, values) -> Column:
        return F.get(F.array(*map(F.lit, values)), self.integer(0, len(values) - 1))

    def weighted(self, table) -> Column:
        total, below, u, out = sum(w for _, w in table), 0, self.uniform(), None
        for value, weight in table[:-1]:
            below += weight
            out = (F if out is None else out).when(u < below / total, value)
        return out.otherwise(table[-1][0])

    def hex(self, n: int) -> Column:
        return F.substring(F.md5(self.uniform().cast("string")), 1, n)

    def latency(self) -> Column:
        return F.greatest(F.lit(5), F.floor(F.exp(LATENCY_LOG[0] + LATENCY_LOG[1] * self.normal()))).cast("int")

    def spike(self) -> Column:
        return self.integer(*SPIKE)


def _kv(*pairs) -> Column:
    return F.concat_ws(" ", *[F.concat(F.lit(f"{k}="), v.cast("string")) for k, v in pairs])


def _num(value: Column, digits: int) -> Column:
    return F.format_string(f"%.{digits}f", value)


def _bodies(d: Draw, bad: Column) -> dict[str, Column]:
    """The fields of a line of each source, in its normal or its anomalous form."""
    pick = lambda a, b: F.when(bad, a).otherwise(b)
    svc, prompt, spiked = d.choice(SERVICES), pick(d.integer(256, 4096), d.integer(20, 512)), d.uniform() < 0.05
    took = F.when(spiked, d.spike()).otherwise(d.latency())
    health, base, op = d.weighted(HEALTH), d.latency(), d.choice(OPERATIONS)
    factor = F.when(health == "NORMAL", 1.0).when(health == "SLOW", d.uniform(2, 4)).when(health == "VERY_SLOW", d.uniform(4, 10)).otherwise(d.uniform(10, 30))
    level = d.weighted(LEVELS)
    message = F.create_map(*[F.lit(x) for kv in MESSAGES.items() for x in kv])[level]
    answered = F.floor(10 + d.uniform() * (prompt - 9)).cast("int")
    is_db = op.contains("db")
    span = lambda: F.substring(F.md5(F.concat_ws("|", "trace_id", (d.uniform() * F.col("n_spans")).cast("int").cast("string"))), 1, 16)  # noqa: E731  one of the session's
    return {
        "APMTracer": F.concat(F.lit("[svc="), svc, F.lit("] "), _kv(("latency_ms", pick(d.spike(), d.latency())), ("error", pick(d.choice(KINDS), F.lit("none"))), ("trace_id", F.col("trace_id")), ("span_id", span()), ("http_status", pick(d.choice((400, 401, 403, 404, 408, 429, 500, 502, 503, 504)), F.lit(200))), ("http_method", d.choice(METHODS)), ("gpu_util", _num(pick(d.uniform(0.88, 0.99), d.uniform(0.05, 0.65)), 2)), ("prompt_tokens", prompt), ("response_tokens", pick(F.lit(0), answered)), ("cost_usd", _num(prompt * 0.000003, 6)), ("drift_score", _num(pick(d.uniform(0.65, 0.99), d.uniform(0, 0.12)), 3)))),
        "NetIntel": _kv(("path", F.concat(F.lit("internet→aws-"), d.choice(REGIONS))), ("latency_ms", pick(d.integer(800, 8000), d.integer(10, 200))), ("jitter_ms", pick(d.integer(50, 800), d.integer(1, 8))), ("packet_loss", _num(pick(d.uniform(0.05, 0.45), d.uniform(0, 0.001)), 4)), ("bgp_changes", pick(d.integer(1, 12), F.lit(0))), ("dns_ms", pick(d.integer(200, 5000), d.integer(5, 40))), ("hop_count", pick(d.integer(18, 32), d.integer(7, 14))), ("mtu", pick(d.choice((576, 1400, 1500)), F.lit(1500))), ("reachable", pick(d.choice(("true", "false")), F.lit("true")))),
        "LogStream": F.concat(_kv(("host", d.choice(HOSTS)), ("level", pick(F.lit("CRITICAL"), level)), ("svc", svc), ("msg", pick(d.choice(ALERTS), message)), ("latency_ms", pick(d.spike(), d.latency())), ("session_id", d.hex(8))), F.when(bad, " alert=true escalated=true pagerduty=triggered").otherwise(""), F.lit(" "), _kv(("user_id", F.concat(F.lit("usr_"), d.integer(10000, 99999).cast("string"))))),
        "OTel": _kv(("trace_id", F.col("trace_id")), ("span_id", span()), ("parent", span()), ("op", op), ("svc", svc), ("duration_ms", took), ("status", F.when(spiked | (took > 1000), "error").otherwise("ok")), ("db", F.when(is_db, "postgres").otherwise("n/a")), ("rows", F.when(is_db, d.integer(0, 5000)).otherwise(0)), ("k8s_pod", F.concat(svc, F.lit("-"), d.hex(8))), ("k8s_ns", F.lit("prod"))),
        "WANController": F.concat(_kv(("site", d.choice(SITES)), ("link", d.choice(LINKS)), ("qos", pick(F.lit("be"), d.choice(("ef", "af41", "af31", "cs3", "cs1", "be")))), ("latency_ms", pick(d.integer(500, 5000), d.integer(10, 80))), ("loss", _num(pick(d.uniform(0.05, 0.4), F.lit(0.0)), 3)), ("jitter_ms", pick(d.integer(80, 600), d.integer(1, 5))), ("bw_util", _num(pick(d.uniform(0.92, 1.0), d.uniform(0.1, 0.75)), 3)), ("policy", pick(F.lit("VIOLATED"), F.lit("active")))), F.when(bad, " alert=link_degraded").otherwise(""), F.lit(" "), _kv(("interface", F.concat(F.lit("ge0/"), d.integer(0, 3).cast("string"))))),
        "APMTracer-BizTxn": _kv(("trace_id", F.col("trace_id")), ("svc", svc), ("txn", F.concat(F.lit("/"), svc, F.lit("/api/v2/"), d.choice(("checkout", "search", "auth", "recommend")))), ("health", health), ("response_time_ms", F.when(health == "ERROR", d.spike()).otherwise((base * factor).cast("int"))), ("baseline_ms", base), ("call_count", d.integer(1, 500)), ("error_pct", _num(F.when(health == "NORMAL", d.uniform(0, 0.05)).otherwise(d.uniform(0, 0.8)), 3)), ("slow_pct", _num(F.when(health == "NORMAL", d.uniform(0, 0.1)).otherwise(d.uniform(0, 0.9)), 3))),
    }


def generate_events(spark: SparkSession, n: int, seed: int = 42, anomaly: float = ANOMALY_RATE, cascade: float = CASCADE_RATE, onset: str = "reference", shard_rows: int = 1000) -> DataFrame:
    """(session_id, shard, kind, event_pos, ts, src, line) of n sessions.

    onset='documented' lets the first events of a cascade be normal; by default they are bad from the first on.
    """
    d = Draw(seed, "session_id")
    p = d.uniform()
    kind = F.when(p < cascade, "cascade").when(p < cascade + anomaly, "anomalous").otherwise("normal")
    s = spark.range(n).select(F.col("id").alias("session_id"), F.floor(F.col("id") / shard_rows).cast("int").alias("shard"), kind.alias("kind"))
    size = None
    for name, (lo, hi) in SIZES.items():
        size = (F if size is None else size).when(F.col("kind") == name, d.integer(lo, hi))
    s = s.withColumns({"n_events": size, "trigger": d.integer(3, 6), "n_spans": d.integer(*SPANS), "trace_id": d.hex(16)})
    # Sessions begin one after the other within a shard, events within a session, of which there are 60 at most.
    begins = F.sum(d.uniform(*SESSION_GAP_MS)).over(Window.partitionBy("shard").orderBy("session_id"))
    gaps = F.transform(F.sequence(F.lit(0), F.col("n_events") - 1), lambda i: Draw(seed + 2, "session_id", i).uniform(*GAP_MS))
    s = s.withColumns({"begins": begins, "gaps": gaps})
    after = F.transform("gaps", lambda _, i: F.aggregate(F.slice("gaps", F.lit(1), i + 1), F.lit(0.0), lambda a, g: a + g))
    e = s.select("session_id", "shard", "kind", "trigger", "n_spans", "trace_id", "begins", F.posexplode(after).alias("event_pos", "after"))
    d = Draw(seed + 1, "session_id", "event_pos")
    ms = F.lit(START_MS) + F.floor(F.col("begins") + F.col("after"))
    bad = F.col("kind") != "normal"
    if onset == "documented":
        bad = bad & ((F.col("kind") != "cascade") | (F.col("event_pos") >= F.col("trigger")))
    e = e.withColumns({"ts": F.timestamp_millis(ms), "src": d.weighted(SOURCES), "bad": bad})
    body = None
    for name, fields in _bodies(d, F.col("bad")).items():
        body = (F if body is None else body).when(F.col("src") == name, fields)
    head = F.concat(F.lit("[ts="), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSS"), F.lit("Z] [src="), F.col("src"), F.lit("] "))
    return e.select("session_id", "shard", "kind", "event_pos", "ts", "src", F.concat(head, body).alias("line"))


def generate_sessions(spark: SparkSession, n: int, **options) -> DataFrame:
    """(session_id, shard, kind, text): lines joined in order; a session has at most 60."""
    e = generate_events(spark, n, **options)
    lines = F.transform(F.array_sort(F.collect_list(F.struct("event_pos", "line"))), lambda x: x["line"])
    return e.groupBy("session_id", "shard", "kind").agg(F.array_join(lines, "\n").alias("text"))


def generate_corpus(spark: SparkSession) -> DataFrame:
    """(session_id, shard, kind, text) of the training shards and of the validation shard, whose ids come after theirs."""
    n = TRAIN_SHARDS * SHARD_ROWS
    val = generate_sessions(spark, SHARD_ROWS, seed=VAL_SEED, shard_rows=SHARD_ROWS)
    val = val.withColumns({"session_id": F.col("session_id") + n, "shard": F.lit(VAL_SHARD)})
    return generate_sessions(spark, n, seed=TRAIN_SEED, shard_rows=SHARD_ROWS).unionByName(val)


def audited(corpus: DataFrame) -> DataFrame:
    """Per shard of (session_id, shard, kind, text): its sessions, and how many depart from the sizes, gaps and forms that the generator states."""
    lines = F.split("text", "\n")
    known = "|".join(name for name, _ in SOURCES)
    form = rf"^\[ts=\d{{4}}-\d\d-\d\dT\d\d:\d\d:\d\d\.\d{{3}}Z\] \[src=({known})\] (\[svc=\S+\] )?(\S+=\S+)( \S+=\S+)+$"
    at = F.transform(lines, lambda x: F.unix_millis(F.try_to_timestamp(F.substring(x, 5, 23), F.lit("yyyy-MM-dd'T'HH:mm:ss.SSS"))))
    gaps = F.zip_with(F.slice(at, F.lit(2), F.size(at) - 1), F.slice(at, F.lit(1), F.size(at) - 1), lambda b, a: b - a)
    lo, hi = (F.create_map(*[F.lit(x) for k, v in SIZES.items() for x in (k, v[i])])[F.col("kind")] for i in (0, 1))
    s = corpus.select("shard", (~F.size(lines).between(lo, hi)).alias("size"), F.exists(gaps, lambda g: (g < GAP_MS[0] - 1) | (g > GAP_MS[1] + 1)).alias("gap"), F.exists(lines, lambda x: ~x.rlike(form)).alias("line"), F.size(F.array_distinct(F.regexp_extract_all("text", F.lit(r"\btrace_id=(\w+)"), F.lit(1)))).cast("long").alias("traces"))
    return s.groupBy("shard").agg(F.count("*").alias("n_sessions"), F.count_if("size").alias("odd_sizes"), F.count_if("gap").alias("odd_gaps"), F.count_if("line").alias("odd_lines"), F.max("traces").alias("most_traces"))
