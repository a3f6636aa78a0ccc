"""Corpus profile: session documents, their labels, sources, lengths and latencies."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import telemetry as T


def event_line(ts: Column, source: Column, fields: list[tuple[str, Column]]) -> Column:
    head = F.concat(F.lit("[ts="), F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSS"), F.lit("Z] [src="), source, F.lit("]"))
    return F.concat_ws(" ", head, *[F.concat(F.lit(f"{k}="), v.cast("string")) for k, v in fields])


def sessions_of_events(events: DataFrame) -> DataFrame:
    """(user_id, day, text): the lines of a user's day in order, joined by line feeds. A day of one user is a document."""
    bad = F.col("event_type") == "error"
    fields = [("latency_ms", F.floor("value").cast("int")), ("error", F.when(bad & (F.col("value") >= 30), "timeout").otherwise("none")), ("level", F.when(bad & (F.col("value") > 100), "CRITICAL").otherwise("INFO"))]
    line = event_line(F.col("ts"), F.col("event_type"), fields)
    rows = events.select("user_id", F.to_date("ts").alias("day"), F.struct("ts", "event_id", line.alias("line")).alias("e"))
    text = F.array_join(F.transform(F.array_sort(F.collect_list("e")), lambda e: e["line"]), "\n")
    return rows.groupBy("user_id", "day").agg(text.alias("text"))


def classified(sessions: DataFrame) -> DataFrame:
    """Adds hits, label and n_events."""
    return sessions.withColumn("hits", T.anomaly_hits(F.col("text"))).withColumn("label", T.session_label(F.col("hits"))).withColumn("n_events", T.event_count(F.col("text")))


def with_share(counts: DataFrame, count: str, share: str) -> DataFrame:
    """Percent of all, over the few rows of a counted domain."""
    return counts.withColumn(share, F.round(F.col(count) * 100.0 / F.nullif(F.sum(count).over(Window.partitionBy()), F.lit(0)), 6))


def label_distribution(sessions: DataFrame) -> DataFrame:
    """A row for each label, those without sessions too."""
    domain = sessions.sparkSession.createDataFrame([(x,) for x in T.LABELS], "label string")
    found = classified(sessions).groupBy("label").agg(F.count("*").alias("n"))
    return with_share(domain.join(found, "label", "left").select("label", F.coalesce("n", F.lit(0)).alias("n_sessions")), "n_sessions", "pct")


def source_mix(sessions: DataFrame) -> DataFrame:
    counts = sessions.select(F.explode_outer(T.sources(F.col("text"))).alias("source")).where("source IS NOT NULL").groupBy("source").agg(F.count("*").alias("n_events"))
    return with_share(counts, "n_events", "pct").orderBy(F.desc("n_events"), "source")


def length_quantiles(sessions: DataFrame) -> DataFrame:
    """Least, quartiles (linear) and most events of a session."""
    q = classified(sessions).agg(F.min("n_events").alias("least"), F.percentile("n_events", F.array(*map(F.lit, (0.25, 0.5, 0.75)))).alias("q"), F.max("n_events").alias("most"))
    return q.select("least", F.col("q")[0].alias("p25"), F.col("q")[1].alias("median"), F.col("q")[2].alias("p75"), "most")


def histogram(df: DataFrame, value: str, bins: int, by: list[str] | None = None) -> DataFrame:
    """Counts in `bins` equal bins between each group's least and greatest value, the last one closed.

    Bins without rows have no row; nulls are left out; a single value widens its range by a half on both sides.
    """
    by = by or []
    v = F.col(value).cast("double")
    df = df.where(v.isNotNull())
    ends = df.groupBy(*by).agg(F.min(v).alias("lo"), F.max(v).alias("hi"))
    ends = ends.withColumn("one", F.col("lo") == F.col("hi")).select(*by, F.when(F.col("one"), F.col("lo") - 0.5).otherwise(F.col("lo")).alias("lo"), F.when(F.col("one"), F.col("hi") + 0.5).otherwise(F.col("hi")).alias("hi"))
    joined = df.join(ends, by) if by else df.join(F.broadcast(ends), F.lit(True))  # without groups, one row
    bin_ = F.least(F.floor((v - F.col("lo")) * bins / (F.col("hi") - F.col("lo"))) + 1, F.lit(bins)).alias("bin")
    return joined.groupBy(*by, "lo", "hi", bin_).agg(F.count("*").alias("n"))


def latencies_by_label(sessions: DataFrame) -> DataFrame:
    """A row for each latency, with its session and whether that is normal."""
    return classified(sessions).select("user_id", "day", "label", F.posexplode(T.latencies(F.col("text"))).alias("pos", "latency_ms"))


def first_sessions(sessions: DataFrame, n: int = 2000) -> DataFrame:
    """The first n sessions in order, for a quick look: each task keeps n, no more meet."""
    return sessions.orderBy("user_id", "day").limit(n)


def sample_per_label(sessions: DataFrame, seed: int = 42) -> DataFrame:
    """One session of each label, by the least digest; partial minima, so no label is gathered."""
    c = classified(sessions)
    key = F.struct(F.md5(F.concat_ws("|", "user_id", F.col("day").cast("string"), F.lit(seed))).alias("h"), "user_id", "day", F.substring("text", 1, 400).alias("shown"))
    return c.groupBy("label").agg(F.min(key).alias("s")).select("label", "s.user_id", "s.day", "s.shown")


def event_rows(sessions: DataFrame) -> DataFrame:
    """Typed view of the lines: position, time, source, attributes and the promoted ones."""
    e = sessions.select("user_id", "day", F.posexplode(F.split("text", "\n")).alias("event_pos", "line"))
    ts = F.try_to_timestamp(F.regexp_extract("line", r"\[ts=([^\]]+)Z\]", 1), F.lit("yyyy-MM-dd'T'HH:mm:ss.SSS"))
    e = e.select("user_id", "day", "event_pos", ts.alias("ts"), F.nullif(F.regexp_extract("line", T.SOURCE_PATTERN, 1), F.lit("")).alias("src"), T.attributes(F.col("line")).alias("attrs"))
    return e.withColumn("latency_ms", F.col("attrs")["latency_ms"].try_cast("int")).withColumn("error", F.col("attrs")["error"]).withColumn("level", F.col("attrs")["level"])
