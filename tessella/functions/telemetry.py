"""Expressions over session texts and event lines."""

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values.
ANOMALY_PATTERN = r"error=(?!none)|level=CRITICAL|pagerduty=triggered|policy=VIOLATED|health=(?:STALL|VERY_SLOW|ERROR)|reachable=false|alert=true"
SOURCE_PATTERN = r"\[src=([A-Za-z\-]+)\]"
LATENCY_PATTERN = r"latency_ms=(\d+)"
LABELS = ("normal", "anomalous", "cascade")
CASCADE_HITS = 3
ANOMALY_KEYWORDS = (
    "error", "ERROR", "timeout", "TIMEOUT", "fail", "FAIL", "CRITICAL", "critical",
    "alert", "ALERT", "VIOLATED", "violated", "circuit_breaker", "escalate",
    "pagerduty", "anomal", "ANOMAL", "drift_score", "STALL", "stall",
    "degraded", "DEGRADED", "down", "DOWN", "outage", "OUTAGE",
)


def anomaly_hits(text: Column) -> Column:
    """Matches, not events: a line can count several times. `error=none` is no hit."""
    return F.regexp_count(text, F.lit(ANOMALY_PATTERN)).cast("long")


def session_label(hits: Column) -> Column:
    return F.when(hits == 0, "normal").when(hits >= CASCADE_HITS, "cascade").otherwise("anomalous")


def event_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(r"\[ts=")).cast("long")


def sources(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(SOURCE_PATTERN), F.lit(1))


def latencies(text: Column) -> Column:
    """Numbers too large for an int are null."""
    return F.transform(F.regexp_extract_all(text, F.lit(LATENCY_PATTERN), F.lit(1)), lambda x: x.try_cast("int"))


def attributes(line: Column) -> Column:
    """key=value pairs behind the bracketed header, as a map; of equal keys the first."""
    pairs = F.regexp_extract_all(line, F.lit(r"(?:^|[\s])([A-Za-z_]+=\S*)"), F.lit(1))
    names = F.transform(pairs, lambda p: F.substring_index(p, "=", 1))
    first = F.filter(pairs, lambda p, i: F.array_position(names, F.substring_index(p, "=", 1)) == i + 1)
    return F.map_from_entries(F.transform(first, lambda p: F.struct(F.substring_index(p, "=", 1), F.substring(p, F.instr(p, F.lit("=")) + 1, F.length(p)))))


def attribute(attrs: Column, name: str, otherwise: str) -> Column:
    """The value of a name, or `otherwise`."""
    return F.coalesce(F.try_element_at(attrs, F.lit(name)), F.lit(otherwise))


def has_anomaly_keyword(token: Column) -> Column:
    return token.rlike("|".join(ANOMALY_KEYWORDS))
