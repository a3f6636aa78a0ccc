"""The session profile over a stream: an addition, as the operators are batch ones."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def live_sessions(events: DataFrame, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """(user_id, start, end, n_events, n_errors, worst): windows that close after `gap` without events.

    events has ts (timestamp), user_id, event_type and value; rows later than `late` are dropped.
    """
    w = F.session_window("ts", gap)
    out = events.withWatermark("ts", late).groupBy("user_id", w.alias("w")).agg(F.count("*").alias("n_events"), F.count_if(F.col("event_type") == "error").alias("n_errors"), F.max("value").alias("worst"))
    return out.select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n_events", "n_errors", "worst")
