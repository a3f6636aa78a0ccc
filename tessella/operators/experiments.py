"""Experiment histories: each history is a partition, so no window gathers all rows."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import reports as R

ORDER = ("ran_at", "ordinal")


def history() -> Window:
    return Window.partitionBy("night").orderBy(*ORDER)


def upto(start: int | None = None, end: int = 0) -> Window:
    return history().rowsBetween(Window.unboundedPreceding if start is None else start, end)


def numbered(df: DataFrame) -> DataFrame:
    return df.withColumn("n", F.row_number().over(history()).cast("long"))


def normalized(df: DataFrame) -> DataFrame:
    """Text columns as read to numbers and upper-case status; what is no number is null."""
    return df.withColumns({"val_bpb": R.number(F.col("val_bpb").cast("string")), "status": F.upper(F.trim("status"))})


def status_counts(df: DataFrame) -> DataFrame:
    k, d, c = (F.count_if(F.col("status") == s) for s in ("KEEP", "DISCARD", "CRASH"))
    out = df.groupBy("night").agg(F.count("*").alias("n_total"), k.alias("n_keep"), d.alias("n_discard"), c.alias("n_crash"))
    return out.withColumn("keep_rate", F.round(F.col("n_keep") / F.nullif(F.col("n_keep") + F.col("n_discard"), F.lit(0)), 6))


def value_counts(df: DataFrame, column: str) -> DataFrame:
    return df.where(F.col(column).isNotNull()).groupBy(column).agg(F.count("*").alias("n")).orderBy(F.desc("n"), column)


def kept(df: DataFrame) -> DataFrame:
    return df.where(F.col("status") == "KEEP")


def running_best(df: DataFrame) -> DataFrame:
    return kept(df).withColumn("best_so_far", F.min("val_bpb").over(upto()))


def kept_deltas(df: DataFrame) -> DataFrame:
    """Gain over the kept experiment before, the first one left out."""
    k = kept(df).withColumn("before", F.lag("val_bpb").over(history())).withColumn("n", F.row_number().over(history()))
    return k.where("n > 1").withColumn("delta", F.round(F.col("before") - F.col("val_bpb"), 6)).drop("n")


def ranked_gains(df: DataFrame) -> DataFrame:
    """Each history's gains, the greatest first, nulls last, then by time; numbered from 1."""
    order = [F.desc_nulls_last("delta"), *ORDER]
    return kept_deltas(df).withColumn("rank", F.row_number().over(Window.partitionBy("night").orderBy(*order)).cast("long")).orderBy("night", "rank")


def commit_rows(df: DataFrame, start: float) -> DataFrame:
    """The commit line of every kept run: its subject states the value and the difference to the best one before, or to `start`."""
    best = F.coalesce(F.min("val_bpb").over(upto(end=-1)), F.lit(start))
    rows = numbered(keep_if_better(df, start).where("kept")).withColumn("best_before", F.least(best, F.lit(start)))
    return rows.withColumn("subject", R.commit_subject(F.col("val_bpb"), F.col("best_before"), F.col("description"), F.col("n")))


def report_lines(df: DataFrame, most: int = 5) -> DataFrame:
    """Each history's best runs as lines of a report: number, commit, value, and what was changed, cut for display."""
    w = Window.partitionBy("night").orderBy("val_bpb", *ORDER)
    top = df.where(F.col("val_bpb").isNotNull()).withColumn("rank", F.row_number().over(w).cast("long")).where(F.col("rank") <= most)
    return top.withColumn("shown", F.format_string("%2d. %s  %.4f  %s", "rank", F.substring("commit", 1, 8), "val_bpb", R.shortened(F.col("description"))))


def keep_if_better(df: DataFrame, start: float | None = None) -> DataFrame:
    """Kept if strictly better than all before; crashed and implausible runs never are."""
    v = R.plausible_bpb(F.when(~F.col("status").eqNullSafe("CRASH"), F.col("val_bpb")))
    best = F.min("v").over(upto(end=-1))
    first = F.lit(float("inf") if start is None else start)
    return df.withColumn("v", v).withColumn("kept", F.coalesce(F.col("v") < F.least(F.coalesce(best, first), first), F.lit(False))).drop("v")


def best_experiment(df: DataFrame) -> DataFrame:
    """Of each history: first, worst and best value, the first row that has the best, its number, the gain."""
    n = numbered(df.where(F.col("val_bpb").isNotNull()))
    out = n.groupBy("night").agg(F.min(F.struct("val_bpb", "n", "commit")).alias("b"), F.min_by("val_bpb", "n").alias("first_bpb"), F.max("val_bpb").alias("max_bpb"), F.count("*").alias("n_runs"))
    return out.select("night", "n_runs", "first_bpb", "max_bpb", F.col("b.val_bpb").alias("best_bpb"), F.col("b.n").alias("best_at"), F.col("b.commit").alias("best_commit"), F.round(R.improvement_percent(F.col("first_bpb"), F.col("b.val_bpb")), 6).alias("gain_pct"))


def marked_best(df: DataFrame) -> DataFrame:
    """Marks every row that has its history's best value."""
    return df.withColumn("is_best", F.col("val_bpb") == F.min("val_bpb").over(Window.partitionBy("night")))


def top_changes(df: DataFrame, k: int = 5) -> DataFrame:
    return df.where(F.col("val_bpb").isNotNull()).orderBy("val_bpb", *ORDER).limit(k)


def drops(df: DataFrame, least: float = 0.02) -> DataFrame:
    return numbered(df).withColumn("before", F.lag("val_bpb").over(history())).where(F.col("val_bpb") < F.col("before") - least)


def below_baseline(df: DataFrame, slack: float = 0.0005) -> DataFrame:
    """Runs that didn't crash and are not above the first one's value."""
    ran = df.where(~F.col("status").eqNullSafe("CRASH")).withColumn("baseline", F.first_value("val_bpb").over(upto()))
    return ran.where(F.col("val_bpb") <= F.col("baseline") + slack)


def failure_streaks(rows: DataFrame, key: str, order: list[str], failed: Column, stop: int = 10) -> DataFrame:
    """The number of failures in a row up to each row, reset by a success, and whether the stop is reached."""
    w = Window.partitionBy(key).orderBy(*order)
    f = failed.cast("int")
    isle = rows.withColumn("isle", F.sum(1 - f).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    w = Window.partitionBy(key, "isle").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return isle.withColumn("streak", F.sum(f).over(w).cast("long")).withColumn("stopped", F.col("streak") >= stop).drop("isle")


def verdicts(df: DataFrame) -> DataFrame:
    return df.withColumns({"verdict": R.verdict(F.col("val_bpb")), "next_step": R.next_step(F.col("val_bpb"))})


def sparklines(df: DataFrame) -> DataFrame:
    values = F.transform(F.array_sort(F.collect_list(F.struct(*ORDER, "val_bpb"))), lambda s: s["val_bpb"])
    return df.where(F.col("val_bpb").isNotNull()).groupBy("night").agg(values.alias("v")).select("night", R.sparkline(F.col("v")).alias("line"))


def parse_log(lines: DataFrame, column: str = "line") -> DataFrame:
    """`hash|subject|time` lines that mention val_bpb; a bar within the subject cuts it, the rest goes to the time."""
    p = F.split(F.col(column), "\\|", 3)
    df = lines.where(F.col(column).contains("val_bpb") & F.col(column).contains("|")).withColumns({"_h": F.get(p, F.lit(0)), "_s": F.get(p, F.lit(1)), "_t": F.get(p, F.lit(2))})
    s = F.col("_s")
    fields = {"sha": F.substring("_h", 1, 8), "val_bpb": R.number(R.first_group(s, R.BPB_PATTERN)), "delta": R.number(R.first_group(s, R.DELTA_PATTERN)), "change": F.coalesce(R.first_group(s, R.CHANGE_PATTERN), F.substring(s, 1, 60)), "hypothesis": F.coalesce(R.first_group(s, R.HYPOTHESIS_PATTERN), F.lit("")), "timestamp": F.coalesce(F.trim("_t"), F.lit(""))}
    return df.select(*[c for c in lines.columns if c != column and c not in fields], *[v.alias(k) for k, v in fields.items()]).where(F.col("val_bpb").isNotNull())


def recent_best(df: DataFrame, most: int = 100) -> DataFrame:
    """The best value of each history's last rows; the limit comes before the filter."""
    last = Window.partitionBy("night").orderBy(*[F.desc(c) for c in ORDER])
    recent = df.withColumn("back", F.row_number().over(last)).where(F.col("back") <= most)
    return recent.where(F.col("val_bpb").isNotNull()).groupBy("night").agg(F.min("val_bpb").alias("best_bpb"), F.count("*").alias("n_seen"))


def ema(rows: DataFrame, key: str, order: list[str], value: str, beta: float = 0.9) -> DataFrame:
    """Debiased exponential mean up to each row.

    The sum of (1 - beta) * beta ** (k - i) * x_i is worked out within blocks of 256 rows and carried
    over whole blocks, so that powers stay in range and no history is gathered in one row.
    """
    w, block = Window.partitionBy(key).orderBy(*order), 256
    r = rows.withColumn("_k", F.row_number().over(w) - 1).withColumn("_b", F.floor(F.col("_k") / block)).withColumn("_i", (F.col("_k") % block).cast("int"))
    inner = Window.partitionBy(key, "_b").orderBy("_i").rowsBetween(Window.unboundedPreceding, 0)
    scaled = F.sum(F.col(value) * F.pow(F.lit(beta), -F.col("_i").cast("double"))).over(inner)
    r = r.withColumn("_e", (1 - beta) * scaled * F.pow(F.lit(beta), F.col("_i").cast("double")))
    ends = r.where((F.col("_i") == block - 1)).select(key, (F.col("_b") + 1).alias("_b"), F.col("_e").alias("_x"))
    # A block's weight at the end of the next ones is below 1e-11, so three blocks carry all that a double holds.
    carry = None
    for back in range(3):
        part = ends.select(key, (F.col("_b") + back).alias("_b"), (F.col("_x") * beta ** (block * back)).alias("_x"))
        carry = part if carry is None else carry.unionByName(part)
    carry = carry.groupBy(key, "_b").agg(F.sum("_x").alias("_c"))
    r = r.join(carry, [key, "_b"], "left")
    total = F.col("_e") + F.coalesce("_c", F.lit(0.0)) * F.pow(F.lit(beta), (F.col("_i") + 1).cast("double"))
    return r.withColumn("ema", total / (1 - F.pow(F.lit(beta), (F.col("_k") + 1).cast("double")))).drop("_k", "_b", "_i", "_e", "_c")


def distinct_in_order(rows: DataFrame, value: str, order: list[str]) -> DataFrame:
    """Distinct values with the place where each was first seen."""
    return rows.groupBy(value).agg(F.min(F.struct(*order)).alias("first")).select(value, "first.*")
