"""Expressions over experiment records."""

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values.
SPARK_LEVELS = "▁▂▃▄▅▆▇█"
VERDICTS = ((0.80, "excellent"), (1.00, "strong"), (1.20, "good"), (1.50, "fair"))
NEXT_STEPS = ((1.5, "basics"), (1.2, "schedule"), (1.0, "architecture"))
BPB_PATTERN, DELTA_PATTERN = r"val_bpb=(\d+\.\d+)", r"Δ=([+-]?\d+\.\d+)"
CHANGE_PATTERN, HYPOTHESIS_PATTERN = r"\[change: ([^\]]+)\]", r"\[hypothesis: ([^\]]+)\]"
TAGGED_BLOCK, ANY_BLOCK = r"```python\s*\n(.*?)```", r"```\s*\n(.*?)```"
CODE_MARKS = ("import torch", "def ")
SUMMARY_PATTERNS = (
    r"(?:Change|Modification|Change I'm making|Proposed change)[:\s]+(.{20,100})",
    r"(?:I'm|I am|Will) (?:changing|modifying|setting|trying|increasing|decreasing)\s+(.{15,80})",
)


def first_group(text: Column, pattern: str) -> Column:
    """The first match's group, null without a match."""
    return F.nullif(F.regexp_extract(text, pattern, 1), F.lit(""))


def last_group(text: Column, pattern: str) -> Column:
    """The last match's group, null without a match."""
    return F.try_element_at(F.regexp_extract_all(text, F.lit(pattern), F.lit(1)), F.lit(-1))


def number(text: Column) -> Column:
    """A double, null for what isn't one and for NaN."""
    d = text.try_cast("double")
    return F.when(~F.isnan(d), d)


def plausible_bpb(value: Column, most: float = 50.0) -> Column:
    return F.when(~F.isnan(value) & (value <= most), value)


def verdict(value: Column) -> Column:
    out = F.when(value.isNull(), None)
    for limit, name in VERDICTS:
        out = out.when(value < limit, name)
    return out.otherwise("weak")


def next_step(value: Column) -> Column:
    out = F.when(value.isNull(), None)
    for limit, name in NEXT_STEPS:
        out = out.when(value > limit, name)
    return out.otherwise("fine tuning")


def shortened(text: Column, most: int = 45) -> Column:
    return F.when(F.length(text) > most, F.concat(F.substring(text, 1, most - 3), F.lit("..."))).otherwise(text)


def stripped(text: Column) -> Column:
    """Without white space at the ends, of any script."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+\z", "")


def code_block(text: Column) -> Column:
    """The last fenced Python block without white space at its ends; without one, the last fenced block if it looks like code, else null."""
    any_ = stripped(last_group(text, "(?s)" + ANY_BLOCK))
    looks = F.lit(False)
    for mark in CODE_MARKS:
        looks = looks | any_.contains(mark)
    return F.coalesce(stripped(last_group(text, "(?s)" + TAGGED_BLOCK)), F.when(looks, any_))


def change_summary(text: Column, otherwise: str = "see response log") -> Column:
    """One line about a change: what a pattern finds, without white space and full stops at its end.

    Else the last line before the code that is longer than 20 characters, its first 80; else `otherwise`.
    """
    found = [F.rtrim(stripped(first_group(text, "(?i)" + p)), F.lit(".")) for p in SUMMARY_PATTERNS]
    before = F.substring_index(text, "```python", 1)
    lines = F.filter(F.transform(F.split(before, r"\r\n|[\n\r\x0B\f\x1C-\x1E\x85\u2028\u2029]"), stripped), lambda x: F.length(x) > 20)
    return F.coalesce(*found, F.substring(F.try_element_at(lines, F.lit(-1)), 1, 80), F.lit(otherwise))


def metric(text: Column, name: str) -> Column:
    """The last decimal number behind `name:` anywhere in a run's output."""
    return number(last_group(text, rf"{name}:\s+(\d+\.\d+)"))


def last_lines(text: Column, most: int = 20) -> Column:
    """The last lines of a text without white space at its ends."""
    lines = F.split(stripped(text), "\n")
    return F.array_join(F.slice(lines, F.greatest(F.lit(1), F.size(lines) - (most - 1)), F.lit(most)), "\n")


def run_log(stdout: Column, stderr: Column) -> Column:
    """Both streams of a run, one after the other; a missing one is empty."""
    return F.concat(F.coalesce(stdout, F.lit("")), F.coalesce(stderr, F.lit("")))


def numeric_suffix(name: Column) -> Column:
    """The number at a name's end, null without one."""
    return F.nullif(F.regexp_extract(name, r"(\d+)$", 1), F.lit("")).try_cast("long")


def shard_file(number_: Column) -> Column:
    return F.format_string("shard_%05d.parquet", number_)


def commit_subject(val_bpb: Column, before: Column, change: Column, number_: Column) -> Column:
    """The subject that parse_log reads: value, signed difference, the change's first 60 characters, the experiment."""
    return F.format_string("[val_bpb=%.4f] [Δ=%+.4f] [change: %s] [exp: %d]", val_bpb, val_bpb - before, F.substring(change, 1, 60), number_)


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def momentum(step: Column, warmup: int = 300, first: float = 0.85, last: float = 0.95) -> Column:
    part = F.least(step / warmup, F.lit(1.0))
    return (1 - part) * first + part * last


def weight_decay(progress: Column, start: float) -> Column:
    return start * (1 - progress)


def improvement_percent(first: Column, best: Column) -> Column:
    return F.when(first > 0, (first - best) / first * 100)


def schedule(progress: Column, warmup: float = 0.0, warmdown: float = 0.65, final: float = 0.0) -> Column:
    """Piecewise linear rate multiplier: up, flat, down to `final`."""
    down = F.when(progress > 1 - warmdown, (1 - progress) / warmdown * (1 - final) + final).otherwise(1.0)
    return F.when(progress < warmup, progress / warmup).otherwise(down) if warmup else down


def softcap(x: Column, cap: float = 15.0) -> Column:
    return cap * F.tanh(x / cap)


def focal(nats: Column, gamma: float = 3.0) -> Column:
    return F.pow(1 - F.exp(-nats), F.lit(gamma)) * nats


def token_weight(anomalous: Column, cascade: Column) -> Column:
    return F.when(anomalous, 4.0).otherwise(1.0) * F.when(cascade, 2.5).otherwise(1.0)


def backoff_seconds(failures: Column) -> Column:
    return F.least(120 * F.pow(F.lit(2), failures - 1), F.lit(900.0)).cast("long")


def rounded_dim(depth: Column, ratio: int = 64, multiple: int = 128) -> Column:
    return (F.ceil(depth * ratio / multiple) * multiple).cast("long")


def attention_windows(pattern: str, layers: int, length: int) -> list[int]:
    """S is half the length, L all of it, repeated over the layers; the last layer has all."""
    if set(pattern.upper()) - set("SL") or not pattern:
        raise ValueError("a window pattern has S and L only")
    out = [length // 2 if pattern.upper()[i % len(pattern)] == "S" else length for i in range(layers)]
    return [*out[:-1], length] if out else []


def sparkline(values: Column) -> Column:
    """Ordered values as bars, lower is taller; equal values all have the tallest."""
    lo, hi = F.array_min(values), F.array_max(values)
    span = F.when(hi > lo, hi - lo).otherwise(1e-9)
    level = lambda v: ((1 - (v - lo) / span) * 7).cast("int")
    return F.array_join(F.transform(values, lambda v: F.substring(F.lit(SPARK_LEVELS), level(v) + 1, 1)), "")
