"""Token-level masks, weights and metrics over (row, position, token, nats)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import reports as R
from ..functions import telemetry as T


def anomaly_tokens(vocab: DataFrame, token: str = "token") -> DataFrame:
    """The distinct tokens that contain an anomaly keyword."""
    return vocab.where(T.has_anomaly_keyword(F.col(token))).select(token).distinct()


def anomaly_mask(tokens: DataFrame, marked: DataFrame, token: str = "token") -> DataFrame:
    """Adds is_anomaly: whether the token is one of `marked`, distinct tokens."""
    m = marked.select(token).distinct().withColumn("_m", F.lit(True))
    return tokens.join(m, token, "left").withColumn("is_anomaly", F.coalesce("_m", F.lit(False))).drop("_m")


def cascade_density(tokens: DataFrame, row: list[str], pos: list[str], flag: str, window: int = 7, least: float = 0.35) -> DataFrame:
    """Adds in_cascade: over `least` of the centred window is flagged. Positions outside count as unflagged; rows shorter than the window have none."""
    w, half = Window.partitionBy(*row).orderBy(*pos), window // 2
    density = F.sum(F.col(flag).cast("int")).over(w.rowsBetween(-half, half)) / window
    size = F.count("*").over(Window.partitionBy(*row))
    return tokens.withColumn("in_cascade", (density > least) & (size >= window))


def weighted_loss(tokens: DataFrame, nats: str = "nats") -> DataFrame:
    """Adds focal and weighted loss of rows with is_anomaly and in_cascade."""
    focal = R.focal(F.col(nats))
    return tokens.withColumn("focal", focal).withColumn("loss", focal * R.token_weight(F.col("is_anomaly"), F.col("in_cascade")))


def reduced(tokens: DataFrame, by: list[str], loss: str = "loss") -> DataFrame:
    """Sum and mean; the mean divides by the tokens, not by their weights."""
    return tokens.groupBy(*by).agg(F.count("*").alias("n_tokens"), F.sum(loss).alias("loss_sum"), F.avg(loss).alias("loss_mean"))


def bits_per_byte(nats: Column, n_bytes: Column, times: Column | None = None) -> Column:
    """Aggregate: nats of tokens that have bytes, over their bytes, in bits."""
    k = F.lit(1) if times is None else times
    top = F.sum(F.when(n_bytes > 0, nats * k))
    return top / F.nullif(F.log(F.lit(2.0)) * F.sum(n_bytes * k), F.lit(0.0))


def with_lengths(tokens: DataFrame, lengths: DataFrame, token: str = "token_id") -> DataFrame:
    """Each token with its bytes, by an inner join on the vocabulary's id."""
    return tokens.join(lengths, token)


def evaluated(tokens: DataFrame, lengths: DataFrame, budget: int, length: int, batch: int) -> DataFrame:
    """Bits per byte of (row_id, pos, token_id, nats) over a budget of tokens: whole batches of rows of `length` tokens, as many as the budget holds.

    Row ids count from 0, so the budget is a filter on them. Tokens without bytes don't count; lengths is a vocabulary table.
    """
    rows = budget // (batch * length) * batch
    t = with_lengths(tokens.where(F.col("row_id") < rows), F.broadcast(lengths))  # a vocabulary's size bounds it
    n = F.col("n_bytes")
    return t.agg(F.count("*").alias("n_tokens"), F.sum(n).alias("n_bytes"), bits_per_byte(F.col("nats"), n).alias("bpb_ce"), bits_per_byte(R.focal(F.col("nats")), n).alias("bpb_focal"))


def bigram_nats(docs: DataFrame, by: list[str], text: str = "text") -> DataFrame:
    """(by, before, token, n, nats): word pairs with add-one smoothing, a stand-in for a network's losses."""
    words = F.filter(F.split(text, "[ \n]+"), lambda w: w != "")
    d = docs.select(*by, words.alias("w")).where(F.size("w") > 1)
    d = d.select(*by, F.explode(F.arrays_zip(F.slice("w", F.lit(1), F.size("w") - 1).alias("a"), F.slice("w", F.lit(2), F.size("w") - 1).alias("b"))).alias("p"))
    pairs = d.groupBy(*by, F.col("p.a").alias("before"), F.col("p.b").alias("token")).agg(F.count("*").alias("n"))
    all_pairs = pairs.groupBy("before", "token").agg(F.sum("n").alias("pair_n"))
    firsts = all_pairs.groupBy("before").agg(F.sum("pair_n").alias("before_n"))
    size = all_pairs.select("token").distinct().agg(F.count("*").alias("v"))
    out = pairs.join(all_pairs, ["before", "token"]).join(firsts, "before").join(F.broadcast(size), F.lit(True))  # one row
    return out.select(*by, "before", "token", "n", (-F.log((F.col("pair_n") + 1) / (F.col("before_n") + F.col("v")))).alias("nats"))


def throughput(steps: DataFrame, tokens_per_step: int, flops_per_token: float, peak_flops: float = 989.5e12, warmup: int = 10) -> DataFrame:
    """Per step of (run, step, dt): tokens per second, utilisation of the peak in percent, and time since the warm-up."""
    w = Window.partitionBy("run").orderBy("step").rowsBetween(Window.unboundedPreceding, 0)
    rate = tokens_per_step / F.nullif(F.col("dt"), F.lit(0.0))
    return steps.withColumns({"tokens_per_s": rate, "mfu_percent": rate * flops_per_token / peak_flops * 100, "trained_s": F.coalesce(F.sum(F.when(F.col("step") > warmup, F.col("dt"))).over(w), F.lit(0.0))})


def progress_rows(steps: DataFrame, tokens_per_step: int, flops_per_token: float, budget_s: float, peak_flops: float = 989.5e12, warmup: int = 10) -> DataFrame:
    """What is shown after each step of (run, step, dt): share of the budget done before it, milliseconds, tokens per second, utilisation, seconds left."""
    t = throughput(steps, tokens_per_step, flops_per_token, peak_flops, warmup)
    w = Window.partitionBy("run").orderBy("step").rowsBetween(Window.unboundedPreceding, -1)
    before = F.coalesce(F.sum(F.when(F.col("step") > warmup, F.col("dt"))).over(w), F.lit(0.0))
    return t.withColumns({"done_percent": 100 * F.least(before / budget_s, F.lit(1.0)), "dt_ms": F.col("dt") * 1000, "tokens_per_s": F.floor("tokens_per_s"), "remaining_s": F.greatest(F.lit(0.0), budget_s - F.col("trained_s"))})


def run_summary(steps: DataFrame, tokens_per_step: int, flops_per_token: float, peak_flops: float = 989.5e12, warmup: int = 10) -> DataFrame:
    """One row for each run of (run, step, dt): its seconds after the warm-up and in all, steps, millions of tokens, steady utilisation of the peak."""
    trained = F.coalesce(F.sum(F.when(F.col("step") > warmup, F.col("dt"))), F.lit(0.0))
    out = steps.groupBy("run").agg(trained.alias("training_seconds"), F.sum("dt").alias("total_seconds"), F.count("*").alias("num_steps"))
    steady = 100 * flops_per_token * tokens_per_step * (F.col("num_steps") - warmup) / F.col("training_seconds") / peak_flops
    return out.withColumns({"mfu_percent": F.when(F.col("training_seconds") > 0, steady).otherwise(0.0), "total_tokens_m": tokens_per_step * F.col("num_steps") / 1e6})


def parameter_groups(parameters: DataFrame) -> DataFrame:
    """(component, shape, n) parameters grouped by shape, in order of shape, with their totals."""
    return parameters.groupBy("shape").agg(F.array_sort(F.collect_list("name")).alias("names"), F.sum("n").alias("n")).orderBy("shape")


def model_size(vocab: int, depth: int, dim: int) -> dict[str, int]:
    """Parameters by component: embeddings, value embeddings of every other layer, head, blocks, scalars."""
    out = {"wte": vocab * dim, "value_embeds": vocab * dim * (depth // 2), "lm_head": vocab * dim, "blocks": 12 * dim * dim * depth + 32 * depth, "scalars": 2 * depth}
    return out | {"total": sum(out.values())}


def flops_per_token(vocab: int, depth: int, dim: int, heads: int, length: int, pattern: str = "L") -> int:
    """Forward and backward: six for each parameter of a matrix, and attention over each layer's window."""
    size = model_size(vocab, depth, dim)
    matrices = size["total"] - size["wte"] - size["value_embeds"] - size["scalars"]
    return 6 * matrices + sum(12 * heads * (dim // heads) * min(w, length) for w in R.attention_windows(pattern, depth, length))
