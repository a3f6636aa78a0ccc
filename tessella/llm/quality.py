"""A quality classifier: random Fourier features, ridge scores, isotonic calibration.

Statistics of a document's text, standardized, are mapped to cosines of random projections, whose
inner products approximate a Gaussian kernel. Each partition sums its normal equations, by fold; the
sums give the ridge solution of all folds and of all but each one. The scores of the folds left out
are calibrated by isotonic regression, linear between the blocks.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, id_again, id_crc_mod, id_text, text_or_empty

#: The most labelled rows that are fitted; of more, those whose ids hash lowest.
MOST_LABELLED = 20_000
FEATURES, FOLDS, WIDTH, RIDGE, SEED = 256, 5, 10.0, 1e-3, 7

_KINDS = {"letter": range(65, 91), "small": range(97, 123), "digit": range(48, 58), "feed": [10], "space": [9, 11, 12, 13, 32], "stop": [46], "comma": [44], "bar": [124], "call": [33, 63], "sign": [35, 36, 37, 38, 42, 43, 61, 64, 94, 95, 126], "quote": [34, 39, 96], "bracket": [40, 41, 60, 62, 91, 93, 123, 125], "other": [45, 47, 58, 59, 92], "high": range(128, 256)}
_TO_KIND = np.zeros(256, np.int64)
for _i, _k in enumerate(_KINDS.values(), 1):
    _TO_KIND[list(_k)] = _i


def statistics(text: str) -> np.ndarray:
    """What the classifier knows of a text: sizes, shares of characters, words and lines, and their repetition."""
    raw = np.frombuffer(text.encode("utf-8", "replace"), np.uint8)
    n = max(1, len(raw))
    kinds = np.bincount(_TO_KIND, np.bincount(raw, minlength=256), len(_KINDS) + 1) / n
    words, lines = text.split(), [x for x in text.split("\n") if x.strip()]
    count, distinct = max(1, len(words)), len(set(words))
    line_words = max(1, len(lines))
    top = Counter(words).most_common(10)
    doubled = count - len(set(zip(words, words[1:], words[2:])))
    upper = sum(w.isupper() for w in words) / count
    tails = sum(not w[-1].isalnum() for w in words) / count
    heads = sum(w[0].isupper() for w in words) / count
    long = sum(len(w) > 12 for w in words) / count
    short = sum(len(w) < 4 for w in words) / count
    letters = kinds[1] + kinds[2] + kinds[14]
    return np.array([np.log1p(n), np.log1p(count), np.log1p(len(lines)), *np.sqrt(kinds[1:]), n / count / 10, distinct / count, top[0][1] / count if top else 0, sum(c for _, c in top) / count, max(0, doubled - 2) / count, 1 - len(set(lines)) / line_words, np.log1p(n / line_words), upper, np.sqrt(upper), tails, np.sqrt(tails), heads, long, short, letters, kinds[1] / max(1e-9, letters)])


def _pooled(blocks: np.ndarray) -> np.ndarray:
    """Rows (sum of scores, sum of labels, weight) of ascending scores, neighbours joined until the rates ascend."""
    out: list[np.ndarray] = []
    for block in blocks:
        out.append(block)
        while len(out) > 1 and out[-2][1] / out[-2][2] >= out[-1][1] / out[-1][2]:
            out[-2:] = [out[-2] + out[-1]]
    return np.array(out)


def isotonic(scores: np.ndarray, labels: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool-adjacent-violators: (scores, rates) of the blocks' centres, both ascending. Equal scores share a block.

    Half a row of the mean label joins each block, so that no rate is 0 or 1; blocks that this puts out of order are pooled again.
    """
    names, inverse = np.unique(scores, return_inverse=True)
    sums, weights = np.bincount(inverse, labels), np.bincount(inverse).astype(float)
    b = _pooled(np.column_stack([names * weights, sums, weights]))
    more = b[:, 2] + 0.5
    b = _pooled(np.column_stack([b[:, 0] / b[:, 2] * more, b[:, 1] + 0.5 * labels.mean(), more]))
    return b[:, 0] / b[:, 2], b[:, 1] / b[:, 2]


@dataclass
class Model:
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    at: np.ndarray
    rate: np.ndarray

    def score(self, x: np.ndarray) -> np.ndarray:
        return np.interp(features(x, self.mean, self.scale) @ self.weights, self.at, self.rate)


def features(x: np.ndarray, mean: np.ndarray, scale: np.ndarray) -> np.ndarray:
    """Cosines of seeded random projections of the standardized statistics, and a constant."""
    rng = np.random.default_rng(SEED)
    w = rng.normal(0, 1 / WIDTH, (x.shape[1], FEATURES))
    z = np.cos(np.clip((x - mean) / scale, -6, 6) @ w + rng.uniform(0, 2 * np.pi, FEATURES)) * np.sqrt(2 / FEATURES)
    return np.hstack([z, np.ones((len(x), 1))])


def left_out_scores(x: np.ndarray, fold: np.ndarray, mean: np.ndarray, scale: np.ndarray, weights: list[np.ndarray], step: int = 1000) -> np.ndarray:
    """Each row's score by the weights of its fold; features of `step` rows at a time, as all of them would take the driver many times the rows."""
    out = np.zeros(len(x))
    for k, w in enumerate(weights):
        own = np.flatnonzero(fold == k)
        for i in range(0, len(own), step):
            at = own[i : i + step]
            out[at] = features(x[at], mean, scale) @ w
    return out


def equations(mean: np.ndarray, scale: np.ndarray):
    """A mapInPandas function: labelled statistics to each fold's summed normal equations."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        size = FEATURES + 1
        a, b = np.zeros((FOLDS, size, size)), np.zeros((FOLDS, size))
        for frame in frames:
            z, fold, y = features(np.stack(frame["x"].to_list()), mean, scale), frame["fold"].to_numpy(), frame["y"].to_numpy(float)
            for k in range(FOLDS):
                own = z[fold == k]
                a[k] += own.T @ own
                b[k] += own.T @ y[fold == k]
        yield pd.DataFrame({"fold": range(FOLDS), "a": [x.tobytes() for x in a], "b": [x.tobytes() for x in b]})

    return run


def labelled(docs: DataFrame, labels: DataFrame, column: str, mod: int, held_out: int, most: int) -> DataFrame:
    """(doc_id, text, y, fold) of the rows to learn from: labels 0 or 1 outside the held-out part, at most `most` ids, broadcast.

    Of an id's several labels the highest counts.
    """
    rows = labels.where(F.col("doc_id").isNotNull() & F.col(column).isin(0, 1) & (id_crc_mod("doc_id", mod) != held_out))
    rows = rows.groupBy("doc_id").agg(F.max(column).cast("double").alias("y"))
    rows = rows.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    fold = F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(FOLDS)).cast("int").alias("fold")
    return docs.select("doc_id", text_or_empty("text").alias("text")).join(F.broadcast(rows), "doc_id").select("doc_id", "text", "y", fold)


def train(docs: DataFrame, labels: DataFrame, column: str = "quality", mod: int = 4, held_out: int = 2, most: int = MOST_LABELLED) -> Model:
    """The model of the labelled rows; without any, or with one label alone, its share is every document's score (0.5 without any)."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "quality")

    def stats(frames):
        for f in frames:
            yield pd.DataFrame({"doc_id": f["doc_id"], "x": [statistics(t) for t in f["text"]], "y": f["y"], "fold": f["fold"]})

    rows = labelled(docs, labels, column, mod, held_out, most).withColumn("doc_id", F.col("doc_id").cast("string"))
    rows = rows.mapInPandas(stats, "doc_id string, x array<double>, y double, fold int")
    # One row for each id, so that `most` bounds the rows: of repeated ids the least statistics.
    rows = scratch.write(rows.groupBy("doc_id").agg(F.min(F.struct("x", "y", "fold")).alias("r")).select("r.*"), "rows")
    got = rows.toPandas()  # at most `most` rows of some thirty numbers
    size = len(statistics(""))
    x, y, fold = np.array(got["x"].to_list(), float).reshape(-1, size), got["y"].to_numpy(float), got["fold"].to_numpy()
    del got  # its objects take several times the numbers
    if not len(y) or y.min() == y.max():
        return Model(np.zeros(size), np.ones(size), np.zeros(FEATURES + 1), np.array([0.0]), np.array([float(y.mean()) if len(y) else 0.5]))
    mean, scale = x.mean(axis=0), x.std(axis=0) + 1e-6
    # At most `most` rows of numbers, so few tasks do, and few sums come to the driver.
    sums = rows.coalesce(4).mapInPandas(equations(mean, scale), "fold int, a binary, b binary").toPandas()
    size = FEATURES + 1
    a, b = np.zeros((FOLDS, size, size)), np.zeros((FOLDS, size))
    for r in sums.itertuples(index=False):
        a[r.fold] += np.frombuffer(r.a).reshape(size, size)
        b[r.fold] += np.frombuffer(r.b)
    scratch.drop("rows")
    ridge = RIDGE * len(y) * np.eye(size) / FEATURES
    ridge[-1, -1] = 1e-9
    out = left_out_scores(x, fold, mean, scale, [np.linalg.solve(a.sum(axis=0) - a[k] + ridge, b.sum(axis=0) - b[k]) for k in range(FOLDS)])
    return Model(mean, scale, np.linalg.solve(a.sum(axis=0) + ridge, b.sum(axis=0)), *isotonic(out, y))


def _scored(model: Model):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            x = np.array([statistics(t) for t in f["text"]]).reshape(len(f), -1)
            yield pd.DataFrame({"doc_id": f["doc_id"], "held_out": f["held_out"], "score": model.score(x) if len(f) else []})

    return run


def report(docs: DataFrame, labels: DataFrame, threshold: float = 0.7) -> DataFrame:
    """Per row of docs (doc_id, text): held_out, score and predicted. Null and empty texts are scored by their statistics, all zero."""
    model = train(docs, labels)
    d = docs.select(id_text(docs), text_or_empty("text").alias("text"), (id_crc_mod("doc_id", 4) == 2).alias("held_out"))
    out = id_again(d.mapInPandas(_scored(model), "doc_id string, held_out boolean, score double"), docs)
    return out.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = 0.7) -> DataFrame:
    """The rows of docs, all columns, whose score reaches the threshold."""
    model = train(docs, labels)

    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        x = np.array([statistics(t or "") for t in texts]).reshape(len(texts), -1)
        return pd.Series(model.score(x) if len(texts) else [], dtype=float)

    return docs.where(score(docs["text"]) >= threshold)
