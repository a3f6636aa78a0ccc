"""A toxicity model: bidirectional gated recurrent network with attention pooling, in numpy.

A word enters as the embedding of its hash beside the mean embedding of the hashes of its 3 to 5
bytes, both started from their log odds in toxic documents. Windows of WINDOW words, one every STRIDE words,
cover the whole text; both directions of the recurrent network run over each, attention pools the
states, and the document's score is its highest window's, calibrated by a logistic curve.
Training picks each labelled document's highest window of all in every round, so that a toxic document
teaches by its toxic passage and a clean one by its most suspicious; executors score the windows, the
driver gets the highest ones and as many drawn from the clean ones.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, id_again, id_crc_mod, id_text, text_or_empty

#: At most so many documents of each label are fitted, with all windows of each.
MOST_TOXIC, MOST_CLEAN = 1200, 2400
WINDOW, STRIDE = 24, 16
STATE, WIDTH, TABLE = 8, 6, 1 << 15
ROUNDS, RATE, SEED = 8, 0.01, 11
#: Words whose inputs a worker keeps.
KEPT = 200_000
_EDGE = b"\"'.,;:!?()[]{}<>|*#$%&@+-_=/\\~`^"
_M = np.uint64(0x9E3779B97F4A7C15)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(27))


def hashes(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(word hashes, n-gram hashes, each word's first n-gram) below TABLE; lower-cased (A-Z), without punctuation at the ends."""
    cores = [w.encode("utf-8", "replace").lower().strip(_EDGE) for w in words]
    raw = np.frombuffer(b"".join([b"^" + c + b"$" for c in cores]) + b"\0" * 8, np.uint8).astype(np.uint64)
    sizes = np.array([len(c) + 2 for c in cores], np.int64)
    ends = np.cumsum(sizes)
    starts = ends - sizes
    place = np.arange(len(raw) - 8) - np.repeat(starts, sizes)
    whole = np.add.reduceat(_mix((raw[: len(place)] << np.uint64(32)) + place.astype(np.uint64) * _M), starts) if len(words) else np.empty(0, np.uint64)
    owner, grams = [], []
    which = np.repeat(np.arange(len(words)), sizes)
    left = np.repeat(ends, sizes) - np.arange(len(place))
    h = np.zeros(len(place), np.uint64)
    for n in range(1, 6):
        h = _mix(h * _M + raw[n - 1 : n - 1 + len(place)] + np.uint64(n))
        if n >= 3:
            ok = left >= n
            owner.append(which[ok])
            grams.append(h[ok])
    # Every core has its two marks, so an empty one has no n-gram of 3: it gets one of its own.
    owner.append(np.arange(len(words)))
    grams.append(_mix(np.full(len(words), 5, np.uint64)))
    owner, grams = np.concatenate(owner), np.concatenate(grams)
    order = np.argsort(owner, kind="stable")
    first = np.searchsorted(owner[order], np.arange(len(words)))
    return (_mix(whole) % np.uint64(TABLE)).astype(np.int64), (grams[order] % np.uint64(TABLE)).astype(np.int64), first


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return np.float32(0.5) * np.tanh(np.float32(0.5) * x) + np.float32(0.5)


class Network:
    """Parameters by name; the inputs of a word are worked out apart, so that each distinct word is embedded once."""

    def __init__(self, seed: int = SEED):
        rng = np.random.default_rng(seed)
        d, h = 2 * WIDTH, STATE
        self.p = {"word": rng.normal(0, 0.1, (TABLE, WIDTH)), "char": rng.normal(0, 0.1, (TABLE, WIDTH)), "v": rng.normal(0, 0.3, 2 * h), "w": rng.normal(0, 0.3, 2 * h), "b": np.zeros(1)}
        for s in "fb":
            self.p |= {f"W{s}": rng.normal(0, 0.4, (d, 3 * h)), f"U{s}": rng.normal(0, 0.3, (h, 3 * h)), f"c{s}": np.zeros(3 * h)}
        self.p = {k: v.astype(np.float32) for k, v in self.p.items()}
        self.line = (1.0, 0.0)

    def embed(self, words: list[str]) -> np.ndarray:
        a, b, first = hashes(words)
        if not len(words):
            return np.zeros((0, 2 * WIDTH), np.float32)
        mean = np.add.reduceat(self.p["char"][b], first) / np.diff(np.r_[first, len(b)])[:, None]
        return np.hstack([self.p["word"][a], mean]).astype(np.float32)

    def inputs(self, x: np.ndarray) -> np.ndarray:
        """What both directions take from embedded words: [n, 6 * STATE]."""
        p = self.p
        return np.hstack([x @ p["Wf"] + p["cf"], x @ p["Wb"] + p["cb"]]).astype(np.float32)

    def forward(self, g: np.ndarray, mask: np.ndarray, keep: bool = False):
        """Logits of windows from word inputs [n, time, 6 * STATE]; mask is 0 behind a text's end."""
        n, time, _ = g.shape
        h, out, trace = STATE, np.zeros((time, n, 2 * STATE), np.float32), {}
        for s, at, order in (("f", 0, range(time)), ("b", 3 * h, range(time - 1, -1, -1))):
            u, state, steps = self.p["U" + s], np.zeros((n, h), np.float32), []
            for t in order:
                x, m = g[:, t, at : at + 3 * h], mask[:, t, None]
                zr = _sigmoid(x[:, : 2 * h] + state @ u[:, : 2 * h])
                z, r = zr[:, :h] * m, zr[:, h:]
                c = np.tanh(x[:, 2 * h :] + (r * state) @ u[:, 2 * h :])
                if keep:
                    steps.append((t, state, z, r, c, zr[:, :h]))
                state = state + z * (c - state)
                out[t, :, (0 if s == "f" else h) : (h if s == "f" else 2 * h)] = state
            trace[s] = steps
        e = out @ self.p["v"] + (mask.T - 1) * 1e4
        e = np.exp(e - e.max(axis=0))
        a = e / e.sum(axis=0)
        pooled = np.einsum("tn,tnk->nk", a, out)
        logit = pooled @ self.p["w"] + self.p["b"][0]
        return (logit, out, a, pooled, trace) if keep else logit

    def gradients(self, g, mask, y):
        """(loss, gradients of all but the tables, gradient of the word inputs)."""
        n, time, _ = g.shape
        h, p = STATE, self.p
        logit, out, a, pooled, trace = self.forward(g, mask, True)
        q = _sigmoid(logit)
        d = (q - y) / n
        grad = {k: np.zeros_like(v) for k, v in p.items() if k not in ("word", "char")}
        grad["w"], grad["b"] = pooled.T @ d, np.array([d.sum()], np.float32)
        dpool = d[:, None] * p["w"]
        dout = a[:, :, None] * dpool
        da = np.einsum("tnk,nk->tn", out, dpool)
        de = a * (da - (a * da).sum(axis=0))
        grad["v"] = np.einsum("tn,tnk->k", de, out)
        dout += de[:, :, None] * p["v"]
        dg = np.zeros_like(g)
        for s, at, lo in (("f", 0, 0), ("b", 3 * h, h)):
            u, back = p["U" + s], np.zeros((n, h), np.float32)
            for t, state, z, r, c, raw in reversed(trace[s]):
                back = back + dout[t, :, lo : lo + h]
                m = mask[:, t, None]
                dz = back * (c - state) * m * raw * (1 - raw)
                dc = back * z * (1 - c * c)
                drs = dc @ u[:, 2 * h :].T
                dr = drs * state * r * (1 - r)
                grad["U" + s][:, 2 * h :] += (r * state).T @ dc
                grad["U" + s][:, :h] += state.T @ dz
                grad["U" + s][:, h : 2 * h] += state.T @ dr
                dg[:, t, at : at + 3 * h] = np.hstack([dz, dr, dc])
                back = back * (1 - z) + drs * r + dz @ u[:, :h].T + dr @ u[:, h : 2 * h].T
        loss = -np.mean(y * np.log(q + 1e-7) + (1 - y) * np.log(1 - q + 1e-7))
        return loss, grad, dg


def windows_of(n: int) -> np.ndarray:
    """Where the windows of a text of n words start; a text without words has one, all behind its end."""
    return np.arange(0, max(1, n - WINDOW + STRIDE), STRIDE)


def _pair_ids(words: list[str], doc: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(doc * TABLE + slot) of the words and of the n-grams that stand in the documents, each once; word indexes words."""
    a, b, first = hashes(words)
    starts = np.r_[first, len(b)].astype(np.int64)
    reps = np.diff(starts)[word]
    at = np.repeat(starts[word] - np.r_[0, np.cumsum(reps)[:-1]], reps) + np.arange(reps.sum()) if len(word) else np.empty(0, int)
    return np.unique(doc * TABLE + a[word]), np.unique(np.repeat(doc, reps) * TABLE + b[at])


def document_counts(docs: Iterable[list[str]], labels: Iterable[float]) -> np.ndarray:
    """[word or n-gram, clean or toxic, TABLE]: in how many documents, given as words, each slot stands."""
    out = np.zeros((2, 2, TABLE))
    for found, y in zip(docs, labels, strict=True):
        words = list(set(found))
        for i in range(0, len(words), 50_000):  # n-grams are many; a slot of two parts counts once
            part = words[i : i + 50_000]
            pairs = _pair_ids(part, np.zeros(len(part), np.int64), np.arange(len(part)))
            seen = pairs if not i else tuple(np.union1d(s, p) for s, p in zip(seen, pairs, strict=True))
        for kind in range(2 if words else 0):
            out[kind, int(y), seen[kind]] += 1
    return out


class Chosen:
    """Windows of one round: each document's highest with its logit, and clean ones drawn from all of them."""

    def __init__(self, best: list[list[str]], logits: np.ndarray, labels: np.ndarray, drawn: list[list[str]]):
        self.best, self.logits, self.labels, self.drawn = best, logits, labels, drawn


def choose(scorer: Scorer, docs: list[list[str]], keys: list[int], labels: list[float], turn: int, share: float) -> Iterator[tuple[int, float, float, list[str]]]:
    """(position in docs, logit, -1, words) of each document's highest window, (position, 0, draw, words) of clean windows with draws below share."""
    owner, logits = scorer.logits(docs)
    ends = np.searchsorted(owner, np.arange(len(docs) + 1))
    for i, (words, key, y) in enumerate(zip(docs, keys, labels, strict=True)):
        starts, found = windows_of(len(words)), logits[ends[i] : ends[i + 1]]
        at = int(starts[found.argmax()])
        yield i, float(found.max()), -1.0, words[at : at + WINDOW]
        if not y and share > 0:
            draws = np.random.default_rng([SEED, turn, int(key) & 0x7FFFFFFFFFFFFFFF]).random(len(starts))
            for s, draw in zip(starts[draws < share].tolist(), draws[draws < share].tolist(), strict=True):
                yield i, 0.0, draw, words[s : s + WINDOW]


def train(docs: Iterable[list[str]], labels: list[float]) -> Network:
    """The network of documents given as words, all in this process."""
    docs = list(docs)
    y = np.array(labels, np.float32)
    total = sum(len(windows_of(len(d))) for d, k in zip(docs, labels, strict=True) if not k)

    def pick(net: Network, turn: int, share: float) -> Chosen:
        got = list(choose(Scorer(net), docs, range(len(docs)), labels, turn, share)) if docs else []
        best = [r for r in got if r[2] < 0]
        drawn = sorted((r for r in got if r[2] >= 0), key=lambda r: (r[2], r[0]))[: len(docs)]
        return Chosen([r[3] for r in best], np.array([r[1] for r in best]), y, [r[3] for r in drawn])

    return learn(y, total, lambda: document_counts(docs, labels), pick)


def learn(y: np.ndarray, clean_windows: int, counts: Callable[[], np.ndarray], pick: Callable[[Network, int, float], Chosen]) -> Network:
    """The network of documents that counts and pick look through wholly. With one label alone, its share is every score."""
    net = Network()
    if not len(y) or y.min() == y.max():
        share = float(y.mean()) if len(y) else 0.5
        net.line = (0.0, float(np.clip(np.log((share + 1e-6) / (1 - share + 1e-6)), -14, 14)))
        return net
    # Log odds of the hashes: in how many toxic and clean documents they stand.
    pos, neg = y.sum(), len(y) - y.sum()
    for name, (c, t) in zip(("word", "char"), counts(), strict=True):
        odds = np.log((t + 0.5) / (pos + 1)) - np.log((c + 0.5 * neg / pos) / (neg + neg / pos))
        sure = np.maximum(0, np.abs(odds) - 0.7 * np.sqrt(1 / (t + 0.5) + 1 / (c + 0.5)))  # what some standard error leaves
        net.p[name][:, 0] += np.clip(np.sign(odds) * sure, -3, 3).astype(np.float32)
    rng, moments, step = np.random.default_rng(SEED), {}, 0
    share = min(1.0, 1.5 * len(y) / max(1, clean_windows))  # enough to draw as many as there are documents

    for turn in range(ROUNDS):
        got = pick(net, turn, share)
        numbers: dict[str, int] = {}
        ids = np.zeros((len(got.best) + len(got.drawn), WINDOW), np.int64)
        for i, w in enumerate([*got.best, *got.drawn]):
            ids[i, : len(w)] = [numbers.setdefault(x, len(numbers) + 1) for x in w]
        mask, target = (ids > 0).astype(np.float32), np.r_[got.labels, np.zeros(len(got.drawn), np.float32)]
        a, b, first = hashes(list(numbers))
        starts = np.r_[first, len(b)]
        sizes = np.diff(starts)
        chosen = rng.permutation(len(ids))
        for i in range(0, len(chosen), 128):
            pick_ = chosen[i : i + 128]
            used, where = np.unique(ids[pick_], return_inverse=True)
            where = where.reshape(len(pick_), WINDOW)
            rows = used[used > 0] - 1
            reps = sizes[rows]
            at = np.repeat(starts[rows] - np.r_[0, np.cumsum(reps)[:-1]], reps) + np.arange(reps.sum())
            mean = np.add.reduceat(net.p["char"][b[at]], np.r_[0, np.cumsum(reps)[:-1]]) / reps[:, None]
            x = np.hstack([net.p["word"][a[rows]], mean]).astype(np.float32)
            x = np.vstack([np.zeros((len(used) - len(rows), 2 * WIDTH), np.float32), x])
            _, grad, dg = net.gradients(net.inputs(x)[where], mask[pick_], target[pick_])
            du = np.zeros((len(used), 6 * STATE), np.float32)
            np.add.at(du, where.ravel(), dg.reshape(-1, 6 * STATE))
            h = 3 * STATE
            grad |= {"Wf": x.T @ du[:, :h], "Wb": x.T @ du[:, h:], "cf": du[:, :h].sum(axis=0), "cb": du[:, h:].sum(axis=0)}
            dx = (du[:, :h] @ net.p["Wf"].T + du[:, h:] @ net.p["Wb"].T)[len(used) - len(rows) :]
            step += 1
            rate = RATE * (1 - 0.8 * turn / ROUNDS)
            for k, v in grad.items():
                m, s = moments.setdefault(k, [np.zeros_like(v), np.zeros_like(v)])
                m += 0.1 * (v - m)
                s += 0.01 * (v * v - s)
                net.p[k] -= (rate * (m / (1 - 0.9**step)) / (np.sqrt(s / (1 - 0.99**step)) + 1e-6)).astype(np.float32)
            np.add.at(net.p["word"], a[rows], -0.3 * dx[:, :WIDTH])
            np.add.at(net.p["char"], b[at], np.repeat(-0.3 * dx[:, WIDTH:] / reps[:, None], reps, axis=0))
    got = pick(net, ROUNDS, 0.0)
    net.line = _logistic(got.logits, got.labels)
    return net


def _logistic(x: np.ndarray, y: np.ndarray, rounds: int = 200) -> tuple[float, float]:
    """Slope and offset of the calibrating curve, by damped Newton steps with a little decay."""
    a, b = 1.0, 0.0
    for _ in range(rounds):
        q = 1 / (1 + np.exp(-np.clip(a * x + b, -30, 30)))
        w = q * (1 - q) + 1e-4
        g = np.array([((q - y) * x).sum() + 0.5 * (a - 1), (q - y).sum()])
        hess = np.array([[(w * x * x).sum() + 0.5, (w * x).sum()], [(w * x).sum(), w.sum()]])
        step = np.linalg.solve(hess, g)
        a, b = max(0.05, a - 0.5 * step[0]), b - 0.5 * step[1]
    return float(a), float(b)


class Scorer:
    """Scores texts; a distinct word's inputs are worked out once and kept."""

    def __init__(self, net: Network):
        self.net, self.rows = net, {}
        self.inputs = np.zeros((1024, 6 * STATE), np.float32)

    def _learn(self, words: set[str]) -> None:
        new = [w for w in words if w not in self.rows]
        if len(self.rows) + len(new) > KEPT and self.rows:
            self.rows = {}
            new = list(words)
        at = len(self.rows) + 1
        while at + len(new) > len(self.inputs):
            self.inputs = np.concatenate([self.inputs, np.zeros_like(self.inputs)])
        for i in range(0, len(new), 20_000):
            part = new[i : i + 20_000]
            self.inputs[at : at + len(part)] = self.net.inputs(self.net.embed(part))
            self.rows.update(zip(part, range(at, at + len(part)), strict=True))
            at += len(part)

    def logits(self, words: list[list[str]]) -> tuple[np.ndarray, np.ndarray]:
        """(which text, logit) of all windows of texts given as words."""
        self._learn(set().union(*words))
        get, held, n_held, owner, out = self.rows.__getitem__, [], 0, [], []

        def flush() -> None:
            ids = np.concatenate(held)
            for i in range(0, len(ids), 2048):
                part = ids[i : i + 2048]
                out.append(self.net.forward(self.inputs[part], (part > 0).astype(np.float32)))
            held.clear()

        for n, found in enumerate(words):
            starts = windows_of(len(found))
            ids = np.zeros(starts[-1] + WINDOW, np.int64)
            ids[: len(found)] = np.fromiter(map(get, found), np.int64, len(found))
            held.append(np.lib.stride_tricks.sliding_window_view(ids, WINDOW)[starts])
            owner.append(np.full(len(starts), n))
            n_held += len(starts)
            if n_held >= 8192:
                flush()
                n_held = 0
        if held:
            flush()
        return np.concatenate(owner), np.concatenate(out)

    def scores(self, texts: list[str]) -> np.ndarray:
        out = np.full(len(texts), -np.inf)
        if texts:
            np.maximum.at(out, *self.logits([t.split() for t in texts]))
        a, b = self.net.line
        return 1 / (1 + np.exp(-np.clip(a * out + b, -30, 30)))


def fit(docs: DataFrame, labels: DataFrame, mod: int = 4, held_out: int = 2) -> Network:
    """The network of at most MOST_TOXIC and MOST_CLEAN labelled documents outside the held-out part, those whose ids hash lowest.

    Of an id's several labels the highest counts.
    """
    rows = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isin(0, 1) & (id_crc_mod("doc_id", mod) != held_out))
    rows = rows.groupBy("doc_id").agg(F.max("toxic").alias("y"))
    first = lambda y, n: rows.where(F.col("y") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(n)
    chosen = first(1, MOST_TOXIC).unionByName(first(0, MOST_CLEAN))

    scratch = Scratch(docs.sparkSession, "toxicity")
    d = docs.select("doc_id", text_or_empty("text").alias("text")).join(F.broadcast(chosen), "doc_id")
    # One text for each id, the least, so that the two bounds hold for the rows.
    d = d.groupBy("doc_id").agg(F.min("text").alias("text"), F.max("y").alias("y"))
    d = scratch.write(d.repartition(docs.sparkSession.sparkContext.defaultParallelism * 2, "doc_id").withColumn("key", F.xxhash64("doc_id", "text")), "fitted")

    def measured(frames):
        total = np.zeros((2, 2, TABLE))
        for f in frames:
            total += document_counts((t.split() for t in f["text"]), f["y"])
        kind, label, slot = np.nonzero(total)
        yield pd.DataFrame({"kind": kind, "label": label, "slot": slot, "n": total[kind, label, slot].astype(np.int64)})

    def sized(frames):
        for f in frames:
            yield pd.DataFrame({"key": f["key"], "y": f["y"], "n": [len(windows_of(len(t.split()))) for t in f["text"]]})

    sizes = d.mapInPandas(sized, "key long, y double, n long").groupBy("y").agg(F.count("*").alias("docs"), F.sum("n").alias("n")).toPandas()
    y = np.repeat(sizes["y"].to_numpy(np.float32), sizes["docs"])
    clean_windows = int(sizes.loc[sizes["y"] == 0, "n"].sum())

    def counts() -> np.ndarray:
        got = d.mapInPandas(measured, "kind int, label int, slot int, n long").groupBy("kind", "label", "slot").agg(F.sum("n").alias("n")).toPandas()
        out = np.zeros((2, 2, TABLE))
        out[got["kind"], got["label"], got["slot"]] = got["n"]
        return out

    def pick(net: Network, turn: int, share: float) -> Chosen:
        def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            scorer = Scorer(net)
            for f in frames:
                if len(f):
                    rows = choose(scorer, [t.split() for t in f["text"]], f["key"].tolist(), f["y"].tolist(), turn, share)
                    yield pd.DataFrame([(f["key"].iloc[i], f["y"].iloc[i], *r) for i, *r in rows], columns=["key", "y", "logit", "draw", "words"])

        got = d.mapInPandas(run, "key long, y double, logit double, draw double, words array<string>").toPandas()
        best, drawn = got[got["draw"] < 0].sort_values("key", kind="stable"), got[got["draw"] >= 0].sort_values(["draw", "key"]).head(len(y))
        return Chosen([list(w) for w in best["words"]], best["logit"].to_numpy(), best["y"].to_numpy(np.float32), [list(w) for w in drawn["words"]])

    net = learn(y, clean_windows, counts, pick)
    scratch.drop("fitted")
    return net


def report(docs: DataFrame, labels: DataFrame, threshold: float = 0.3) -> DataFrame:
    """Per row of docs (doc_id, text): held_out, score and predicted. Null and empty texts have one window without words."""
    net = fit(docs, labels)

    def scored(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        scorer = Scorer(net)
        for f in frames:
            yield pd.DataFrame({"doc_id": f["doc_id"], "held_out": f["held_out"], "score": scorer.scores(f["text"].tolist())})

    d = docs.select(id_text(docs), text_or_empty("text").alias("text"), (id_crc_mod("doc_id", 4) == 2).alias("held_out"))
    return id_again(d.mapInPandas(scored, "doc_id string, held_out boolean, score double"), docs).withColumn("predicted", (F.col("score") >= threshold).cast("int"))
