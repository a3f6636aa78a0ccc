"""Trained operators: held-out results, gradients, brute-force counts, and edges."""

import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest

from tessella.llm import chat, quality, suffix_tree, toxicity
from tessella.llm.common import table


def auc(score, label):
    rank = pd.Series(score).rank().to_numpy()
    n1 = label.sum()
    return (rank[label == 1].sum() - n1 * (n1 + 1) / 2) / n1 / (len(label) - n1)


@pytest.fixture(scope="module")
def labelled(spark):
    import os

    sf = "/root/testdata/sf0.01"
    if not os.path.isdir(sf):
        pytest.skip("no test tables")
    return table(spark, sf, "documents"), table(spark, sf, "labels")


@pytest.mark.parametrize(("module", "column", "sf", "least"), [(quality, "quality", "sf0.01", 0.97), (toxicity, "toxic", "sf0.1", 0.95)])
def test_held_out(spark, labelled, odd, none, module, column, sf, least):
    # sf0.01 has 37 toxic documents to learn from and 14 to judge by, too few for either.
    docs, labels = (table(spark, f"/root/testdata/{sf}", n) for n in ("documents", "labels"))
    got = module.report(docs, labels).toPandas().merge(labels.toPandas(), on="doc_id")
    assert (got["held_out"] == [zlib.crc32(str(i).encode()) % 4 == 2 for i in got["doc_id"]]).all()
    held = got[got["held_out"]]
    assert held["score"].between(0, 1).all()
    assert auc(held["score"].to_numpy(), held[column].to_numpy()) > least
    rows = module.report(odd, labels).collect()
    assert len(rows) == odd.count() and all(0 <= r["score"] <= 1 for r in rows)
    assert module.report(none, labels).count() == 0
    few = module.report(odd, labels.where("false")).collect()
    assert {r["score"] for r in few} == {0.5}


def test_quality_keeps_columns(labelled, odd):
    kept = quality.keep_good(odd, labelled[1])
    assert kept.columns == odd.columns


def test_isotonic():
    rng = np.random.default_rng(1)
    x = rng.random(500)
    y = (rng.random(500) < x**2).astype(float)
    at, rate = quality.isotonic(x, y)
    assert (np.diff(at) > 0).all() and (np.diff(rate) >= 0).all() and 0 < rate[0] and rate[-1] < 1
    assert len(quality.isotonic(np.array([1.0, 1.0, 2.0]), np.array([1.0, 0.0, 0.0]))[0]) == 1


def test_isotonic_blocks_stay_in_order():
    for seed in range(200):
        rng = np.random.default_rng(seed)
        n = int(rng.integers(2, 60))
        at, rate = quality.isotonic(rng.integers(0, 20, n).astype(float), rng.integers(0, 2, n).astype(float))
        assert (np.diff(at) > 0).all() and (np.diff(rate) >= 0).all()


def test_ridge_is_the_direct_solution(labelled):
    docs, labels = labelled
    model = quality.train(docs, labels)
    label = {r["doc_id"]: r["quality"] for r in labels.collect() if r["quality"] is not None}
    rows = [(quality.statistics(r["text"] or ""), label[r["doc_id"]]) for r in docs.collect() if r["doc_id"] in label and zlib.crc32(str(r["doc_id"]).encode()) % 4 != 2]
    x, y = np.array([r[0] for r in rows]), np.array([r[1] for r in rows], float)
    assert np.allclose(model.mean, x.mean(axis=0)) and np.allclose(model.scale, x.std(axis=0) + 1e-6)
    z = quality.features(x, model.mean, model.scale)
    ridge = quality.RIDGE * len(y) * np.eye(z.shape[1]) / quality.FEATURES
    ridge[-1, -1] = 1e-9
    # As least squares over the rows and the square root of the penalty.
    direct = np.linalg.lstsq(np.vstack([z, np.sqrt(ridge)]), np.r_[y, np.zeros(len(ridge))], rcond=None)[0]
    assert np.allclose(z @ model.weights, z @ direct, atol=1e-5)


def test_gradients():
    rng, net = np.random.default_rng(0), toxicity.Network(3)
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    g, y = rng.normal(0, 1, (5, 6, 6 * toxicity.STATE)), rng.integers(0, 2, 5).astype(float)
    mask = (np.arange(6)[None] < np.array([6, 4, 1, 3, 6])[:, None]).astype(float)
    _, grad, dg = net.gradients(g, mask, y)

    def loss():
        q = toxicity._sigmoid(net.forward(g, mask))
        return -np.mean(y * np.log(q) + (1 - y) * np.log(1 - q))

    for k in ("Uf", "Ub", "v", "w", "b"):
        i = tuple(0 for _ in net.p[k].shape)
        net.p[k][i] += 1e-4
        up = loss()
        net.p[k][i] -= 2e-4
        down = loss()
        net.p[k][i] += 1e-4
        assert abs((up - down) / 2e-4 - grad[k][i]) < 1e-4, k
    g[1, 2, 3] += 1e-4
    up = loss()
    g[1, 2, 3] -= 2e-4
    assert abs((up - loss()) / 2e-4 - dg[1, 2, 3]) < 1e-4


def test_left_out_scores_take_little_memory():
    import tracemalloc

    rng = np.random.default_rng(3)
    x, fold = rng.normal(size=(20_000, 30)), rng.integers(0, quality.FOLDS, 20_000)
    weights, mean, scale = list(rng.normal(size=(quality.FOLDS, quality.FEATURES + 1))), x.mean(axis=0), x.std(axis=0)
    tracemalloc.start()
    got = quality.left_out_scores(x, fold, mean, scale, weights)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 16e6  # features of all rows at once: 41 MB, and several times that on the way
    assert np.allclose(got, np.einsum("ij,ij->i", quality.features(x, mean, scale), np.array(weights)[fold]))


def test_windows_cover_the_text():
    for n in range(0, 200):
        s = toxicity.windows_of(n)
        assert set(range(n)) <= {i for a in s for i in range(a, a + toxicity.WINDOW)}
        assert s[0] == 0 and (np.diff(s) == toxicity.STRIDE).all()


def plain_base(docs):
    train, ends = Counter(), 0
    for key, text in docs:
        if zlib.crc32(str(key if key is not None else "").encode()) % 5 != 1:
            train.update(suffix_tree.tokens_of(text or ""))
            ends += 1
    n, v = sum(train.values()) + ends, len(train) + (ends > 0)
    one = lambda c: math.log10((c + 0.5) / (n + 0.5 * (v + 1)))
    out = []
    for _, text in docs:
        w = suffix_tree.tokens_of(text or "")
        out.append((len(w) + 1, sum(train[x] > 0 for x in w) + (ends > 0), n, sum(one(train[x]) for x in w) + one(ends)))
    return out


def test_scores(spark, odd, none, labelled):
    rows = [(r["doc_id"], r["text"]) for r in odd.collect()]
    got = suffix_tree.score(odd).collect()
    want = plain_base(rows)
    key = lambda r: (r[0], r[1], r[2], round(r[3], 6))
    assert sorted(key((r["n_tokens"], r["n_known"], r["train_tokens"], r["base_score"])) for r in got) == sorted(map(key, want))
    assert all(r["score"] < 0 and math.isfinite(r["score"]) for r in got)
    assert suffix_tree.score(none).count() == 0
    held = spark.createDataFrame([(i, "a b") for i in range(200) if zlib.crc32(str(i).encode()) % 5 == 1], "doc_id long, text string")
    assert {r["train_tokens"] for r in suffix_tree.score(held).collect()} == {0}
    full = suffix_tree.score(labelled[0]).toPandas().sort_values("doc_id")
    plain = plain_base([(r["doc_id"], r["text"]) for r in labelled[0].orderBy("doc_id").collect()])
    assert np.allclose(full["base_score"], [p[3] for p in plain])
    seen = full[~full["held_out"]]
    assert seen["score"].sum() > seen["base_score"].sum()


def test_tree_is_a_distribution():
    words = [w.encode() for w in ("the", "then", "than", "a", "an", "to", "ten", "net")]
    counts = np.array([50, 20, 10, 60, 30, 40, 5, 3], float)
    names = [x for x, _ in suffix_tree.frequent_contexts(words, counts)]
    table_ = suffix_tree.context_counts(words, counts, names)
    tree = suffix_tree.build(table_)
    singles = [bytes([b]) for b in range(256) if b != 32]
    # All beginnings of two bytes, a word of one byte being followed by its end: what is missing to 1 is a space at once and the share of a 257th symbol.
    pairs = [a + b for a in singles for b in singles]
    start = np.exp(tree.score(singles)[0]).sum() + np.exp(tree.score(pairs)[0]).sum()
    assert 0.9 < start <= 1 + 1e-9
    # And behind a beginning of three bytes: its chance is that of all that may follow.
    follow = np.exp(tree.score([b"the" + s for s in singles])[1] - tree.score([b"the" + s + b"#" for s in singles])[1])
    assert np.isfinite(follow).all()
    held = tree.score(words)[1]
    assert held[0] > held[2] and np.isfinite(held).all()
    total = table_[table_["depth"] == 0]["n"].sum()
    assert total == sum(c * (len(w) + 1) for w, c in zip(words, counts, strict=True))


def plain_scores(docs):
    """The score by the rules, for texts of fewer distinct words than the tree lists: one distribution for each context, in dictionaries."""
    from collections import defaultdict as dd

    M = suffix_tree
    train = [M.tokens_of(t) for k, t in docs if zlib.crc32(str(k).encode()) % 5 != 1]
    count = Counter(w for t in train for w in t)
    listed = {w: i for i, (w, _) in enumerate(sorted(count.items(), key=lambda x: (-x[1], x[0])), 1)}
    # The symbols that aren't words are those of prefixes: none here.
    size = M.LISTED + 2 + M.PREFIXES

    def states(words):
        for i in range(len(words) + 1):
            before, far = words[i - 1] if i else None, words[i - 2] if i > 1 else None
            n, m = listed.get(before, 0), listed.get(far, 0)
            last = (b" " + before)[-2:] if before else b"\n"
            yield (words[i] if i < len(words) else None), ("s", last), ("w", n) if 0 < n <= M.WHOLE else None, ("p", m, n if n <= M.NEAR else 0) if 0 < m <= M.FAR else None

    root, seen = Counter(), dd(Counter)
    for t in train:
        for s, *contexts in states(t):
            root[s] += 1
            for c in contexts:
                if c:
                    seen[c][s] += 1
    total = sum(root.values())
    p0 = lambda s: (root[s] + 0.5) / (total + 0.5 * size)
    kept = {c for c, x in seen.items() if sum(x.values()) >= M.P_UPPER * total and sum(n * math.log(n / sum(x.values()) / p0(s)) for s, n in x.items()) >= M.DIVERGENCE * len(x)}
    out = []
    for _, text in docs:
        score = 0.0
        for s, suffix, whole, pair in states(M.tokens_of(text)):
            p = p0(s)
            for c in (suffix, whole, pair):
                if c in kept:
                    x = seen[c]
                    n = sum(x.values())
                    p = (x[s] + len(x) * p) / (n + len(x))
            score += math.log10(p)
        out.append(score)
    return out, len(kept)


def test_scores_by_the_rules(spark):
    rng = random.Random(8)
    words = [f"{a}{b}" for a in ("ka", "lo", "mi", "tru") for b in ("n", "st", "ring", "e", "o")]
    nexts = {w: [rng.choice(words) for _ in range(3)] for w in words}
    docs = []
    for i in range(400):
        w = [rng.choice(words)]
        for _ in range(rng.randrange(0, 60)):
            w.append(rng.choice(nexts[w[-1]]))
        docs.append((i, " ".join(w)))
    got = {r["doc_id"]: r["score"] for r in suffix_tree.score(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    want, kept = plain_scores(docs)
    assert kept > 20
    assert np.allclose([got[i] for i, _ in docs], want, rtol=1e-4)


def test_rare_contexts_by_the_rules():
    M = suffix_tree
    rng = random.Random(4)
    words = [a + b for a in (b"ka", b"lo", b"mi", b"tru") for b in (b"n", b"st", b"ring", b"e", b"o", b"a", b"u")]
    listed, pairs = words[:5], sorted({(w[0] << 8) | w[1] for w in words})
    nexts = {w: rng.sample(words, 2) for w in words}
    texts = []
    for _ in range(300):
        t = [rng.choice(words)]
        for _ in range(rng.randrange(40)):
            t.append(rng.choice(nexts[t[-1]]) if rng.random() < 0.9 else rng.choice(words))
        texts.append(t)
    texts += [[b"twice", b"kan"], [b"twice", b"kan"], [b"once", b"kan"]]
    symbols = M.Symbols(listed, pairs)
    symbol = lambda w: symbols.ids.get(w) or int(symbols.of_prefix[(w[0] << 8) | w[1]])
    root, seen = np.zeros(symbols.size), {}
    for t in texts:
        for before, w in zip([None, *t], [*map(symbol, t), symbols.end], strict=True):
            root[w] += 1
            if before is not None and before not in listed:
                seen.setdefault(before, Counter())[w] += 1
    p0 = (root + 0.5) / (root.sum() + 0.5 * symbols.size)
    kept = {c for c, x in seen.items() if sum(x.values()) >= M.MASS and sum(n * math.log(n / sum(x.values()) / p0[s]) for s, n in x.items()) >= M.DIVERGENCE * len(x)}
    assert len(kept) > 5 and b"once" not in kept
    frame = pd.DataFrame({"text": [b" ".join(t).decode() for t in texts], "held_out": False})
    frames = [f for half in (frame[:150], frame[150:]) for f in M.context_codes(symbols, 8)(iter([half]))]
    held = np.sort(M.rare_codes(words[5:], len(words) - 5))
    out = pd.concat(M.kept_contexts(p0, root.sum(), held)(iter([pd.concat(frames).sort_values("bucket", kind="stable")])))
    rare = out[out["rare"]]
    table = M.Distributions(np.frombuffer(b"".join(rare["codes"]), np.uint64), np.frombuffer(b"".join(rare["n"]), np.float64))
    assert len(table.names) == len(kept)
    assert set(np.frombuffer(b"".join(rare["held"]), np.uint64).tolist()) == set(M.rare_codes(list(kept & set(words)), len(kept & set(words))).tolist())
    every = np.arange(symbols.size)
    for c, x in seen.items():
        gains = table.gains(M.rare_codes([c], 1) | every.astype(np.uint64), p0)
        n = sum(x.values())
        want = [(x[s] + len(x) * p0[s]) / (n + len(x)) if c in kept else p0[s] for s in every.tolist()]
        assert np.allclose(p0 * 10**gains, want) and abs((p0 * 10**gains).sum() - 1) < 1e-9
    upper = M.Upper(root, np.frombuffer(b"".join(out["codes"][~out["rare"]]), np.uint64), np.frombuffer(b"".join(out["n"][~out["rare"]]), np.float64))
    assert (upper.whole >= 0).sum() == len(listed) and np.allclose(upper.suffix_rows.sum(1), 1, atol=1e-4)


def test_pairs_of_any_words_are_contexts(spark):
    """Behind two words that aren't both among the most frequent: the scores by the rules, beyond those of listed contexts."""
    M = suffix_tree
    rng = random.Random(5)
    words = [f"{a}{b}" for a in ("ka", "lo", "mi", "tru", "ves", "pon", "gar", "hil", "dez", "sul") for b in ("n", "st", "ring", "e", "o", "a", "u", "im", "ek", "or", "ap", "yl")]
    docs = [(i, " ".join(rng.choice(words) for _ in range(rng.randrange(40)))) for i in range(120)]
    docs += [(1000 + i, docs[i % 40][1]) for i in range(60)]
    train = [M.tokens_of(t) for k, t in docs if zlib.crc32(str(k).encode()) % 5 != 1]
    count = Counter(w for t in train for w in t)
    listed = {w: i for i, (w, _) in enumerate(sorted(count.items(), key=lambda x: (-x[1], x[0])), 1)}
    assert len(listed) > M.NEAR
    size = M.LISTED + 2 + M.PREFIXES
    root, seen = Counter(), {}

    def states(t):
        for i, s in enumerate([*t, None]):
            near, far = (t[i - 1], t[i - 2]) if i > 1 else (t[0] if i else None, None)
            n, m = listed.get(near, 0), listed.get(far, 0)
            levels = [("s", (b" " + near)[-2:] if near else b"\n"), ("w", n) if n else None, ("p", m, n if n <= M.NEAR else 0) if 0 < m <= M.FAR else None]
            yield s, levels, ("open", far, near) if i > 1 and not (m <= M.FAR and n <= M.NEAR) else None

    for t in train:
        for s, levels, pair in states(t):
            root[s] += 1
            for c in filter(None, [*levels, pair]):
                seen.setdefault(c, Counter())[s] += 1
    total = sum(root.values())
    p0 = lambda s: (root[s] + 0.5) / (total + 0.5 * size)
    kept = {c for c, x in seen.items() if (c[0] != "open" or sum(x.values()) >= M.MASS) and sum(n * math.log(n / sum(x.values()) / p0(s)) for s, n in x.items()) >= M.DIVERGENCE * len(x)}
    assert sum(c[0] == "open" for c in kept) > 100
    got = {r["doc_id"]: r["score"] for r in M.score(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    for k, text in docs:
        t, want = M.tokens_of(text), 0.0
        if any(w not in listed for w in t):
            continue
        for s, levels, pair in states(t):
            p = p0(s)
            for c in (*levels, pair):
                if c in kept:
                    n = sum(seen[c].values())
                    p = (seen[c][s] + len(seen[c]) * p) / (n + len(seen[c]))
            want += math.log10(p)
        assert abs(got[k] - want) < 1e-3 + 1e-4 * abs(want)


def test_held_out_texts_cost_their_own_words():
    """Words of a held-out text are looked up one by one: the words counted before aren't walked through again for it."""
    import time

    def seconds(n: int) -> float:
        texts = [" ".join(f"w{i}" for i in range(n)), *["a b a"] * 3_000]
        frame = pd.DataFrame({"text": texts, "held_out": [False] + [True] * 3_000})
        began = time.thread_time()
        (out,) = suffix_tree._counted(iter([frame]))
        assert out.dropna().set_index("word")["c"].loc[[b"w0", b"a", b"b"]].tolist() == [1, 0, 0] and len(out) == n + 3
        return time.thread_time() - began

    assert seconds(200_000) < seconds(10) + 3


def test_counts_leave_in_small_batches():
    """Packed counts of all ranges in one batch took several times their size in the worker and its JVM."""
    words = [f"w{i}" for i in range(3_000)]
    frame = pd.DataFrame({"text": [" ".join(words)] * 2, "held_out": [False, True]})
    symbols = suffix_tree.Symbols([w.encode() for w in words[:10]], [])
    out = list(suffix_tree.context_codes(symbols, 8, pairs=True)(iter([frame])))
    assert all(len(f) <= 32 for f in out)
    buckets = np.concatenate([f["bucket"] for f in out])
    assert len(set(buckets.tolist())) == len(buckets) > 200
    assert sum(np.frombuffer(n, np.uint32).sum() for f in out for n in f["n"]) == 3_001 + 10 + 10 + 2 * 2_990


def test_counting_takes_little_memory():
    """Two workers and their JVM share an executor: what counts hold beside themselves was several times their 9 MB."""
    import tracemalloc

    rng, words = np.random.default_rng(1), [f"w{i}" for i in range(200_000)]
    symbols = suffix_tree.Symbols([w.encode() for w in words[:1024]], [])
    texts = [[" ".join(words[i] for i in (rng.zipf(1.3, 1_000) % 200_000).tolist()) for _ in range(100)] for _ in range(12)]
    tracemalloc.start()
    try:
        out = sum(sum(map(len, f["codes"])) for f in suffix_tree.context_codes(symbols, 8, pairs=True)(pd.DataFrame({"text": t, "held_out": False}) for t in texts))
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert out > 700_000 * 8 and peak < 60e6


def test_counts_are_added():
    codes, n = np.empty(0, np.uint64), np.empty(0, np.uint32)
    rng, want = np.random.default_rng(2), Counter()
    for size in (0, 5, 300, 1, 0, 300):
        new = rng.integers(0, 200, size).astype(np.uint64) << np.uint64(57)
        want.update(new.tolist())
        codes, n = suffix_tree._added(codes, n, [new[:2], new[2:]])
        assert dict(zip(codes.tolist(), n.tolist(), strict=True)) == want and codes.tolist() == sorted(want)
    assert (codes.dtype, n.dtype) == (np.uint64, np.uint32)


def test_large_rows_come_in_small_batches(spark):
    """Rows of packed arrays came in batches of 64 MB."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    was = spark.conf.get(key)
    try:
        spark.conf.set(key, "64m")
        suffix_tree.small_batches(spark)
        rows = spark.range(300, numPartitions=1).selectExpr("cast(repeat('x', 100000) as binary) as b")
        assert max(r["n"] for r in rows.mapInPandas(lambda frames: (pd.DataFrame({"n": [len(f)]}) for f in frames), "n long").collect()) <= 100
        spark.conf.set(key, "1000000")
        suffix_tree.small_batches(spark)
        assert spark.conf.get(key) == "1000000"
    finally:
        spark.conf.set(key, was)


def test_pair_behind_a_rare_word():
    """A pair whose nearer word isn't listed lies in that word's range and is smoothed towards it; frequent pairs below the share are kept there too."""
    M = suffix_tree
    listed, rare = [b"ka", b"lo", b"mi"], [b"tru", b"ves", b"pon"]
    symbols = M.Symbols(listed, [(w[0] << 8) | w[1] for w in rare])
    texts = [[b"ka", b"tru", b"lo"]] * 3 + [[b"lo", b"tru", b"mi"]] * 3 + [[b"ves", b"tru", b"ka"]] + [[b"ka", b"lo", b"pon"]] * 4
    p0 = np.full(symbols.size, 1e-4)
    frame = pd.DataFrame({"text": [b" ".join(t).decode() for t in texts], "held_out": False})
    counts = pd.concat(M.context_codes(symbols, 9, pairs=True)(iter([frame]))).sort_values("bucket", kind="stable")
    out = pd.concat(M.kept_contexts(p0, 4 / M.P_UPPER + 1, np.empty(0, np.uint64), 9)(iter([counts])))
    out = out[out["rare"]].set_index("bucket")
    known = np.r_[np.zeros(1, np.uint64), M.word_hashes(symbols.ids, 3)]

    def chance(text, i, p):
        number, _, _, _, pair = symbols.read([text], symbols.ids)
        word, both = M.Symbols.open_codes(symbols, [text], number, symbols.hashes([text], number, known), np.arange(4) == 0, pair, 9)
        symbol = np.uint64(symbols.ids.get(text[i]) or symbols.of_prefix[(text[i][0] << 8) | text[i][1]])
        assert not word[i] or word[i] >> np.uint64(55) == both[i] >> np.uint64(55)
        row = out.loc[int(both[i] >> np.uint64(55))]
        slots = np.zeros((512, 1 << (M.SLOT_BITS - 12)), np.uint8)
        slots[int(both[i] >> np.uint64(55))] = np.frombuffer(row["slots"], np.uint8)
        kind = lambda k, codes, pairs, rows, n: {"kind": k, "bucket": 0, "row": 7, "codes": codes, "pairs": pairs, "rows": rows, "n": n}
        ask = kind(M.ASK, ((word[i] | symbol) if word[i] else word[i]).tobytes(), (both[i] | symbol).tobytes(), np.uint32(0).tobytes(), np.float32(p).tobytes())
        schema = pa.schema([("kind", pa.int32()), ("bucket", pa.int32()), ("row", pa.int64()), ("codes", pa.binary()), ("pairs", pa.binary()), ("rows", pa.binary()), ("n", pa.binary())])
        got = list(M.answered(iter([pa.RecordBatch.from_pylist([kind(M.TABLE, row["codes"], None, None, row["n"]), ask], schema)])))
        return p * 10 ** (np.frombuffer(got[0].column("n")[0].as_py(), np.float32)[0] if got else 0), bool(M._may_be_kept(both[i : i + 1], slots.reshape(-1))[0])

    after_word = (3 + 3 * 0.01) / (7 + 3)  # behind tru: lo and mi three times each, ka once
    assert np.allclose(chance([b"ka", b"tru", b"lo"], 2, 0.01)[0], (3 + after_word) / (3 + 1), rtol=1e-4)
    assert chance([b"ka", b"tru", b"lo"], 2, 0.01)[1]
    assert np.allclose(chance([b"ves", b"tru", b"lo"], 2, 0.01)[0], after_word, rtol=1e-4)  # once only: no context
    got, there = chance([b"ka", b"lo", b"pon"], 2, 0.01)
    assert there and np.allclose(got, (4 + 0.01) / (4 + 1), rtol=1e-4)


def least_cost(roles):
    best = {chat.START: 0}
    for r in roles:
        new = {}
        for s, c in best.items():
            for q, (k, _, _) in chat.MOVES[s, r].items():
                new[q] = min(new.get(q, 10**9), c + k)
        best = new
    return min(c + chat.INSERT * len(chat.CLOSING[s]) for s, c in best.items())


def test_chats(spark):
    random.seed(2)
    rows = [(c, t, random.choice(["user", "assistant", "system", "tool", None, "Human"]), random.choice(["hi", "yo", None, ""])) for c in range(60) for t in range(random.randint(1, 6))]
    rows += [(99, t, random.choice(["user", "user", "assistant", "system"]), f"t{t}") for t in range(2500)]
    rows += [(None, None, None, None), (7, 100, "user", "same"), (7, 100, "user", "same")]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "conv_id long, turn long, role string, text string, part string, position int")
    out = chat.format_chats(df).toPandas()
    assert len(out) == len(rows)
    given = defaultdict(list)
    for c, t, r, x in rows:
        given[c].append((t if t is not None else math.inf, r or "", x or "", r))
    for c, f in out.groupby(out["conv_id"].astype("float").fillna(-1)):
        turns = sorted(given[None if c == -1 else int(c)], key=lambda t: (t[0], t[3] is not None, t[1], t[2]))
        f = f.sort_values(["turn", "position"], kind="stable")
        sequence = re.findall(r"<\|(system|user|assistant)\|>", "".join(f["rendered"]))
        assert re.fullmatch(r"(system )?(user assistant )*", " ".join(sequence) + " ")
        roles = [chat.role_number(r) for *_, r in turns]
        cost = 0
        for r, action, role, inserted in zip(roles, f["action"], f["role"], f["inserted"], strict=True):
            q = chat.ROLES.index(role) + 1
            cost += chat.INSERT * len([x for x in inserted.split(",") if x])
            cost += {"keep": 0, "relabel": chat.NAME if r == 0 else chat.RELABEL, "merge": chat.MERGE if r in (q, 0) else chat.MERGE_OTHER}[action]
        assert cost == least_cost(roles), c
    assert chat.format_chats(df.where("false")).count() == 0


def test_toxicity_sees_all_windows(spark):
    # The passage lies in one window of some 400, at another place of each text.
    rng = np.random.default_rng(4)
    rows = []
    for i in range(240):
        words = [f"w{x}" for x in rng.integers(0, 300, 6400)]
        if i % 2:
            at = int(rng.integers(0, 6390))
            words[at : at + 4] = ["vile", "rotten", "filthy", "scum"]
        rows.append((i, " ".join(words), i % 2))
    d = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    docs, labels = d.select("doc_id", "text"), d.select("doc_id", "toxic")
    got = toxicity.report(docs, labels).toPandas().merge(labels.toPandas(), on="doc_id")
    held = got[got["held_out"]]
    assert auc(held["score"].to_numpy(), held["toxic"].to_numpy()) > 0.95
    assert (held["predicted"] == held["toxic"]).mean() > 0.9
