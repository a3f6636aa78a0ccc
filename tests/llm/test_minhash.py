import random

import numpy as np
import pytest

from tessella.llm import components as CC
from tessella.llm import minhash as M
from tessella.llm.common import Scratch


def brute(texts, words, percent):
    sets = [set(M.shingle_set(t, words).tolist()) for t in texts]
    parent = list(range(len(texts)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                x, y = find(i), find(j)
                parent[max(x, y)] = min(x, y)
    return [find(i) for i in range(len(texts))]


@pytest.mark.parametrize(("words", "block", "grid"), [(2, 128, 16), (5, 128, 16), (2, 3, 2)])
def test_chains_of_near_copies(spark, monkeypatch, words, block, grid):
    monkeypatch.setattr(M, "BLOCK", block)  # groups of many parts, blocks and cells
    monkeypatch.setattr(M, "GRID", grid)
    random.seed(5)
    vocabulary, texts = [f"w{i}" for i in range(5000)], []
    for _ in range(4):
        base = [random.choice(vocabulary) for _ in range(80)]
        for _ in range(50):
            t = list(base)
            for _ in range(random.choice([0, 1, 3, 5, 6, 7, 8, 10])):
                t[random.randrange(80)] = random.choice(vocabulary)
            texts.append(" ".join(t))
            base = t if random.random() < 0.2 else base
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r for r in M.near_duplicates(df, words, 80).collect()}
    want = brute(texts, words, 80)
    assert [got[i]["component_id"] for i in range(len(texts))] == want
    assert all(got[i]["kept"] == (want[i] == i) for i in got)


def test_signature_estimates_similarity():
    rng = np.random.default_rng(0)
    a = np.unique(rng.integers(0, 1 << 63, 2000, dtype=np.uint64))
    b = np.unique(np.r_[a[:1500], rng.integers(0, 1 << 63, 500, dtype=np.uint64)])
    j = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
    assert abs((M.signature(a, 4096) == M.signature(b, 4096)).mean() - j) < 0.03


def test_shingles():
    assert len(M.shingle_set(None, 2)) == len(M.shingle_set(" \t", 2)) == 0
    assert len(M.shingle_set("one", 2)) == 1
    assert np.array_equal(M.shingle_set("A b\x0bC", 2), M.shingle_set("a B c", 2))
    assert not np.array_equal(M.shingle_set("É b", 2), M.shingle_set("é b", 2))
    assert len(M.shingle_set("a a a a", 2)) == 1


def test_odd(odd, none):
    rows = M.near_duplicates(odd, 2, 80).collect()
    assert len(rows) == odd.count()
    by = {r["doc_id"]: r for r in rows}
    assert by[0]["n_shingles"] == by[1]["n_shingles"] == by[2]["n_shingles"] == 0 and by[0]["kept"] and by[2]["kept"]
    assert by[4]["component_id"] == 3 and by[6]["component_id"] == 5 and by[7]["n_shingles"] == 1
    assert by[None]["component_id"] is None and by[None]["kept"]
    assert M.near_duplicates(none, 2, 80).count() == 0
    kept = M.dedup(odd, 2, 80)
    assert {r["doc_id"] for r in rows} >= {(1 << 60) + 1, (1 << 60) + 3}
    assert kept.columns == odd.columns and {4, 6}.isdisjoint(r["doc_id"] for r in kept.collect())


def test_dedup_of_repeated_rows(spark):
    same, other = "a b c d e f g h", "p q r s t u v w"
    rows = [(1, same, 0), (1, same, 1), (1, same, 2), (1, other, 3), (2, other, 4), (None, same, 5), (None, other, 6), (None, "x y z", 7), (None, "x y z", 8), (9, "", 9), (9, "", 10)]
    kept = M.dedup(spark.createDataFrame(rows, "doc_id long, text string, n int"), 2, 80).collect()
    assert sorted((r["doc_id"] or 0, r["text"]) for r in kept) == [(0, "x y z"), (1, same), (1, other), (9, ""), (9, "")]
    with pytest.raises(TypeError, match="integer"):
        M.near_duplicates(spark.createDataFrame([("a", same)], "doc_id string, text string"))


def test_components(spark):
    random.seed(3)
    edges = [(i, i + 1) for i in range(0, 300)] + [(random.randrange(400, 500), random.randrange(400, 500)) for _ in range(80)]
    got = {r["id"]: r["component"] for r in CC.components(spark.createDataFrame(edges, "u long, v long"), Scratch(spark, "cc-test")).collect()}
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for u, v in edges:
        a, b = find(u), find(v)
        parent[max(a, b)] = min(a, b)
    assert got == {x: find(x) for u, v in edges for x in (u, v) if u != v}
