"""Known values, properties and edges of the engine's own operators."""

import datetime
import math
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tessella.functions import reports as R
from tessella.functions import telemetry as T
from tessella.functions import tokenize as K
from tessella.operators import experiments as X
from tessella.operators import loss as L
from tessella.operators import packing as P
from tessella.operators import sessions as S
from tessella.sources import corpus as C
from tessella.sources import generate as G


def value(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(
    ("text", "hits"),
    [("error=none level=INFO", 0), ("error=timeout level=CRITICAL alert=true pagerduty=triggered", 4), ("status=error alert=link_degraded error_pct=0.3 health=SLOW", 0), ("health=VERY_SLOW", 1), ("", 0)],
)
def test_hits(spark, text, hits):
    assert value(spark, T.anomaly_hits(F.lit(text))) == hits
    assert value(spark, T.session_label(T.anomaly_hits(F.lit(text)))) == ("normal" if not hits else "cascade" if hits >= 3 else "anomalous")


def test_pack_known():
    docs = [["a"] * 3, ["b"] * 5, ["c"] * 9, ["d"] * 2, ["e"] * 5, ["f"] * 4]
    rows = list(P.pack(docs, 8))
    assert ["".join(r) for r in rows] == ["bbbbbaaa", "eeeeeddf", "cccccccc"]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 30), max_size=60), st.integers(1, 12), st.integers(1, 8))
def test_pack_properties(sizes, capacity, buffer):
    docs = [[(i, j) for j in range(n)] for i, n in enumerate(sizes)]
    rows = list(P.pack(docs, capacity, buffer=buffer, batch=3))
    assert all(len(r) == capacity for r in rows)
    assert all(r[0][1] == 0 for r in rows)
    out = [t for r in rows for t in r]
    assert len(set(out)) == len(out) and set(out) <= {t for d in docs for t in d}


def test_cascade_and_weights(spark):
    df = spark.createDataFrame([(1, i, i in (4, 5, 6)) for i in range(12)] + [(2, i, True) for i in range(5)], "r int, p int, flag boolean")
    got = L.cascade_density(df, ["r"], ["p"], "flag").where("in_cascade").select("r", "p").collect()
    assert sorted((x["r"], x["p"]) for x in got) == [(1, p) for p in (3, 4, 5, 6, 7)]
    for anomalous, cascade, want in ((False, False, 1.0), (True, False, 4.0), (False, True, 2.5), (True, True, 10.0)):
        assert value(spark, R.token_weight(F.lit(anomalous), F.lit(cascade))) == want


@pytest.mark.parametrize(("nats", "want"), [(0.1, 0.000086), (1.0, 0.252580), (5.0, 4.899610)])
def test_focal(spark, nats, want):
    assert value(spark, F.round(R.focal(F.lit(nats)), 6)) == want


@pytest.mark.parametrize(("progress", "want"), [(0.2, 1.0), (0.35, 1.0), (0.675, 0.5), (1.0, 0.0)])
def test_schedule(spark, progress, want):
    assert abs(value(spark, R.schedule(F.lit(progress))) - want) < 1e-12


def test_ema(spark):
    df = spark.createDataFrame([("a", i, v) for i, v in enumerate((4.0, 2.0, 1.0))] + [("b", i, float(i % 7)) for i in range(1200)], "k string, i int, v double")
    got = {(r["k"], r["i"]): r["ema"] for r in X.ema(df, "k", ["i"], "v").collect()}
    assert [round(got["a", i], 6) for i in range(3)] == [4.0, 2.947368, 2.228782]
    m = 0.0
    for i in range(1200):
        m = 0.9 * m + 0.1 * (i % 7)
        assert math.isclose(got["b", i], m / (1 - 0.9 ** (i + 1)), rel_tol=1e-9)


def test_sparkline_and_windows(spark):
    assert value(spark, R.sparkline(F.array(*map(F.lit, (0.4372, 0.4349, 0.4297, 0.3950, 0.3682))))) == "▁▁▁▅█"
    assert value(spark, R.sparkline(F.array(F.lit(1.0), F.lit(1.0)))) == "██"
    assert R.attention_windows("SSL", 4, 2048) == [1024, 1024, 2048, 2048]
    with pytest.raises(ValueError):
        R.attention_windows("SX", 2, 8)


def history(spark, rows):
    day = datetime.datetime(2026, 1, 1)
    return spark.createDataFrame([(1, day + datetime.timedelta(hours=i), i, f"c{i}", s, v) for i, (s, v) in enumerate(rows)], "night int, ran_at timestamp, ordinal int, commit string, status string, val_bpb double")


def test_running_best_carries_over_nulls(spark):
    df = history(spark, [("KEEP", 1.0), ("KEEP", None), ("KEEP", 0.7), ("KEEP", 0.9)])
    assert [r["best_so_far"] for r in X.running_best(df).orderBy("ordinal").collect()] == [1.0, 1.0, 0.7, 0.7]


def test_keep_if_better_is_a_loop(spark):
    random.seed(1)
    rows = [(random.choice(["KEEP", "CRASH"]), random.choice([None, 0.5, 0.6, 0.7, 0.8, 99.0, float("nan")])) for _ in range(200)]
    got = [r["kept"] for r in X.keep_if_better(history(spark, rows)).orderBy("ordinal").collect()]
    best, want = math.inf, []
    for status, v in rows:
        ok = status != "CRASH" and v is not None and v == v and v <= 50 and v < best
        best = v if ok else best
        want.append(ok)
    assert got == want


def test_quartile_and_histogram_edges(spark):
    assert value(spark, F.get(F.transform(F.array(F.lit(0.8)), lambda x: x), F.lit(0))) == 0.8
    df = spark.createDataFrame([(1.0,), (0.7,), (0.9,), (None,)], "v double")
    assert round(df.agg(F.percentile("v", F.lit(0.25))).first()[0], 9) == 0.8
    assert {r["bin"]: r["n"] for r in S.histogram(df, "v", 3).collect()} == {1: 1, 2: 1, 3: 1} or S.histogram(df, "v", 3).agg(F.sum("n")).first()[0] == 3
    same = spark.createDataFrame([(2.0,), (2.0,)], "v double")
    r = S.histogram(same, "v", 4).collect()
    assert [(x["lo"], x["hi"], x["bin"], x["n"]) for x in r] == [(1.5, 2.5, 3, 2)]
    assert S.histogram(df.where("false"), "v", 3).count() == 0


def test_vocabulary(spark):
    docs = spark.createDataFrame([("the cat sat on the mat, the end 123 4567",), ("Unicode: 你好 été",), (None,)], "text string")
    ranks = K.train_vocabulary(docs, size=300)
    assert len(ranks) <= 296 and all(bytes([i]) in ranks for i in range(256))
    v = K.vocabulary(spark, ranks)
    exact = {r["token_id"]: r["n_bytes"] for r in K.token_lengths(v).collect()}
    decoded = {r["token_id"]: r["n_bytes"] for r in K.token_lengths(v, exact=False).collect()}
    assert exact[ranks[b"\xe2"]] == 1 and decoded[ranks[b"\xe2"]] == 3
    assert all(exact[len(ranks) + k] == 0 for k in range(4))
    d = spark.createDataFrame([(1, "Hello world! Numbers: 123. Unicode: 你好"), (2, ""), (3, None), (4, "a  b\n\n c")], "id long, text string")
    ids = d.select("id", K.encoder(ranks, prepend=K.bos_id(ranks))("text").alias("ids"))
    assert all(r["ids"][0] == len(ranks) for r in ids.collect())
    back = {r["id"]: r["text"] for r in K.decode_ids(ids, "ids", v, "id").collect()}
    assert back == {1: "Hello world! Numbers: 123. Unicode: 你好", 2: "", 3: "", 4: "a  b\n\n c"}


def test_rows_decode_by_themselves(spark):
    ranks = {bytes([i]): i for i in range(256)}
    d = spark.createDataFrame([(1, "one"), (1, "two"), (None, "no key"), (None, None), (2, "")], "id long, text string")
    ids = d.select("id", K.encoder(ranks, prepend=K.bos_id(ranks))("text").alias("ids"))
    out = K.decode_ids(ids, "ids", K.vocabulary(spark, ranks), "id")
    assert sorted(map(tuple, out.collect()), key=str) == sorted([(1, "one"), (1, "two"), (None, "no key"), (None, ""), (2, "")], key=str)
    assert "Exchange" not in out._jdf.queryExecution().executedPlan().toString()  # an id isn't a row of its own


def test_encoding_holds_packed_ids(spark):
    import tracemalloc

    import pyarrow as pa

    ranks = {bytes([i]): i for i in range(256)} | {f"{a}{b}".encode(): 256 + 8 * i + j for i, a in enumerate("abcdefgh") for j, b in enumerate("abcdefgh")}
    texts = pa.array(["".join(random.choices("abcdefgh", k=2000)) for _ in range(200)])
    tracemalloc.start()
    ids = K.encoder(ranks, prepend=320).func(texts)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    names = {i: b for b, i in ranks.items()} | {320: b""}
    assert [b"".join(names[i] for i in x).decode() for x in ids.to_pylist()] == texts.to_pylist()
    assert most < 20 * len(ids.values)  # two packed copies and what a text takes for a while; lists take 36 bytes an id


def test_roundtrip_of_odd_documents(spark, tmp_path):
    import duckdb

    from tessella.plans import queries as Q

    rows = [(1, "one"), (1, "two"), (2, None), (None, "no key"), (3, ""), (4, "\u4f60\u597d \U0001f600 <|reserved_0|>")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    ours = map(tuple, Q.decode_roundtrip(spark, str(tmp_path)).collect())
    assert sorted(ours, key=str) == sorted(con.sql(Q.SQL["decode_roundtrip"]).fetchall(), key=str)


def test_pretokens_join_to_the_text(spark):
    for text in ("don't stop\n\n now  ", "été 12345 ", "a b 　c", "!!! ...\r\n x"):
        pieces = value(spark, K.pretokens(F.lit(text)))
        assert "".join(pieces) == text
        assert all(len(p) <= 2 for p in pieces if p.isdigit())


def test_log_lines(spark):
    lines = ["aaaabbbbcc|[val_bpb=1.1832] [Δ=-0.0344] [change: wider] [hypothesis: more]|2026-01-01", "ffff|[val_bpb=0.9] note|cut|x", "eeee|no metric|t", "dddd|[val_bpb=bad]|t"]
    got = X.parse_log(spark.createDataFrame([(x,) for x in lines], "line string")).orderBy("sha").collect()
    assert [r["sha"] for r in got] == ["aaaabbbb", "ffff"]
    assert (got[0]["val_bpb"], got[0]["delta"], got[0]["change"], got[0]["hypothesis"]) == (1.1832, -0.0344, "wider", "more")
    assert (got[1]["delta"], got[1]["change"], got[1]["timestamp"]) == (None, "[val_bpb=0.9] note", "cut|x")


def test_run_outputs(spark):
    text = "noise\n---\nval_bpb:   0.368200\nnum_steps: 10\nval_bpb:   0.4\n```python\nx = 1\n```\n"
    assert value(spark, R.metric(F.lit(text), "val_bpb")) == 0.4
    assert value(spark, R.metric(F.lit(text), "depth")) is None
    assert value(spark, R.plausible_bpb(F.lit(99.0))) is None
    assert value(spark, R.code_block(F.lit(text))) == "x = 1"
    assert value(spark, R.code_block(F.lit("```\nprose\n```"))) is None and value(spark, R.code_block(F.lit("```\n\n def f(): 1\u00a0\n```"))) == "def f(): 1"
    assert value(spark, R.code_block(F.lit("none"))) is None
    assert value(spark, R.metric(F.lit("[log] val_bpb:  0.25 val_bpb:\n1.2.3 depth: 4"), "val_bpb")) == 1.2
    assert value(spark, R.change_summary(F.lit("Proposed change: raise the warm-up share to 0.1..\nmore"))) == "raise the warm-up share to 0.1"
    assert value(spark, R.change_summary(F.lit("well\nI AM TRYING a larger batch of tokens now\n"))) == "a larger batch of tokens now"
    assert value(spark, R.change_summary(F.lit("short\n  this line has more than twenty characters  \nend\n```python\na longer line than any other one here"))) == "this line has more than twenty characters"
    assert value(spark, R.change_summary(F.lit("short"))) == "see response log"
    assert value(spark, R.last_lines(F.lit("\n".join(map(str, range(30))) + "\n\n"), 3)) == "27\n28\n29"
    assert value(spark, R.run_log(F.lit("a"), F.lit(None).cast("string"))) == "a" and value(spark, R.numeric_suffix(F.lit("KEY_12"))) == 12
    assert value(spark, R.rounded_dim(F.lit(5))) == 384 and value(spark, R.weight_decay(F.lit(0.25), 0.2)) == pytest.approx(0.15)
    assert value(spark, R.commit_subject(F.lit(0.5), F.lit(0.625), F.lit("x" * 70), F.lit(3))) == "[val_bpb=0.5000] [Δ=-0.1250] [change: " + "x" * 60 + "] [exp: 3]"
    assert value(spark, R.shortened(F.lit("x" * 50))) == "x" * 42 + "..."
    assert value(spark, R.number(F.lit("1.5x"))) is None


def test_shards(spark, tmp_path):
    path = str(tmp_path / "corpus")
    for n, texts in ((0, ["a", "b"]), (1, ["c"]), (6542, ["d"])):
        spark.createDataFrame([(t,) for t in texts], "text string").coalesce(1).write.parquet(f"{tmp_path}/w{n}")
        import glob
        import os
        import shutil

        os.makedirs(path, exist_ok=True)
        shutil.copy(glob.glob(f"{tmp_path}/w{n}/*.parquet")[0], f"{path}/{C.shard_name(n)}")
    df = C.read_corpus(spark, path)
    assert sorted((r["session_id"], r["text"]) for r in df.collect()) == [(0, "a"), (1, "b"), (1 << 32, "c"), (6542 << 32, "d")]
    assert [r["text"] for r in C.split(df, "val").collect()] == ["d"] and C.split(df, "train").count() == 3
    assert C.read_corpus(spark, path, first=1).count() == 2
    assert [r["file"] for r in C.list_shards(spark, path).collect()] == ["shard_00000.parquet", "shard_00001.parquet", "shard_06542.parquet"]
    out = str(tmp_path / "out")
    assert C.write_shards(spark.createDataFrame([(0, "a"), (1, "b")], "shard int, text string"), out) == ["shard_00000.parquet", "shard_00001.parquet"]
    assert C.write_shards(spark.createDataFrame([(1, "again"), (2, "c"), (None, "x")], "shard int, text string"), out) == ["shard_00002.parquet"]
    assert sorted((r["file"], r["text"]) for r in C.read_corpus(spark, out).collect()) == [("shard_00000.parquet", "a"), ("shard_00001.parquet", "b"), ("shard_00002.parquet", "c")]


def test_log_and_outputs(spark, tmp_path):
    lines = [f"{i:040d}|[val_bpb=0.{9000 - i}] note|2026-01-01" for i in range(5000)]
    (tmp_path / "log.txt").write_text("\n".join(lines) + "\n")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        got = C.read_log(spark, str(tmp_path / "log.txt")).orderBy("ordinal").collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert [r["line"] for r in got] == lines[::-1]
    df = spark.createDataFrame([("a", "x\n\ny"), ("b", "z\n")], "name string, text string")
    C.write_outputs(df, str(tmp_path / "texts"))
    assert sorted(map(tuple, C.read_named_outputs(spark, str(tmp_path / "texts")).collect())) == [("a", "x\n\ny"), ("b", "z\n")]


def test_experiment_table(spark, tmp_path):
    (tmp_path / "results.tsv").write_text("commit\tval_bpb\tmemory_gb\tstatus\tdescription\nabc\t0.5\t1\t keep \tx\ndef\tbad\t2\tcrash\ty\n")
    df = X.normalized(C.read_experiments(spark, str(tmp_path / "results.tsv")))
    assert [(r["val_bpb"], r["status"]) for r in df.orderBy("commit").collect()] == [(0.5, "KEEP"), (None, "CRASH")]


def test_generator(spark):
    g = G.generate_sessions(spark, 3000).cache()
    share = {r["kind"]: r["n"] / 3000 for r in g.groupBy("kind").agg(F.count("*").alias("n")).collect()}
    assert abs(share["cascade"] - 0.03) < 0.012 and abs(share["anomalous"] - 0.06) < 0.018
    c = S.classified(g).groupBy("kind").agg(F.min("n_events").alias("lo"), F.max("n_events").alias("hi")).collect()
    assert all(G.SIZES[r["kind"]][0] <= r["lo"] and r["hi"] <= G.SIZES[r["kind"]][1] for r in c)
    again = G.generate_sessions(spark, 3000)
    assert g.exceptAll(again).count() == 0
    assert g.where("text IS NULL OR text = ''").count() == 0
    e = G.generate_events(spark, 200)
    from pyspark.sql import Window

    w = Window.partitionBy("session_id").orderBy("event_pos")
    assert e.withColumn("b", F.lag("ts").over(w)).where("b > ts").count() == 0
    late = G.generate_events(spark, 3000, onset="documented").where("kind = 'cascade' AND event_pos = 0")
    assert late.where(F.col("line").contains("pagerduty") | F.col("line").contains("VIOLATED")).count() == 0


def test_budget_and_epochs(spark):
    d = spark.createDataFrame([(i, "x" * n) for i, n in enumerate((5, 0, 7, 3, 9))] + [(9000, "late")], "id long, text string")
    assert sorted(r["id"] for r in P.char_budget(d, "id", "text", 12).collect()) == [0, 1, 2]
    assert P.epochs(d, 3).count() == 18
    assert P.char_budget(d.where("false"), "id", "text", 5).count() == 0


def test_stream(spark, tmp_path):
    rows = [(1, datetime.datetime(2026, 1, 1, 0, m), "error" if m == 5 else "view", float(m)) for m in (0, 5, 10)] + [(1, datetime.datetime(2026, 1, 1, 5), "view", 1.0), (2, datetime.datetime(2026, 1, 2), "view", 1.0)]
    df = spark.createDataFrame(rows, "user_id int, ts timestamp, event_type string, value double")
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    from tessella.streaming.sessions import live_sessions

    s = live_sessions(spark.readStream.schema(df.schema).parquet(str(tmp_path / "in")))
    q = s.writeStream.format("memory").queryName("live").outputMode("append").option("checkpointLocation", str(tmp_path / "ck")).start()
    q.processAllAvailable()
    q.stop()
    got = spark.table("live").orderBy("start").collect()
    assert (got[0]["n_events"], got[0]["n_errors"], got[0]["worst"]) == (3, 1, 10.0)


def test_vocabulary_learns_from_all_pretokens(spark):
    # 60,000 pre-tokens of equal counts; the letters "zq" stand only in those that are last in order.
    letters = "abcdefghijklmnopqrst"
    rare = [letters[i % 20] + letters[i // 20 % 20] + letters[i // 400 % 20] + letters[i // 8000] for i in range(52_000)]
    docs = spark.createDataFrame([(" ".join(rare[i::8]) + " " + " ".join(f"zq{w}" for w in rare[i:9_000:8]),) for i in range(8)], "text string")
    ranks = K.train_vocabulary(docs, size=300, doc_cap=None)
    assert b" zq" in ranks


def test_vocabulary_stops_at_its_budget(spark):
    docs = spark.createDataFrame([(0, "ab ab ab"), (1, "cd cd cd"), (2, "ef ef ef ef"), (None, "gh gh gh gh gh")], "doc_id long, text string")
    own = lambda **o: set(K.train_vocabulary(docs, size=300, **o)) - {bytes([i]) for i in range(256)}
    assert own(order="doc_id", max_chars=9) == {b"ab", b" ab", b"cd", b" cd"}  # the document that crosses the budget counts
    assert own(order="doc_id") == {b"ab", b" ab", b"cd", b" cd", b"ef", b" ef"}
    assert b" gh" in own()
    assert K.train_vocabulary(docs.where("false"), size=300, order="doc_id") == {bytes([i]): i for i in range(256)}


def test_vocabulary_words_stay_with_the_executors(spark, monkeypatch):
    import random

    from pyspark.sql.classic.dataframe import DataFrame

    rng = random.Random(5)
    words = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(1, 12))) for _ in range(4000)]
    docs = spark.createDataFrame([(i, " ".join(rng.choices(words, k=200))) for i in range(60)], "doc_id long, text string")
    counts = [(r["token"].encode(), r["n"]) for r in K.pretoken_counts(docs).collect() if len(r["token"].encode()) > 1]
    for name in ("toPandas", "toArrow", "toLocalIterator"):
        monkeypatch.setattr(DataFrame, name, None)  # only ranks come to the driver
    one = K.train_vocabulary(docs, size=500, order="doc_id")
    assert list(one) == list(K.learn_merges(counts, 496)) and len(one) > 400
    assert list(K.train_vocabulary(docs, size=500, order="doc_id", share=5_000)) == list(one)  # words in four tasks


def test_merges_are_the_most_frequent_pairs():
    import random

    rng = random.Random(3)
    counts = [(w, rng.randint(1, 9)) for w in {bytes(rng.choice(b"abcd") for _ in range(rng.randint(1, 9))) for _ in range(300)}]
    names, words = [bytes([i]) for i in range(256)], [(list(w), n) for w, n in counts]
    while len(names) < 330:
        pairs = {}
        for w, n in words:
            for p in zip(w, w[1:], strict=False):
                pairs[p] = pairs.get(p, 0) + n
        best = max(pairs, key=lambda p: (pairs[p], -p[0], -p[1]))
        for w, _ in words:
            i = 0
            while i + 1 < len(w):
                if (w[i], w[i + 1]) == best:
                    w[i : i + 2] = [len(names)]
                i += 1
        names.append(names[best[0]] + names[best[1]])
    assert list(K.learn_merges(counts, 330)) == list(dict.fromkeys(names))
    assert list(K.learn_merges([(b"aaaaa", 2), (b"aaa", 1)], 300))[256:] == [b"aa", b"aaa", b"aaaaa"]  # runs are merged from the left


def test_generator_writes_all_attributes(spark):
    keys = {
        "APMTracer": "latency_ms error trace_id span_id http_status http_method gpu_util prompt_tokens response_tokens cost_usd drift_score",
        "NetIntel": "path latency_ms jitter_ms packet_loss bgp_changes dns_ms hop_count mtu reachable",
        "LogStream": "host level svc msg latency_ms session_id user_id",
        "OTel": "trace_id span_id parent op svc duration_ms status db rows k8s_pod k8s_ns",
        "WANController": "site link qos latency_ms loss jitter_ms bw_util policy interface",
        "APMTracer-BizTxn": "trace_id svc txn health response_time_ms baseline_ms call_count error_pct slow_pct",
    }
    for r in G.generate_events(spark, 300).collect():
        found = dict(x.split("=", 1) for x in r["line"].split(" ")[2:] if not x.startswith("["))
        extra = {"LogStream": {"alert", "escalated", "pagerduty"}, "WANController": {"alert"}}.get(r["src"], set()) if r["kind"] != "normal" else set()
        assert set(found) == set(keys[r["src"]].split()) | extra, r["line"]
        if r["src"] == "APMTracer":
            n, m = int(found["prompt_tokens"]), int(found["response_tokens"])
            assert (20 <= n <= 512 and 10 <= m <= n) if r["kind"] == "normal" else (256 <= n <= 4096 and m == 0)
        if found.get("health") == "ERROR":
            assert 1800 <= int(found["response_time_ms"]) <= 32000
    n = {r["shard"]: r["n"] for r in G.generate_corpus(spark).groupBy("shard").agg(F.countDistinct("session_id").alias("n")).collect()}
    assert n == dict.fromkeys([*range(20), 6542], 1000)


def test_scratch_leaves_no_shuffle_files(spark):
    """What a written table was shuffled through goes with the write, not when the driver happens to collect its garbage."""
    from tessella.sources.scratch import Scratch

    def files() -> set[str]:
        found = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
        return {x for i in range(found.size()) if "/shuffle_" in (x := str(found.apply(i)))}

    scratch, before = Scratch(spark, "cleaned"), files()
    table = scratch.write(spark.range(1000).repartition(3, "id"), "dealt")
    assert not files() - before
    assert table.count() == 1000
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled") == "false"
