"""The pipeline, stage by stage, against plain versions."""

import corpus_pipeline as C
from tessella.llm import minhash, pii, quality, winnow
from tessella.llm.common import table


def test_stages(spark, sf):
    docs = table(spark, sf, "documents")
    d = docs
    for name, stage in C.STAGES[:-1]:
        out = stage(spark, d, sf)
        assert out.columns == docs.columns, name
        assert out.join(docs, "doc_id", "left_anti").count() == 0
        if name == "near duplicates":
            kept = {r["doc_id"]: r["text"] for r in out.collect()}
            sets = [set(minhash.shingle_set(t, 5).tolist()) for t in kept.values()]
            assert not any(a and b and len(a & b) >= 0.8 * len(a | b) for i, a in enumerate(sets) for b in sets[:i])
        if name == "decontamination":
            assert winnow.report(out, table(spark, sf, "benchmark")).where("contaminated").count() == 0
        if name == "personal data":
            assert out.count() == d.count()
            tagger = pii.Tagger(pii.train())
            assert not any(pii.find(r["text"], tagger)[0] for r in out.collect())
        d = out
    assert quality.keep_good(docs, table(spark, sf, "labels")).count() >= d.count()
    last = C.STAGES[-1][1](spark, d, sf)
    import hashlib

    assert {r["doc_id"]: r["decoded_sha256"] for r in last.collect()} == {r["doc_id"]: hashlib.sha256(r["text"].encode()).hexdigest() for r in d.collect()}


def test_run_and_edges(spark, odd, sf):
    assert C.run(spark, sf).columns == ["doc_id", "lang", "source", "n_chars", "n_tokens", "ids", "decoded_sha256"]
    for _, stage in C.STAGES:
        stage(spark, odd, sf).count()
        assert stage(spark, odd.where("false"), sf).count() == 0
