"""The pipeline's stages against their operators' brute-force versions."""

import hashlib

from test_operators import brute_components, brute_contamination, brute_fingerprint

import corpus_pipeline

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "near_dedup", "decontaminate", "secret_scan", "sentencepiece"]
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = [tuple(r) for r in docs.select("doc_id", "text").collect()]
    names = docs.columns
    out = {}
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF)
        docs = spark.createDataFrame(docs.collect(), docs.schema)
        out[name] = docs
        assert name == "sentencepiece" or docs.columns == names
    rows = [r for r in rows if r[1] and any(c.isalpha() for c in r[1])]
    assert {r["doc_id"] for r in out["language_id"].collect()} == {r[0] for r in rows}
    root = brute_components([brute_fingerprint(t) for _, t in rows])
    first = {}
    for (i, t), k in zip(rows, root):
        first[k] = min(first.get(k, (i, t)), (i, t))
    assert {r["doc_id"] for r in out["near_dedup"].collect()} == {i for i, _ in first.values()}
    items = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text").collect()]
    clean = {x[0] for x in brute_contamination(list(first.values()), items) if not x[-1]}
    assert {r["doc_id"] for r in out["decontaminate"].collect()} == clean
    texts = {r["doc_id"]: r["text"] for r in out["secret_scan"].collect()}
    assert texts.keys() == clean
    for r in out["sentencepiece"].collect():
        assert r["ids_sha256"] == hashlib.sha256(",".join(map(str, r["ids"])).encode()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(texts[r["doc_id"]].encode()).hexdigest()


def test_language_without_a_model(spark):
    docs = spark.createDataFrame([(1, "plain words", None), (2, "12 34", None), (3, None, None)], "doc_id long, text string, lang string")
    assert [r["doc_id"] for r in corpus_pipeline.language(spark, docs, SF).collect()] == [1]


def test_run(spark):
    assert corpus_pipeline.run(spark, SF).count() > 0
