"""The pipeline's stages on odd rows, on clashing columns and on nothing; a run that goes on where another ended."""

import hashlib

import pytest

import corpus_pipeline
from lumenframe.llm.common import new_path

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, `a.b` string, digest string, n_tokens string, __id string, `match` string"


def odd(spark):
    plain = "The words of this text are plain and there are enough of them to tell the language of it"
    texts = [(1, plain, None), (2, plain, "en"), (None, plain + " as well", "en"), (3, None, "en"), (4, "", None), (5, "12 34", "en"), (6, "word " * 50_000, "en"), (7, "x" * 200_000, "de"), (8, "my token = abcdef123456 is here", "en")]
    return spark.createDataFrame([(i, t, x, "s", 1, "b", "d", "n", "k", "m") for i, t, x in texts + texts[:1]], SCHEMA)


def test_odd_rows(spark):
    docs = odd(spark)
    names = docs.columns
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF)
        rows = docs.collect()
        if name == "language_id":
            assert sorted((r["doc_id"] or 0) for r in rows) == [0, 1, 1, 2, 6, 7, 8]
            assert {r["lang"] for r in rows if r["doc_id"] == 1} <= {"en", "de"}  # a null lang became the predicted one
        if name == "near_dedup":
            assert sorted((r["doc_id"] or 0) for r in rows) in ([0, 1, 6, 7, 8], [1, 6, 7, 8])
        if name == "secret_scan":
            assert {r["text"] for r in rows if r["doc_id"] == 8} == {"my [SECRET] is here"}
        if name != "sentencepiece":
            assert docs.columns == names
    assert docs.columns == [f"{c}_in" if c == "n_tokens" else c for c in names] + ["n_tokens", "ids_sha256", "decoded_sha256", "n_fallback", "ids"]
    for r in rows:
        assert r["n_tokens"] == len(r["ids"]) and r["decoded_sha256"] == hashlib.sha256(r["text"].encode()).hexdigest() and r["n_fallback"] == 0


def test_nothing(spark):
    docs = odd(spark).limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF)
        assert docs.count() == 0


def test_run_goes_on(spark, monkeypatch):
    path, calls = new_path(spark, "kept"), []

    def broken(spark, docs, sf_dir):
        calls.append("broken")
        raise RuntimeError("lost")

    def first(spark, docs, sf_dir):
        calls.append("first")
        return docs.limit(5)

    monkeypatch.setattr(corpus_pipeline, "STAGES", [("one", first), ("two", broken)])
    with pytest.raises(RuntimeError):
        corpus_pipeline.run(spark, SF, path)
    monkeypatch.setattr(corpus_pipeline, "STAGES", [("one", first), ("two", lambda s, d, p: d)])
    assert corpus_pipeline.run(spark, SF, path).count() == 5
    assert calls == ["first", "broken"]
