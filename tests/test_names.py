"""Names in texts, layouts, widths and margins against plain versions and fixtures."""

import math
import random
from difflib import SequenceMatcher

import pytest
from pyspark.sql import functions as F

from lumenframe.functions import geometry as geo
from lumenframe.operators import gazetteer, layout, matching, metrics
from lumenframe.sources import interchange

TEXTS = "id int, text string, lang string, conf double"
POOL = "candidate string, lang string, scope string, rank int"


def ratio(a, b):
    a, b = ("".join(ch for ch in x if ch.isalnum()).lower() for x in (a, b))
    return SequenceMatcher(None, a, b).ratio() if a and b else 0.0


def greedy(spans, key):
    kept = []
    for s in sorted(spans, key=key):
        if all(s[1] <= k[0] or k[1] <= s[0] for k in kept):
            kept.append(s)
    return sorted(kept)


def plain_aligned(text, lang, pool, equal_length):
    spans = set()
    for name, of, _, rank in pool:
        n = len(name)
        if not text or " " in text or lang and of != lang or n < 2 or len(text) < n or (len(text) == n and not equal_length):
            continue
        for i in range(len(text) - n + 1):
            window = text[i : i + n]
            differing = sum(a != b for a, b in zip(window, name))
            if 0 < differing <= n / 2 and ratio(window, name) >= 0.5:
                spans.add((i, i + n, name, ratio(window, name), differing))
    first = {name: min(r for n, *_, r in pool if n == name) for name, *_ in pool}
    return greedy(spans, lambda s: (-s[3], s[0] - s[1], s[4], s[0], first[s[2]], s[2]))


def plain_verbatim(text, lang, pool):
    if not text or " " in text:
        return []
    spans = {(i, i + len(n), n, 1.0, 0) for n, of, *_ in pool if (not lang or of == lang) and len(n) >= 2 for i in range(len(text)) if text.startswith(n, i)}
    return greedy(spans, lambda s: (s[0] - s[1], s[0], s[2]))


@pytest.fixture(scope="module")
def signs(spark):
    rng = random.Random(5)
    word = lambda low, high, letters="abc湯屋": "".join(rng.choice(letters) for _ in range(rng.randint(low, high)))
    pool = [(word(1, 5), rng.choice(["ja", "de"]), None, i) for i in range(25)] + [("Bar", "de", "project", 25), ("ab", "de", "project", 26), ("ab", "de", None, 27)]
    texts = [(i, word(0, 12) if i % 9 else word(2, 4) + " " + word(2, 4), rng.choice(["ja", "de", None, ""]), rng.choice([None, 0.1, 0.6, 0.9])) for i in range(150)]
    texts += [(150, None, "de", 0.1), (151, "", None, None), (152, "abcab" * 40, "de", 0.1), (153, pool[0][0], pool[0][1], 0.2)]
    return texts, pool, spark.createDataFrame(texts, TEXTS), spark.createDataFrame(pool, POOL)


def spans_of(df):
    return {r["id"]: [tuple(s) for s in r["spans"]] for r in df.collect()}


@pytest.mark.parametrize("equal_length", [False, True])
def test_aligned_spans(signs, equal_length):
    texts, pool, df, names = signs
    want = {i: s for i, t, lang, _ in texts if (s := plain_aligned(t, lang, pool, equal_length))}
    assert want and spans_of(gazetteer.aligned_spans(df, names, equal_length)) == want
    assert spans_of(gazetteer.aligned_spans(df, names.limit(0))) == {}


def test_verbatim_spans(signs):
    texts, pool, df, names = signs
    want = {i: s for i, t, lang, _ in texts if (s := plain_verbatim(t, lang, pool))}
    assert want and spans_of(gazetteer.verbatim_spans(df, names)) == want


@pytest.mark.parametrize("sent", [1 << 20, 0])
def test_verbatim_spans_meet_names_without_gathering_texts(spark, monkeypatch, sent):
    # the names come from a table like the texts' own, so that the planner takes the texts' pairs for no larger
    monkeypatch.setattr(matching, "SENT_BYTES", sent)
    at = F.col("id").cast("string")
    texts = spark.range(300).select("id", F.concat(F.lit("redbolt"), at).alias("text"), F.lit("en").alias("lang"))
    pool = spark.range(300).select(F.concat(F.lit("bolt"), at).alias("candidate"), F.lit("en").alias("lang"), F.lit("a scope").alias("scope"), F.lit(0).alias("rank"))
    got = gazetteer.verbatim_spans(texts, pool)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "BuildLeft" not in plan and ("BuildRight" in plan) == (sent > 0)
    assert spans_of(got) == {i: [(3, 7 + len(str(i)), f"bolt{i}", 1.0, 0)] for i in range(300)}
    assert spans_of(gazetteer.verbatim_spans(texts, pool.limit(0))) == {}


def test_whole_names(signs):
    texts, pool, df, names = signs
    want = {}
    for i, t, lang, conf in texts:
        best = None
        for name, of, scope, rank in pool:
            if not t or (conf or 0) >= 0.6 or lang and of != lang or len(name) < (2 if scope else 3):
                continue
            got = (-ratio(t, name), rank, name)
            if -got[0] >= 0.5:
                best = min(best or got, got)
        if best:
            want[i] = (best[2], -best[0])
    assert want and {r["id"]: (r["candidate"], r["similarity"]) for r in gazetteer.whole_names(df, names).collect()} == want


def test_accent_proposals(spark):
    forms = spark.createDataFrame([("fr", "cafe", "café"), ("fr", "cote", "côte"), ("fr", "cote", "côté"), ("de", "munchen", "münchen"), ("fr", "noel", "noël")], "lang string, folded string, canonical string")
    texts = [(1, "le cafe  NOEL", "fr"), (2, "cote", "fr"), (3, "munchen", "fr"), (4, "café", "fr"), (5, None, "fr"), (6, "", None), (7, "cafe", None)]
    got = gazetteer.accent_proposals(spark.createDataFrame(texts, "id int, text string, lang string"), forms).collect()
    assert sorted((r["id"], r["start"], r["token"], r["canonical"], [tuple(p) for p in r["positions"]]) for r in got) == [
        (1, 3, "cafe", "café", [(6, "́")]), (1, 9, "NOEL", "noël", [(11, "̈")])]


def test_recall(spark):
    regions = spark.createDataFrame([("a", "St0p here", False), ("b", "St0p hero", False), ("c", "Stop there now", True), ("d", "quite other", False), ("e", "EXIT", False), ("f", None, None)], "region_id string, text string, dnt boolean")
    kept = spark.createDataFrame([(1, "st0p HERE", "Stop here", 1), (2, "exit", "EXIT ", 2), (3, "EXIT!", "Exit!", 1)], "memory_id int, text string, corrected string, recency int")
    got = gazetteer.recall_corrections(regions, kept).collect()
    # the best hit of "EXIT" proposes what it says already, so that the older record isn't offered either
    assert sorted((r["region_id"], r["corrected"], r["tier"]) for r in got) == [("a", "Stop here", "exact"), ("b", "Stop here", "fuzzy")]


def test_expansion(spark):
    langs = ["de", "de-AT", "EN-us", "uk", "uk-UA", "km", "zh-cn", "zh-TW", "zh", "xx", "", None, "ja"]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(langs)], "i int, l string").orderBy("i")
    assert [r[0] for r in df.select(layout.expansion_factor("l")).collect()] == [1.35, 1.35, 1.0, 1.15, 1.15, 1.2, 0.6, 0.6, 1.0, 1.0, 1.0, 1.0, 0.6]
    cases = [("word", None, 40, 20, None, "en", "de"), ("word", None, 20, 20, None, "en", "de"), ("word", "longer word", 40, 20, 0.0, "en", "de"), ("word", None, 28, 20, None, None, "en"), ("", "x", 9, 9, None, "en", "de"), (None, "x", 9, 9, None, "en", "de"), ("word", "x", 0, 9, None, "en", "de"), ("word", "", 40, 20, 10.0, "de", "en")]
    df = spark.createDataFrame([(i, *c) for i, c in enumerate(cases)], "i int, s string, t string, w int, h int, p double, a string, b string").orderBy("i")
    got = [r[0] and tuple(r[0]) for r in df.select(layout.expansion_fit("s", "t", "w", "h", "p", "a", "b")).collect()]
    assert got == [(1.013, None), (2.025, "error"), (2.063, "warning"), (1.071, "warning"), None, None, None, (0.37, None)]


REGIONS = "asset int, text string, x int, h int, image_width int, image_height int, excluded boolean"


def test_layout(spark):
    rows = [(1, "EXIT", 0, 40, 100, 300, False), (2, "Net 5 kg", 0, 30, 200, 300, False), (2, "Price €7", 30, 10, 200, 300, False), (2, "a b", 90, 10, 200, 300, None)]
    rows += [(3, "File", 0, 10, 100, 1000, False), (3, "Edit", 0, 10, 100, 1000, False), (3, "View", 0, 10, 100, 1000, False), (3, "Help", 0, 10, 100, 1000, False)]
    rows += [(4, " ", 0, 9, 9, 9, False), (4, "x", 0, 9, 9, 9, True), (5, None, 0, 0, None, None, None), (6, "Big words on a very long line of a poster", 0, 50, None, None, False)]
    got = {r["asset"]: r for r in layout.layout_class(spark.createDataFrame(rows, REGIONS)).collect()}
    assert {k: (r["asset_class"], r["regions"], r["quantities"]) for k, r in got.items()} == {1: ("billboard", 1, 0), 2: ("product_label", 3, 2), 3: ("ui_graphic", 4, 0), 6: ("sign", 1, 0)}
    assert got[1]["scores"] == {"billboard": 0.85, "poster": 0.2, "product_label": 0.1, "sign": 0.8, "ui_graphic": 0.25} and got[1]["confidence"] == 0.575
    assert (got[3]["grid"], got[3]["median_words"], got[2]["hierarchy"], got[6]["height_share"]) == (0.75, 1, 3.0, 0.0)


def test_margins(spark, monkeypatch):
    rng = random.Random(2)
    pairs = [(m, int(rng.random() < 1 / (1 + math.exp(-2 * m)))) for m in (round(rng.uniform(-3, 3), 1) for _ in range(200))]
    slope, level = 1.0, 0.0
    for _ in range(2000):
        errors = [1 / (1 + math.exp(-(slope * m + level))) - o for m, o in pairs]
        slope, level = slope - 0.1 * sum(e * m for e, (m, _) in zip(errors, pairs)) / 200, level - 0.1 * sum(errors) / 200
    df = spark.createDataFrame([*pairs, (None, 1), (1.0, None)], "margin double, outcome int")
    got = metrics.fit_margin(df).first()
    assert (got["slope"], got["intercept"]) == pytest.approx((slope, level), abs=1e-7) and (got["samples"], got["fitted"]) == (200, True)
    monkeypatch.setattr(metrics, "STEPS", 5)
    few = metrics.fit_margin(df).first()
    monkeypatch.setattr(metrics, "HELD", 0)
    assert tuple(metrics.fit_margin(df).first()) == pytest.approx(tuple(few), abs=1e-7)
    assert tuple(metrics.fit_margin(df.limit(0)).first()) == (1.0, 0.0, 0, 0, False) == (*tuple(metrics.fit_margin(df.limit(20)).first())[:2], 0, 0, False)


def test_harmonise(spark):
    quad = "array<struct<x: double, y: double>>"
    square, tilted = [(0.0, 0.0), (4.0, 0.0), (4.0, 2.0), (0.0, 2.0)], [(2.0, 0.0), (4.0, 1.0), (2.0, 2.0), (0.0, 1.0)]
    df = spark.createDataFrame([(0, tilted, square), (1, tilted, tilted)], f"i int, c {quad}, t {quad}").orderBy("i")
    got = [[tuple(p) for p in r[0]] for r in df.select(geo.harmonise("c", "t")).collect()]
    assert got == [square, tilted]


def test_memory_pairs(spark):
    plates = spark.createDataFrame([(1, "u", 0, "a", "b", "fr"), (1, None, 7, "a", "c", "fr"), (1, "v", 1, "a", None, "fr"), (1, "w", 2, "", "d", "fr")], "asset int, uid string, plate int, source string, target string, lang string")
    regions = spark.createDataFrame([(1, "r1", " s ", "t", "fr", False), (1, "r2", "s", " ", "fr", False), (1, "r3", "s", "t", "fr", True), (1, "r4", "s", "t", "fr", None)], "asset int, region_id string, source string, target string, lang string, dnt boolean")
    pairs = lambda profile: sorted(tuple(r)[1:4] for r in interchange.memory_pairs(plates, regions, profile).collect())
    own, single = [("7", "a", "c"), ("u", "a", "b")], [("r1", "s", "t"), ("r4", "s", "t")]
    assert (pairs("semantic"), pairs("atomic"), pairs("both")) == (own, single, sorted(own + single))
    with pytest.raises(ValueError):
        interchange.memory_pairs(plates, regions, "all")


def test_composition(spark):
    frames = spark.createDataFrame([("j", "t", i) for i in range(6)] + [("j", "u", 2)], "job string, track string, frame int")
    tracks = spark.createDataFrame([("j", "t", "sign")], "job string, track string, label string")
    keys = spark.createDataFrame([("j", "t", 1, 10.0), ("j", "t", 4, 40.0)], "job string, track string, frame int, value double")
    got = layout.composition(tracks, frames, keys, 2, 5).orderBy("track", "frame").collect()
    assert [(r["track"], r["frame"], r["label"], r["key_before"], r["key_after"], r["value"]) for r in got] == [
        ("t", 2, "sign", 1, 4, 20.0), ("t", 3, "sign", 1, 4, 30.0), ("t", 4, "sign", 4, 4, 40.0), ("t", 5, "sign", 4, None, 40.0), ("u", 2, None, None, None, None)]


def test_queries_find_something(spark):
    from lumenframe.plans import queries

    for name in ("aligned_spans", "whole_names", "recalled_corrections"):
        assert queries.QUERIES[name](spark, "/root/testdata/sf0.001").where(F.lit(True)).limit(1).count() == 1
