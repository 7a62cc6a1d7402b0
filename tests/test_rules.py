"""Rules on small fixtures that tell them from their simpler forms, and operators against plain versions."""

import difflib
import hashlib
import json
import os
import random

import pytest
from pyspark.sql import functions as F

from lumenframe.functions import geometry as geo
from lumenframe.functions import text as tx
from lumenframe.operators import evidence, language_model, matching, metrics, review, spatial, store
from lumenframe.sources import interchange
from lumenframe.streaming import events as ev


def of(spark, values, fn, kind="string"):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, c {kind}")
    return [r[0] for r in rows.orderBy("i").select(fn(F.col("c")).alias("r")).collect()]


def test_spacing_at_token_ends_only(spark):
    texts = ["Il est 10:30", "http://x", "Oui!! Non?", "Bon !", "«mot»", "!", None]
    assert of(spark, texts, lambda c: tx.punctuation_spacing(c, F.lit("fr-FR"))) == ["Il est 10:30", "http://x", "Oui !! Non ?", "Bon !", "« mot »", "!", None]
    assert of(spark, texts[:3], lambda c: tx.punctuation_spacing(c, F.lit("fr-CA"))) == texts[:3]
    assert of(spark, texts[:3], lambda c: tx.punctuation_spacing(c, F.lit("de-DE"))) == texts[:3]
    pairs = [("fr", None), ("fr", "fr_CA"), ("fr-BE", "fr-CA"), ("fr", "en-CA"), (None, "fr"), (None, None), ("de", None), ("zh-Hant-TW", None)]
    df = spark.createDataFrame([(i, *p) for i, p in enumerate(pairs)], "i int, a string, b string")
    assert [r[0] for r in df.orderBy("i").select(tx.resolve_locale("a", "b")).collect()] == ["fr-FR", "fr-CA", "fr-BE", "fr-FR", "fr-FR", None, None, "zh-TW"]


def test_look_alikes(spark):
    assert of(spark, ["ЅІЈҮԛԝ", "ВМЕСТЕ", "Valentina", "123", None], tx.skeleton) == ["SIJYqw", "BMECTE", "Valentina", "123", None]
    assert of(spark, ["ЅІЈҮԛԝ", "зл", "1 2", None], tx.twin_share) == [1.0, 0.0, 0.0, 0.0]
    assert of(spark, ["BMЕСТЕ С РОССИЕЙ Za", "BMЕСТЕ", "plain"], tx.restored_cyrillic) == ["ВМЕСТЕ С РОССИЕЙ Za", "BMЕСТЕ", "plain"]


def test_error_rates(spark):
    rows = [("ＡＢＣ", "abc"), ("x", "--"), ("", "abcd"), ("one two", "one three two"), ("東京", "東京都"), ("one two three", "two three")]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, h string, r string").orderBy("i")
    got = [tuple(r) for r in df.select(tx.error_rate("h", "r"), tx.word_error_rate("h", "r")).collect()]
    assert got == [(0.0, 0.0), (None, None), (1.0, 1.0), (pytest.approx(5 / 11, abs=1e-4), pytest.approx(1 / 3, abs=1e-4)), (pytest.approx(1 / 3, abs=1e-4), None), (pytest.approx(3 / 8, abs=1e-4), 0.5)]


def test_identities(spark):
    want = hashlib.sha256("␟".join(("1", "r1␞r2", "é")).encode()).hexdigest()
    assert of(spark, ["é "], lambda c: tx.membership_hash(F.array(F.lit("r1"), F.lit("r2")), c)) == [want]
    key = "|".join(("img", "merged", "production", "1.00,2.67,0.12,5.00", "a,b", ""))
    got = of(spark, [[1.0, 2.675, 0.125, 5.0]], lambda c: tx.candidate_id(F.lit("img"), F.lit("merged"), c, F.array(F.lit("b"), F.lit("a"))), "array<double>")
    assert got == ["merg-" + hashlib.sha1(key.encode()).hexdigest()[:12]]


def test_model_tokens(spark):
    assert of(spark, ["Nos rues! STRAßE a_b l'été", "", None], tx.lm_tokens) == [["nos", "rues", "!", "strasse", "a", "_", "b", "l", "'", "été"], [], []]
    assert of(spark, ["東京 Tower"], lambda c: tx.lm_tokens(c, "cjk")) == [list("東京Tower")]


def test_more_text_forms(spark):
    assert of(spark, ["漢語", "汉语", "汉語", "出口", ""], tx.han_variant) == ["Hant", "Hans", "mixed", "undetermined", "undetermined"]
    assert of(spark, [["Rue des", " ", "VIEUX"], ["東京", "都"], ["東京", "Tower"], []], tx.joined_runs, "array<string>") == ["Rue des VIEUX", "東京都", "東京 Tower", ""]
    assert of(spark, ["ＡＢ  c"], lambda c: tx.agreement_form(c, F.lit("en"))) == ["ab c"] and of(spark, ["ＡＢ  c"], lambda c: tx.agreement_form(c, F.lit("zh-CN"))) == ["AB c"]
    assert of(spark, ['{"b": 1, "a": [2]}', "no"], tx.payload_checksum) == ["sha256:" + hashlib.sha256(b'{"a":[2],"b":1}').hexdigest(), None]
    assert of(spark, ["RÉP. 1!"], tx.nfkc_word) == ["RÉP1"]
    steps = "struct<s: array<struct<original_text: string>>, o: string, h: array<struct<text: string>>>"
    rows = [([("first",)], "o", []), ([], "o", [("h",)]), ([], None, [("",), ("h",)]), ([], None, [])]
    assert of(spark, rows, lambda c: tx.earliest_text(c["s"], c["o"], c["h"]), steps) == ["first", "o", "h", None]
    assert of(spark, ["ВМЕСТЕ"], lambda c: tx.pared_ratio(c, F.lit("bmecte"))) == [1.0]
    assert of(spark, ["x"], lambda c: tx.detector_fingerprint(c, F.lit(1))) == [hashlib.sha1(b"x|1").hexdigest()[:10]]


def test_validation(spark):
    rows = [("Pay {n} 10%", "Zahle {n} 10%", 0), ("Pay {n}", "Zahle", 0), ("10 cm", "11 cm", 0), ("word", "", 0), ("word", "WORD ", 0), ("ab", "abcdefgh", 0), ("sun", "mond", 2), (None, None, None)]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, s string, t string, m int").orderBy("i")
    got = [r[0] for r in df.select(tx.validation("s", "t", "m")).collect()]
    assert [[x["code"] for x in g["issues"]] for g in got] == [[], ["placeholder_mismatch"], ["number_mismatch"], ["empty_target", "expansion_risk"], ["source_identical"], ["expansion_risk"], ["glossary_violation"], ["empty_target", "expansion_risk"]]
    assert [g["eligible"] for g in got] == [True, False, False, False, True, True, False, False] and not got[0]["review_required"]


def near(spark, a, b, square=False):
    df = spark.createDataFrame([(*a, *b)], ", ".join(f"{p}_{k} long" for p in "ab" for k in "xywh"))
    return df.select(geo.nearby(geo.Box("a_"), geo.Box("b_"), F.lit(square))).first()[0]


def test_nearby(spark):
    box = (0, 0, 40, 10)
    assert near(spark, box, (60, 2, 40, 10)) and not near(spark, box, (66, 2, 40, 10))  # along a line
    assert near(spark, box, (0, 24, 40, 10)) and not near(spark, box, (0, 30, 40, 10))  # one above the other
    assert not near(spark, box, (45, 18, 40, 10))  # diagonal neighbours
    assert near(spark, box, (100, 0, 40, 30)) and not near(spark, box, (100, 0, 40, 22))  # the larger height counts
    glyph = (0, 0, 20, 20)
    assert near(spark, glyph, (12, 35, 22, 20), True) and not near(spark, (0, 0, 20, 20), (19, 35, 20, 20), True)


def test_triggers(spark):
    cases = [(1, 1, 1, 1, 0.1, 0.9, 1), (0, 1, 1, 1, 0.1, 0.9, 1), (0, 0, 1, 1, 0.1, 0.9, 1), (0, 0, 0, 1, 0.1, 0.9, 1), (0, 0, 0, 0, 0.1, 0.9, 1), (0, 0, 0, 0, 0.55, 0.9, 1), (0, 0, 0, 0, 0.9, 0.35, 1), (0, 0, 0, 0, 0.9, 0.1, 0), (None,) * 7]
    df = spark.createDataFrame([(i, *(None if v is None else bool(v) if k in (0, 1, 2, 3, 6) else float(v) for k, v in enumerate(c))) for i, c in enumerate(cases)], "i int, f boolean, c boolean, b boolean, r boolean, conf double, ch double, k boolean").orderBy("i")
    got = [r[0] for r in df.select(evidence.trigger("f", "c", "b", "r", "conf", "ch", "k")).collect()]
    assert got == ["forced", "scene_cut", "track_birth", "occlusion_recovery", "confidence_decay", "visual_change", "keyframe", None, None]


CANDIDATE = "struct<engine: string, key: string, raw: double, script: string, languages: array<string>, risk_flags: array<string>>"


def test_arbitration(spark):
    primary = ("easyocr", "abc", 0.4, "Latn", ["en"], [])
    other = lambda **kw: tuple({"engine": "PaddleOCR", "key": "abd", "raw": 0.95, "script": "Latn", "languages": ["en"], "risk_flags": [], **kw}.values())
    cases = [
        (other(key=""), 1.0, 1.0, "reject", "alternate_empty"), (other(engine="EasyOCR"), 1.0, 1.0, "reject", "same_backend"), (other(engine="x"), 1.0, 1.0, "review", "uncalibrated_engine"),
        (other(key="abc"), 0.0, 0.0, "agree", "consensus_text"), (other(risk_flags=["r"]), 1.0, 1.0, "reject", "risky_alternate"),
        (other(script="Cyrl", languages=["de"]), 1.0, 1.0, "reject", "script_incompatible,language_incompatible"), (other(script=None, languages=[]), 1.0, 1.0, "accept", "alternate_accepted"),
        (other(raw=0.5), 0.5, 0.6, "review", "insufficient_ink_support,insufficient_geometry_support,below_absolute_floor,insufficient_calibrated_margin,conflicting_text"), (other(), 0.55, 0.65, "accept", "alternate_accepted"),
    ]
    df = spark.createDataFrame([(i, primary, c, ink, g) for i, (c, ink, g, _, _) in enumerate(cases)], f"i int, p {CANDIDATE}, a {CANDIDATE}, ink double, g double").orderBy("i")
    got = [r[0] for r in df.select(evidence.arbitrate("p", "a", "ink", "g")).collect()]
    assert [(g["decision"], ",".join(g["reasons"])) for g in got] == [c[3:] for c in cases]
    assert got[6]["selected"] == "alternate" and got[3]["selected"] == "primary"
    forced = df.where("i = 5").select(evidence.arbitrate("p", "a", "ink", "g", F.lit(True), F.lit(True))).first()[0]
    assert forced["decision"] == "accept"


def test_survival(spark):
    cases = [
        (0.05, 30.0, "t", None, 0.9, "absent"), (0.15, 30.0, "t", None, 0.9, "weak"), (None, 30.0, " ", None, 0.9, "absent"), (0.5, 30.0, "", None, 0.9, "weak"), (0.5, 11.0, "t", None, 0.9, "weak"), (0.5, 12.0, "t", None, 0.9, "present"),
        (0.5, 30.0, "t", "unresolvable", 0.9, "weak"), (0.5, 30.0, "t", "review_required", 0.9, "partial"), (0.5, 30.0, "t", None, 0.2, "partial"), (None, None, "t", None, None, "unknown"),
    ]
    df = spark.createDataFrame([(i, *c[:5]) for i, c in enumerate(cases)], "i int, peak double, h double, text string, state string, conf double").orderBy("i")
    got = [r[0] for r in df.select(evidence.survival("peak", "h", "text", "state", "conf")).collect()]
    assert [g["state"] for g in got] == [c[5] for c in cases] and got[5]["reasons"] == [] and got[4]["reasons"] == ["glyph_height_below_legible"]


def test_hypothesis(spark):
    rows = [(1, 1, "easyocr", "ab", "ab", 0.9, 0, 0, 10, 10, "en", "Latn", None), (1, 2, "paddleocr", "ab", "ab", 1.0, 0, 0, 10, 10, "en", "Latn", None), (1, 3, "x", "zz", "zz", 1.0, 0, 0, 9, 9, "de", None, "lost"), (2, 4, "x", "q", "q", 0.4, 0, 0, 5, 5, None, None, None), (3, 5, "x", "q", "q", 0.4, 0, 0, 5, 5, None, None, "lost")]
    df = spark.createDataFrame(rows, "asset long, id long, backend string, text string, key string, raw double, x long, y long, w long, h long, language string, script string, error string")
    got = {r["asset"]: r for r in evidence.hypothesis_scores(df, "asset").collect()}
    assert got[1]["selected_id"] == 2 and got[1]["reasons"] == ["cross_backend_consensus", "text_stable", "geometry_aligned"]
    assert got[1]["score"] == pytest.approx(0.30 * 0.5 + 0.20 * 0.97 + 0.20 + 0.15 + 0.10 + 0.05, abs=1e-4)
    assert got[2]["reasons"] == ["single_observation"] and got[2]["confidence"] == 0.4 and got[2]["geometry"] == 0.5
    assert got[3]["reasons"] == ["all_errored"] and got[3]["score"] == 0 and got[3]["selected_id"] is None


BOX = "asset long, id long, x long, y long, w long, h long, rtl boolean"


def plain_bands(items, share, grow):
    """(centre, size) in order; the band of each, begun bands first come first served."""
    sizes = sorted(s for _, s in items)
    slack, begun, out = max(4.0, sizes[len(sizes) // 2] * share), [], []
    for c, s in items:
        for b in begun:
            if abs(c - b["c"]) <= (max(slack, b["s"] * share) if grow else slack):
                b["n"] += 1
                b["c"] += (c - b["c"]) / b["n"]
                b["s"] += (s - b["s"]) / b["n"]
                break
        else:
            b = {"c": c, "s": s, "n": 1}
            begun.append(b)
        out.append(b)
    order = sorted(begun, key=lambda b: b["c"])
    return [next(k for k, x in enumerate(order) if x is b) for b in out]


def test_reading_orders(spark):
    rng = random.Random(3)
    rows = [(a, i, rng.randrange(300), rng.randrange(120), rng.randrange(4, 60), rng.randrange(6, 40), a % 2 == 0) for a in range(30) for i in range(rng.randrange(1, 14))]
    df = spark.createDataFrame(rows, BOX).repartition(4)
    for fn, which in ((spatial.reading_lines, "lines"), (spatial.visual_order, "visual"), (spatial.column_order, "columns")):
        got = {}
        for r in fn(df).collect():
            got.setdefault(r["asset"], {})[r["reading_order"]] = r["id"]
        for a in range(30):
            own = sorted((r for r in rows if r[0] == a), key=lambda r: r[1])
            if which == "columns":
                own.sort(key=lambda r: (-(r[2] + r[4] / 2), r[3]))
                band = plain_bands([(-(r[2] + r[4] / 2), r[4]) for r in own], 0.6, False)
                want = [r[1] for r, _ in sorted(zip(own, band), key=lambda p: (p[1], p[0][3]))]
            else:
                flat = [r for r in own if which == "visual" or r[4] >= r[5] * 0.55]
                tall = sorted((r for r in own if r not in flat), key=lambda r: (r[2], r[3]))
                flat.sort(key=lambda r: (r[3] + r[5] / 2, r[2]))
                band = plain_bands([(r[3] + r[5] / 2, r[5]) for r in flat], 0.42, True) if flat else []
                way = -1 if which == "visual" and a % 2 == 0 else 1
                key = (lambda p: (p[1], way * p[0][2])) if which == "visual" else (lambda p: (p[1], p[0][2], p[0][3]))
                want = [r[1] for r, _ in sorted(zip(flat, band), key=key)] + [r[1] for r in tall]
            assert [got[a][k] for k in sorted(got[a])] == want, (which, a)
    lines = spark.createDataFrame([(1, 1, 50, 0, 20, 10, False), (1, 2, 0, 4, 20, 10, False), (1, 3, 0, 8, 20, 10, False)], BOX)
    assert {r["id"]: r["line"] for r in spatial.fragment_order(lines).collect()} == {1: 0, 2: 0, 3: 1}


def test_greedy_passes(spark):
    rng = random.Random(4)
    rows = [(a, i, rng.randrange(60), rng.randrange(60), rng.randrange(5, 40), rng.randrange(5, 40), rng.random()) for a in range(40) for i in range(rng.randrange(12))]
    df = spark.createDataFrame(rows, "asset long, id long, x long, y long, w long, h long, conf double").repartition(3)
    want = set()
    for a in range(40):
        held = []
        for r in sorted((r for r in rows if r[0] == a), key=lambda r: (-r[6], r[1])):
            over = lambda s: max(0, min(r[2] + r[4], s[2] + s[4]) - max(r[2], s[2])) * max(0, min(r[3] + r[5], s[3] + s[5]) - max(r[3], s[3]))  # noqa: B023, E731
            if all(over(s) <= 0.5 * min(r[4] * r[5], s[4] * s[5]) for s in held):
                held.append(r)
        want |= {(r[0], r[1]) for r in held}
    assert {(r["asset"], r["id"]) for r in spatial.suppress(df).collect()} == want
    pairs = spatial.greedy_match(df.where("id % 2 = 0"), df.where("id % 2 = 1"), 0.2).collect()
    assert len({(r["asset"], r["a_id"]) for r in pairs}) == len({(r["asset"], r["b_id"]) for r in pairs}) == len(pairs)


def test_concordance_counts_pairs(spark):
    rng = random.Random(6)
    rows = [(g, i, rng.randrange(6), rng.randrange(6)) for g in range(20) for i in range(rng.randrange(15))]
    got = {r["g"]: (r["n_pairs"], r["n_kept"]) for r in metrics.concordance(spark.createDataFrame(rows, "g int, i int, a int, b int"), "g", "i", "a", "b").collect()}
    for g in range(20):
        own = [r for r in rows if r[0] == g]
        pairs = [(p, q) for k, p in enumerate(own) for q in own[:k] if p[2] != q[2]]
        kept = sum((p[2] - q[2]) * (p[3] - q[3]) > 0 for p, q in pairs)
        assert got.get(g, (0, 0)) == (len(pairs), kept)


def test_fuzzy_loses_no_pair(spark):
    rng = random.Random(8)
    made = lambda: "".join(rng.choice("abcde") for _ in range(rng.randrange(1, 25)))

    def changed(s):
        out = list(s)
        for _ in range(rng.randrange(4)):
            k = rng.randrange(len(out) + 1)
            out[k : k + rng.randrange(2)] = [rng.choice("abcdef")] * rng.randrange(2)
        return "".join(out)

    left = sorted({made() for _ in range(150)} | {"a", "aaaa", "ab"})
    right = sorted({x for s in left for x in (changed(s), changed(s))} - {""} | {made() for _ in range(50)})
    want = {(a, b) for a in left for b in right if difflib.SequenceMatcher(None, a, b).ratio() >= 0.85}
    pairs = matching.fuzzy_candidates(spark.createDataFrame([(s,) for s in left], "ak string"), spark.createDataFrame([(s,) for s in right], "bk string"), 0.85)
    got = {(r["ak"], r["bk"]) for r in pairs.collect()}
    assert want and want <= got and len(got) < len(left) * len(right)


def test_hamming_loses_no_pair(spark):
    rng = random.Random(9)
    base = [rng.getrandbits(64) for _ in range(60)]
    near_ = [x ^ sum(1 << k for k in rng.sample(range(64), rng.randrange(9))) for x in base]
    df = lambda xs: spark.createDataFrame([(i, x >> 32, x & 0xFFFFFFFF) for i, x in enumerate(xs)], "id long, hi long, lo long")
    got = [(r["a_id"], r["b_id"], r["distance"]) for r in matching.hamming_pairs(df(base), df(near_), 7).collect()]
    want = [(i, j, (a ^ b).bit_count()) for i, a in enumerate(base) for j, b in enumerate(near_) if (a ^ b).bit_count() <= 7]
    assert sorted(got) == sorted(want) and want


def test_binomial():
    from math import comb

    for k, n in ((0, 0), (0, 5), (3, 10), (5, 10), (7, 10), (40, 100), (2, 69)):
        low = min(k, n - k)
        want = min(1.0, sum(comb(n, i) for i in range(n + 1) if comb(n, i) <= comb(n, low)) / 2**n)
        assert metrics.binomial_p(k, n) == pytest.approx(want, rel=1e-9)
    assert 0 < metrics.binomial_p(499_900_000, 1_000_000_000) < 1e-9


def test_bootstrap_interval_holds_the_mean(spark):
    rng = random.Random(1)
    values = [(i, rng.gauss(10, 3)) for i in range(2000)]
    low, high = metrics.bootstrap_mean(spark.createDataFrame(values, "id long, v double").repartition(3), "v", "id", 500).first()
    mean = sum(v for _, v in values) / len(values)
    assert low < mean < high and 0.8 * 3.92 * 3 / 2000**0.5 < high - low < 1.2 * 3.92 * 3 / 2000**0.5


def test_model_scores_by_counts(spark):
    docs = spark.createDataFrame([(1, "a b a b c"), (2, "a b"), (3, "c a !")], "doc_id long, text string")
    counted = language_model.document_counts(docs)
    unigrams, bigrams = language_model.counts(counted)
    got = {r["doc_id"]: r["n_tokens"] for r in language_model.score(counted, unigrams, bigrams).collect()}
    assert got == {1: 5, 2: 2, 3: 3}
    assert {(r["token"], r["n"], r["contexts"]) for r in unigrams.collect()} == {("a", 4, 3), ("b", 3, 1), ("c", 2, 2), ("!", 1, 1)}


def test_rewrite_policies(spark):
    lists = spark.createDataFrame([(1, ["r3", "r9", "r1"]), (2, []), (3, None)], "asset long, ids array<string>")
    names = spark.createDataFrame([(1, "r3", "r1"), (1, "r1", "r2"), (2, "r9", "r5")], "asset long, old_id string, new_id string")
    of_policy = lambda p: {r["asset"]: r["ids"] for r in store.rewrite_ids(lists, names, ["asset"], p).collect()}
    assert of_policy("drop") == {1: ["r1", "r2"], 2: [], 3: []} and of_policy("keep")[1] == ["r1", "r9", "r2"]
    with pytest.raises(Exception, match="no region for id r9"):
        of_policy("error")


def test_symbol_noise_and_scene(spark):
    rows = [("", 0.9, 50, 50, True), ("~", 0.3, 50, 50, True), ("~", 0.9, 10, 10, True), ("~", 0.9, 50, 50, False), ("7", 0.1, 2, 2, False), ("é", 0.1, 2, 2, False)]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, t string, c double, w long, h long, want boolean").orderBy("i")
    assert [r[0] for r in df.select(review.symbol_noise("t", "c", "w", "h") == F.col("want")).collect()] == [True] * len(rows)
    assert not df.where("i = 2").select(review.symbol_noise("t", "c", "w", "h", F.lit(True))).first()[0]


# Files

TMX = """<?xml version="1.0"?><!DOCTYPE tmx SYSTEM "tmx14.dtd"><tmx version="1.4"><header/><body><tu tuid="1"><tuv xml:lang="en"><seg>a</seg></tuv><tuv xml:lang="fr"><seg>b</seg></tuv></tu></body></tmx>"""


def test_readers(spark, tmp_path):
    assert interchange.tmx_rows(TMX) == [("1", "a", "b", "fr")]
    with pytest.raises(ValueError, match="entities"):
        interchange.tmx_rows(TMX.replace('SYSTEM "tmx14.dtd"', '[<!ENTITY x "y">]'))
    assert interchange.xliff_rows('<file target-language="de"><trans-unit id="1"><source>a</source><target>b</target></trans-unit></file>') == [("1", "a", "b", "de")]
    assert interchange.tbx_rows('<tbx><termEntry id="e"><langSet lang="en"><term>a</term></langSet><langSet lang="fr"><term>b</term></langSet></termEntry></tbx>') == [("e", "a", "b", "fr")]
    files = [("a.tmx", TMX), ("b.tsv", "id\tsource\tTarget\n1\ts\tt\n2\tshort"), ("c.csv", 'id,source,target\n1,"s, s","say ""t"""\n'), ("d.txt", "[1] one\nno id\n[2]two"), ("e.xlf", "<broken"), ("f.bin", "[9] x")]
    got = {}
    for r in interchange.import_files(spark.createDataFrame(files, "path string, document string")).collect():
        got.setdefault(r["path"], []).append((r["unit_id"], r["source"], r["target"]) if r["error"] is None else "error")
    assert got == {"a.tmx": [("1", "a", "b")], "b.tsv": [("1", "s", "t")], "c.csv": [("1", "s, s", 'say "t"')], "d.txt": [("1", "", "one"), ("2", "", "two")], "e.xlf": ["error"], "f.bin": [("9", "", "x")]}
    for name, text, coding in (("a", "é1", "utf-8"), ("b", "é2", "utf-8-sig"), ("c", "é3", "utf-16")):
        (tmp_path / name).write_bytes(text.encode(coding))
    assert sorted(r["document"] for r in interchange.read_files(spark, str(tmp_path)).collect()) == ["é1", "é2", "é3"]
    (tmp_path / "t").mkdir()
    (tmp_path / "t" / "x.tsv").write_text("id\tsource\ttarget\n1\ta\tb\n2\tc\t \n")
    assert [tuple(r) for r in interchange.read_table(spark, str(tmp_path / "t")).collect()] == [("1", "b")]
    lines = spark.createDataFrame([("#UTX",), ("a\tb\tnoun\tx",), ("a\t\tnoun\tx",), ("[r1] hello",)], "value string")
    assert [tuple(r) for r in interchange.read_utx(lines).collect()] == [("a", "b")]
    assert [tuple(r) for r in interchange.read_txt(lines).collect()] == [("r1", "hello")]
    units = spark.createDataFrame([("p", "1", "s", "old", "fr", 0), ("p", "1", "s", "new", "fr", 1), ("p", "1", "s", " ", "fr", 2)], interchange.UNITS)
    assert [tuple(r) for r in interchange.target_map(units).collect()] == [("p", "1", "new")]
    merged = spark.range(1).select(interchange.merge_server_owned(F.lit('{"a":"1","b":"2","c":"3"}'), F.lit('{"a":""}'), ["a", "b"])).first()[0]
    assert merged == {"a": "", "b": "2"}
    heads = spark.createDataFrame([("id,plate_uid ,x\n1",), ("id,uid\nplate_uid",), ('"plate_uid"',)], "d string")
    assert [r[0] for r in heads.select(interchange.is_semantic(F.col("d"))).collect()] == [True, False, True]


def test_writers(spark, tmp_path):
    rows = [(1, "r1", 'say "a", b', "t\nu", "fr", 0, False), (1, "r2", "x", None, "fr", 1, False), (1, "r3", "hidden", "h", "fr", 2, True)]
    df = spark.createDataFrame(rows, "asset long, region_id string, source string, target string, lang string, reading_order int, dnt boolean").withColumns({k: F.lit(i) for i, k in enumerate("xywh")})
    df = df.withColumns({"language": F.lit(None).cast("string"), "detected_language": F.lit("en"), "target_language": F.col("lang")})
    csv = interchange.write_delimited(df).first()["document"]
    assert csv == 'id,source,src_lang,target,tgt_lang,font,bbox\r\nr1,"say ""a"", b",en,"t\nu",fr,,"0,1,2,3"\r\nr2,x,en,,fr,,"0,1,2,3"\r\n'
    assert interchange.delimited_units(csv, ",") == [("r1", 'say "a", b', "t\nu", "fr"), ("r2", "x", "", "fr")]
    tsv = interchange.write_delimited(df.where("region_id = 'r2'"), "\t").first()["document"]
    assert tsv == "id\tsource\tsrc_lang\ttarget\ttgt_lang\tfont\tbbox\nr2\tx\ten\t\tfr\t\t0,1,2,3"
    interchange.write_tables(df.where("region_id = 'r2'"), str(tmp_path / "tables"))
    assert spark.read.option("sep", "\t").option("header", True).csv(str(tmp_path / "tables")).first()["bbox"] == "0,1,2,3"


def test_resources(spark):
    entries = [{"b": "é", "a": 1}]
    good = {"id": "x", "kind": "k", "locale": "fr", "schema_version": 1, "data_version": "1.0.0", "provenance": {}, "license": "l", "entries": entries}
    good["checksum"] = "sha256:" + hashlib.sha256(json.dumps(entries, ensure_ascii=False, sort_keys=True, separators=(",", ":")).encode()).hexdigest()
    files = [("ok", good), ("sum", {**good, "checksum": "sha256:0"}), ("version", {**good, "data_version": "1"}), ("lost", {k: v for k, v in good.items() if k != "license"}), ("list", [])]
    rows = spark.createDataFrame([(n, json.dumps(d)) for n, d in files] + [("bad", "{")], "path string, document string")
    got = {r["path"]: (r["entry"], r["error"]) for r in interchange.correction_resources(rows).collect()}
    assert got["ok"] == ('{"a": 1, "b": "é"}', None) and got["sum"][1] == "checksum mismatch" and got["lost"][1] == "missing fields: license" and got["list"][1] == "not an object" and got["bad"][1] and "semantic" in got["version"][1]


def test_manifest_guard(spark, tmp_path):
    made = lambda ids, refs: {"asset_id": "m", "instances": [{"id": i, "excluded": i.startswith("x")} for i in ids], "semantic_units": [{"id": "p1", "region_ids": refs}]}
    cases = [(["r1", "r2", "x1"], ["r2", "x1"], []), (["r1", "r3"], [], ["not_contiguous"]), (["r1", "r1"], [], ["not_contiguous", "duplicate_id"]), (["r1"], ["r7"], ["dangling_reference"])]
    for k, (ids, refs, want) in enumerate(cases):
        path = tmp_path / str(k)
        path.mkdir()
        (path / "m.json").write_text(json.dumps(made(ids, refs)))
        rows = interchange.load_manifests(spark, str(path))
        assert rows.select(interchange.manifest_problems(rows)).first()[0] == want
        out = str(tmp_path / f"out{k}")
        if want:
            with pytest.raises(Exception, match="manifest of m"):
                interchange.save_manifests(rows, out)
            interchange.save_manifests(rows, out + "-free", guard=False)
        else:
            interchange.save_manifests(rows, out)
            assert interchange.load_manifests(spark, out).collect() == rows.collect()


# Streams


def stream_of(spark, tmp_path, parts, schema):
    seen = set()
    for k, p in enumerate(parts):
        spark.createDataFrame(p, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        for file in set((tmp_path / "in").glob("*.parquet")) - seen:  # files are taken in order of their times
            os.utime(file, (1_700_000_000 + 100 * k,) * 2)
            seen.add(file)
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))


def test_sessions_and_chunks_of_streams(spark, tmp_path):
    import datetime

    at = lambda m: datetime.datetime(2024, 1, 1) + datetime.timedelta(minutes=m)
    parts = [[(1, at(0)), (1, at(5)), (2, at(3))], [(1, at(40)), (1, at(44))], [(4, at(46))], [(1, at(1)), (3, at(600))]]  # the last brings a row that is too late
    schema = "user long, ts timestamp"
    for name, fn in (("sessions_", lambda d, **k: ev.sessions(d, "user", 900, **k)), ("chunks_", lambda d, **k: ev.chunks(d, "10 minutes", **k))):
        folder = tmp_path / name
        out = fn(stream_of(spark, folder, parts, schema), watermark="10 minutes")
        run = out.writeStream.format("memory").queryName(name).option("checkpointLocation", str(folder / "state")).outputMode("append").trigger(availableNow=True).start()
        run.awaitTermination(120)
        seen = {tuple(r) for r in spark.table(name).collect()}
        batch = {tuple(r) for r in fn(spark.createDataFrame([r for p in parts[:3] for r in p], schema)).collect()}
        assert seen and seen <= batch and len(seen) >= len(batch) - 1


def test_bounded_votes(spark, tmp_path):
    parts = [[(1, f"t{i}", float(i), i) for i in range(10)], [(1, "t9", 5.0, 10), (2, "x", 1.0, 11)]]
    out = ev.bounded_consensus(stream_of(spark, tmp_path, parts, "track long, key string, mass double, seq long"))
    run = out.writeStream.format("memory").queryName("votes").option("checkpointLocation", str(tmp_path / "state")).outputMode("update").trigger(availableNow=True).start()
    run.awaitTermination(120)
    last = {r["track"]: (r["key"], r["share"]) for r in spark.table("votes").collect()}
    assert last[1] == ("t9", pytest.approx(14 / 50)) and last[2] == ("x", 1.0)  # what was evicted stays in the total


def test_chunks_are_committed_once(spark, tmp_path):
    stream = stream_of(spark, tmp_path, [[(1,)], [(2,)], [(3,)]], "v long")
    for _ in range(2):
        ev.commit_chunks(stream, str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination(120)
    assert sorted(r["v"] for r in spark.read.parquet(str(tmp_path / "out")).collect()) == [1, 2, 3]
    tracks = spark.createDataFrame([(1, 1, 0.9, 1.0, False), (2, 3, 0.5, 1.0, False), (3, 3, 0.9, 1.0, False), (4, 1, 0.9, 1.0, True)], "track long, n long, conf double, share double, excluded boolean")
    assert {r["track"]: r["status"] for r in ev.settle(tracks).collect()} == {2: "review", 3: "ok", 4: "excluded"}


@pytest.mark.parametrize("sent", [1 << 20, 0])
def test_glossary_meets_sources_without_gathering_them(spark, monkeypatch, sent):
    # the list comes from a table as large and its rows are wider: the planner takes the exploded sources for the smaller side
    monkeypatch.setattr(matching, "SENT_BYTES", sent, raising=False)
    at = F.col("id")
    rows = spark.range(300).select("id", F.concat(F.lit("Red bolt "), (at % 7).cast("string")).alias("source"), F.when(at % 2 == 0, "ROT und mehr").alias("target"))
    glossary = spark.range(300).where("id < 8").select(F.when(at < 7, F.concat(F.lit("BOLT "), at.cast("string"))).otherwise("x").alias("term"), F.lit("Rot").alias("required"))
    got = matching.glossary_violations(rows, glossary)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "BuildLeft" not in plan and ("BuildRight" in plan) == (sent > 0)
    assert sorted(map(tuple, got.collect())) == [(i, f"BOLT {i % 7}", "Rot") for i in range(1, 300, 2)]
    assert matching.glossary_violations(rows, glossary.limit(0)).collect() == []
