"""Further queries over the driver tables: known names in texts, layout classes, widths, calibrated margins, compositions."""

from __future__ import annotations

from pyspark.sql import functions as F

from lumenframe.functions import geometry as geo
from lumenframe.operators import gazetteer, layout, metrics
from lumenframe.plans.queries import interchange_rows, query
from lumenframe.plans.relations import BOXES, FRAMES, boxes, observations, table
from lumenframe.sources import interchange


def signs(spark, sf_dir, joint: str = ""):
    """Parts as composite signs: id, the two words of the name, the type, and all of them as one text."""
    p = table(spark, sf_dir, "part")
    word = lambda i: F.split_part("p_name", F.lit(" "), F.lit(i))
    return p.select(F.col("p_partkey").alias("id"), word(1).alias("one"), word(2).alias("two"), "p_type", F.concat_ws(joint, word(1), word(2), "p_type").alias("text"), F.lit("en").alias("lang"))


def names(rows):
    """The signs' words as a pool in alphabetical order, which the names themselves stand for."""
    said = rows.select(F.explode(F.array("one", "two", "p_type")).alias("candidate")).distinct()
    return said.select("candidate", F.lit("en").alias("lang"), F.lit(None).cast("string").alias("scope"), F.lit(0).alias("rank"))


@query("""SELECT p_partkey AS id, '0:' || split_part(p_name, ' ', 1) || ',' || length(split_part(p_name, ' ', 1)) || ':' || split_part(p_name, ' ', 2) || ',' || (length(p_name) - 1) || ':' || p_type AS spans FROM part""")
def verbatim_spans(spark, sf_dir):
    """The names that composite signs are made of."""
    rows = signs(spark, sf_dir)
    spans = F.transform("spans", lambda s: F.concat_ws(":", s["start"].cast("string"), s["candidate"]))
    return gazetteer.verbatim_spans(rows, names(rows)).select("id", F.array_join(spans, ",").alias("spans"))


@query()
def aligned_spans(spark, sf_dir):
    """Names within signs of which a letter was misread; held against a plain version in tests."""
    rows = signs(spark, sf_dir)
    spans = F.transform("spans", lambda s: F.concat_ws(":", s["start"].cast("string"), s["candidate"], s["n_diffs"].cast("string")))
    return gazetteer.aligned_spans(rows.withColumn("text", F.replace("text", F.lit("e"), F.lit("c"))), names(rows)).select("id", F.array_join(spans, ",").alias("spans"))


@query()
def whole_names(spark, sf_dir):
    """The likest name of signs read without confidence; held against a plain version in tests."""
    rows = signs(spark, sf_dir)
    misread = rows.withColumns({"text": F.concat("two", F.lit("x")), "conf": F.when(F.col("id") % 2 == 0, 0.9).otherwise(0.2)})
    return gazetteer.whole_names(misread, names(rows))


@query("""WITH w AS (SELECT p_partkey AS id, split_part(p_name, ' ', 1) AS a, split_part(p_name, ' ', 2) AS b FROM part), t AS (SELECT id, 0 AS start, a AS token FROM w UNION ALL SELECT id, length(a) + 1, b FROM w)
SELECT id, start, token, translate(token, 'aeiou', 'áéíóú') AS canonical, length(token) - length(translate(token, 'aeiou', '')) AS marks FROM t WHERE token IN (SELECT a FROM w) AND translate(token, 'aeiou', '') <> token""")
def accent_proposals(spark, sf_dir):
    """Words whose stored form has accents."""
    rows = signs(spark, sf_dir, " ")
    forms = rows.select("lang", F.col("one").alias("folded"), F.translate("one", "aeiou", "áéíóú").alias("canonical")).distinct()
    got = gazetteer.accent_proposals(rows.withColumn("text", F.concat_ws(" ", "one", "two")), forms)
    return got.select("id", "start", "token", "canonical", F.size("positions").cast("bigint").alias("marks"))


@query()
def recalled_corrections(spark, sf_dir):
    """Corrections of equal misreadings, else of like ones; held against a plain version in tests."""
    rows = signs(spark, sf_dir, " ")
    regions = rows.where("id % 2 = 1").select(F.col("id").alias("region_id"), "text", (F.col("id") % 7 == 0).alias("dnt"))
    kept = rows.where("id % 2 = 0").select(F.col("id").alias("memory_id"), "text", F.concat("text", F.when(F.col("id") % 4 == 0, "!").otherwise("")).alias("corrected"), F.col("id").alias("recency"))
    return gazetteer.recall_corrections(regions, kept)


@query(f"""WITH {BOXES}, l AS (SELECT *, CASE id % 4 WHEN 0 THEN 'de-DE' WHEN 1 THEN 'ja' WHEN 2 THEN 'uk' ELSE NULL END AS tl, CASE WHEN id % 3 = 0 THEN text || text || text || text END AS target FROM boxes),
f AS (SELECT *, CASE WHEN target IS NOT NULL THEN length(target) * 0.5::DOUBLE * (h * 0.75::DOUBLE) / w ELSE length(text) * 0.5::DOUBLE * (h * 0.75::DOUBLE) * (CASE tl WHEN 'de-DE' THEN 1.35::DOUBLE WHEN 'ja' THEN 0.6::DOUBLE WHEN 'uk' THEN 1.15::DOUBLE ELSE 1.0::DOUBLE END / 1.0::DOUBLE) / w END AS fit FROM l)
SELECT asset, id, CASE WHEN fit > 1.35 AND target IS NULL THEN 'error' WHEN fit > 1.05 THEN 'warning' END AS severity, fit > 0.5 AS filled FROM f""")
def expansion_fit(spark, sf_dir):
    """Whether texts, or their translations to come, fit their boxes."""
    b = boxes(spark, sf_dir)
    n = F.col("id") % 4
    lang = F.when(n == 0, "de-DE").when(n == 1, "ja").when(n == 2, "uk")
    fit = layout.expansion_fit("text", F.when(F.col("id") % 3 == 0, F.repeat("text", 4)), "w", "h", F.lit(None), F.lit("en"), lang)
    return b.withColumn("fit", fit).select("asset", "id", F.col("fit.severity").alias("severity"), (F.col("fit.fit") > 0.5).alias("filled"))


@query("""WITH c AS (SELECT conv_id, (turn * 37) % 120 AS x, 12 + (turn * 7) % 40 AS h, 200 + conv_id % 300 AS ih, trim(CASE turn % 3 WHEN 0 THEN substr(text, 1, 20) || ' 5 kg' WHEN 1 THEN substr(text, 1, 10) ELSE text END, ' ' || chr(10)) AS t FROM conversations WHERE role <> 'system'),
w AS (SELECT *, length(t) - length(regexp_replace(t, '\\S+', '', 'g')) AS chars, len(regexp_extract_all(t, '\\S+')) AS words FROM c WHERE t <> ''),
g AS (SELECT conv_id, count(*) AS n, list_sort(list(words))[count(*) // 2 + 1] AS mw, max(h / ih::DOUBLE) AS hs, max(h) / greatest(1.0::DOUBLE, list_sort(list(h))[count(*) // 2 + 1]) AS hi,
  count(*) FILTER (regexp_matches(t, '\\d\\s*(kg|g|mg|l|ml|cl|oz|lb|cm|mm)\\b', 'i')) AS q, count(*) FILTER (length(t) <= 24 AND words <= 4) / count(*)::DOUBLE AS sr, 1.0::DOUBLE - least(1.0::DOUBLE, count(DISTINCT round(x / 127::DOUBLE * 10)) / count(*)::DOUBLE) AS ga FROM w GROUP BY 1),
s AS (SELECT conv_id, n, mw, q, unnest([{'k': 'billboard', 's': 0.1::DOUBLE + CASE WHEN n <= 2 THEN 0.45::DOUBLE ELSE 0 END + CASE WHEN hs >= 0.1 THEN 0.3::DOUBLE ELSE 0 END}, {'k': 'poster', 's': 0.2::DOUBLE + CASE WHEN n >= 3 THEN 0.3::DOUBLE ELSE 0 END + CASE WHEN hi >= 1.6 THEN 0.25::DOUBLE ELSE 0 END},
  {'k': 'product_label', 's': 0.1::DOUBLE + least(0.6::DOUBLE, q * 0.3::DOUBLE) + CASE WHEN n >= 3 THEN 0.2::DOUBLE ELSE 0 END}, {'k': 'sign', 's': 0.45::DOUBLE + CASE WHEN n <= 2 THEN 0.2::DOUBLE ELSE 0 END + 0.15::DOUBLE * sr}, {'k': 'ui_graphic', 's': 0.1::DOUBLE + CASE WHEN n >= 4 AND mw <= 3 THEN 0.35::DOUBLE ELSE 0 END + 0.25::DOUBLE * ga + 0.15::DOUBLE * sr}]) AS e FROM g),
r AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY e.s DESC, e.k) AS place, lead(e.s) OVER (PARTITION BY conv_id ORDER BY e.s DESC, e.k) AS second FROM s)
SELECT conv_id AS asset, e.k AS asset_class, round(least(0.95::DOUBLE, 0.55::DOUBLE + (e.s - second) * 0.5::DOUBLE) * 1000) / 1000 AS confidence, n AS regions, CAST(mw AS INTEGER) AS median_words, q AS quantities FROM r WHERE place = 1""")
def layout_classes(spark, sf_dir):
    """Conversations as assets, a turn a region."""
    n = F.col("turn") % 3
    said = F.when(n == 0, F.concat(F.substring("text", 1, 20), F.lit(" 5 kg"))).when(n == 1, F.substring("text", 1, 10)).otherwise(F.col("text"))
    rows = table(spark, sf_dir, "conversations").select(
        F.col("conv_id").alias("asset"), said.alias("text"), ((F.col("turn") * 37) % 120).alias("x"), (12 + (F.col("turn") * 7) % 40).alias("h"),
        F.lit(127).alias("image_width"), (200 + F.col("conv_id") % 300).alias("image_height"), (F.col("role") == "system").alias("excluded"),
    )
    return layout.layout_class(rows).select("asset", "asset_class", "confidence", "regions", "median_words", "quantities")


@query()
def margin_calibration(spark, sf_dir):
    """Slope and intercept that make margins probabilities; held against a plain version in tests."""
    l = table(spark, sf_dir, "lineitem")  # noqa: E741
    return metrics.fit_margin(l.select((F.col("l_quantity") / 10 - 2.5).alias("margin"), (F.col("l_quantity") + F.col("l_linenumber") * 6 > 45).cast("int").alias("outcome")))


@query(f"""WITH {FRAMES}, t AS (SELECT track, min(frame) AS born, max(frame) AS died FROM frames GROUP BY 1),
b AS (SELECT *, max(CASE WHEN text = 'purchase' THEN frame END) OVER (PARTITION BY track ORDER BY frame) AS key_before, min(CASE WHEN text = 'purchase' THEN frame END) OVER (PARTITION BY track ORDER BY frame DESC) AS key_after FROM frames)
SELECT b.track, frame, born, died, key_before, key_after FROM b JOIN t ON b.track = t.track WHERE frame BETWEEN 5 AND 40""")
def composition(spark, sf_dir):
    """Frames 5 to 40 of each track, with its life and the purchases about each frame."""
    o = observations(spark, sf_dir)
    lives = o.groupBy("track").agg(F.min("frame").alias("born"), F.max("frame").alias("died"))
    got = layout.composition(lives, o.select("track", "frame"), o.where("text = 'purchase'").select("track", "frame", "value"), 5, 40, on=("track",))
    return got.select("track", "frame", "born", "died", "key_before", "key_after")


@query("""SELECT conv_id AS asset, 'r' || turn AS region_id, trim(text) AS source, '<fr> ' || text AS target FROM conversations WHERE turn % 2 = 0 AND role <> 'system' AND trim(text) <> ''
UNION ALL SELECT conv_id, 'p' || turn, text, 'plate ' || turn FROM conversations WHERE turn % 2 = 1""")
def memory_profiles(spark, sf_dir):
    """Translation-memory pairs of plates and of single regions."""
    rows = interchange_rows(spark, sf_dir)
    turn = F.substring("region_id", 2, 9)
    plates = rows.select("asset", F.concat(F.lit("p"), turn).alias("uid"), F.lit(0).alias("plate"), "source", F.when(turn.cast("int") % 2 == 1, F.concat(F.lit("plate "), turn)).otherwise(F.lit(" ")).alias("target"), "lang")
    return interchange.memory_pairs(plates, rows, "both").select("asset", "region_id", "source", "target")


@query(f"""WITH {BOXES} SELECT asset, id, CASE WHEN id % 2 = 0 THEN w * h::DOUBLE ELSE w * h / 2::DOUBLE END AS area FROM boxes""")
def harmonised(spark, sf_dir):
    """Areas of tilted quads held against upright truths (as their boxes) or against tilted ones (as they are)."""
    point = lambda x, y: F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))
    x, y, w, h = (F.col(c) for c in "xywh")
    tilted = F.array(point(x + w / 2, y), point(x + w, y + h / 2), point(x + w / 2, y + h), point(x, y + h / 2))
    upright = F.array(point(x, y), point(x + w, y), point(x + w, y + h), point(x, y + h))
    truth = F.when(F.col("id") % 2 == 0, upright).otherwise(tilted)
    return boxes(spark, sf_dir).select("asset", "id", geo.polygon_area(geo.harmonise(tilted, truth)).alias("area"))
