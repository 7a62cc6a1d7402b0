"""Further queries over the driver tables: validation, verdicts, lineage, store changes, glossaries, manifests and files."""

from __future__ import annotations

from pyspark.sql import functions as F

from lumenframe.functions import text as tx
from lumenframe.operators import matching, metrics, review, spatial, store
from lumenframe.plans.queries import interchange_rows, operations, outcomes, query, sign_hashes
from lumenframe.plans.relations import BOXES, PAIRS, boxes, observations, table
from lumenframe.sources import interchange
from lumenframe.streaming import events as ev

# Text


@query("""WITH c AS (SELECT conv_id, turn, text AS s, CASE turn % 5 WHEN 0 THEN '' WHEN 1 THEN text WHEN 2 THEN replace(text, 'a', 'aaaa') || ' {name} 7' WHEN 3 THEN substr(text, 1, 3) ELSE upper(text) || '!' END AS t FROM conversations),
p AS (SELECT *, list_sort(regexp_extract_all(s, '%(?:\\d+\\$)?[a-zA-Z]|\\{[^{}\\s]+\\}|</?[A-Za-z][^>]*>')) <> list_sort(regexp_extract_all(t, '%(?:\\d+\\$)?[a-zA-Z]|\\{[^{}\\s]+\\}|</?[A-Za-z][^>]*>')) AS holders,
  list_sort(list_filter(regexp_split_to_array(regexp_replace(s, '([^0-9A-Za-z_.,%+-])', ' ', 'g'), ' '), lambda x: regexp_full_match(x, '[+-]?[0-9]+([.,][0-9]+)*%?[.,]?'))) <> list_sort(list_filter(regexp_split_to_array(regexp_replace(t, '([^0-9A-Za-z_.,%+-])', ' ', 'g'), ' '), lambda x: regexp_full_match(x, '[+-]?[0-9]+([.,][0-9]+)*%?[.,]?'))) AS digits,
  length(trim(t)) / greatest(1, length(trim(s))) AS ratio FROM c),
i AS (SELECT conv_id, turn, list_filter([CASE WHEN holders THEN 'placeholder_mismatch' END, CASE WHEN digits THEN 'number_mismatch' END, CASE WHEN trim(t) = '' THEN 'empty_target' END, CASE WHEN trim(s) <> '' AND lower(trim(s)) = lower(trim(t)) THEN 'source_identical' END, CASE WHEN ratio > 2.5::DOUBLE OR ratio < 0.25::DOUBLE THEN 'expansion_risk' END], lambda x: x IS NOT NULL) AS issues FROM p)
SELECT conv_id, turn, array_to_string(issues, ',') AS issues, NOT list_has_any(issues, ['placeholder_mismatch', 'number_mismatch', 'empty_target']) AS eligible, len(issues) > 0 AS review_required FROM i""")
def validate_translations(spark, sf_dir):
    """Issues of five kinds of translation of every turn."""
    n = F.col("turn") % 5
    target = F.when(n == 0, "").when(n == 1, F.col("text")).when(n == 2, F.concat(F.replace("text", F.lit("a"), F.lit("aaaa")), F.lit(" {name} 7"))).when(n == 3, F.substring("text", 1, 3)).otherwise(F.concat(F.upper("text"), F.lit("!")))
    v = tx.validation("text", target)
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", v.alias("v"))
    return rows.select("conv_id", "turn", F.array_join(F.transform("v.issues", lambda i: i["code"]), ",").alias("issues"), F.col("v.eligible").alias("eligible"), F.col("v.review_required").alias("review_required"))


@query("""WITH g AS (SELECT DISTINCT p_name AS term, upper(p_type) AS required FROM part WHERE p_partkey % 20 = 0), r AS (SELECT p_partkey AS id, p_name || ' ' || p_type AS source, CASE WHEN p_partkey % 40 = 0 THEN p_type ELSE p_name END AS target FROM part)
SELECT id, term, required FROM r JOIN g ON contains(lower(source), lower(term)) AND NOT contains(lower(target), lower(required))""")
def glossary_misses(spark, sf_dir):
    """Terms of a glossary that a target fails to translate."""
    p = table(spark, sf_dir, "part")
    glossary = p.where("p_partkey % 20 = 0").select(F.col("p_name").alias("term"), F.upper("p_type").alias("required")).distinct()
    target = F.when(F.col("p_partkey") % 40 == 0, F.col("p_type")).otherwise(F.col("p_name"))
    return matching.glossary_violations(p.select(F.col("p_partkey").alias("id"), F.concat_ws(" ", "p_name", "p_type").alias("source"), target.alias("target")), glossary)


@query("""SELECT p_partkey AS id, trim(regexp_replace('  ' || p_name || '   ' || p_type || ' ', '\\s+', ' ', 'g')) AS cell, CASE p_partkey % 3 WHEN 0 THEN 'fr-FR' WHEN 1 THEN 'zh-Hant-TW' ELSE 'de' END AS locale, p_name || ' ' || p_type AS joined, len(string_split(p_type, ' ')) - CASE WHEN contains(' ' || p_name || ' ', ' ' || string_split(p_type, ' ')[1] || ' ') THEN 1 ELSE 0 END AS fewer FROM part""")
def cell_forms(spark, sf_dir):
    """Cleaned cells, locale tags, texts put together, and tokens that another text lacks."""
    p = table(spark, sf_dir, "part")
    n = F.col("p_partkey") % 3
    tag = F.when(n == 0, "FR_fr").when(n == 1, "zh_Hant_tw").otherwise(" de ")
    fewer = F.size(store.token_difference(F.split("p_type", " "), F.slice(F.split("p_type", " "), 1, 0))) - F.when(F.array_contains(F.split("p_name", " "), F.split("p_type", " ")[0]), 1).otherwise(0)
    return p.select(F.col("p_partkey").alias("id"), tx.clean_cell(F.concat(F.lit("  "), "p_name", F.lit("   "), "p_type", F.lit(" "))).alias("cell"), tx.locale_tag(tag).alias("locale"), tx.joined_runs(F.array("p_name", F.lit(" "), "p_type")).alias("joined"), fewer.alias("fewer"))


@query(f"WITH {BOXES} SELECT asset, id, CASE WHEN w > 0 AND h > 0 THEN greatest(w, h) / length(text) END AS density, x AS note_x FROM boxes")
def text_density(spark, sf_dir):
    """Pixels a character, and a box's own note read back."""
    note = tx.box_note(F.concat(F.lit("see BBox : "), F.concat_ws(" , ", "x", "y", "w", "h")))
    return boxes(spark, sf_dir).select("asset", "id", tx.text_density("w", "h", "text").alias("density"), note["x"].cast("bigint").alias("note_x"))


# Verdicts, order and lineage


@query(f"""WITH {BOXES}, {PAIRS}, r AS (SELECT *, row_number() OVER (PARTITION BY asset, a_id ORDER BY inter / (aw * ah) DESC, b_text) AS k FROM pairs WHERE b_backend = 1),
v AS (SELECT b.asset, b.id, b.conf * 10 AS conf, coalesce(r.inter / (r.aw * r.ah), 0) AS cover, r.b_text AS label FROM boxes b LEFT JOIN r ON r.asset = b.asset AND r.a_id = b.id AND k = 1 WHERE b.backend = 0)
SELECT asset, id, round(cover, 3) AS surface_overlap, label AS surface_label, cover <= 0.5::DOUBLE AS outside, cover <= 0.5::DOUBLE AND conf < 0.5::DOUBLE AS would_veto FROM v""")
def scene_verdict(spark, sf_dir):
    """What a scene filter would decide about every box."""
    b = boxes(spark, sf_dir).withColumn("conf", F.col("conf") * 10)
    return review.scene_verdict(b.where("backend = 0"), b.where("backend = 1").withColumn("label", F.col("text")))


@query(f"""WITH {BOXES}, t AS (SELECT asset, id, CASE id % 4 WHEN 0 THEN '' WHEN 1 THEN '~' WHEN 2 THEN '7' ELSE text END AS t, conf * 10 AS c, w * h AS area FROM boxes)
SELECT asset, id, t = '' OR (t = '~' AND (c < 0.4::DOUBLE OR area < 500)) AS noise FROM t""")
def symbol_noise(spark, sf_dir):
    """Readings that are blank or mere symbols."""
    n = F.col("id") % 4
    text = F.when(n == 0, "").when(n == 1, "~").when(n == 2, "7").otherwise(F.col("text"))
    return boxes(spark, sf_dir).select("asset", "id", review.symbol_noise(text, F.col("conf") * 10, "w", "h").alias("noise"))


@query(f"""WITH {BOXES}, r AS (SELECT asset, id, CASE WHEN conf < 0.03::DOUBLE THEN 'fail' WHEN conf < 0.07::DOUBLE THEN 'review' ELSE 'pass' END AS status, CASE WHEN id % 3 <> 0 THEN w END AS score FROM boxes)
SELECT asset, id, row_number() OVER (PARTITION BY asset ORDER BY status, coalesce(score, 101), id) AS place FROM r WHERE status <> 'pass'""")
def review_order(spark, sf_dir):
    """Regions in the order in which a reviewer takes them."""
    status = F.when(F.col("conf") < 0.03, "fail").when(F.col("conf") < 0.07, "review").otherwise("pass")
    rows = boxes(spark, sf_dir).select("asset", "id", status.alias("status"), F.when(F.col("id") % 3 != 0, F.col("w")).alias("score"))
    return review.review_order(rows, "asset").select("asset", "id", "place")


STAGE = "CASE l_returnflag WHEN 'A' THEN 'raw_craft' WHEN 'N' THEN 'merged' ELSE 'final' END"


@query(f"""WITH n AS (SELECT l_orderkey AS asset, {STAGE} AS stage, CASE WHEN l_linestatus = 'F' THEN 'active' ELSE 'pruned' END AS state FROM lineitem WHERE l_orderkey % 5 <> 0), r AS (SELECT o_orderkey AS asset, o_orderstatus = 'F' AS excluded FROM orders WHERE o_orderkey % 3 <> 0),
a AS (SELECT DISTINCT o_orderkey AS asset FROM orders), x AS (SELECT asset, count(*) AS total, count(*) FILTER (NOT excluded) AS active FROM r GROUP BY 1), s AS (SELECT asset, count(*) FILTER (stage = 'raw_craft') AS raw, count(*) FILTER (state <> 'active') AS suppressed FROM n GROUP BY 1)
SELECT a.asset, CASE WHEN coalesce(active, 0) > 0 THEN 'regions_present' WHEN s.asset IS NULL THEN 'no_lineage' WHEN coalesce(total, 0) > 0 THEN 'all_excluded' WHEN raw = 0 THEN 'no_proposals' ELSE 'all_suppressed' END AS rung, coalesce(total, 0) AS total, coalesce(active, 0) AS active, coalesce(raw, 0) AS raw, coalesce(suppressed, 0) AS suppressed
FROM a LEFT JOIN x ON x.asset = a.asset LEFT JOIN s ON s.asset = a.asset""")
def detection_rungs(spark, sf_dir):
    """Why every asset has its regions, or none."""
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("asset"), (F.col("o_orderstatus") == "F").alias("excluded"))
    stage = F.when(F.col("l_returnflag") == "A", "raw_craft").when(F.col("l_returnflag") == "N", "merged").otherwise("final")
    nodes = table(spark, sf_dir, "lineitem").where("l_orderkey % 5 <> 0").select(F.col("l_orderkey").alias("asset"), stage.alias("stage"), F.when(F.col("l_linestatus") == "F", "active").otherwise("pruned").alias("state"))
    return review.detection_rung(o.where("asset % 3 <> 0"), nodes, o)


@query("""WITH RECURSIVE n AS (SELECT p_partkey AS id, CASE p_partkey % 3 WHEN 0 THEN 'raw_craft' WHEN 1 THEN 'merged' ELSE 'final' END AS stage, CASE WHEN p_size % 2 = 0 THEN 'active' ELSE 'pruned' END AS state FROM part),
e AS (SELECT p_partkey AS child, p_partkey - 1 AS parent FROM part WHERE p_partkey % 3 = 2 OR (p_partkey % 3 = 1 AND p_size > 20)), c AS (SELECT child, parent FROM e UNION SELECT c.child, e.parent FROM c JOIN e ON e.child = c.parent),
t AS (SELECT DISTINCT c.child AS id FROM c JOIN n ON n.id = c.parent WHERE n.stage = 'raw_craft')
SELECT id, 'orphan' AS problem FROM n WHERE stage <> 'raw_craft' AND id NOT IN (SELECT id FROM t) UNION ALL SELECT id, 'raw_untraced' FROM n WHERE stage = 'raw_craft' AND state = 'active' AND id NOT IN (SELECT parent FROM e)""")
def conservation(spark, sf_dir):
    """Candidates without a proposal beneath them, and proposals that nothing came of."""
    p = table(spark, sf_dir, "part")
    third = F.col("p_partkey") % 3
    nodes = p.select(F.col("p_partkey").alias("id"), F.when(third == 0, "raw_craft").when(third == 1, "merged").otherwise("final").alias("stage"), F.when(F.col("p_size") % 2 == 0, "active").otherwise("pruned").alias("state"))
    parents = p.where((third == 2) | ((third == 1) & (F.col("p_size") > 20))).select(F.col("p_partkey").alias("child"), (F.col("p_partkey") - 1).alias("parent"))
    return review.conservation(nodes, parents)


@query(f"""WITH {BOXES}, a AS (SELECT * FROM boxes WHERE state = 'F' AND lang <> 'R') SELECT asset, min(id) AS id, x, y, w, h FROM a GROUP BY asset, x, y, w, h HAVING count(*) = 1""")
def surviving_nodes(spark, sf_dir):
    """The one active node at each geometry."""
    nodes = boxes(spark, sf_dir).withColumns({"stage": F.when(F.col("lang") == "R", "final").otherwise("merged"), "state": F.when(F.col("state") == "F", "active").otherwise("pruned")})
    return review.surviving_at(nodes).select("asset", "id", *[F.col(c).cast("bigint").alias(c) for c in ("x", "y", "w", "h")])


@query(f"""WITH {BOXES}, s AS (SELECT DISTINCT asset, x, y, w, h FROM boxes WHERE state = 'F') SELECT asset, id FROM (SELECT b.asset, b.id, row_number() OVER (PARTITION BY b.asset ORDER BY b.id) AS r FROM boxes b WHERE state <> 'F' AND NOT EXISTS (SELECT 1 FROM s WHERE s.asset = b.asset AND s.x = b.x AND s.y = b.y AND s.w = b.w AND s.h = b.h)) WHERE r <= 512""")
def recovered_pool(spark, sf_dir):
    """Suppressed boxes that did not ship."""
    b = boxes(spark, sf_dir).withColumn("state", F.when(F.col("state") == "F", "active").otherwise("pruned"))
    return review.recovered(b, b.where("state = 'active'")).select("asset", "id")


@query("""WITH a AS (SELECT doc_id, quality = 1 AS f FROM labels WHERE doc_id % 7 <> 0), b AS (SELECT doc_id, toxic = 0 AS f FROM labels WHERE doc_id % 5 <> 0), j AS (SELECT a.f AS x, b.f AS y FROM a FULL JOIN b ON a.doc_id = b.doc_id)
SELECT count(*) FILTER (x IS NOT NULL AND y IS NOT NULL) AS paired, count(*) FILTER (x IS NULL OR y IS NULL) AS unpaired, count(*) FILTER (x AND y) AS both, count(*) FILTER (NOT x AND NOT y) AS neither, count(*) FILTER (x AND NOT y) AS only_first, count(*) FILTER (NOT x AND y) AS only_second FROM j""")
def paired_arms(spark, sf_dir):
    """Two arms' outcomes by occurrence."""
    rows = table(spark, sf_dir, "labels")
    return review.paired_arms(rows.where("doc_id % 7 <> 0").select("doc_id", (F.col("quality") == 1).alias("found")), rows.where("doc_id % 5 <> 0").select("doc_id", (F.col("toxic") == 0).alias("found")), ["doc_id"])


@query("""WITH o AS (SELECT lang, quality AS e, quality * (1 - toxic) AS f FROM labels l JOIN documents d ON d.doc_id = l.doc_id), s AS (SELECT lang, sum(f) / sum(e) AS recall, sum(e) >= 30 AS sufficient FROM o GROUP BY 1 HAVING sum(e) > 0) SELECT lang, recall, sufficient FROM s WHERE recall < 0.99::DOUBLE""")
def recall_floor(spark, sf_dir):
    """Languages whose recall is under the floor."""
    rows = outcomes(spark, sf_dir).withColumn("found", F.col("outcome") * (1 - F.col("toxic")))
    strata = metrics.strata_recall(rows, "lang", "found", "outcome").where("is_total = 0")
    return review.floor_violations(strata, 0.99).select("lang", "recall", "sufficient")


@query("""SELECT o_orderpriority AS split, count(*) AS assets, CAST(sum(o_custkey) AS BIGINT) AS expected, CAST(sum(o_custkey - o_orderkey % 2) AS BIGINT) AS found, round(100.0::DOUBLE * CAST(sum(o_custkey - o_orderkey % 2) AS BIGINT) / CAST(sum(o_custkey) AS BIGINT), 1) AS recall,
round(100.0::DOUBLE * CAST(sum(o_orderkey % 3) FILTER (o_orderstatus <> 'P') AS BIGINT) / CAST(sum(o_orderkey % 11) FILTER (o_orderstatus <> 'P') AS BIGINT), 1) AS false_region_rate, count(*) FILTER (o_orderstatus <> 'P') AS false_region_basis FROM orders GROUP BY 1""")
def guided_recall(spark, sf_dir):
    """Recall by split, and the rate of unrequested regions."""
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("split"), F.col("o_custkey").alias("expected"), (F.col("o_custkey") - F.col("o_orderkey") % 2).alias("found"), (F.col("o_orderkey") % 11).alias("shipped"), (F.col("o_orderkey") % 3).alias("unrequested"), (F.col("o_orderstatus") == "P").alias("partial"))
    return review.guided_recall(rows, ["split"])


@query(f"WITH {BOXES}, m AS (SELECT asset, median(w * h) AS m FROM boxes GROUP BY 1) SELECT b.asset, b.id, b.w * b.h / m AS relative_area FROM boxes b JOIN m ON m.asset = b.asset")
def relative_area(spark, sf_dir):
    """Area over the asset's median area."""
    return review.relative_area(boxes(spark, sf_dir)).select("asset", "id", "relative_area")


@query(f"WITH {BOXES}, l AS (SELECT asset, list_sort(list(h)) AS hs FROM boxes GROUP BY 1) SELECT asset, hs[len(hs) // 2 + 1] AS upper_median FROM l")
def upper_median(spark, sf_dir):
    """The upper median height."""
    return review.upper_median(boxes(spark, sf_dir), ["asset"], "h")


@query("""WITH s AS (SELECT l_returnflag AS face_set, l_suppkey AS region, max(l_quantity) AS own FROM lineitem GROUP BY 1, 2), b AS (SELECT l_suppkey AS region, max(l_quantity) AS best FROM lineitem GROUP BY 1)
SELECT face_set, min(own / best) AS least, round(avg(own / best), 9) AS mean FROM s JOIN b ON b.region = s.region GROUP BY 1""")
def cohort_maximin(spark, sf_dir):
    """The least and the mean achievable share of each set of faces."""
    rows = table(spark, sf_dir, "lineitem").select("l_partkey", F.col("l_returnflag").alias("face_set"), F.col("l_suppkey").alias("region"), F.col("l_quantity").alias("score"))
    return review.cohort_maximin(rows, "l_partkey", "face_set", "region", "score").select("face_set", "least", F.round("mean", 9).alias("mean"))


@query("""SELECT o_custkey AS project, coalesce(round(avg(CASE WHEN o_orderstatus = 'F' THEN o_orderkey % 100 END), 9), 1) AS quality, count(*) AS regions FROM orders GROUP BY 1""")
def quality_mean(spark, sf_dir):
    """Mean score of a project's regions, 1 without any."""
    rows = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("project"), F.when(F.col("o_orderstatus") == "F", F.col("o_orderkey") % 100).alias("score"))
    return review.quality_mean(rows, "project", "score").select("project", F.round("quality", 9).alias("quality"), "regions")


# Store


@query("""WITH n AS (SELECT s_name AS name, s_nationkey AS kind FROM supplier WHERE s_suppkey % 2 = 1) SELECT count(*) AS n, count(DISTINCT id) AS ids, CAST(max(id) AS BIGINT) AS last, CAST(sum(kind) AS BIGINT) AS kinds FROM (SELECT s_suppkey AS id, s_nationkey AS kind FROM supplier UNION ALL SELECT (SELECT max(s_suppkey) FROM supplier) + row_number() OVER (), kind FROM n)""")
def insert_rows(spark, sf_dir):
    """New rows under the next ids, without gaps."""
    now = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"), F.col("s_nationkey").alias("kind"))
    made = store.insert_rows(now, now.where("id % 2 = 1").drop("id"))
    return made.agg(F.count("*").alias("n"), F.countDistinct("id").alias("ids"), F.max("id").cast("bigint").alias("last"), F.sum("kind").cast("bigint").alias("kinds"))


@query("""SELECT CAST(c_custkey AS BIGINT) AS attempt, c_name AS name FROM customer WHERE c_custkey % 3 <> 0 UNION ALL SELECT CAST(c_custkey AS BIGINT), 'again' FROM customer WHERE c_custkey % 3 = 0""")
def append_once(spark, sf_dir):
    """Attempts that are there already, or come twice, are not appended again."""
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("bigint").alias("attempt"), F.col("c_name").alias("name"))
    again = c.withColumn("name", F.lit("again"))
    return store.append_once(c.where("attempt % 3 <> 0"), again.unionByName(again), ["attempt"])


@query("""SELECT s_suppkey AS id, CASE WHEN s_suppkey % 4 = 0 THEN 'set' ELSE s_name END AS name, CASE WHEN s_suppkey % 4 = 0 THEN 2 ELSE s_suppkey % 2 + 1 END AS revision, s_suppkey % 4 = 0 AS applied FROM supplier""")
def compare_and_set(spark, sf_dir):
    """Changes made from an older revision do not apply."""
    now = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"), (F.col("s_suppkey") % 2 + 1).cast("int").alias("revision"))
    changes = now.where("id % 4 IN (0, 1)").select("id", F.lit("set").alias("name"), F.lit(2).alias("revision"), F.lit(1).alias("expected_revision"))
    return store.compare_and_set(now, changes, ["id"])


@query("SELECT l_orderkey AS job, count(*) AS n, min('none') AS note FROM lineitem WHERE l_partkey < 100 GROUP BY 1")
def scoped_delete(spark, sf_dir):
    """Rows from a boundary on are deleted; a column that was missing is added with its default."""
    rows = store.delete_scope(table(spark, sf_dir, "lineitem"), F.col("l_partkey") >= 100)
    rows = store.evolve(rows, {"note": ("string", "none"), "l_partkey": ("bigint", 0)})
    return rows.groupBy(F.col("l_orderkey").alias("job")).agg(F.count("*").alias("n"), F.min("note").alias("note"))


@query("""WITH o AS (SELECT o_custkey AS job, o_orderpriority AS kind, o_orderkey AS k, CASE o_orderstatus WHEN 'O' THEN 'queued' WHEN 'P' THEN 'running' ELSE 'done' END AS status, o_orderkey % 2 = 0 AS preview FROM orders),
r AS (SELECT job, kind, k + 1 AS k FROM o WHERE k % 10 = 0), f AS (SELECT DISTINCT job, kind, k FROM r WHERE NOT EXISTS (SELECT 1 FROM o WHERE o.job = r.job AND o.kind = r.kind AND o.k = r.k))
SELECT job, kind, k, CASE WHEN status = 'queued' AND preview AND EXISTS (SELECT 1 FROM f WHERE f.job = o.job AND f.kind = o.kind) THEN 'superseded' ELSE status END AS status FROM o UNION ALL SELECT job, kind, k, 'queued' FROM f""")
def dedupe_jobs(spark, sf_dir):
    """Requests for operations that exist are dropped; queued previews of a requested job and kind are superseded."""
    ops = operations(spark, sf_dir).select("job", "kind", F.col("id").alias("k"), "status", (F.col("id") % 2 == 0).alias("preview"))
    asked = ops.where("k % 10 = 0").select("job", "kind", (F.col("k") + 1).alias("k"), F.lit("queued").alias("status"), F.lit(False).alias("preview"))
    return store.dedupe_jobs(ops, asked, ["job", "kind", "k"]).select("job", "kind", "k", "status")


@query("""SELECT o_orderkey AS id FROM (SELECT *, CASE o_orderkey % 3 WHEN 0 THEN 'en' WHEN 1 THEN 'de' END AS s, CASE WHEN o_orderkey % 2 = 0 THEN 'fr' ELSE 'es' END AS t FROM orders) WHERE o_custkey = 7 AND t = 'fr' AND (s IS NULL OR s = 'en') ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 2000""")
def memory_candidates(spark, sf_dir):
    """A project's newest records of a language pair; the limit is the feature."""
    third = F.col("o_orderkey") % 3
    rows = table(spark, sf_dir, "orders").select(
        F.col("o_custkey").alias("project"), F.col("o_orderkey").alias("id"), F.col("o_orderdate").alias("created"), F.when(third == 0, "en").when(third == 1, "de").alias("source_lang"), F.when(F.col("o_orderkey") % 2 == 0, "fr").otherwise("es").alias("target_lang"),
    )
    return store.memory_candidates(rows, 7, "fr", "en").select("id")


@query("SELECT s_nationkey AS job, max(s_suppkey) AS chunk FROM supplier WHERE s_suppkey % 3 = 0 AND s_suppkey % 2 = 0 GROUP BY 1")
def latest_checkpoint(spark, sf_dir):
    """The newest completed chunk whose revision is the wanted one."""
    chunks = table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("job"), F.col("s_suppkey").alias("chunk"), F.col("s_suppkey").alias("id"), F.when(F.col("s_suppkey") % 3 == 0, "completed").otherwise("running").alias("status"), (F.col("s_suppkey") % 2).cast("int").alias("revision"))
    return store.latest_checkpoint(chunks, ["job"], revision=0).select("job", "chunk")


@query("SELECT o_custkey AS asset, min(o_orderkey) AS block FROM orders WHERE o_orderstatus = 'O' GROUP BY 1")
def active_blocks(spark, sf_dir):
    """Each asset's first open block."""
    rows = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("asset"), F.col("o_orderkey").alias("block"), F.col("o_orderkey").alias("place"), (F.col("o_orderstatus") == "O").alias("open"))
    return store.active_block(rows, ["asset"]).select("asset", "block")


@query("""SELECT 'en' AS lang, p_name AS term, min(CASE WHEN p_size < 10 THEN 'asset' ELSE 'project' END) AS origin FROM part GROUP BY 1, 2""")
def override_terms(spark, sf_dir):
    """An asset's terms over its project's."""
    p = table(spark, sf_dir, "part").select(F.lit("en").alias("lang"), F.col("p_name").alias("term"), "p_size")
    of = lambda rows, origin: rows.select("lang", "term").distinct().withColumn("origin", F.lit(origin))
    return store.override_union(of(p, "project"), of(p.where("p_size < 10"), "asset"), ["lang", "term"])


@query("""WITH o AS (SELECT o_custkey AS asset, 'r' || o_orderkey AS old_id, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS n FROM orders WHERE o_orderstatus <> 'P'), u AS (SELECT o_custkey AS asset, 'r' || o_orderkey AS old_id, o_orderkey AS at FROM orders)
SELECT u.asset, coalesce(string_agg('r' || o.n, ',' ORDER BY u.at) FILTER (o.n IS NOT NULL), '') AS ids FROM u LEFT JOIN o ON o.asset = u.asset AND o.old_id = u.old_id GROUP BY 1""")
def rewritten_ids(spark, sf_dir):
    """Lists of regions under their new ids; retired ones are dropped."""
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("asset"), F.concat(F.lit("r"), F.col("o_orderkey").cast("string")).alias("old_id"), F.col("o_orderkey").alias("at"), F.col("o_orderdate").alias("d"), (F.col("o_orderstatus") != "P").alias("live"))
    mapping = store.compact_ids(o.where("live"), ["asset"], F.asc("d"), F.asc("at")).select("asset", "old_id", "new_id")
    lists = o.groupBy("asset").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "old_id"))), lambda s: s["old_id"]).alias("ids"))
    return store.rewrite_ids(lists, mapping, ["asset"], "drop").select("asset", F.array_join("ids", ",").alias("ids"))


# Matching


@query("""WITH s AS (SELECT vec_id, list_reduce(list_prepend(0::BIGINT, list_transform(embedding[1:32], lambda v: (v > 0)::BIGINT)), lambda a, b: a * 2 + b) AS hi, list_reduce(list_prepend(0::BIGINT, list_transform(embedding[33:64], lambda v: (v > 0)::BIGINT)), lambda a, b: a * 2 + b) AS lo FROM embeddings),
m AS (SELECT vec_id, xor(hi, CAST(vec_id % 64 AS BIGINT)) AS hi, xor(lo, CAST(vec_id % 32 AS BIGINT) * 1024) AS lo FROM s)
SELECT * FROM (SELECT a.vec_id AS a_id, b.vec_id AS b_id, CAST(bit_count(xor(a.hi, b.hi)) + bit_count(xor(a.lo, b.lo)) AS INTEGER) AS distance FROM s a JOIN m b ON true) WHERE distance <= 7""")
def tm_visual_noisy(spark, sf_dir):
    """Sign hashes and noisy copies of them within seven bits."""
    s = sign_hashes(spark, sf_dir)
    noisy = s.select("vec_id", F.col("hi").bitwiseXOR((F.col("vec_id") % 64).cast("bigint")).alias("hi"), F.col("lo").bitwiseXOR((F.col("vec_id") % 32).cast("bigint") * 1024).alias("lo"))
    return matching.hamming_pairs(s, noisy, 7).select(F.col("a_vec_id").alias("a_id"), F.col("b_vec_id").alias("b_id"), "distance")


# Orders of boxes and streams


@query()
def column_order(spark, sf_dir):
    """Boxes in columns from the right; a greedy order, held against a plain one in tests."""
    return spatial.column_order(boxes(spark, sf_dir)).select("asset", "id", "line", "reading_order")


@query("""SELECT CAST(epoch_us(time_bucket(INTERVAL 1 DAY, ts)) AS BIGINT) AS start, count(*) AS n FROM events GROUP BY 1""")
def day_chunks(spark, sf_dir):
    """Tumbling windows of a day."""
    rows = ev.chunks(table(spark, sf_dir, "events"), "1 day")
    return rows.select(ev.micros("start").alias("start"), "n")


# Files


@query("""SELECT conv_id AS asset, 'r' || turn AS unit_id, text AS source, CASE WHEN turn % 2 = 0 THEN '<fr> ' || text ELSE '' END AS target, 'fr' AS lang, CASE conv_id % 2 WHEN 0 THEN 'csv' ELSE 'tmx' END AS format FROM conversations WHERE role <> 'system' AND conv_id % 2 = 0
UNION ALL SELECT conv_id, 'r' || turn, text, '<fr> ' || text, 'fr', 'tmx' FROM conversations WHERE turn % 2 = 0 AND trim(text) <> '' AND conv_id % 2 = 1""")
def import_round_trip(spark, sf_dir):
    """Conversations written as CSV or TMX and read by their extension."""
    rows = interchange_rows(spark, sf_dir).withColumns({k: F.lit(1) for k in "xywh"}).withColumn("target_language", F.col("lang"))
    name = lambda ext: F.concat(F.col("asset").cast("string"), F.lit(f".{ext}"))
    csv = interchange.write_delimited(rows.where("asset % 2 = 0")).select(name("csv").alias("path"), "document")
    tmx = interchange.write_tmx(rows.where("asset % 2 = 1")).select(name("tmx").alias("path"), "document")
    got = interchange.import_files(csv.unionByName(tmx))
    return got.select(F.substring_index("path", ".", 1).cast("bigint").alias("asset"), "unit_id", "source", "target", "lang", "format")


@query("""SELECT conv_id AS asset, CASE WHEN turn % 4 = 0 THEN 'accepted' WHEN turn % 4 = 1 THEN 'stale' WHEN turn % 4 = 2 THEN 'blank' ELSE 'unknown' END AS state, count(*) AS n FROM conversations GROUP BY 1, 2""")
def returned_plates(spark, sf_dir):
    """Returned plates: accepted, stale, blank or unknown."""
    c = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("asset"), "turn", F.concat_ws("-", "conv_id", "turn").alias("uid"), tx.source_hash("text").alias("revision"))
    n = F.col("turn") % 4
    back = c.select("asset", F.when(n == 3, F.concat("uid", F.lit("?"))).otherwise(F.col("uid")).alias("uid"), F.when(n == 1, "old").otherwise(F.col("revision")).alias("revision"), F.when(n == 2, " ").otherwise("t").alias("target"))
    return interchange.readiness(c, back).groupBy("asset", "state").agg(F.count("*").alias("n"))


@query("""SELECT p_name AS source, p_type AS target, 'en-US' AS src_lang, CASE WHEN p_partkey % 2 = 0 THEN 'de' ELSE 'fr-CA' END AS targ_lang FROM part WHERE p_partkey % 5 <> 0""")
def glossary_rows(spark, sf_dir):
    """Glossary rows under headings of any kind; blank ones are left out."""
    p = table(spark, sf_dir, "part")
    term = F.when(F.col("p_partkey") % 5 == 0, " ").otherwise(F.concat(F.lit(" "), F.replace("p_name", F.lit(" "), F.lit("  "))))
    rows = p.select(F.col("p_type").alias("Translation"), term.alias("Source Term"), F.when(F.col("p_partkey") % 2 == 0, "DE").otherwise("fr_ca").alias("Target-Language"))
    return interchange.glossary_entries(rows, "EN_us")


@query("""SELECT CAST(conv_id AS VARCHAR) AS asset_id, count(*) AS total_regions, string_agg('r' || (r), ',' ORDER BY r) AS ids FROM (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS r FROM conversations) GROUP BY 1""")
def manifest_round_trip(spark, sf_dir):
    """Manifests written behind the guard and read again."""
    import uuid

    from lumenframe.operators.graph import shared_path

    rows = interchange_rows(spark, sf_dir).withColumns({"live": F.lit(True), "conf": F.lit(1.0)}).withColumns({k: F.lit(1) for k in "xywh"})
    named = store.compact_ids(rows, ["asset"], F.asc("reading_order"), F.asc("region_id")).withColumn("region_id", F.col("new_id"))
    path = shared_path(spark, f"manifests-{uuid.uuid4().hex}")
    interchange.save_manifests(interchange.manifest_of(named), path)
    got = interchange.load_manifests(spark, path)
    return got.select("asset_id", F.col("total_regions").cast("bigint").alias("total_regions"), F.array_join(F.transform("instances", lambda i: i["id"]), ",").alias("ids"))
