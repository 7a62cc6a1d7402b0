"""Named queries over the driver tables: a function of (spark, sf_dir) each, and SQL that must give the same rows.

Sums of scaled integers and single divisions keep values equal whatever the order of summation.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lumenframe.functions import geometry as geo
from lumenframe.functions import text as tx
from lumenframe.operators import evidence, graph, language_model, matching, metrics, spatial, store
from lumenframe.operators import detection, plates as plating
from lumenframe.plans.relations import BOXES, FRAMES, LINES, PAIRS, boxes, lines, norm, observations, table
from lumenframe.sources import interchange
from lumenframe.streaming import events as ev, tracker

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


# Review events

ACTIONS = {"signup": "accept", "purchase": "edit", "error": "reject", "view": "skip", "click": "flag"}
_ACTION = "CASE event_type WHEN 'signup' THEN 'accept' WHEN 'purchase' THEN 'edit' WHEN 'error' THEN 'reject' WHEN 'view' THEN 'skip' WHEN 'click' THEN 'flag' END"


def review_events(spark, sf_dir):
    known = F.create_map(*[F.lit(x) for kv in ACTIONS.items() for x in kv])
    rows = table(spark, sf_dir, "events").withColumn("action", F.try_element_at(known, F.col("event_type")))
    return rows.where(F.col("action").isNotNull() & F.col("user_id").isNotNull())


@query(f"""WITH e AS (SELECT *, {_ACTION} AS action FROM events), l(action) AS (VALUES ('accept'), ('edit'), ('reject'), ('skip'), ('flag'))
SELECT l.action, count(e.event_id) AS n, count(DISTINCT e.user_id) AS candidates FROM l LEFT JOIN e ON e.action = l.action GROUP BY l.action""")
def review_summary(spark, sf_dir):
    """Events and distinct candidates by action, zero-filled over the five labels."""
    labels = spark.createDataFrame([(a,) for a in ACTIONS.values()], "action string")
    got = review_events(spark, sf_dir).groupBy("action").agg(F.count("event_id").alias("n"), F.countDistinct("user_id").alias("candidates"))
    zero = F.lit(0).cast("bigint")
    return labels.join(got, "action", "left").select("action", F.coalesce("n", zero).alias("n"), F.coalesce("candidates", zero).alias("candidates"))


@query(f"""WITH e AS (SELECT *, {_ACTION} AS action FROM events), g AS (SELECT user_id, count(*) AS reviewed, count(*) FILTER (action = 'accept') AS accepted,
  max(CAST(json_extract(props, '$.k') AS BIGINT)) AS top_k FROM e GROUP BY user_id)
SELECT user_id, reviewed, accepted, CASE WHEN accepted > 0 THEN reviewed / accepted END AS per_accept, top_k FROM g""")
def review_by_session(spark, sf_dir):
    """Reviews, acceptances, their ratio (null without any) and the largest feature of each session."""
    k = F.get_json_object("props", "$.k").cast("bigint")
    got = review_events(spark, sf_dir).groupBy("user_id").agg(F.count("*").alias("reviewed"), F.count_if(F.col("action") == "accept").alias("accepted"), F.max(k).alias("top_k"))
    return got.select("user_id", "reviewed", "accepted", F.when(F.col("accepted") > 0, F.col("reviewed") / F.col("accepted")).alias("per_accept"), "top_k")


# Projects, assets, snapshots


@query("""SELECT c_custkey AS project, c_name AS name, count(o_orderkey) AS n_assets, coalesce(sum(l.n), 0)::BIGINT AS n_snapshots
FROM customer LEFT JOIN orders ON o_custkey = c_custkey LEFT JOIN (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY 1) l ON l_orderkey = o_orderkey
WHERE c_acctbal IS NOT NULL AND contains(lower(c_name), '00001') GROUP BY 1, 2""")
def project_cards(spark, sf_dir):
    """Projects by a case-insensitive part of the name, with their assets and snapshots, 0 for none."""
    projects = table(spark, sf_dir, "customer").where(F.lower("c_name").contains("00001") & F.col("c_acctbal").isNotNull()).select(F.col("c_custkey").alias("project"), F.col("c_name").alias("name"))
    assets = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("project"), F.col("o_orderkey").alias("l_orderkey"))
    snaps = table(spark, sf_dir, "lineitem").select("l_orderkey").join(assets, "l_orderkey").select("project")
    return store.with_counts(store.with_counts(projects, assets, "project", "n_assets"), snaps, "project", "n_snapshots")


@query("""SELECT project, asset, total FROM (SELECT o_custkey AS project, o_orderkey AS asset, o_totalprice AS total, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS r
FROM orders JOIN customer ON c_custkey = o_custkey WHERE o_orderstatus = 'F') WHERE r = 1""")
def duplicate_asset(spark, sf_dir):
    """The newest finished asset of each project."""
    rows = table(spark, sf_dir, "orders").where("o_orderstatus = 'F'").join(table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey")), "o_custkey")
    best = store.newest_per_key(rows, ["o_custkey"], 1, F.desc("o_orderdate"), F.desc("o_orderkey"))
    return best.select(F.col("o_custkey").alias("project"), F.col("o_orderkey").alias("asset"), F.col("o_totalprice").alias("total"))


@query("""SELECT l_returnflag, count(*) AS n, CAST(sum(l_orderkey) AS BIGINT) AS keys FROM (SELECT *, row_number() OVER (PARTITION BY l_returnflag, l_orderkey ORDER BY l_shipdate DESC, l_linenumber DESC,
  l_partkey DESC, l_suppkey DESC, l_quantity DESC, l_extendedprice DESC, l_discount DESC, l_tax DESC, l_linestatus DESC) AS r FROM lineitem) WHERE l_returnflag = 'R' OR r <= 2 GROUP BY 1""")
def autosave_retention(spark, sf_dir):
    """Protected rows, and of the others the newest two of each asset and reason."""
    order = [F.desc(c) for c in ("l_shipdate", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_linestatus")]
    rows = store.ranked(table(spark, sf_dir, "lineitem"), ["l_returnflag", "l_orderkey"], *order).where("l_returnflag = 'R' OR __r <= 2")
    return rows.groupBy("l_returnflag").agg(F.count("*").alias("n"), F.sum("l_orderkey").alias("keys"))


@query("""SELECT user_id, event_id, event_type FROM (SELECT *, lag(event_type) OVER w AS before, row_number() OVER w AS r FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)) WHERE r = 1 OR event_type IS DISTINCT FROM before""")
def autosave_dedup(spark, sf_dir):
    """Events whose payload differs from the one just before."""
    return store.changed_only(table(spark, sf_dir, "events"), ["user_id"], "event_type", F.asc("ts"), F.asc("event_id")).select("user_id", "event_id", "event_type")


@query("""WITH o AS (SELECT o_orderkey AS id, o_custkey AS job, o_orderpriority AS kind, CASE o_orderstatus WHEN 'O' THEN 'queued' WHEN 'P' THEN 'running' ELSE 'done' END AS status, o_orderdate AS lease FROM orders)
SELECT id, job, kind, status FROM o WHERE (status = 'queued' OR (status = 'running' AND lease <= TIMESTAMP '1997-01-01')) AND NOT EXISTS (SELECT 1 FROM o b WHERE b.job = o.job AND b.kind = o.kind AND b.id <> o.id AND b.status = 'running' AND b.lease > TIMESTAMP '1997-01-01')""")
def claimable_ops(spark, sf_dir):
    """Operations that may be claimed: no other of the same job and kind runs on a live lease."""
    return store.claimable(operations(spark, sf_dir), F.lit("1997-01-01").cast("timestamp_ntz")).select("id", "job", "kind", "status")


def operations(spark, sf_dir):
    status = F.when(F.col("o_orderstatus") == "O", "queued").when(F.col("o_orderstatus") == "P", "running").otherwise("done")
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("job"), F.col("o_orderpriority").alias("kind"), status.alias("status"), F.col("o_orderdate").alias("lease"))


@query("""SELECT o_orderkey AS id, CASE WHEN o_orderstatus = 'O' OR (o_orderstatus = 'P' AND o_orderdate <= TIMESTAMP '1997-01-01') THEN 'queued' WHEN o_orderstatus = 'P' THEN 'running' ELSE 'done' END AS status,
CASE WHEN o_orderstatus = 'P' AND o_orderdate <= TIMESTAMP '1997-01-01' THEN NULL ELSE o_orderdate END AS lease FROM orders""")
def lease_requeue(spark, sf_dir):
    """Running operations with an expired lease are queued again."""
    return store.requeue_expired(operations(spark, sf_dir), F.lit("1997-01-01").cast("timestamp_ntz")).select("id", "status", "lease")


@query("SELECT l_orderkey AS asset, count(*) AS n FROM lineitem WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_orderkey = l_orderkey AND o_orderstatus <> 'P') GROUP BY 1")
def orphan_keyframes(spark, sf_dir):
    """Child rows whose parent is gone (here: of another status), counted."""
    parents = table(spark, sf_dir, "orders").where("o_orderstatus <> 'P'").select(F.col("o_orderkey").alias("l_orderkey"))
    return store.orphans(table(spark, sf_dir, "lineitem"), parents, ["l_orderkey"]).groupBy(F.col("l_orderkey").alias("asset")).agg(F.count("*").alias("n"))


@query("""SELECT job, CAST(floor(f / 240) AS BIGINT) AS chunk, count(*) AS n, CAST(sum(CASE WHEN status = 'F' THEN 1 ELSE 0 END) AS BIGINT) AS completed, max(CASE WHEN status = 'F' THEN f END) AS last_done
FROM (SELECT l_suppkey % 20 AS job, l_partkey AS f, l_linestatus AS status FROM lineitem) GROUP BY 1, 2""")
def chunk_progress(spark, sf_dir):
    """Frames by fixed chunks of 240, with what is completed."""
    rows = table(spark, sf_dir, "lineitem").select((F.col("l_suppkey") % 20).alias("job"), F.col("l_partkey").alias("f"), (F.col("l_linestatus") == "F").alias("done"))
    done = F.when(F.col("done"), F.col("f"))
    return rows.groupBy("job", F.floor(F.col("f") / 240).alias("chunk")).agg(F.count("*").alias("n"), F.count_if("done").alias("completed"), F.max(done).alias("last_done"))


@query("SELECT event_id, user_id, value, true AS truncated FROM events WHERE user_id BETWEEN 10 AND 60 ORDER BY ts, event_id LIMIT 40 OFFSET 20")
def timeline_page(spark, sf_dir):
    """A page of forty events of a key range, with whether more follow."""
    rows = table(spark, sf_dir, "events").where(F.col("user_id").between(10, 60))
    return store.page(rows, 20, 40, F.asc("ts"), F.asc("event_id")).select("event_id", "user_id", "value", "truncated")


@query("""SELECT o_custkey AS project, max(CASE WHEN r = 1 THEN o_orderkey END) AS active, max(CASE WHEN r = 2 THEN o_orderkey END) AS successor FROM (
SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS r FROM orders) WHERE r <= 2 GROUP BY 1""")
def successor(spark, sf_dir):
    """The active asset of each project and the one that follows it."""
    rows = store.ranked(table(spark, sf_dir, "orders"), ["o_custkey"], F.desc("o_orderdate"), F.desc("o_orderkey")).where("__r <= 2")
    at = lambda n: F.max(F.when(F.col("__r") == n, F.col("o_orderkey")))
    return rows.groupBy(F.col("o_custkey").alias("project")).agg(at(1).alias("active"), at(2).alias("successor"))


@query("""SELECT s_suppkey AS id, CASE WHEN s_suppkey % 3 = 0 THEN s_acctbal + 1 ELSE s_acctbal END AS balance, CASE WHEN s_suppkey % 3 = 0 THEN 2 ELSE 1 END AS revision FROM supplier""")
def upsert_rows(spark, sf_dir):
    """Changes replace current rows by key; the newest of several changes wins."""
    now = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_acctbal").alias("balance"), F.lit(1).alias("revision"))
    some = now.where("id % 3 = 0")
    changes = some.withColumn("revision", F.lit(2)).withColumn("balance", F.col("balance") + 1).unionByName(some)
    return store.upsert(now, changes, ["id"], F.desc("revision"))


@query("""SELECT l_orderkey AS asset, o_orderkey IS NULL OR max(epoch_us(l_shipdate)) < epoch_us(o_orderdate) AS stale FROM lineitem LEFT JOIN orders ON o_orderkey = l_orderkey GROUP BY l_orderkey, o_orderkey, o_orderdate""")
def staleness(spark, sf_dir):
    """Artifacts older than their source, or without one."""
    made = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("asset")).agg(F.max(ev.micros("l_shipdate")).alias("revision"))
    sources = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("asset"), ev.micros("o_orderdate").alias("revision"))
    return store.stale(made, sources, ["asset"]).select("asset", "stale")


@query("""SELECT c_mktsegment AS stratum, c_name AS name, CASE WHEN count(*) OVER (PARTITION BY c_mktsegment) > 1 AND row_number() OVER (PARTITION BY c_mktsegment ORDER BY c_name DESC) = 1 THEN 'holdout' ELSE 'dev' END AS split FROM customer""")
def stable_split(spark, sf_dir):
    """The last name of each stratum is held out."""
    rows = table(spark, sf_dir, "customer").select(F.col("c_mktsegment").alias("stratum"), F.col("c_name").alias("name"))
    return store.stable_split(rows, "stratum", "name")


@query("""SELECT c_custkey AS id, CASE WHEN CAST(('0x' || substr(sha256(c_name), 1, 16))::UBIGINT % 10 AS INTEGER) IN (8, 9) THEN 'holdout' ELSE 'train' END AS split FROM customer""")
def hash_split(spark, sf_dir):
    """A reproducible split by hash."""
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), store.hash_split(F.col("c_name")).alias("split"))


@query("""WITH o AS (SELECT o_custkey AS asset, o_orderkey AS id, o_orderstatus <> 'P' AS live, o_orderdate AS d FROM orders)
SELECT asset, id, (CASE WHEN live THEN 'r' ELSE 'x' END) || row_number() OVER w AS new_id, row_number() OVER w - 1 AS new_order FROM o WINDOW w AS (PARTITION BY asset, live ORDER BY d NULLS LAST, id)""")
def compact_ids(spark, sf_dir):
    """Live rows are renumbered in order, retired ones under their own prefix."""
    rows = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("asset"), F.col("o_orderkey").alias("id"), (F.col("o_orderstatus") != "P").alias("live"), F.col("o_orderdate").alias("d"))
    return store.compact_ids(rows, ["asset"], F.asc_nulls_last("d"), F.asc("id")).select("asset", "id", "new_id", "new_order")


@query(f"""WITH {FRAMES}, k AS (SELECT track, frame, value FROM frames WHERE frame % 10 = 1),
j AS (SELECT f.track, f.frame, max(a.frame) AS key_before FROM frames f LEFT JOIN k a ON a.track = f.track AND a.frame <= f.frame GROUP BY 1, 2),
l AS (SELECT f.track, f.frame, min(b.frame) AS key_after FROM frames f LEFT JOIN k b ON b.track = f.track AND b.frame >= f.frame GROUP BY 1, 2)
SELECT j.track, j.frame, key_before, key_after, CASE WHEN key_after IS NULL THEN a.value WHEN key_before = key_after THEN a.value ELSE a.value + (b.value - a.value) * (j.frame - key_before) / (key_after - key_before) END AS value
FROM j JOIN l ON j.track = l.track AND j.frame = l.frame LEFT JOIN k a ON a.track = j.track AND a.frame = key_before LEFT JOIN k b ON b.track = j.track AND b.frame = key_after""")
def asof_keyframes(spark, sf_dir):
    """Every frame between its neighbouring keyframes, interpolated."""
    frames = observations(spark, sf_dir).select("track", "frame", "value")
    return store.bracket_keyframes(frames, frames.where("frame % 10 = 1"), ["track"])


# Text


@query(f"""SELECT doc_id, {norm('text')} AS normalized, lower(trim(regexp_replace(text, '[ \\t\\n\\r\\f\\v]+', ' ', 'g'))) AS segment FROM documents""")
def normalize_profile(spark, sf_dir):
    """Normal forms of every text."""
    return table(spark, sf_dir, "documents").select("doc_id", tx.normalize_text("text").alias("normalized"), tx.segment_normalize("text").alias("segment"))


@query("""SELECT lang, CAST(sum(len(regexp_extract_all(text, '\\p{Latin}'))) AS BIGINT) AS latin, CAST(sum(len(regexp_extract_all(text, '\\p{Han}'))) AS BIGINT) AS han, CAST(sum(len(regexp_extract_all(text, '\\p{Nd}'))) AS BIGINT) AS digits,
CAST(sum(CASE WHEN regexp_matches(text, '[\\p{Arabic}\\p{Hebrew}]') THEN 1 ELSE 0 END) AS BIGINT) AS n_rtl FROM documents GROUP BY lang""")
def script_profile(spark, sf_dir):
    """Characters of scripts and right-to-left texts by language."""
    s = tx.script_counts("text")
    rows = table(spark, sf_dir, "documents").select("lang", s["latin"].alias("latin"), s["han"].alias("han"), tx.class_count("text", r"\p{Nd}").alias("digits"), (tx.direction("text") == "rtl").alias("rtl"))
    return rows.groupBy("lang").agg(F.sum("latin").alias("latin"), F.sum("han").alias("han"), F.sum("digits").alias("digits"), F.count_if("rtl").alias("n_rtl"))


LEXICON = {"de": ("der die das und ist", "äöüß"), "en": ("the of and in that", ""), "es": ("el la de que los", "ñóí"), "fr": ("le la les des est", "éèêç")}


def _lexicon_sql():
    parts = []
    for lang, (stop, marks) in sorted(LEXICON.items()):
        words = ", ".join(f"'{w}'" for w in stop.split())
        score = f"2 * len(list_filter(w, lambda x: x IN ({words})))" + (f" + len(regexp_extract_all(lower(text), '[{marks}]'))" if marks else "")
        parts.append(f"SELECT doc_id, '{lang}' AS lang_guess, {score} AS score FROM d")
    return "WITH d AS (SELECT doc_id, text, regexp_split_to_array(lower(text), '[^\\p{L}]+') AS w FROM documents), s AS (" + " UNION ALL ".join(parts) + ") SELECT doc_id, lang_guess, CAST(score AS INTEGER) AS score FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, lang_guess) AS r FROM s) WHERE r = 1"


@query(_lexicon_sql())
def lexicon_language(spark, sf_dir):
    """Language by stopwords and marks."""
    best = tx.stopword_scores("text", LEXICON)[0]
    return table(spark, sf_dir, "documents").select("doc_id", best["lang"].alias("lang_guess"), (-best["score"]).alias("score"))


@query(f"""SELECT doc_id, translate(text, '{tx.CYRILLIC_TWINS}', '{tx.LATIN_TWINS}') = text AS unchanged, CASE WHEN length(regexp_replace(text, '[^\\p{{L}}]', '', 'g')) > 0
THEN length(regexp_replace(text, '[^{tx.CYRILLIC_TWINS}{tx.LATIN_TWINS}]', '', 'g')) / length(regexp_replace(text, '[^\\p{{L}}]', '', 'g')) ELSE 0.0::DOUBLE END AS twins FROM documents""")
def homoglyph_fold(spark, sf_dir):
    """Share of letters with a twin in another script."""
    return table(spark, sf_dir, "documents").select("doc_id", (tx.skeleton("text") == F.col("text")).alias("unchanged"), tx.twin_share("text").alias("twins"))


_KEY = "lower(regexp_replace({c}, '[^\\p{{L}}\\p{{N}}]+', '', 'g'))"


@query(f"""WITH p AS (SELECT p_partkey AS id, p_name AS ref, CASE WHEN p_partkey % 7 = 0 THEN '- -' ELSE replace(p_name, 'e', 'c') || ' #' END AS hyp FROM part),
k AS (SELECT *, CASE WHEN id % 11 = 0 THEN '' ELSE {_KEY.format(c='ref')} END AS r, {_KEY.format(c='hyp')} AS h FROM p)
SELECT id, CAST(levenshtein(hyp, ref) AS INTEGER) AS edits, CASE WHEN length(r) > 0 THEN round(least(1.0::DOUBLE, levenshtein(h, r) / length(r)), 4) END AS cer, levenshtein(hyp, ref) / greatest(length(hyp), length(ref)) AS ned FROM k""")
def character_error(spark, sf_dir):
    """Edits and error rates of a noisy reading; some references have no letter."""
    noisy = F.when(F.col("p_partkey") % 7 == 0, F.lit("- -")).otherwise(F.concat(F.replace("p_name", F.lit("e"), F.lit("c")), F.lit(" #")))
    rows = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("ref"), noisy.alias("hyp"))
    asked = F.when(F.col("id") % 11 == 0, F.lit("--")).otherwise(F.col("ref"))
    return rows.select("id", F.levenshtein("hyp", "ref").alias("edits"), tx.error_rate("hyp", asked).alias("cer"), tx.normalized_edit("hyp", "ref").alias("ned"))


@query("""WITH p AS (SELECT p_partkey AS id, string_split(lower(p_name || ' ' || p_type), ' ') AS r, string_split(lower(replace(p_name, 'o', '0') || CASE WHEN p_partkey % 3 = 0 THEN '' ELSE ' ' || p_type END), ' ') AS h FROM part),
e AS (SELECT id, r, h, list_concat(r, h) AS w FROM p), c AS (SELECT id, len(r) AS n, array_to_string(list_transform(r, lambda x: chr(64 + CAST(list_position(w, x) AS INTEGER))), '') AS a, array_to_string(list_transform(h, lambda x: chr(64 + CAST(list_position(w, x) AS INTEGER))), '') AS b FROM e)
SELECT id, round(least(1.0::DOUBLE, levenshtein(a, b) / n), 4) AS wer FROM c""")
def word_error(spark, sf_dir):
    """Word error rate of a noisy reading."""
    p = table(spark, sf_dir, "part")
    heard = F.concat(F.replace("p_name", F.lit("o"), F.lit("0")), F.when(F.col("p_partkey") % 3 == 0, F.lit("")).otherwise(F.concat(F.lit(" "), F.col("p_type"))))
    return p.select(F.col("p_partkey").alias("id"), tx.word_error_rate(heard, F.concat_ws(" ", "p_name", "p_type")).alias("wer"))


@query(r"""SELECT page_id, len(regexp_extract_all(html, '</?[A-Za-z][^<>]*>'))::INTEGER AS tags, list_sort(regexp_extract_all(html, '[0-9]+(?:[.,][0-9]+)*')) = list_sort(regexp_extract_all(replace(html, '10', 'ten'), '[0-9]+(?:[.,][0-9]+)*')) AS same_numbers FROM pages""")
def placeholder_check(spark, sf_dir):
    """Tags as placeholders, and whether a version in which one number is spelled out has the same numbers; of whole pages."""
    spelled, number = F.replace("html", F.lit("10"), F.lit("ten")), "[0-9]+(?:[.,][0-9]+)*"
    return table(spark, sf_dir, "pages").select("page_id", F.size(tx.multiset("html", "</?[A-Za-z][^<>]*>")).alias("tags"), (tx.multiset("html", number) == tx.multiset(spelled, number)).alias("same_numbers"))


@query("""WITH c AS (SELECT *, text || ' 10:30 http://x oui!! non ? «a»' AS t, CASE turn % 3 WHEN 0 THEN 'fr-FR' WHEN 1 THEN 'fr-CA' ELSE 'en-US' END AS l FROM conversations),
b AS (SELECT *, CASE l WHEN 'fr-FR' THEN regexp_replace(t, '(\\S)([!?;:»]+)(\\s|$)', '\\1 \\2\\3', 'g') WHEN 'fr-CA' THEN regexp_replace(t, '(\\S)([:»]+)(\\s|$)', '\\1 \\2\\3', 'g') ELSE t END AS s FROM c)
SELECT conv_id, turn, replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;') AS escaped, CASE WHEN l = 'en-US' THEN s ELSE regexp_replace(s, '(«)(\\S)', '\\1 \\2', 'g') END AS spaced, sha256(replace(text, chr(13) || chr(10), chr(10))) AS source_hash FROM b""")
def locale_spacing(spark, sf_dir):
    """Escaped text, spacing by three locales (with a tail of marks that take a space and marks that don't) and source hash."""
    c = table(spark, sf_dir, "conversations")
    said = F.concat("text", F.lit(" 10:30 http://x oui!! non ? «a»"))
    locale = F.when(F.col("turn") % 3 == 0, tx.resolve_locale(F.lit("fr"))).when(F.col("turn") % 3 == 1, tx.resolve_locale(F.lit("fr"), F.lit("fr_ca"))).otherwise(tx.resolve_locale(F.lit("en"), F.lit("en-us")))
    return c.select("conv_id", "turn", tx.xml_escape("text").alias("escaped"), tx.punctuation_spacing(said, locale).alias("spaced"), tx.source_hash("text").alias("source_hash"))


@query("""SELECT conv_id, string_agg(trim(text), ' ' ORDER BY turn) AS assembled, count(*) AS n FROM conversations WHERE trim(text) <> '' GROUP BY 1""")
def assemble_fragments(spark, sf_dir):
    """Fragments joined in reading order."""
    rows = table(spark, sf_dir, "conversations").where(F.trim("text") != "")
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("turn", F.trim("text").alias("t")))), lambda s: s["t"])
    return rows.groupBy("conv_id").agg(F.array_join(ordered, " ").alias("assembled"), F.count("*").alias("n"))


# Translation memory


def tm_inputs(spark, sf_dir):
    """Lines of odd documents are regions, of even ones memory; texts of equal norm share a style."""
    rows = lines(spark, sf_dir).withColumn("rid", F.col("doc_id") * 100_000 + F.col("pos"))
    regions = rows.where("doc_id % 2 = 1").select(F.col("rid").alias("region_id"), "text")
    memory = rows.where("doc_id % 2 = 0").select(F.col("rid").alias("memory_id"), "text", F.col("doc_id").alias("recency"))
    return regions, memory


@query(f"""WITH {LINES}, n AS (SELECT *, doc_id * 100000 + pos AS rid, {norm('text')} AS k FROM lines), m AS (SELECT k, rid, doc_id, row_number() OVER (PARTITION BY k ORDER BY doc_id DESC, rid) AS r FROM n WHERE doc_id % 2 = 0 AND k <> '')
SELECT n.rid AS region_id, m.rid AS memory_id, m.doc_id AS recency FROM n JOIN m ON n.k = m.k AND m.r = 1 WHERE n.doc_id % 2 = 1""")
def tm_exact(spark, sf_dir):
    """Regions with the newest memory record of the same normalised text."""
    return matching.exact_pairs(*tm_inputs(spark, sf_dir)).select("region_id", "memory_id", "recency")


@query()
def tm_fuzzy(spark, sf_dir):
    """Fuzzy lookup of part names in the names of others; no SQL form of the ratio."""
    names = table(spark, sf_dir, "part").select("p_partkey", F.concat_ws(" ", "p_name", "p_type").alias("text"))
    regions = names.where("p_partkey % 2 = 1").select(F.col("p_partkey").alias("region_id"), "text")
    memory = names.where("p_partkey % 2 = 0").select(F.col("p_partkey").alias("memory_id"), F.concat("text", F.lit("s")).alias("text"), F.col("p_partkey").alias("recency"))
    return matching.fuzzy_pairs(regions, memory)


def sign_hashes(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").select("vec_id", geo.sign_hash("embedding", 0).alias("hi"), geo.sign_hash("embedding", 32).alias("lo"))


@query("""WITH s AS (SELECT vec_id, list_reduce(list_prepend(0::BIGINT, list_transform(embedding[1:32], lambda v: (v > 0)::BIGINT)), lambda a, b: a * 2 + b) AS hi, list_reduce(list_prepend(0::BIGINT, list_transform(embedding[33:64], lambda v: (v > 0)::BIGINT)), lambda a, b: a * 2 + b) AS lo FROM embeddings)
SELECT * FROM (SELECT a.vec_id AS a_id, b.vec_id AS b_id, CAST(bit_count(xor(a.hi, b.hi)) + bit_count(xor(a.lo, b.lo)) AS INTEGER) AS distance FROM s a JOIN s b ON a.vec_id < b.vec_id) WHERE distance <= 7""")
def tm_visual(spark, sf_dir):
    """Pairs of sign hashes within seven bits, by equal slices."""
    s = sign_hashes(spark, sf_dir)
    return matching.hamming_pairs(s, s, 7).where("a_vec_id < b_vec_id").select(F.col("a_vec_id").alias("a_id"), F.col("b_vec_id").alias("b_id"), "distance")


@query()
def tm_tiered(spark, sf_dir):
    """Exact before fuzzy, over part names."""
    names = table(spark, sf_dir, "part").select("p_partkey", F.concat_ws(" ", "p_name", "p_type").alias("text"))
    regions = names.where("p_partkey % 2 = 1").select(F.col("p_partkey").alias("region_id"), "text")
    memory = names.where("p_partkey % 2 = 0").select(F.col("p_partkey").alias("memory_id"), F.when(F.col("p_partkey") % 4 == 0, F.concat("text", F.lit("x"))).otherwise(F.col("text")).alias("text"), F.col("p_partkey").alias("recency"))
    return matching.tiered(regions, [("exact", matching.exact_pairs(regions, memory)), ("fuzzy", matching.fuzzy_pairs(regions, memory))])


@query("""WITH a AS (SELECT l_orderkey AS asset, avg(1 - l_discount * 4) AS s FROM lineitem GROUP BY 1), r AS (SELECT l_orderkey AS asset, l_suppkey AS id, 1 - l_discount * 4 AS score, l_tax AS tax FROM lineitem)
SELECT r.asset, id, tax FROM r WHERE score >= 0.8 AND EXISTS (SELECT 1 FROM orders o WHERE o_orderkey = r.asset AND o_totalprice / 500000 >= 0.8)""")
def tm_gate(spark, sf_dir):
    """Rows whose own and whose asset's quality reach the floor."""
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("asset"), F.col("l_suppkey").alias("id"), (1 - F.col("l_discount") * 4).alias("score"), F.col("l_returnflag").alias("source"), F.col("l_linestatus").alias("target"), F.col("l_tax").alias("tax"))
    assets = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("asset"), (F.col("o_totalprice") / 500000).alias("asset_score"))
    return matching.quality_gate(rows, assets).select("asset", "id", "tax")


@query("""WITH u AS (SELECT s_suppkey, 's' || s_suppkey AS unit_id, CASE WHEN s_suppkey % 5 = 1 THEN 'n' || s_nationkey END AS note, s_name AS source FROM supplier), g AS (SELECT 's' || (s_suppkey * 2) AS region_id, 'n' || (s_suppkey % 50) AS note, CASE WHEN s_suppkey % 2 = 0 THEN s_name ELSE 'x' || (s_suppkey % 7) END AS source FROM supplier),
b AS (SELECT note, min(region_id) AS region_id FROM g GROUP BY 1 HAVING count(*) = 1), k AS (SELECT """ + norm("source") + """ AS k, min(region_id) AS region_id, count(*) AS n FROM g GROUP BY 1)
SELECT u.unit_id, coalesce(i.region_id, b.region_id, CASE WHEN k.n = 1 THEN k.region_id END) AS region_id, CASE WHEN i.region_id IS NOT NULL THEN 'id' WHEN b.region_id IS NOT NULL THEN 'bbox' WHEN k.n = 1 THEN 'source' WHEN k.n > 1 THEN 'ambiguous' ELSE 'unresolved' END AS how
FROM u LEFT JOIN (SELECT DISTINCT region_id FROM g) i ON i.region_id = u.unit_id LEFT JOIN b ON b.note = u.note LEFT JOIN k ON k.k = """ + norm("u.source") + " AND k.k <> ''")
def interchange_resolve(spark, sf_dir):
    """Imported units by id, box note or unique source."""
    s = table(spark, sf_dir, "supplier")
    units = s.select(F.concat(F.lit("s"), F.col("s_suppkey").cast("string")).alias("unit_id"), F.when(F.col("s_suppkey") % 5 == 1, F.concat(F.lit("n"), F.col("s_nationkey").cast("string"))).alias("note"), F.col("s_name").alias("source"))
    regions = s.select(
        F.concat(F.lit("s"), (F.col("s_suppkey") * 2).cast("string")).alias("region_id"), F.concat(F.lit("n"), (F.col("s_suppkey") % 50).cast("string")).alias("note"),
        F.when(F.col("s_suppkey") % 2 == 0, F.col("s_name")).otherwise(F.concat(F.lit("x"), (F.col("s_suppkey") % 7).cast("string"))).alias("source"),
    )
    return matching.resolve_imports(units, regions)


@query(f"""SELECT {norm('p_name')} AS term, count(*) AS n_rows, count(DISTINCT {norm('p_type')}) AS n_targets, count(DISTINCT {norm('p_type')}) <= 1 AS consistent FROM part GROUP BY 1 HAVING {norm('p_name')} <> ''""")
def terminology(spark, sf_dir):
    """Whether every source term has one target."""
    return matching.terminology(table(spark, sf_dir, "part").select(F.col("p_name").alias("source"), F.col("p_type").alias("target")))


@query("""WITH b AS (SELECT DISTINCT 'en' AS src_lang, CASE WHEN p_partkey % 2 = 0 THEN 'de' ELSE 'fr' END AS targ_lang, p_name AS source, 'b' AS origin FROM part), u AS (SELECT DISTINCT 'en' AS src_lang, 'de' AS targ_lang, p_name AS source, 'u' AS origin FROM part WHERE p_size < 10)
SELECT * FROM u UNION ALL SELECT * FROM b WHERE NOT EXISTS (SELECT 1 FROM u WHERE u.src_lang = b.src_lang AND u.targ_lang = b.targ_lang AND u.source = b.source)""")
def glossary_merge(spark, sf_dir):
    """Uploaded terms over built-in ones."""
    p = table(spark, sf_dir, "part")
    built = p.select(F.lit("en").alias("src_lang"), F.when(F.col("p_partkey") % 2 == 0, "de").otherwise("fr").alias("targ_lang"), F.col("p_name").alias("source"), F.lit("b").alias("origin")).distinct()
    sent = p.where("p_size < 10").select(F.lit("en").alias("src_lang"), F.lit("de").alias("targ_lang"), F.col("p_name").alias("source"), F.lit("u").alias("origin")).distinct()
    return matching.merge_glossaries(built, sent, "merge")


# Boxes


def halves(spark, sf_dir):
    b = boxes(spark, sf_dir)
    return b.where("backend = 0"), b.where("backend = 1")


@query(f"WITH {BOXES}, {PAIRS} SELECT asset, a_id, b_id, iou FROM pairs WHERE a_backend = 0 AND b_backend = 1 AND iou >= 0.5")
def iou_pairs(spark, sf_dir):
    """Boxes of two backends that overlap by half."""
    return spatial.iou_pairs(*halves(spark, sf_dir)).select("asset", "a_id", "b_id", "iou")


@query(f"WITH {BOXES}, {PAIRS} SELECT b.asset, b.id, coalesce(max(p.iou), 0) AS best_iou FROM boxes b LEFT JOIN pairs p ON p.asset = b.asset AND p.a_id = b.id AND p.b_backend = 1 WHERE b.backend = 0 GROUP BY 1, 2")
def best_iou(spark, sf_dir):
    """Each true box's best overlap."""
    return spatial.best_iou(*halves(spark, sf_dir))


@query(f"WITH {BOXES}, {PAIRS} SELECT b.asset, b.id, coalesce(max(p.iou), 0) AS neighbour_iou FROM boxes b LEFT JOIN pairs p ON p.asset = b.asset AND p.a_id = b.id AND p.b_id <> b.id GROUP BY 1, 2")
def neighbour_iou(spark, sf_dir):
    """Each box's largest overlap with another."""
    return spatial.neighbour_iou(boxes(spark, sf_dir))


@query(f"""WITH {BOXES}, {PAIRS} SELECT asset, id, text FROM boxes b WHERE NOT EXISTS (SELECT 1 FROM pairs p WHERE p.asset = b.asset AND p.a_id = b.id AND length(b_text) > length(a_text) AND contains(b_text, a_text) AND inter / least(aw * ah, bw * bh) > 0.5)""")
def fragment_prune(spark, sf_dir):
    """Boxes that are no part of a longer text over the same place."""
    return spatial.prune_fragments(boxes(spark, sf_dir)).select("asset", "id", "text")


@query(f"""WITH {BOXES}, {PAIRS}, r AS (SELECT *, inter / (aw * ah) AS cover, row_number() OVER (PARTITION BY asset, a_id ORDER BY inter / (aw * ah) DESC, b_id) AS k FROM pairs WHERE a_backend = 0 AND b_backend = 1 AND inter / (aw * ah) >= 0.5)
SELECT b.asset, b.id, r.b_id AS surface_id, r.cover FROM boxes b LEFT JOIN r ON r.asset = b.asset AND r.a_id = b.id AND k = 1 WHERE b.backend = 0""")
def surface_cover(spark, sf_dir):
    """The surface that covers most of each box."""
    return spatial.covering_surface(*halves(spark, sf_dir))


@query(f"""WITH {BOXES}, {PAIRS}, r AS (SELECT *, row_number() OVER (PARTITION BY asset, a_id ORDER BY bw * bh, b_id) AS k FROM pairs WHERE a_backend = 0 AND b_backend = 1 AND 2 * ax + aw BETWEEN 2 * bx AND 2 * (bx + bw) AND 2 * ay + ah BETWEEN 2 * by_ AND 2 * (by_ + bh))
SELECT b.asset, b.id, r.b_id AS region_id FROM boxes b LEFT JOIN r ON r.asset = b.asset AND r.a_id = b.id AND k = 1 WHERE b.backend = 0""")
def containing_region(spark, sf_dir):
    """The smallest region that holds each box's centre."""
    return spatial.containing_region(*halves(spark, sf_dir))


@query(f"""WITH {BOXES}, {PAIRS} SELECT asset, id, 'primary' AS origin FROM boxes WHERE backend = 0 UNION ALL SELECT asset, id, 'secondary' FROM boxes b WHERE backend = 1 AND NOT EXISTS (SELECT 1 FROM pairs p WHERE p.asset = b.asset AND p.a_id = b.id AND p.b_backend = 0 AND inter / least(aw * ah, bw * bh) > 0.5)""")
def authoritative_union(spark, sf_dir):
    """Primary boxes, and secondary ones that no primary covers."""
    return spatial.authoritative_union(*halves(spark, sf_dir)).select("asset", "id", "origin")


@query(f"WITH {BOXES} SELECT asset, min(x) AS x, min(y) AS y, max(x + w) - min(x) AS w, max(y + h) - min(y) AS h FROM boxes GROUP BY 1")
def union_bbox(spark, sf_dir):
    """The box around an asset's boxes."""
    return spatial.union_box(boxes(spark, sf_dir), ["asset"])


@query()
def box_suppression(spark, sf_dir):
    """Greedy suppression within each asset."""
    return spatial.suppress(boxes(spark, sf_dir))


@query()
def greedy_match(spark, sf_dir):
    """One-to-one matches of two backends' boxes."""
    return spatial.greedy_match(*halves(spark, sf_dir), 0.3)


@query()
def reading_lines(spark, sf_dir):
    """Lines and reading order of each asset's boxes."""
    return spatial.reading_lines(boxes(spark, sf_dir)).select("asset", "id", "line", "reading_order")


@query(f"""WITH {BOXES}, v AS (SELECT asset, lang, CAST(sum(greatest(1, w * h)) AS BIGINT) AS area FROM boxes GROUP BY 1, 2) SELECT asset, lang, area FROM (SELECT *, row_number() OVER (PARTITION BY asset ORDER BY area DESC, lang) AS r FROM v) WHERE r = 1""")
def scene_language(spark, sf_dir):
    """The language with most area in each asset."""
    return metrics.area_vote(boxes(spark, sf_dir), ["asset"], "lang")


@query(f"WITH {BOXES} SELECT asset, CAST(sum(CAST(round(conf * 100) AS BIGINT) * w * h) AS BIGINT) / CAST(sum(w * h) AS BIGINT) AS conf FROM boxes GROUP BY 1")
def merge_confidence(spark, sf_dir):
    """Area-weighted mean confidence, in percent."""
    area = F.col("w") * F.col("h")
    return boxes(spark, sf_dir).groupBy("asset").agg((F.sum(F.round(F.col("conf") * 100).cast("bigint") * area) / F.sum(area)).alias("conf"))


@query(f"""WITH {BOXES} SELECT asset, id, CASE WHEN least(x + w, 100) - greatest(x, 10) > 0 AND least(y + h, 50) - greatest(y, 5) > 0 THEN (least(x + w, 100) - greatest(x, 10)) * (least(y + h, 50) - greatest(y, 5)) ELSE 0 END AS inside, h > w * 1.5 AS tall FROM boxes""")
def box_scalars(spark, sf_dir):
    """Area inside a frame, and orientation."""
    frame = boxes(spark, sf_dir).withColumns({"f_x": F.lit(10).cast("bigint"), "f_y": F.lit(5).cast("bigint"), "f_w": F.lit(90).cast("bigint"), "f_h": F.lit(45).cast("bigint")})
    return frame.select("asset", "id", geo.intersection(geo.Box(), geo.Box("f_")).alias("inside"), geo.is_tall(geo.Box()).alias("tall"))


@query(f"WITH {BOXES}, {PAIRS} SELECT asset, a_id, b_id, CAST(inter AS BIGINT) AS common FROM pairs WHERE a_backend = 0 AND b_backend = 1")
def polygon_overlap(spark, sf_dir):
    """Common area of overlapping boxes as polygons, clipped side by side."""
    p = spatial.overlapping_pairs(*halves(spark, sf_dir))
    common = geo.polygon_intersection(geo.box_polygon(geo.Box("a_")), geo.box_polygon(geo.Box("b_")))
    return p.select("asset", "a_id", "b_id", F.round(common).cast("bigint").alias("common"))


@query(f"""WITH {BOXES}, {PAIRS}, c AS (SELECT *, inter / (aw * ah) AS holds, inter / (bw * bh) AS within FROM pairs WHERE a_backend = 0 AND b_backend = 1),
s AS (SELECT asset, b_id, count(*) AS spans FROM c WHERE holds >= 0.6 GROUP BY 1, 2), p AS (SELECT c.*, coalesce(spans, 0) AS spans, iou >= 0.1 AS touch, iou >= 0.1 AND within >= 0.8 AS inside FROM c LEFT JOIN s USING (asset, b_id)),
d AS (SELECT p.asset, p.a_id, sum(q.inter) AS twice FROM p JOIN p r ON r.asset = p.asset AND r.a_id = p.a_id AND r.b_id > p.b_id AND p.inside AND r.inside JOIN pairs q ON q.asset = p.asset AND q.a_id = p.b_id AND q.b_id = r.b_id GROUP BY 1, 2),
b AS (SELECT asset, a_id, iou, holds, within FROM (SELECT *, row_number() OVER (PARTITION BY asset, a_id ORDER BY iou DESC, b_id) AS r FROM p) WHERE r = 1),
g AS (SELECT asset, a_id, bool_or(touch) AS touched, bool_or(holds >= 0.6) AS swallowed, bool_or(touch AND spans >= 2) AS spanned, count(*) FILTER (inside) AS n_inside, sum(inter) FILTER (inside) AS covered FROM p GROUP BY 1, 2)
SELECT t.asset, t.id, coalesce(b.iou, 0) AS best_iou, CASE WHEN b.iou IS NULL THEN 'missed' WHEN b.iou >= 0.5 THEN 'matched' WHEN NOT touched AND swallowed THEN 'over_merged' WHEN NOT touched THEN 'missed' WHEN spanned THEN 'over_merged'
  WHEN n_inside >= 2 AND (covered - coalesce(twice, 0)) / (t.w * t.h) >= 0.5 THEN 'fragmented' WHEN b.within >= 0.9 AND b.holds < 0.5 THEN 'clipped' ELSE 'displaced' END AS outcome
FROM boxes t LEFT JOIN b ON b.asset = t.asset AND b.a_id = t.id LEFT JOIN g ON g.asset = t.asset AND g.a_id = t.id LEFT JOIN d ON d.asset = t.asset AND d.a_id = t.id WHERE t.backend = 0""")
def region_outcomes(spark, sf_dir):
    """What became of every true region."""
    return detection.taxonomy(*halves(spark, sf_dir)).drop("merged_by")


def block_inputs(spark, sf_dir):
    """Three requested texts of every asset, and its boxes as candidates; boxes of one backend are shipped."""
    b = boxes(spark, sf_dir)
    asked = F.array(*[F.struct(F.lit(i).alias("place"), F.lit(t).alias("text")) for i, t in enumerate(("A", "RR", "NNN"))])
    blocks = b.select("asset").distinct().withColumn("b", F.explode(asked)).select("asset", F.col("b.text").alias("block"), F.col("b.place").alias("place"), F.col("b.text").alias("text"), F.lit(None).cast("int").alias("expected"))
    return blocks, b.select("asset", "id", "text", (F.col("backend") == 0).alias("shipped"))


@query(f"""WITH {BOXES}, k(block) AS (VALUES ('A'), ('RR'), ('NNN')), a AS (SELECT DISTINCT asset FROM boxes), n AS (SELECT asset, text AS block, least(count(*), 12) AS n FROM boxes GROUP BY 1, 2)
SELECT a.asset, k.block, coalesce(n.n, 0) AS n, CASE WHEN n.n IS NULL THEN 'not_detected' WHEN n.n > 1 THEN 'multiple' ELSE 'found' END AS state FROM a CROSS JOIN k LEFT JOIN n ON n.asset = a.asset AND n.block = k.block""")
def locate_blocks(spark, sf_dir):
    """Requested texts with their claimed occurrences and state."""
    blocks, candidates = block_inputs(spark, sf_dir)
    return detection.located(blocks, detection.locate(blocks, candidates))


# Plates


def plated(spark, sf_dir):
    """Regions in order of id; every tenth asset has its first two regions pinned."""
    r = boxes(spark, sf_dir).select("asset", "id", "x", "y", "w", "h", "text", F.col("id").alias("reading_order"), F.lit(False).alias("square"))
    pinned = r.where("asset % 10 = 0").select("asset").distinct().select("asset", F.concat(F.lit("pin-"), F.col("asset").cast("string")).alias("uid"), F.array(F.lit(1).cast("bigint"), F.lit(2).cast("bigint")).alias("members"))
    return r, plating.group(r, plating.nearby_edges(r), pinned)


@query(f"""WITH RECURSIVE {BOXES}, f AS (SELECT * FROM boxes WHERE NOT (asset % 10 = 0 AND id <= 2)),
e AS (SELECT a.asset, a.id AS a, b.id AS b FROM f a JOIN f b ON a.asset = b.asset AND a.id <> b.id AND ((abs(a.y + a.h / 2 - b.y - b.h / 2) <= greatest(a.h, b.h) * 0.46::DOUBLE AND greatest(0, a.x - b.x - b.w, b.x - a.x - a.w) <= greatest(a.h, b.h) * 2.5::DOUBLE)
  OR (greatest(0, a.y - b.y - b.h, b.y - a.y - a.h) <= greatest(a.h, b.h) * 1.6::DOUBLE AND greatest(0, least(a.x + a.w, b.x + b.w) - greatest(a.x, b.x)) / least(a.w, b.w) >= 0.18::DOUBLE))),
r AS (SELECT asset, id, id AS t FROM f UNION SELECT r.asset, r.id, e.b FROM r JOIN e ON e.asset = r.asset AND e.a = r.t), c AS (SELECT asset, id, min(t) AS root FROM r GROUP BY 1, 2),
p AS (SELECT f.asset, string_agg(CAST(f.id AS VARCHAR), ',' ORDER BY f.id) AS members, string_agg(f.text, chr(10) ORDER BY f.id) AS source, min(f.id) AS first, CASE WHEN count(*) > 1 THEN 'derived' ELSE 'solo' END AS origin FROM f JOIN c ON c.asset = f.asset AND c.id = f.id GROUP BY f.asset, c.root
  UNION ALL SELECT asset, '1,2', string_agg(text, chr(10) ORDER BY id) FILTER (id <= 2), 1, 'pinned' FROM boxes WHERE asset % 10 = 0 GROUP BY 1)
SELECT asset, row_number() OVER (PARTITION BY asset ORDER BY first) AS plate, members, source, origin FROM p""")
def plates(spark, sf_dir):
    """Regions grouped to plates, pinned ones kept."""
    _, p = plated(spark, sf_dir)
    return p.select("asset", "plate", F.array_join(F.transform("members", lambda i: i.cast("string")), ",").alias("members"), "source", "origin")


@query(f"""WITH {BOXES}, n AS (SELECT asset, count(*) AS n FROM boxes GROUP BY 1) SELECT asset, 'pin-' || asset AS uid, 'missing_region' AS problem FROM n WHERE asset % 10 = 0 AND n < 2""")
def plate_problems(spark, sf_dir):
    """Plates that name a region that is gone."""
    r, p = plated(spark, sf_dir)
    return plating.problems(p, r)


@query()
def tracks(spark, sf_dir):
    """Boxes of an asset's line numbers as frames, followed through them."""
    b = boxes(spark, sf_dir).withColumns({"frame": F.col("id"), "shot": F.col("backend")})
    return tracker.track(b)


# Evidence


ENGINE = "CASE backend WHEN 0 THEN 'easyocr' ELSE 'paddleocr' END"


def engine():
    """The engine that the driver's backend number stands for."""
    return F.when(F.col("backend") == 0, "easyocr").otherwise("paddleocr")


def _knots_sql(x, backend):
    out = "CASE"
    for name, knots in evidence.KNOTS.items():
        for (x0, y0), (x1, y1) in zip(knots, knots[1:]):
            out += f" WHEN {backend} = '{name}' AND {x} <= {x1}::DOUBLE THEN {y0}::DOUBLE + ({x} - {x0}::DOUBLE) * {y1 - y0!r}::DOUBLE / {x1 - x0!r}::DOUBLE"
        out += f" WHEN {backend} = '{name}' AND {x} IS NOT NULL THEN {knots[-1][1]}::DOUBLE"
    return out + " END"


@query(f"WITH {BOXES} SELECT asset, id, {_knots_sql('conf', ENGINE)} AS calibrated FROM boxes")
def calibrated_confidence(spark, sf_dir):
    """Raw confidences through each engine's knots."""
    return boxes(spark, sf_dir).select("asset", "id", evidence.calibrated("conf", engine()).alias("calibrated"))


@query(f"""WITH r AS (SELECT l_orderkey AS asset, l_linenumber AS id, l_partkey, l_suppkey, l_quantity / 50 AS ink, l_extendedprice / 100000 AS geometry, 'easyocr' AS pe, CASE l_linenumber % 4 WHEN 0 THEN 'EasyOCR' WHEN 1 THEN 'other' ELSE 'paddleocr' END AS ae,
  l_discount * 10 AS praw, l_tax * 12.5::DOUBLE AS araw, l_returnflag AS pk, CASE l_suppkey % 5 WHEN 0 THEN '' WHEN 1 THEN l_returnflag ELSE 'Z' END AS ak, CASE WHEN l_linestatus = 'F' THEN 'Latn' END AS ps, CASE WHEN l_partkey % 2 = 0 THEN 'Latn' ELSE 'Cyrl' END AS sc,
  CASE l_partkey % 3 WHEN 0 THEN ['en', 'fr'] WHEN 1 THEN ['de'] ELSE [] END AS al, l_quantity > 45 AS risky FROM lineitem),
c AS (SELECT *, {_knots_sql('praw', 'pe')} AS pc, {_knots_sql('araw', 'lower(ae)')} AS ac FROM r),
g AS (SELECT *, list_filter([CASE WHEN ps IS NOT NULL AND ps <> sc THEN 'script_incompatible' END, CASE WHEN len(al) > 0 AND NOT list_contains(al, 'en') THEN 'language_incompatible' END], lambda x: x IS NOT NULL) AS gates,
  list_filter([CASE WHEN ink < 0.55::DOUBLE THEN 'insufficient_ink_support' END, CASE WHEN geometry < 0.65::DOUBLE THEN 'insufficient_geometry_support' END, CASE WHEN ac < 0.78::DOUBLE THEN 'below_absolute_floor' END, CASE WHEN ac - pc < 0.12::DOUBLE THEN 'insufficient_calibrated_margin' END], lambda x: x IS NOT NULL) AS floors FROM c)
SELECT asset, id, l_partkey, l_suppkey, CASE WHEN ak = '' OR lower(ae) = pe THEN 'reject' WHEN pc IS NULL OR ac IS NULL THEN 'review' WHEN ak = pk THEN 'agree' WHEN risky OR len(gates) > 0 THEN 'reject' WHEN len(floors) > 0 THEN 'review' ELSE 'accept' END AS decision,
  CASE WHEN ak = '' THEN 'alternate_empty' WHEN lower(ae) = pe THEN 'same_backend' WHEN pc IS NULL OR ac IS NULL THEN 'uncalibrated_engine' WHEN ak = pk THEN 'consensus_text' WHEN risky THEN 'risky_alternate' WHEN len(gates) > 0 THEN array_to_string(gates, ',')
    WHEN len(floors) > 0 THEN array_to_string(floors, ',') || ',conflicting_text' ELSE 'alternate_accepted' END AS reasons FROM g""")
def arbitrate(spark, sf_dir):
    """The arbitration ladder over two readings of every line, with reasons."""
    n = F.col("l_linenumber") % 4
    listed = lambda *x: F.array(*map(F.lit, x)).cast("array<string>")
    none = F.lit(None).cast("string")
    primary = F.struct(F.lit("easyocr").alias("engine"), F.col("l_returnflag").alias("key"), (F.col("l_discount") * 10).alias("raw"), F.when(F.col("l_linestatus") == "F", "Latn").otherwise(none).alias("script"), listed("en").alias("languages"), listed().alias("risk_flags"))
    alternate = F.struct(
        F.when(n == 0, "EasyOCR").when(n == 1, "other").otherwise("paddleocr").alias("engine"),
        F.when(F.col("l_suppkey") % 5 == 0, "").when(F.col("l_suppkey") % 5 == 1, F.col("l_returnflag")).otherwise("Z").alias("key"), (F.col("l_tax") * 12.5).alias("raw"),
        F.when(F.col("l_partkey") % 2 == 0, "Latn").otherwise("Cyrl").alias("script"),
        F.when(F.col("l_partkey") % 3 == 0, listed("en", "fr")).when(F.col("l_partkey") % 3 == 1, listed("de")).otherwise(listed()).alias("languages"), F.when(F.col("l_quantity") > 45, listed("r")).otherwise(listed()).alias("risk_flags"),
    )
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", primary.alias("p"), alternate.alias("a"))
    d = evidence.arbitrate("p", "a", F.col("l_quantity") / 50, F.col("l_extendedprice") / 100000)
    return rows.select(F.col("l_orderkey").alias("asset"), F.col("l_linenumber").alias("id"), "l_partkey", "l_suppkey", d.alias("d")).select("asset", "id", "l_partkey", "l_suppkey", F.col("d.decision").alias("decision"), F.array_join("d.reasons", ",").alias("reasons"))


@query(f"""WITH {BOXES}, b AS (SELECT asset, id, CASE WHEN id % 3 = 0 THEN conf * 3 END AS peak, CASE WHEN id % 5 <> 0 THEN h - 6 END AS height, CASE WHEN id % 4 = 1 THEN ' ' ELSE text END AS text, CASE WHEN w > 65 THEN 'unresolvable' WHEN state = 'F' THEN 'review_required' END AS quality, CASE WHEN id % 2 = 0 THEN conf * 10 END AS conf, conf * 5 AS margin FROM boxes),
s AS (SELECT *, CASE WHEN peak < 0.1::DOUBLE THEN 'no_detector_activation' WHEN peak < 0.2::DOUBLE THEN 'detector_activation_below_proposal_floor' WHEN trim(text) = '' THEN 'no_text_recovered' WHEN height < 12 THEN 'glyph_height_below_legible' WHEN quality = 'unresolvable' THEN 'ocr_unresolvable'
  WHEN quality = 'review_required' THEN 'ocr_review_required' WHEN conf < 0.3::DOUBLE THEN 'low_recognition_confidence' WHEN peak IS NULL AND height IS NULL THEN 'nothing_measured' ELSE '' END AS reasons FROM b),
t AS (SELECT *, CASE reasons WHEN 'no_detector_activation' THEN 'absent' WHEN 'no_text_recovered' THEN CASE WHEN peak IS NULL THEN 'absent' ELSE 'weak' END WHEN 'ocr_review_required' THEN 'partial' WHEN 'low_recognition_confidence' THEN 'partial' WHEN 'nothing_measured' THEN 'unknown' WHEN '' THEN 'present' ELSE 'weak' END AS state FROM s)
SELECT asset, id, state, reasons, CASE WHEN state IN ('absent', 'unknown') THEN 'unresolvable' WHEN state = 'present' AND margin >= 0.45::DOUBLE THEN 'accepted' ELSE 'review_required' END AS decision FROM t""")
def survival(spark, sf_dir):
    """Evidence states with their reasons, and the margin decision."""
    state = F.when(F.col("w") > 65, "unresolvable").when(F.col("state") == "F", "review_required")
    found = evidence.survival(
        F.when(F.col("id") % 3 == 0, F.col("conf") * 3), F.when(F.col("id") % 5 != 0, F.col("h") - 6), F.when(F.col("id") % 4 == 1, " ").otherwise(F.col("text")), state, F.when(F.col("id") % 2 == 0, F.col("conf") * 10),
    )
    rows = boxes(spark, sf_dir).select("asset", "id", found.alias("s"), (F.col("conf") * 5).alias("margin"))
    return rows.select("asset", "id", F.col("s.state").alias("state"), F.array_join("s.reasons", ",").alias("reasons"), evidence.margin_decision("s.state", "margin", 0.45).alias("decision"))


@query(f"""WITH {BOXES} SELECT asset, id, CASE WHEN id % 6 = 0 THEN 'forced' WHEN id % 5 = 0 THEN 'scene_cut' WHEN id = 1 THEN 'track_birth' WHEN lang = 'R' THEN 'occlusion_recovery' WHEN conf * 10 < 0.55::DOUBLE THEN 'confidence_decay' WHEN w / 100 > 0.35::DOUBLE THEN 'visual_change' WHEN state = 'F' THEN 'keyframe' END AS reason FROM boxes""")
def reading_triggers(spark, sf_dir):
    """Why each box is read again."""
    reason = evidence.trigger(F.col("id") % 6 == 0, F.col("id") % 5 == 0, F.col("id") == 1, F.col("lang") == "R", F.col("conf") * 10, F.col("w") / 100, F.col("state") == "F")
    return boxes(spark, sf_dir).select("asset", "id", reason.alias("reason"))


@query(f"""WITH {BOXES}, g AS (SELECT asset, count(*) AS n, CAST(sum(CASE WHEN conf < 0.02::DOUBLE THEN 1 ELSE 0 END) AS BIGINT) AS low, count(DISTINCT lang) AS langs FROM boxes GROUP BY 1)
SELECT asset, n, CASE WHEN low * 2 > n THEN 'fail' WHEN low > 0 OR langs > 2 THEN 'review' ELSE 'pass' END AS status, CASE WHEN low * 2 > n THEN 49 WHEN low > 0 OR langs > 2 THEN 79 ELSE 100 END AS cap FROM g""")
def coverage_gates(spark, sf_dir):
    """Gates only ever lower a status."""
    g = boxes(spark, sf_dir).groupBy("asset").agg(F.count("*").alias("n"), F.count_if(F.col("conf") < 0.02).alias("low"), F.countDistinct("lang").alias("langs"))
    fail, flag = F.col("low") * 2 > F.col("n"), (F.col("low") > 0) | (F.col("langs") > 2)
    status = evidence.gated_status(F.lit("pass"), F.when(fail, "fail").otherwise("pass"), F.when(flag, "review").otherwise("pass"))
    return g.select("asset", "n", status.alias("status"), evidence.critical_cap(fail, flag).alias("cap"))


@query("""WITH c AS (SELECT l_orderkey AS asset, l_partkey, l_suppkey, l_linenumber, CASE WHEN l_returnflag <> 'N' THEN l_quantity END AS coverage, CASE WHEN l_linestatus = 'F' THEN l_tax * 100 END AS content, l_discount * 100 AS spatial FROM lineitem)
SELECT asset, l_partkey, l_suppkey, l_linenumber, (coalesce(coverage * 0.2::DOUBLE, 0) + coalesce(content * 0.2::DOUBLE, 0) + coalesce(spatial * 0.2::DOUBLE, 0)) / ((CASE WHEN coverage IS NOT NULL THEN 0.2::DOUBLE ELSE 0 END) + (CASE WHEN content IS NOT NULL THEN 0.2::DOUBLE ELSE 0 END) + 0.2::DOUBLE) AS score FROM c""")
def component_score(spark, sf_dir):
    """Mean of the measured components, weights rescaled."""
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("asset"), "l_partkey", "l_suppkey", "l_linenumber", F.when(F.col("l_returnflag") != "N", F.col("l_quantity")).alias("coverage"), F.when(F.col("l_linestatus") == "F", F.col("l_tax") * 100).alias("content"), (F.col("l_discount") * 100).alias("spatial"))
    return rows.select("asset", "l_partkey", "l_suppkey", "l_linenumber", evidence.component_score({k: k for k in ("coverage", "content", "spatial")}).alias("score"))


@query(f"""WITH {BOXES}, o AS (SELECT *, {ENGINE} AS engine, conf * 10 AS raw, CASE WHEN state = 'F' THEN 'Latn' WHEN id % 2 = 0 THEN 'Cyrl' END AS script FROM boxes WHERE id % 7 <> 0), k AS (SELECT *, {_knots_sql('raw', 'engine')} AS sure FROM o),
{PAIRS}, q AS (SELECT asset, sum(iou) AS common FROM pairs WHERE a_id < b_id AND a_id % 7 <> 0 AND b_id % 7 <> 0 GROUP BY 1), m AS (SELECT asset, max(c) / sum(c) AS stability FROM (SELECT asset, text, count(*) AS c FROM k GROUP BY 1, 2) GROUP BY 1),
r AS (SELECT asset, count(*) AS n, count(DISTINCT engine) AS engines, max(sure) AS confidence, count(DISTINCT lang) AS langs, count(DISTINCT script) AS scripts FROM k GROUP BY 1),
b AS (SELECT asset, id FROM (SELECT *, row_number() OVER (PARTITION BY asset ORDER BY sure DESC, id) AS place FROM k) WHERE place = 1),
s AS (SELECT r.asset, b.id AS selected_id, n, least(1.0::DOUBLE, (engines - 1) * 0.5::DOUBLE) AS cross_backend, confidence, stability, CASE WHEN n > 1 THEN coalesce(common, 0) / (n * (n - 1) / 2) ELSE 0.5::DOUBLE END AS geometry,
  CASE langs WHEN 0 THEN 0.5::DOUBLE WHEN 1 THEN 1.0::DOUBLE ELSE 0.3::DOUBLE END AS language, CASE scripts WHEN 0 THEN 0.5::DOUBLE WHEN 1 THEN 1.0::DOUBLE ELSE 0.3::DOUBLE END AS glyph FROM r JOIN m ON m.asset = r.asset JOIN b ON b.asset = r.asset LEFT JOIN q ON q.asset = r.asset)
SELECT asset, selected_id, round(geometry, 4) AS geometry, round((cross_backend * 0.3::DOUBLE + confidence * 0.2::DOUBLE + stability * 0.2::DOUBLE + geometry * 0.15::DOUBLE + language * 0.1::DOUBLE + glyph * 0.05::DOUBLE), 4) AS score, array_to_string(CASE WHEN cross_backend = 0 AND (n = 1 OR (stability < 0.8::DOUBLE AND geometry < 0.5::DOUBLE)) THEN ['single_observation'] ELSE
  list_filter([CASE WHEN cross_backend > 0 THEN 'cross_backend_consensus' END, CASE WHEN n > 1 AND stability >= 0.8::DOUBLE THEN 'text_stable' END, CASE WHEN n > 1 AND geometry >= 0.5::DOUBLE THEN 'geometry_aligned' END], lambda x: x IS NOT NULL) END, ',') AS reasons FROM s""")
def hypothesis_score(spark, sf_dir):
    """Signals, score and selected reading of each asset's readings."""
    script = F.when(F.col("state") == "F", "Latn").when(F.col("id") % 2 == 0, "Cyrl")
    rows = boxes(spark, sf_dir).select(
        "asset", "id", engine().alias("backend"), "text", F.col("text").alias("key"), (F.col("conf") * 10).alias("raw"), "x", "y", "w", "h", F.col("lang").alias("language"), script.alias("script"), F.when(F.col("id") % 7 == 0, "lost").alias("error"),
    )
    found = evidence.hypothesis_scores(rows, "asset")
    return found.select("asset", "selected_id", "geometry", "score", F.array_join("reasons", ",").alias("reasons"))


# Metrics


def outcomes(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", (F.least(F.col("n_chars"), F.lit(4000)) / 4000).alias("conf"), "lang")
    return table(spark, sf_dir, "labels").join(docs, "doc_id").select("doc_id", "lang", "conf", F.col("quality").alias("outcome"), "toxic")


_OUT = "o AS (SELECT l.doc_id, lang, least(n_chars, 4000) / 4000 AS conf, quality AS outcome, toxic FROM labels l JOIN documents d ON d.doc_id = l.doc_id)"


@query(f"WITH {_OUT} SELECT CAST(greatest(1, ceil(conf * 10)) AS INTEGER) AS bin, count(*) AS n, CAST(sum(outcome) AS BIGINT) AS hits, CAST(sum(CAST(round(conf * 4000) AS BIGINT)) AS BIGINT) AS conf_4000 FROM o GROUP BY 1")
def ece_bins(spark, sf_dir):
    """Reliability table; confidences are summed as integers."""
    rows = outcomes(spark, sf_dir)
    bins = metrics.calibration_bins(rows.withColumn("c", F.col("conf")))
    whole = rows.groupBy(F.greatest(F.lit(1), F.ceil(F.col("conf") * 10)).cast("int").alias("bin")).agg(F.sum(F.round(F.col("conf") * 4000).cast("bigint")).alias("conf_4000"))
    return bins.join(whole, "bin").select("bin", "n", "hits", "conf_4000")


@query()
def ece_brier(spark, sf_dir):
    """Calibration error, Brier score and log-loss at the fitted temperature."""
    rows = outcomes(spark, sf_dir)
    t = metrics.fit_temperature(rows)
    scores = rows.agg(metrics.brier("conf", "outcome").alias("brier"), metrics.log_loss("conf", "outcome", t).alias("log_loss"), F.lit(t).alias("temperature"))
    return metrics.expected_calibration_error(rows).crossJoin(scores)


@query(f"""WITH {_OUT}, b AS (SELECT conf AS threshold, count(*) AS n, sum(outcome) AS k FROM o GROUP BY 1), r AS (SELECT threshold, sum(n) OVER (ORDER BY threshold DESC) AS acc, sum(k) OVER (ORDER BY threshold DESC) AS ok FROM b) SELECT min(threshold) AS threshold FROM r WHERE acc >= 5 AND ok >= 0.9::DOUBLE * acc""")
def precision_threshold(spark, sf_dir):
    """The lowest confidence from which on nine of ten are right."""
    return metrics.precision_threshold(outcomes(spark, sf_dir), target=0.9)


@query("""WITH c AS (SELECT quality AS a, 1 - toxic AS b FROM labels), t AS (SELECT count(*) AS n, CAST(sum(CASE WHEN a = b THEN 1 ELSE 0 END) AS BIGINT) AS same FROM c), x AS (SELECT CAST(sum(ra * rb) AS BIGINT) AS e FROM (SELECT a AS v, count(*) AS ra FROM c GROUP BY 1) JOIN (SELECT b AS v, count(*) AS rb FROM c GROUP BY 1) USING (v))
SELECT n, same, CASE WHEN e / (n * n) < 1 THEN (same / n - e / (n * n)) / (1 - e / (n * n)) END AS kappa FROM t, x""")
def kappa(spark, sf_dir):
    """Agreement of two judgements."""
    return metrics.cohen_kappa(table(spark, sf_dir, "labels").select("quality", (1 - F.col("toxic")).alias("clean")), "quality", "clean")


@query(f"""WITH {_OUT}, s AS (SELECT unnest(range(20))::INTEGER AS step), q AS (SELECT CAST(least(floor(conf * 20), 19) AS INTEGER) AS b, outcome FROM o), c AS (SELECT step, CAST(sum(CASE WHEN b >= step THEN outcome ELSE 0 END) AS BIGINT) AS tp, CAST(sum(CASE WHEN b >= step THEN 1 - outcome ELSE 0 END) AS BIGINT) AS fp, CAST(sum(CASE WHEN b >= step THEN 0 ELSE outcome END) AS BIGINT) AS fn FROM q, s GROUP BY 1)
SELECT *, CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0 END AS precision, CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0 END AS recall, CASE WHEN 2 * tp + fp + fn > 0 THEN (2 * tp) / (2 * tp + fp + fn) ELSE 0 END AS f1 FROM c""")
def prf_sweep(spark, sf_dir):
    """Precision, recall and F1 by threshold."""
    return metrics.threshold_sweep(outcomes(spark, sf_dir), "conf", "outcome")


@query(f"""WITH {_OUT} SELECT lang, CAST(grouping(lang) AS INTEGER) AS is_total, CAST(sum(outcome * (1 - toxic)) AS BIGINT) AS found, CAST(sum(outcome) AS BIGINT) AS expected, CASE WHEN sum(outcome) > 0 THEN CAST(sum(outcome * (1 - toxic)) AS BIGINT) / CAST(sum(outcome) AS BIGINT) END AS recall, sum(outcome) >= 30 AS sufficient FROM o GROUP BY ROLLUP (lang)""")
def strata_recall(spark, sf_dir):
    """Recall by language and in all."""
    rows = outcomes(spark, sf_dir).withColumn("found", F.col("outcome") * (1 - F.col("toxic")))
    return metrics.strata_recall(rows, "lang", "found", "outcome")


@query()
def mcnemar(spark, sf_dir):
    """Exact paired test of two judgements."""
    rows = table(spark, sf_dir, "labels").select((F.col("quality") == 1).alias("a"), (F.col("toxic") == 1).alias("b"))
    return metrics.mcnemar(rows, "a", "b")


@query(f"""WITH {BOXES} SELECT a.asset, count(*) AS n_pairs, CAST(sum(CASE WHEN sign(a.h - b.h) = sign(a.conf - b.conf) THEN 1 ELSE 0 END) AS BIGINT) AS n_kept FROM boxes a JOIN boxes b ON a.asset = b.asset AND a.id < b.id AND a.h <> b.h GROUP BY 1""")
def hierarchy_concordance(spark, sf_dir):
    """Whether the order of heights is kept by confidence."""
    return metrics.concordance(boxes(spark, sf_dir), "asset", "id", "h", "conf")


@query()
def bootstrap_interval(spark, sf_dir):
    """A bootstrap interval of the mean value."""
    return metrics.bootstrap_mean(table(spark, sf_dir, "events"), "value", "event_id")


# Graph


@query("""WITH RECURSIVE e AS (SELECT 'N' || n_nationkey AS child, 'R' || n_regionkey AS parent FROM nation UNION SELECT 'S' || s_suppkey, 'N' || s_nationkey FROM supplier),
c AS (SELECT child, parent AS ancestor, 1::BIGINT AS distance FROM e UNION ALL SELECT c.child, e.parent, c.distance + 1 FROM c JOIN e ON e.child = c.ancestor) SELECT child, ancestor, min(distance) AS distance FROM c GROUP BY 1, 2""")
def lineage_closure(spark, sf_dir):
    """All ancestors of every node, nearest first."""
    name = lambda p, c: F.concat(F.lit(p), F.col(c).cast("string"))
    e = table(spark, sf_dir, "nation").select(name("N", "n_nationkey").alias("child"), name("R", "n_regionkey").alias("parent"))
    return graph.ancestors(e.union(table(spark, sf_dir, "supplier").select(name("S", "s_suppkey"), name("N", "s_nationkey"))))


@query("""WITH RECURSIVE n AS (SELECT p_partkey AS id FROM part), e AS (SELECT p_partkey AS a, (p_partkey * 3) % 97 AS b FROM part WHERE p_partkey % 4 <> 0), f AS (SELECT a, b FROM e WHERE b IN (SELECT id FROM n)), d AS (SELECT a, b FROM f UNION SELECT b, a FROM f),
r AS (SELECT id, id AS to_ FROM n UNION SELECT r.id, d.b FROM r JOIN d ON d.a = r.to_) SELECT id, min(to_) AS component FROM r GROUP BY 1""")
def components(spark, sf_dir):
    """Connected components by the least id."""
    n = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"))
    e = table(spark, sf_dir, "part").where("p_partkey % 4 <> 0").select(F.col("p_partkey").alias("a"), ((F.col("p_partkey") * 3) % 97).alias("b"))
    return graph.components(e.join(n.select(F.col("id").alias("b")), "b", "left_semi"), n)


@query("""SELECT l_linestatus AS stage, count(*) FILTER (l_returnflag = 'A') AS active, count(*) FILTER (l_returnflag = 'N') AS suppressed, count(*) FILTER (l_returnflag = 'R') AS retired FROM lineitem GROUP BY 1""")
def suppression_pivot(spark, sf_dir):
    """States by stage."""
    state = {"A": "active", "N": "suppressed", "R": "retired"}
    rows = table(spark, sf_dir, "lineitem").groupBy(F.col("l_linestatus").alias("stage")).pivot("l_returnflag", list(state)).count()
    return rows.select("stage", *[F.coalesce(F.col(k), F.lit(0).cast("bigint")).alias(v) for k, v in state.items()])


@query("""SELECT user_id AS node, event_type AS state, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM events) WHERE r = 1""")
def decision_ledger(spark, sf_dir):
    """The last state of each node."""
    return graph.last_state(table(spark, sf_dir, "events"), ["user_id"], F.desc("ts"), F.desc("event_id")).select(F.col("user_id").alias("node"), F.col("event_type").alias("state"), "event_id")


# Language model

_TOKENS = """t AS (SELECT doc_id, list_filter(regexp_split_to_array(regexp_replace(replace(lower(text), 'ß', 'ss'), '([^\\p{L}\\p{N}\\s])', ' \\1 ', 'g'), '\\s+'), lambda x: x <> '') AS w FROM documents), b AS (SELECT doc_id, unnest(list_concat(['<s>'], w[1:len(w) - 1])) AS prev, unnest(w) AS token FROM t WHERE len(w) > 0), g AS (SELECT prev, token, count(*) AS n FROM b GROUP BY 1, 2)"""


@query(f"WITH {_TOKENS} SELECT token, CAST(sum(n) AS BIGINT) AS n, count(*) AS contexts FROM g GROUP BY 1 HAVING sum(n) >= 2")
def ngram_counts(spark, sf_dir):
    """Tokens seen twice or more, with their contexts."""
    unigrams, _ = language_model.counts(language_model.tokens(table(spark, sf_dir, "documents")))
    return unigrams.where("n >= 2")


@query()
def lm_score(spark, sf_dir):
    """Mean log probability of every text."""
    counted = language_model.document_counts(table(spark, sf_dir, "documents"))
    return language_model.score(counted, *language_model.counts(counted))


# Streams (batch forms)


@query(f"""WITH {FRAMES}, v AS (SELECT track, lower(text) AS key, CAST(sum(CAST(round(value * 100) AS BIGINT)) AS BIGINT) AS mass, count(*) AS n FROM frames GROUP BY 1, 2) SELECT track, key, mass, n, mass / total AS share FROM (SELECT *, CAST(sum(mass) OVER (PARTITION BY track) AS BIGINT) AS total, row_number() OVER (PARTITION BY track ORDER BY mass DESC, key) AS r FROM v) WHERE r = 1""")
def consensus_vote(spark, sf_dir):
    """Each track's heaviest text and its share."""
    rows = observations(spark, sf_dir).withColumns({"conf": F.round(F.col("value") * 100).cast("bigint"), "sharpness": F.lit(100)})
    weight = ev.consensus(rows)
    return weight.select("track", "key", F.col("mass").cast("bigint").alias("mass"), "n", "share")


@query("""SELECT event_id, user_id, count(*) OVER (PARTITION BY user_id ORDER BY epoch_us(ts) RANGE BETWEEN 86399999999 PRECEDING AND CURRENT ROW) AS in_window FROM events""")
def rate_window(spark, sf_dir):
    """Events of the last day by caller."""
    return ev.rate_window(table(spark, sf_dir, "events"), "user_id", 86_400).select("event_id", "user_id", "in_window")


@query("""WITH m AS (SELECT user_id, ts, CASE WHEN ts >= lag(ts) OVER w + INTERVAL 6 HOUR OR lag(ts) OVER w IS NULL THEN 1 ELSE 0 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM m)
SELECT user_id, min(ts) AS start, max(ts) AS last, count(*) AS n FROM s GROUP BY user_id, k""")
def session_gaps(spark, sf_dir):
    """Runs of events at most six hours apart."""
    return ev.sessions(table(spark, sf_dir, "events"), "user_id", 6 * 3600).select("user_id", "start", "last", "n")


@query(f"""WITH {FRAMES}, c AS (SELECT *, CASE WHEN text IS DISTINCT FROM lag(text) OVER w OR frame = 1 THEN 1 ELSE 0 END AS new FROM frames WINDOW w AS (PARTITION BY track ORDER BY frame)), r AS (SELECT *, CAST(sum(new) OVER (PARTITION BY track ORDER BY frame ROWS UNBOUNDED PRECEDING) - 1 AS BIGINT) AS run FROM c)
SELECT track, run, min(text) AS text, min(frame) AS first_frame, count(*) AS n FROM r GROUP BY 1, 2""")
def track_runs(spark, sf_dir):
    """A change of text ends a run."""
    return ev.split_runs(observations(spark, sf_dir), "track", "text", "frame").groupBy("track", "run").agg(F.min("text").alias("text"), F.min("frame").alias("first_frame"), F.count("*").alias("n"))


# Embeddings and interchange


@query("""WITH p AS (SELECT a.vec_id AS query_id, b.vec_id AS vec_id, list_dot_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) AS s FROM embeddings a JOIN embeddings b ON b.vec_id <> a.vec_id WHERE a.vec_id % 100 = 0) SELECT query_id, vec_id FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, vec_id) AS r FROM p) WHERE r = 1""")
def embedding_rank(spark, sf_dir):
    """Nearest vector of every hundredth vector, over all."""
    e = table(spark, sf_dir, "embeddings")
    asked = e.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q"))
    scored = e.join(asked, F.col("query_id") != F.col("vec_id")).select("query_id", "vec_id", geo.dot("q", "embedding").alias("s"))
    best = scored.groupBy("query_id").agg(F.min(F.struct((-F.col("s")).alias("s"), F.col("vec_id"))).alias("m"))
    return best.select("query_id", F.col("m.vec_id").alias("vec_id"))


def interchange_rows(spark, sf_dir):
    c = table(spark, sf_dir, "conversations")
    return c.select(F.col("conv_id").alias("asset"), F.concat(F.lit("r"), F.col("turn").cast("string")).alias("region_id"), F.col("text").alias("source"), F.when(F.col("turn") % 2 == 0, F.concat(F.lit("<fr> "), F.col("text"))).otherwise(F.lit("")).alias("target"), F.lit("fr").alias("lang"), F.col("turn").alias("reading_order"), (F.col("role") == "system").alias("dnt"))


@query("""SELECT conv_id AS asset, 'r' || turn AS unit_id, text AS source, CASE WHEN turn % 2 = 0 THEN '<fr> ' || text ELSE '' END AS target, 'fr' AS lang FROM conversations WHERE role <> 'system' AND trim(text) <> ''""")
def xliff_round_trip(spark, sf_dir):
    """Every conversation written as XLIFF and read again."""
    docs = interchange.write_xliff(interchange_rows(spark, sf_dir))
    units = interchange.read_documents(docs.select(F.col("asset").cast("string").alias("path"), "document"), "xliff")
    return units.select(F.col("path").cast("bigint").alias("asset"), "unit_id", "source", "target", "lang")


@query("""SELECT conv_id AS asset, 'r' || turn AS unit_id, text AS source, '<fr> ' || text AS target FROM conversations WHERE turn % 2 = 0 AND trim(text) <> ''""")
def tmx_round_trip(spark, sf_dir):
    """Pairs written as TMX and read again."""
    docs = interchange.write_tmx(interchange_rows(spark, sf_dir))
    units = interchange.read_documents(docs.select(F.col("asset").cast("string").alias("path"), "document"), "tmx")
    return units.select(F.col("path").cast("bigint").alias("asset"), "unit_id", "source", "target")


@query("""SELECT page_id, CASE regexp_extract(url, '\\.([a-z]+)(/|$)', 1) WHEN 'tmx' THEN 'tmx' ELSE 'txt' END AS format FROM pages""")
def format_sniff(spark, sf_dir):
    """Format by extension, txt for unknown ones."""
    return table(spark, sf_dir, "pages").select("page_id", interchange.format_of(F.regexp_extract("url", r"^([^?#]*)", 1)).alias("format"))


from lumenframe.plans import more, names  # noqa: E402, F401  (they add their queries to the same tables)
