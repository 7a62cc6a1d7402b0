"""Lookup of approved texts: exact, fuzzy and by visual hash, resolved in tiers; interchange and glossary resolution."""

from __future__ import annotations

import itertools
import math
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumenframe.functions.geometry import visual_similarity
from lumenframe.functions.text import fuzzy_ratio, normalize_text
from lumenframe.operators.graph import stored

FUZZY = 0.85
VISUAL = 0.88
QA_FLOOR = 0.8
HASH_BITS = 63
#: Bytes up to which a list is sent to every executor.
SENT_BYTES = 4 << 20


def first_of(df: DataFrame, by: list[str], *order: Column) -> DataFrame:
    """The first row of each group; the order has to be total."""
    return df.withColumn("__r", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where("__r = 1").drop("__r")


def join_list(exploded: DataFrame, listed: DataFrame, key: list[str]) -> DataFrame:
    """Inner join of exploded rows with a list, by measured size: a short list goes to the executors, else both are shuffled.

    The planner takes exploded rows for no larger than the rows that they come from, and would gather them all in the
    driver to broadcast them.
    """
    width = sum((F.coalesce(F.octet_length(c), F.lit(0)) if kind == "string" else F.lit(8) for c, kind in listed.dtypes), F.lit(16 * len(listed.columns)))
    if (listed.agg(F.sum(width)).first()[0] or 0) <= SENT_BYTES:
        return exploded.join(F.broadcast(listed), key)
    return exploded.hint("merge").join(listed, key)


def exact_pairs(regions: DataFrame, memory: DataFrame, *, text: str = "text") -> DataFrame:
    """(region_id, memory_id, score 1): equal normalised texts; blank ones never match.

    A text that very many regions or records share would multiply them, so that a region meets its text's best record
    only (the newest, then the least id).
    """
    key = lambda df: df.withColumn("__key", normalize_text(text)).where("__key <> ''")
    best = key(memory).groupBy("__key").agg(F.min(F.struct((-F.col("recency")).alias("r"), F.col("memory_id"))).alias("m"))
    return key(regions).join(best, "__key").select("region_id", F.col("m.memory_id").alias("memory_id"), F.lit(1.0).alias("score"), (-F.col("m.r")).alias("recency"))


def _bigrams(texts: DataFrame, text: str, least: float) -> DataFrame:
    """(text, key) for each key by which a distinct normalised text of ``n`` characters may meet another."""
    share = least / (2 - least)
    # a pair of the least ratio leaves at most so many characters of a text unmatched, and each spoils two bigrams
    spoilt = 2 * F.floor(F.col("n") * (1 - least * (1 + share) / 2) + 1e-9)
    grams = F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.col("n") - 1)), lambda i: F.substring(text, i, F.lit(2))))
    listed = texts.withColumns({"grams": grams, "spoilt": spoilt.cast("int")})
    return listed.withColumn("loose", F.col("spoilt") >= F.size("grams"))


def fuzzy_candidates(left: DataFrame, right: DataFrame, least: float) -> DataFrame:
    """(ak, bk): pairs of distinct normalised texts that may reach the ratio; no pair that does is lost.

    Of the bigrams of two such texts, at least those that no unmatched character spoils are common; so the rarest
    ``spoilt`` + 1 of each, in one order of all, have one in common. Texts so short or so uniform that all their bigrams
    may be spoilt meet each other by bands of length.
    """
    a, b = _bigrams(left.select("ak", F.length("ak").alias("n")), "ak", least), _bigrams(right.select("bk", F.length("bk").alias("n")), "bk", least)
    each = lambda df, k: df.select(k, "n", "spoilt", "loose", F.explode("grams").alias("gram"))
    ga, gb = stored(each(a, "ak"), "bigrams"), stored(each(b, "bk"), "bigrams")
    count = stored(ga.select("gram").unionAll(gb.select("gram")).groupBy("gram").agg(F.count(F.lit(1)).alias("c")), "bigram_counts")

    def rarest(g, k):
        place = F.row_number().over(Window.partitionBy(k).orderBy("c", "gram"))
        return g.join(count, "gram").withColumn("__r", place).where(F.col("__r") <= F.col("spoilt") + 1).select(k, "gram")

    share = least / (2 - least)
    band = F.floor(F.log("n") / F.lit(-math.log(share))).cast("int")
    short = a.where("loose").select("ak", band.alias("band")).join(b.where("loose").select("bk", F.explode(F.array(band - 1, band, band + 1)).alias("band")), "band").select("ak", "bk")
    pairs = rarest(ga, "ak").join(rarest(gb, "bk"), "gram").select("ak", "bk").unionAll(short).distinct()
    return pairs.where(F.least(F.length("ak"), F.length("bk")) >= F.greatest(F.length("ak"), F.length("bk")) * share)


def fuzzy_pairs(regions: DataFrame, memory: DataFrame, least: float = FUZZY, *, text: str = "text") -> DataFrame:
    """Pairs whose matching ratio is at least ``least``: distinct normalised texts meet by rare bigrams, then the ratio itself runs in Arrow batches."""
    key = lambda df, k: df.select(normalize_text(text).alias(k)).where(F.col(k) != "").distinct()
    scored = fuzzy_candidates(key(regions, "ak"), key(memory, "bk"), least).withColumn("score", fuzzy_ratio("ak", "bk")).where(F.col("score") >= least).select("ak", "bk", "score")
    best = first_of(scored, ["ak"], F.desc("score"), F.asc("bk"))
    left = regions.withColumn("ak", normalize_text(text))
    right = first_of(memory.withColumn("bk", normalize_text(text)), ["bk"], F.desc("recency"), F.asc("memory_id"))
    return left.join(best, "ak").join(right.select("bk", "memory_id", "recency"), "bk").select("region_id", "memory_id", "score", "recency")


def hamming_pairs(left: DataFrame, right: DataFrame, budget: int, *, agree: int = 2, hi: str = "hi", lo: str = "lo") -> DataFrame:
    """Pairs of 64-bit hashes (two 32-bit halves) within ``budget`` differing bits.

    Of ``budget`` + ``agree`` blocks at least ``agree`` are equal, so that every choice of so many blocks is an equality
    key; a pair is reported by the first choice that is equal only.
    """
    n = budget + agree
    edges = [64 * i // n for i in range(n + 1)]
    choices = list(itertools.combinations(range(n), agree))

    def block(i, p):
        """The bits of a block as a number; it may lie across the halves."""
        first, last = edges[i], edges[i + 1]
        part = lambda c, a, b: F.shiftright(F.col(p + c), 32 - b).bitwiseAND(F.lit((1 << (b - a)) - 1))
        if last <= 32 or first >= 32:
            return part(hi if last <= 32 else lo, first % 32, (last - 1) % 32 + 1)
        return F.shiftleft(part(hi, first, 32), last - 32).bitwiseOR(part(lo, 0, last - 32))

    def keyed(df, p):
        named = df.select(*[F.col(c).alias(p + c) for c in df.columns])
        blocks = named.withColumn(f"{p}blocks", F.array(*[block(i, p).cast("bigint") for i in range(n)]))
        keys = [F.struct(F.lit(k).alias("k"), *[F.col(f"{p}blocks")[i].alias(f"v{j}") for j, i in enumerate(c)]) for k, c in enumerate(choices)]
        return blocks.withColumn("key", F.explode(F.array(*keys)))

    pairs = keyed(left, "a_").join(keyed(right, "b_"), "key")
    far = F.bit_count(F.col(f"a_{hi}").bitwiseXOR(F.col(f"b_{hi}"))) + F.bit_count(F.col(f"a_{lo}").bitwiseXOR(F.col(f"b_{lo}")))
    same = F.slice(F.filter(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.col("a_blocks")[i] == F.col("b_blocks")[i]), 1, agree)
    own = F.array(*[F.array(*map(F.lit, c)) for c in choices])[F.col("key.k")]
    return pairs.withColumn("distance", far.cast("int")).where((F.col("distance") <= budget) & (same == own)).drop("key", "a_blocks", "b_blocks")


def tiered(regions: DataFrame, tiers: list[tuple[str, DataFrame]]) -> DataFrame:
    """Every region's best hit of the first tier that has one; regions without a hit are absent."""
    parts = [pairs.select("region_id", "memory_id", "score", "recency").withColumns({"tier": F.lit(name), "__t": F.lit(i)}) for i, (name, pairs) in enumerate(tiers)]
    hits = reduce(DataFrame.unionByName, parts).join(regions.select("region_id").distinct(), "region_id", "left_semi")
    return first_of(hits, ["region_id"], F.asc("__t"), F.desc("score"), F.desc("recency"), F.asc("memory_id")).drop("__t")


def visual_score(distance) -> Column:
    return visual_similarity(distance, HASH_BITS)


def quality_gate(rows: DataFrame, assets: DataFrame, floor: float = QA_FLOOR) -> DataFrame:
    """Rows with source and target whose own score and whose asset's score reach the floor; a missing score fails."""
    passing = assets.where(F.col("asset_score") >= floor).select("asset")
    good = (F.col("score") >= floor) & (F.trim("source") != "") & (F.trim("target") != "")
    return rows.where(good).join(passing, "asset", "left_semi")


def resolve_imports(units: DataFrame, regions: DataFrame, *, text: str = "source") -> DataFrame:
    """Imported units with their region: by id, else by box note, else by a source that only one region has.

    ``how`` is id, bbox, source, ambiguous or unresolved.
    """
    key = normalize_text(text)
    by_source = regions.withColumn("__key", key).where("__key <> ''").groupBy("__key").agg(F.count(F.lit(1)).alias("__n"), F.min("region_id").alias("__by_source"))
    by_box = regions.groupBy("note").agg(F.count(F.lit(1)).alias("__m"), F.min("region_id").alias("__by_box")).where("__m = 1 AND note IS NOT NULL")
    known = regions.select(F.col("region_id").alias("__by_id")).distinct()
    joined = units.withColumn("__key", key).join(known, F.col("unit_id") == F.col("__by_id"), "left").join(by_box, "note", "left").join(by_source, "__key", "left")
    only = F.when(F.col("__n") == 1, F.col("__by_source"))
    how = F.when(F.col("__by_id").isNotNull(), "id").when(F.col("__by_box").isNotNull(), "bbox").when(only.isNotNull(), "source").when(F.col("__n") > 1, "ambiguous").otherwise("unresolved")
    return joined.select("unit_id", F.coalesce("__by_id", "__by_box", only).alias("region_id"), how.alias("how"))


def merge_glossaries(built_in: DataFrame, uploaded: DataFrame, mode: str = "merge") -> DataFrame:
    """replace: uploaded only; auxiliary: built-in terms of language pairs without an upload; merge: uploaded terms win."""
    pair, term = ["src_lang", "targ_lang"], ["src_lang", "targ_lang", "source"]
    if mode == "replace":
        return uploaded
    keep = {"auxiliary": pair, "merge": term}[mode]
    return uploaded.unionByName(built_in.join(uploaded.select(*keep).distinct(), keep, "left_anti"))


def terminology(rows: DataFrame) -> DataFrame:
    """Per normalised source: its number of different targets, and whether that is one."""
    n = F.countDistinct(normalize_text("target"))
    return rows.withColumn("term", normalize_text("source")).where("term <> ''").groupBy("term").agg(F.count(F.lit(1)).alias("n_rows"), n.alias("n_targets"), (n <= 1).alias("consistent"))


def glossary_violations(rows: DataFrame, glossary: DataFrame) -> DataFrame:
    """(id, term, required): rows whose source holds a term, in any case, while the target lacks its translation.

    Terms stand anywhere in a source, so that terms and sources meet by the terms' first three characters (shorter terms
    by all of theirs), each once a source; ``contains`` verifies.
    """
    low = lambda c: F.lower(F.coalesce(c, F.lit("")))
    terms = glossary.select("term", "required", low("term").alias("t")).where("t <> ''").withColumn("key", F.substring("t", 1, 3))
    pieces = lambda n: F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.length("s") - n + 1)), lambda i: F.substring("s", i, F.lit(n)))
    sizes = [r[0] for r in terms.select(F.length("key")).distinct().collect()]  # 1, 2, 3
    said = rows.select("id", low("source").alias("s"), low("target").alias("g"))
    if not sizes:
        return said.join(terms, F.lit(False)).select("id", "term", "required")
    keyed = said.withColumn("key", F.explode(F.array_distinct(F.concat(*[pieces(n) for n in sizes]))))
    hits = join_list(keyed, terms, ["key"]).where(F.col("s").contains(F.col("t")) & ~F.col("g").contains(low("required")))
    return hits.select("id", "term", "required")
