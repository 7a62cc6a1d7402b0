"""Known names in recognised text: whole names, aligned and verbatim spans, missing accents, earlier corrections.

Texts have ``id``, ``text`` and ``lang`` (null or empty: any language); a pool has ``candidate``, ``lang``, ``scope`` and
``rank`` (its order, the last tie-break but for the name). Null and empty texts, and an empty pool, give no rows.
"""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lumenframe.functions.text import fuzzy_ratio, normalize_text
from lumenframe.operators import matching

# Fixed values
CONFIDENCE_FLOOR = 0.6
SIMILARITY = 0.5
WHOLE_LENGTH = 3
SPAN_LENGTH = 2

SPAN = "struct<start: int, end: int, candidate: string, similarity: double, n_diffs: int>"


def _asked(texts: DataFrame) -> DataFrame:
    return texts.where(F.col("text") != "").withColumn("__k", F.coalesce("lang", F.lit("")))


def _names(pool: DataFrame) -> DataFrame:
    """(__k, candidate, rank): each name once under its language, and once under none, which texts without a language ask for."""
    under = F.explode(F.array_distinct(F.array(F.coalesce("lang", F.lit("")), F.lit("")))).alias("__k")
    return pool.where("candidate IS NOT NULL").select("candidate", "rank", under).groupBy("__k", "candidate").agg(F.min("rank").alias("rank"))


def similarity(a, b) -> Column:
    """Ratio of two texts' normal forms; 0 if either is blank."""
    return fuzzy_ratio(normalize_text(a), normalize_text(b))


def whole_names(texts: DataFrame, pool: DataFrame) -> DataFrame:
    """(id, candidate, similarity): the likest name of each text read with a confidence (``conf``; null: 0) below the floor.

    Names of a scope need two characters, others three. So low a ratio leaves no prefix filter, so that each distinct text
    meets the names of its language whose length allows the ratio.
    """
    unsure = _asked(texts.where(F.coalesce("conf", F.lit(0.0)) < CONFIDENCE_FLOOR))
    least = F.when(F.coalesce("scope", F.lit("")) != "", SPAN_LENGTH).otherwise(WHOLE_LENGTH)
    names = _names(pool.where(F.length("candidate") >= least))
    a, b = F.length(normalize_text("text")), F.length(normalize_text("candidate"))
    met = unsure.select("__k", "text").distinct().join(names, "__k").where(2 * F.least(a, b) >= SIMILARITY * (a + b))
    scored = met.withColumn("similarity", similarity("text", "candidate")).where(F.col("similarity") >= SIMILARITY)
    best = scored.groupBy("__k", "text").agg(F.min(F.struct((-F.col("similarity")).alias("s"), "rank", "candidate")).alias("best"))
    return unsure.join(best, ["__k", "text"]).select("id", F.col("best.candidate").alias("candidate"), (-F.col("best.s")).alias("similarity"))


def _kept(spans: DataFrame, *order: Column) -> DataFrame:
    """(id, spans): of each text's spans, taken in this order, those that overlap none taken before; by their starts."""
    every = F.array_sort(F.collect_list(F.struct(*[c.alias(f"o{i}") for i, c in enumerate(order)], F.struct("start", "end", "candidate", "similarity", "n_diffs").cast(SPAN).alias("span"))))
    told = spans.groupBy("id").agg(F.transform(every, lambda s: s["span"]).alias("every"))

    def take(kept, s):
        return F.when(F.exists(kept, lambda k: (s["start"] < k["end"]) & (k["start"] < s["end"])), kept).otherwise(F.array_append(kept, s))

    return told.select("id", F.array_sort(F.aggregate("every", F.array().cast(f"array<{SPAN}>"), take)).alias("spans"))


def aligned_spans(texts: DataFrame, pool: DataFrame, equal_length: bool = False) -> DataFrame:
    """(id, spans): windows of a text without spaces that are a name but for at most half its characters, in place.

    A text's characters meet the names' equal characters: each meeting tells where the name would start, and the meetings
    with one start are the equal places. Windows that are the name already are none. Likelier spans are taken before longer
    ones, then those with fewer differences, then the first.
    """
    spaceless = _asked(texts).where(~F.contains("text", F.lit(" ")))
    names = _names(pool.where(F.length("candidate") >= SPAN_LENGTH))
    char = lambda c: F.posexplode(F.split(c, "")).alias("at", "char")
    own = spaceless.select("__k", "text").distinct().select("__k", "text", char("text"))
    theirs = names.select("__k", "candidate", "rank", char("candidate")).withColumnRenamed("at", "offset")
    n, start = F.length("candidate"), F.col("at") - F.col("offset")
    longer = F.length("text") >= n if equal_length else F.length("text") > n
    met = own.join(theirs, ["__k", "char"]).where(longer & (start >= 0) & (start + n <= F.length("text")))
    windows = met.groupBy("__k", "text", "candidate", "rank", start.alias("start")).agg(F.count(F.lit(1)).cast("int").alias("same"))
    near = windows.withColumns({"n_diffs": n - F.col("same"), "end": F.col("start") + n}).where((F.col("n_diffs") > 0) & (2 * F.col("n_diffs") <= n))
    scored = near.withColumn("similarity", similarity(F.substring("text", F.col("start") + 1, n), "candidate")).where(F.col("similarity") >= SIMILARITY)
    spans = spaceless.select("id", "__k", "text").join(scored, ["__k", "text"])
    return _kept(spans, -F.col("similarity"), F.col("start") - F.col("end"), F.col("n_diffs"), F.col("start"), F.col("rank"), F.col("candidate"))


def verbatim_spans(texts: DataFrame, pool: DataFrame) -> DataFrame:
    """(id, spans): the names that a text without spaces holds as they are; longer ones are taken first, then the first.

    A text's pairs of characters meet the names that begin with them.
    """
    spaceless = _asked(texts).where(~F.contains("text", F.lit(" ")) & (F.length("text") >= SPAN_LENGTH))
    names = _names(pool.where(F.length("candidate") >= SPAN_LENGTH)).withColumn("pair", F.substring("candidate", 1, 2))
    pairs = F.transform(F.sequence(F.lit(1), F.length("text") - 1), lambda i: F.substring("text", i, F.lit(2)))
    own = spaceless.select("id", "__k", "text", F.posexplode(pairs).alias("start", "pair"))
    n = F.length("candidate")
    found = matching.join_list(own, names, ["__k", "pair"]).where(F.substring("text", F.col("start") + 1, n) == F.col("candidate"))
    spans = found.withColumns({"end": F.col("start") + n, "similarity": F.lit(1.0), "n_diffs": F.lit(0)})
    return _kept(spans, F.col("start") - F.col("end"), F.col("start"), F.col("candidate"))


@F.pandas_udf(T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("token", T.StringType()), T.StructField("folded", T.StringType())])))
def placed_tokens(c: pd.Series) -> pd.Series:
    """Parts between single spaces, with their starts and folded forms."""

    def tokens(x):
        out, at = [], 0
        for t in (x or "").split(" "):
            if t:
                out.append({"start": at, "token": t, "folded": t.casefold()})
            at += len(t) + 1
        return out

    return c.map(tokens)


@F.pandas_udf(T.ArrayType(T.StructType([T.StructField("at", T.IntegerType()), T.StructField("marks", T.StringType())])))
def missing_marks(token: pd.Series, canonical: pd.Series) -> pd.Series:
    """Where the canonical form differs from a token of its length by marks alone, and by which; null where it differs otherwise or not at all."""

    def marks(seen, proposed):
        if seen == proposed or len(seen) != len(proposed):
            return None
        out = []
        for i, (a, b) in enumerate(zip(seen, proposed)):
            base, *over = unicodedata.normalize("NFD", b)
            over = "".join(m for m in over if unicodedata.combining(m))
            if unicodedata.normalize("NFD", a)[0].casefold() != base.casefold() or not over and a.casefold() != b.casefold():
                return None
            if a != b and over:
                out.append({"at": i, "marks": over})
        return out or None

    return pd.Series([marks(a, b) for a, b in zip(token, canonical)])


def accent_proposals(texts: DataFrame, forms: DataFrame) -> DataFrame:
    """(id, start, token, canonical, positions): tokens whose folded form one entry of ``forms`` (lang, folded, canonical) alone has.

    Positions count from the text's start. Forms that several entries share propose nothing.
    """
    sole = forms.groupBy("lang", "folded").agg(F.count(F.lit(1)).alias("n"), F.min("canonical").alias("canonical")).where("n = 1").drop("n")
    tokens = texts.select("id", "lang", F.explode(placed_tokens("text")).alias("t")).select("id", "lang", "t.*")
    met = tokens.join(sole, ["lang", "folded"]).withColumn("marks", missing_marks("token", "canonical")).where("marks IS NOT NULL")
    placed = F.transform("marks", lambda m: F.struct((m["at"] + F.col("start")).alias("at"), m["marks"].alias("marks")))
    return met.select("id", "start", "token", "canonical", placed.alias("positions"))


def recall_corrections(regions: DataFrame, corrections: DataFrame) -> DataFrame:
    """(region_id, corrected, score, tier, memory_id): confirmed corrections of equal misreadings, else of like ones.

    Corrections have ``memory_id``, ``text`` (the misreading), ``corrected`` and ``recency``; regions have ``region_id``,
    ``text`` and ``dnt``. A best hit that proposes the text as it is gives none, and no second one is looked for.
    """
    asked = regions.where(~F.coalesce("dnt", F.lit(False)) & (F.trim(F.coalesce("text", F.lit(""))) != ""))
    hits = matching.tiered(asked, [("exact", matching.exact_pairs(asked, corrections)), ("fuzzy", matching.fuzzy_pairs(asked, corrections))])
    said = hits.join(corrections.select("memory_id", "corrected"), "memory_id").join(asked.select("region_id", F.trim("text").alias("__said")), "region_id")
    return said.where(F.trim("corrected") != F.col("__said")).select("region_id", "corrected", "score", "tier", "memory_id")
