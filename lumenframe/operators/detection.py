"""What became of every true region, and where requested texts stand."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema as arrow_schema

from lumenframe.functions.geometry import Box, intersection, iou
from lumenframe.functions.text import fuzzy_ratio, normalize_text
from lumenframe.operators.spatial import overlapping_pairs

#: Overlap from which a candidate touches a region.
TOUCH = 0.10
#: Share of a region that a candidate has to hold to cover it.
COVER = 0.60
INSIDE = 0.80
MOSTLY_INSIDE = 0.90
GUIDED = 0.82
OCCURRENCES = 12


def taxonomy(truth: DataFrame, found: DataFrame, threshold: float = 0.5, *, key: str = "asset") -> DataFrame:
    """Each true box with its best overlap and outcome: matched, over_merged, fragmented, clipped, displaced or missed, the first that holds.

    Over-merged: a touching candidate covers two regions or more, or none touches but one covers the region. Fragmented:
    two or more touching candidates inside the region cover ``threshold`` of it together (their areas less their pairwise
    overlaps). Clipped: the best candidate is mostly inside and covers less than ``threshold``. Pairs meet in grid cells.

    ``merged_by`` tells of an over-merge who made its largest candidate, by ``found``'s optional column ``ancestors``:
    policy (two proposals or more), detector (fewer) or unattributed (not known); null for other outcomes.
    """
    t, c = Box("a_"), Box("b_")
    found = found if "ancestors" in found.columns else found.withColumn("ancestors", F.lit(None).cast("int"))
    pairs = overlapping_pairs(truth, found, key=key).withColumns({"inter": intersection(t, c), "iou": iou(t, c)})
    pairs = pairs.withColumns({"holds": F.col("inter") / t.area, "within": F.col("inter") / c.area})
    spans = pairs.where(F.col("holds") >= COVER).groupBy(key, "b_id").agg(F.count(F.lit(1)).alias("spans"))
    pairs = pairs.join(spans, [key, "b_id"], "left")
    touch = F.col("iou") >= TOUCH
    inside = touch & (F.col("within") >= INSIDE)
    parts = pairs.where(inside).select(F.struct(key, "a_id").alias("region"), F.col("b_id").alias("id"), *[F.col(f"b_{k}").alias(k) for k in "xywh"])
    twice = overlapping_pairs(parts, parts, key="region").where("a_id < b_id").groupBy("region").agg(F.sum(intersection(Box("a_"), Box("b_"))).alias("twice"))
    spanning = touch & (F.coalesce("spans", F.lit(0)) >= 2)
    largest = lambda on: F.max(F.when(on, F.struct(c.area.alias("area"), (-F.col("iou")).alias("o"), F.col("b_id"), F.col("b_ancestors"))))
    best = F.min(F.struct((-F.col("iou")).alias("o"), F.col("b_id"), F.col("holds"), F.col("within")))
    region = pairs.groupBy(key, F.col("a_id").alias("id")).agg(
        best.alias("best"), F.max(touch).alias("touched"), F.max(F.col("holds") >= COVER).alias("swallowed"),
        F.max(spanning).alias("spanned"), largest(spanning).alias("spanning"), largest(F.col("holds") >= COVER).alias("swallowing"), F.count_if(inside).alias("n_inside"),
        F.sum(F.when(inside, F.col("inter"))).alias("covered"))
    twice = twice.select(F.col(f"region.{key}").alias(key), F.col("region.a_id").alias("id"), "twice")
    rows = truth.select(key, "id", (F.col("w") * F.col("h")).alias("area")).join(region, [key, "id"], "left").join(twice, [key, "id"], "left")
    share = (F.col("covered") - F.coalesce("twice", F.lit(0))) / F.col("area")
    outcome = (
        F.when(F.col("best").isNull(), "missed").when(-F.col("best.o") >= threshold, "matched")
        .when(~F.col("touched") & F.col("swallowed"), "over_merged").when(~F.col("touched"), "missed").when(F.col("spanned"), "over_merged")
        .when((F.col("n_inside") >= 2) & (share >= threshold), "fragmented")
        .when((F.col("best.within") >= MOSTLY_INSIDE) & (F.col("best.holds") < threshold), "clipped").otherwise("displaced")
    )
    ancestors = F.when(F.col("touched"), F.col("spanning.b_ancestors")).otherwise(F.col("swallowing.b_ancestors"))
    merged_by = F.when(ancestors.isNull(), "unattributed").when(ancestors >= 2, "policy").otherwise("detector")
    return rows.select(key, "id", F.coalesce(-F.col("best.o"), F.lit(0.0)).alias("best_iou"), outcome.alias("outcome"), F.when(outcome == "over_merged", merged_by).alias("merged_by"))


def locate(blocks: DataFrame, candidates: DataFrame, least: float = GUIDED, most: int = OCCURRENCES, *, key: str = "asset") -> DataFrame:
    """Occurrences of requested blocks: (key, block, id, similarity, method).

    Blocks have ``block``, ``place`` (their order), ``text`` and ``expected`` (null: not known); candidates ``id``, ``text``
    and ``shipped``. Blocks claim candidates in order, each candidate serves one block; equal normal forms come before
    near ones, shipped candidates before others of the same evidence, then the least id. A block takes ``expected`` or at
    most ``most`` occurrences. Texts are compared once for each distinct pair of an asset, and only where their lengths
    allow the ratio.
    """
    asked = blocks.withColumn("ak", normalize_text("text")).where("ak <> ''")
    pool = candidates.withColumn("bk", normalize_text("text")).where("bk <> ''")
    a, b = asked.select(key, "ak").distinct(), pool.select(key, "bk").distinct()
    short, long = F.least(F.length("ak"), F.length("bk")), F.greatest(F.length("ak"), F.length("bk"))
    near = a.join(b, key).where(short >= long * (least / (2 - least)))
    scored = near.withColumn("similarity", F.when(F.col("ak") == F.col("bk"), F.lit(1.0)).otherwise(fuzzy_ratio("ak", "bk"))).where(F.col("similarity") >= least)
    rows = asked.select(key, "block", "place", "expected", "ak").join(scored, [key, "ak"]).join(pool.select(key, "id", "shipped", "bk"), [key, "bk"])
    rows = rows.withColumn("method", F.when(F.col("ak") == F.col("bk"), "exact").otherwise("fuzzy")).select(key, "block", "place", "expected", "id", "shipped", "similarity", "method")
    fields = [rows.schema[c] for c in (key, "block", "id", "similarity", "method")]
    rank = F.col("similarity") + F.when(F.col("shipped"), 0.001).otherwise(0.0)
    # an asset's rows come in the order of their claims, so that one pass with the asset's taken ids is enough
    ordered = rows.select(key, "block", "id", "similarity", "method", "place", "expected", rank.alias("rank")).repartition(key).sortWithinPartitions(key, "place", "block", F.desc("rank"), "id")

    def claim(batches):
        kinds = arrow_schema(T.StructType(fields))
        asset, block, left, used = None, None, 0, set()
        for batch in batches:
            take = []
            for i, (k, b, one, place, want) in enumerate(zip(*(batch.column(c).to_pylist() for c in (key, "block", "id", "place", "expected")))):
                if k != asset:
                    asset, block, used = k, None, set()
                if (place, b) != block:
                    block, left = (place, b), min(most, want) if want else most
                if left and one not in used:
                    used.add(one)
                    left -= 1
                    take.append(i)
            yield batch.select(kinds.names).take(pa.array(take, pa.int64())).cast(kinds)

    return ordered.mapInArrow(claim, T.StructType(fields))


def located(blocks: DataFrame, occurrences: DataFrame, *, key: str = "asset") -> DataFrame:
    """Every block with its number of occurrences and state: not_detected, possible, multiple or found."""
    n = occurrences.groupBy(key, "block").agg(F.count(F.lit(1)).alias("n"), F.max(F.col("method") == "exact").alias("exact"))
    rows = blocks.select(key, "block", "expected").join(n, [key, "block"], "left").withColumn("n", F.coalesce("n", F.lit(0).cast("bigint")))
    state = F.when(F.col("n") == 0, "not_detected").when(F.col("n") < F.col("expected"), "possible").when(F.col("n") > 1, "multiple").when(~F.col("exact"), "possible").otherwise("found")
    return rows.select(key, "block", "n", state.alias("state"))
