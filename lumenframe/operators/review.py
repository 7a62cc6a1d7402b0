"""Verdicts on detections and their order for review: scenes, rungs, symbol noise, totals, lineage reports and paired arms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumenframe.functions.geometry import Box, containment
from lumenframe.functions.text import as_col, rounded, scripts_in
from lumenframe.operators.graph import ancestors
from lumenframe.operators.spatial import overlapping_pairs

# Fixed values.
CONFIDENT, INSIDE, NOISE, SYMBOL_AREA, FLOOR = 0.5, 0.5, 0.4, 500, 0.80
SEVERITY = {"fail": 0, "review": 1, "pass": 2}
RAW, FINAL = "raw_craft", "final"


def scene_verdict(boxes: DataFrame, surfaces: DataFrame, *, key: str = "asset", label: str = "label") -> DataFrame:
    """Each box's best cover by a surface and its label (the least of equals), whether it lies outside, and whether a veto would drop it."""
    pairs = overlapping_pairs(boxes.select(key, "id", "x", "y", "w", "h"), surfaces.select(key, "id", "x", "y", "w", "h", label), key=key)
    best = pairs.groupBy(key, F.col("a_id").alias("id")).agg(F.min(F.struct((-containment(Box("a_"), Box("b_"))).alias("o"), F.col(f"b_{label}").alias("l"))).alias("best"))
    rows = boxes.join(best, [key, "id"], "left")
    cover, conf = F.coalesce(-F.col("best.o"), F.lit(0.0)), F.coalesce("conf", F.lit(0.0))
    inside = cover > INSIDE
    return rows.select(key, "id", rounded(cover, 3).alias("surface_overlap"), F.col("best.l").alias("surface_label"), (~inside).alias("outside"), (~(inside | (conf >= CONFIDENT))).alias("would_veto"))


def symbol_noise(text, conf, w, h, localisable=None) -> Column:
    """Whether a reading is blank, or neither letters nor digits and either doubtful or too small for a symbol; ``localisable`` ones may be small."""
    text, conf = F.trim(F.coalesce(as_col(text), F.lit(""))), F.coalesce(as_col(conf), F.lit(0.0))
    small = as_col(w) * as_col(h) < SYMBOL_AREA
    if localisable is not None:
        small = small & ~as_col(localisable)
    bare = (F.size(scripts_in(text)) == 0) & ~text.rlike(r"\p{N}")
    return (text == "") | (bare & ((conf < NOISE) | small))


def review_order(regions: DataFrame, by: str) -> DataFrame:
    """Regions that don't pass, placed by severity, score (none comes last) and id."""
    rank = F.create_map(*[F.lit(x) for kv in SEVERITY.items() for x in kv])
    order = Window.partitionBy(by).orderBy(rank[F.col("status")], F.coalesce(F.col("score").cast("double"), F.lit(101.0)), "id")
    return regions.where("status <> 'pass'").withColumn("place", F.row_number().over(order))


def detection_rung(regions: DataFrame, nodes: DataFrame, assets: DataFrame, *, key: str = "asset") -> DataFrame:
    """Why an asset has its regions or none: regions_present, no_lineage, all_excluded, no_proposals or all_suppressed.

    Regions have ``excluded``; nodes have ``stage`` and ``state``; an asset without any node has no lineage.
    """
    own = regions.groupBy(key).agg(F.count(F.lit(1)).alias("total"), F.count_if(~F.coalesce("excluded", F.lit(False))).alias("active"))
    seen = nodes.groupBy(key).agg(F.count(F.lit(1)).alias("nodes"), F.count_if(F.col("stage") == RAW).alias("raw"), F.count_if(F.col("state") != "active").alias("suppressed"))
    rows = assets.select(key).distinct().join(own, key, "left").join(seen, key, "left")
    zero = lambda c: F.coalesce(c, F.lit(0).cast("bigint"))
    rung = F.when(zero("active") > 0, "regions_present").when(F.col("nodes").isNull(), "no_lineage").when(zero("total") > 0, "all_excluded").when(F.col("raw") == 0, "no_proposals").otherwise("all_suppressed")
    return rows.select(key, rung.alias("rung"), zero("total").alias("total"), zero("active").alias("active"), zero("raw").alias("raw"), zero("suppressed").alias("suppressed"))


def raw_ancestors(nodes: DataFrame, parents: DataFrame) -> DataFrame:
    """(child, ancestor, distance) of ancestors that are the detector's own proposals."""
    raw = nodes.where(F.col("stage") == RAW).select(F.col("id").alias("ancestor"))
    return ancestors(parents).join(raw, "ancestor", "left_semi")


def conservation(nodes: DataFrame, parents: DataFrame) -> DataFrame:
    """(id, problem): orphans, nodes without a raw proposal beneath them, and raw_untraced, active proposals that nothing came of."""
    traced = raw_ancestors(nodes, parents).select(F.col("child").alias("id")).distinct()
    orphans = nodes.where(F.col("stage") != RAW).join(traced, "id", "left_anti").select("id", F.lit("orphan").alias("problem"))
    used = parents.where("parent IS NOT NULL").select(F.col("parent").alias("id")).distinct()
    untraced = nodes.where((F.col("stage") == RAW) & (F.col("state") == "active")).join(used, "id", "left_anti").select("id", F.lit("raw_untraced").alias("problem"))
    return orphans.unionByName(untraced)


def surviving_at(nodes: DataFrame, *, key: str = "asset") -> DataFrame:
    """The active node, not a final one, that alone stands at a geometry to two places."""
    place = [F.round(c, 2).alias(c) for c in ("x", "y", "w", "h")]
    alive = nodes.where((F.col("stage") != FINAL) & (F.coalesce("state", F.lit("active")) == "active"))
    return alive.groupBy(key, *place).agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("id")).where("n = 1").drop("n")


def recovered(nodes: DataFrame, shipped: DataFrame, most: int = 512, *, key: str = "asset") -> DataFrame:
    """Suppressed nodes that didn't ship (boxes compared to one place), the first ``most`` of an asset by id."""
    place = lambda: [F.round(c, 1).alias(f"r{c}") for c in ("x", "y", "w", "h")]
    gone = shipped.select(key, *place()).distinct()
    left = nodes.where("state <> 'active'").select("*", *place()).join(gone, [key, "rx", "ry", "rw", "rh"], "left_anti").drop("rx", "ry", "rw", "rh")
    return left.withColumn("__r", F.row_number().over(Window.partitionBy(key).orderBy("id"))).where(F.col("__r") <= most).drop("__r")


def paired_arms(one: DataFrame, other: DataFrame, on: list[str], found: str = "found") -> DataFrame:
    """Two arms' outcomes by occurrence: how many pair up, how many don't, and the four cells of the pairs, by one full join."""
    a, b = one.select(*on, F.col(found).alias("a")), other.select(*on, F.col(found).alias("b"))
    both = a.join(b, on, "full_outer")
    paired = F.col("a").isNotNull() & F.col("b").isNotNull()
    return both.agg(
        F.count_if(paired).alias("paired"), F.count_if(~paired).alias("unpaired"), F.count_if(F.col("a") & F.col("b")).alias("both"), F.count_if(~F.col("a") & ~F.col("b")).alias("neither"),
        F.count_if(F.col("a") & ~F.col("b")).alias("only_first"), F.count_if(~F.col("a") & F.col("b")).alias("only_second"),
    )


def floor_violations(strata: DataFrame, floor: float = FLOOR) -> DataFrame:
    """Strata whose recall is under the floor, with whether their sample suffices."""
    return strata.where(F.col("recall") < floor)


def guided_recall(results: DataFrame, by: list[str]) -> DataFrame:
    """Recall in percent to one place, and the rate of unrequested regions over fully annotated assets only (null without any)."""
    full = ~F.col("partial")
    expected, found = F.sum("expected"), F.sum("found")
    shipped, extra = F.sum(F.when(full, F.col("shipped"))), F.sum(F.when(full, F.col("unrequested")))
    return results.groupBy(*by).agg(
        F.count(F.lit(1)).alias("assets"), expected.alias("expected"), found.alias("found"), F.when(expected > 0, rounded(100.0 * found / expected, 1)).otherwise(0.0).alias("recall"),
        F.when(shipped > 0, rounded(100.0 * extra / shipped, 1)).alias("false_region_rate"), F.count_if(full).alias("false_region_basis"),
    )


def relative_area(boxes: DataFrame, *, key: str = "asset") -> DataFrame:
    """Each box's area over its asset's median area, which is exact and worked out once an asset."""
    middle = boxes.groupBy(key).agg(F.median(F.col("w") * F.col("h")).alias("__m"))
    return boxes.join(middle, key).withColumn("relative_area", F.when(F.col("__m") > 0, F.col("w") * F.col("h") / F.col("__m"))).drop("__m")


def upper_median(values: DataFrame, by: list[str], value: str) -> DataFrame:
    """The element at half the number of a group's sorted values, by ranks of counted values."""
    counted = values.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count(F.lit(1)).alias("n"))
    up = F.sum("n").over(Window.partitionBy(*by).orderBy(value))
    total = F.sum("n").over(Window.partitionBy(*by))
    ranked = counted.select(*by, value, up.alias("up"), total.alias("total"))
    return ranked.where(F.col("up") > F.floor(F.col("total") / 2)).groupBy(*by).agg(F.min(value).alias("upper_median"))


def cohort_maximin(scores: DataFrame, member: str, group: str, region: str, score: str) -> DataFrame:
    """Per set of faces: the least and the mean of its regions' best scores over what is best achievable in the region."""
    best = scores.groupBy(region).agg(F.max(score).alias("__best"))
    own = scores.groupBy(group, region).agg(F.max(score).alias("__own")).join(best, region)
    share = F.when(F.col("__best") > 0, F.col("__own") / F.col("__best")).otherwise(0.0)
    return own.groupBy(group).agg(F.min(share).alias("least"), F.avg(share).alias("mean"))


def quality_mean(regions: DataFrame, by: str, score: str) -> DataFrame:
    """Mean of the scores, 1 where there is none, and the number of regions of each state."""
    return regions.groupBy(by).agg(F.coalesce(F.avg(score), F.lit(1.0)).alias("quality"), F.count(F.lit(1)).alias("regions"))
