"""Joins and clean-up of boxes: rows have ``asset``, ``id``, ``x``, ``y``, ``w``, ``h``.

Pairs are found through a grid: a box is listed in every cell that it touches and boxes meet in a cell of their asset;
the cell that holds the intersection's top left corner alone reports the pair. An asset with very many boxes is thus
spread over its cells, and no pair of distant boxes is ever formed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumenframe.functions.geometry import Box, containment, intersection, iou, overlap_min

CELL = 64
PART = ("id", "x", "y", "w", "h")


def _cells(df: DataFrame, cell: int) -> DataFrame:
    along = lambda at, size: F.sequence(F.floor(F.col(at) / cell), F.floor((F.col(at) + F.col(size) - 1) / cell))
    return df.withColumn("__cx", F.explode(along("x", "w"))).withColumn("__cy", F.explode(along("y", "h")))


def overlapping_pairs(left: DataFrame, right: DataFrame, *, key: str = "asset", cell: int = CELL) -> DataFrame:
    """Pairs of one asset with a common area; columns get prefixes a_ and b_."""
    name = lambda df, p: df.select(key, "__cx", "__cy", *[F.col(c).alias(f"{p}_{c}") for c in df.columns if c not in (key, "__cx", "__cy")])
    a, b = name(_cells(left.where("w > 0 AND h > 0"), cell), "a"), name(_cells(right.where("w > 0 AND h > 0"), cell), "b")
    pairs = a.join(b, [key, "__cx", "__cy"])
    first = (F.col("__cx") == F.floor(F.greatest("a_x", "b_x") / cell)) & (F.col("__cy") == F.floor(F.greatest("a_y", "b_y") / cell))
    return pairs.where(first & (intersection(Box("a_"), Box("b_")) > 0)).drop("__cx", "__cy")


def iou_pairs(left: DataFrame, right: DataFrame, least: float = 0.5, **options) -> DataFrame:
    return overlapping_pairs(left, right, **options).withColumn("iou", iou(Box("a_"), Box("b_"))).where(F.col("iou") >= least)


def best_iou(truth: DataFrame, found: DataFrame, *, key: str = "asset") -> DataFrame:
    """Every true box with its best overlap, 0 if there is none."""
    best = overlapping_pairs(truth, found, key=key).groupBy(key, F.col("a_id").alias("id")).agg(F.max(iou(Box("a_"), Box("b_"))).alias("best_iou"))
    return truth.select(key, "id").join(best, [key, "id"], "left").withColumn("best_iou", F.coalesce("best_iou", F.lit(0.0)))


def neighbour_iou(boxes: DataFrame, *, key: str = "asset") -> DataFrame:
    """The largest overlap with any other box of the asset."""
    best = overlapping_pairs(boxes, boxes, key=key).where("a_id <> b_id").groupBy(key, F.col("a_id").alias("id")).agg(F.max(iou(Box("a_"), Box("b_"))).alias("neighbour_iou"))
    return boxes.select(key, "id").join(best, [key, "id"], "left").withColumn("neighbour_iou", F.coalesce("neighbour_iou", F.lit(0.0)))


def _top(pairs: DataFrame, key: str, score: Column, *then: Column) -> DataFrame:
    order = Window.partitionBy(key, "a_id").orderBy(score, *then)
    return pairs.withColumn("__r", F.row_number().over(order)).where("__r = 1").drop("__r")


def covering_surface(boxes: DataFrame, surfaces: DataFrame, least: float = 0.5, *, key: str = "asset") -> DataFrame:
    """Each box with the surface that covers most of it (the least id of equals), null under ``least``."""
    pairs = overlapping_pairs(boxes, surfaces, key=key).withColumn("cover", containment(Box("a_"), Box("b_"))).where(F.col("cover") >= least)
    best = _top(pairs, key, F.desc("cover"), F.asc("b_id")).select(key, F.col("a_id").alias("id"), F.col("b_id").alias("surface_id"), "cover")
    return boxes.select(key, "id").join(best, [key, "id"], "left")


def containing_region(boxes: DataFrame, regions: DataFrame, *, key: str = "asset") -> DataFrame:
    """Each box with the smallest region that holds its centre."""
    a, b = Box("a_"), Box("b_")
    x, y = 2 * a.x + a.w, 2 * a.y + a.h
    inside = (x >= 2 * b.x) & (x <= 2 * b.right) & (y >= 2 * b.y) & (y <= 2 * b.bottom)
    best = _top(overlapping_pairs(boxes, regions, key=key).where(inside), key, F.asc(b.area), F.asc("b_id"))
    return boxes.select(key, "id").join(best.select(key, F.col("a_id").alias("id"), F.col("b_id").alias("region_id")), [key, "id"], "left")


def prune_fragments(boxes: DataFrame, text: str = "text", most: float = 0.5, *, key: str = "asset") -> DataFrame:
    """Without boxes whose text is part of a longer one that overlaps them by over ``most`` of the smaller area."""
    pairs = overlapping_pairs(boxes, boxes, key=key)
    part = (F.length(f"b_{text}") > F.length(f"a_{text}")) & F.col(f"b_{text}").contains(F.col(f"a_{text}")) & (overlap_min(Box("a_"), Box("b_")) > most)
    gone = pairs.where(part).select(key, F.col("a_id").alias("id")).distinct()
    return boxes.join(gone, [key, "id"], "left_anti")


def authoritative_union(primary: DataFrame, secondary: DataFrame, most: float = 0.5, *, key: str = "asset") -> DataFrame:
    """The primary boxes and those secondary ones that no primary overlaps by over ``most``."""
    hit = overlapping_pairs(secondary, primary, key=key).where(overlap_min(Box("a_"), Box("b_")) > most).select(key, F.col("a_id").alias("id")).distinct()
    return primary.withColumn("origin", F.lit("primary")).unionByName(secondary.join(hit, [key, "id"], "left_anti").withColumn("origin", F.lit("secondary")), allowMissingColumns=True)


def union_box(boxes: DataFrame, by: list[str]) -> DataFrame:
    x, y = F.min("x"), F.min("y")
    return boxes.groupBy(*by).agg(x.alias("x"), y.alias("y"), (F.max(F.col("x") + F.col("w")) - x).alias("w"), (F.max(F.col("y") + F.col("h")) - y).alias("h"))


def each_asset(rows: DataFrame, key: str, fields: list[str], fn, schema, order: tuple = ()) -> DataFrame:
    """``fn`` over the rows of one asset after the other (lists of the columns ``fields``), which come sorted and in one pass.

    It returns the kept rows' places, in order, and lists of what ``schema`` adds to the rows' own columns. Only one asset's
    rows are held at a time.
    """
    from pyspark.sql.pandas.types import to_arrow_schema

    own = rows.columns

    def run(batches):
        import pyarrow as pa

        kinds = to_arrow_schema(schema)

        def done(held):
            table = pa.Table.from_batches(held).combine_chunks()
            places, more = fn(*(table.column(f).to_pylist() for f in fields))
            kept = table.take(pa.array(places, pa.int64()))
            columns = [kept.column(c).combine_chunks().cast(kinds.field(c).type) for c in own] + [pa.array(m, kinds.field(len(own) + i).type) for i, m in enumerate(more)]
            return pa.RecordBatch.from_arrays([c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c for c in columns], schema=kinds)

        held, last, out, n = [], None, [], 0
        for batch in batches:
            keys = batch.column(key).to_pylist()
            begin = 0
            for i, k in enumerate(keys):
                if i == 0 and not held:
                    last = k
                if k != last:
                    if i > begin:
                        held.append(batch.slice(begin, i - begin))
                    out.append(done(held))
                    n += out[-1].num_rows
                    held, begin, last = [], i, k
            if len(keys) > begin:
                held.append(batch.slice(begin))
            if n > 20_000:
                yield from pa.Table.from_batches(out).combine_chunks().to_batches()
                out, n = [], 0
        if held:
            out.append(done(held))
        if out:
            yield from pa.Table.from_batches(out).combine_chunks().to_batches()

    return rows.repartition(key).sortWithinPartitions(key, *order).mapInArrow(run, schema)


def suppress(boxes: DataFrame, most: float = 0.5, *, key: str = "asset", score: str = "conf") -> DataFrame:
    """Non-maximum suppression: by falling score (then id) a box stays unless a kept one overlaps it by over ``most`` of the smaller area.

    Greedy within an asset, whose boxes come by falling score; the id breaks ties.
    """

    def run(*columns):
        held, keep = [], []
        for i, (x, y, w, h) in enumerate(zip(*columns)):
            for a, b, c, d in held:
                wide, high = min(x + w, a + c) - max(x, a), min(y + h, b + d) - max(y, b)
                if wide > 0 and high > 0 and wide * high > most * min(w * h, c * d):
                    break
            else:
                held.append((x, y, w, h))
                keep.append(i)
        return keep, []

    return each_asset(boxes, key, ["x", "y", "w", "h"], run, boxes.schema, (F.desc(score), F.asc("id")))


def greedy_match(found: DataFrame, truth: DataFrame, least: float = 0.5, *, key: str = "asset") -> DataFrame:
    """One-to-one pairs: found boxes in order of id take their best free true box with an overlap of at least ``least``."""
    pairs = iou_pairs(found, truth, least, key=key).select(key, "a_id", "b_id", "iou")

    def run(a, b):
        used, matched, take = set(), set(), []
        for i, (x, y) in enumerate(zip(a, b)):
            if x not in matched and y not in used:
                matched.add(x)
                used.add(y)
                take.append(i)
        return take, []

    return each_asset(pairs, key, ["a_id", "b_id"], run, pairs.schema, (F.asc("a_id"), F.desc("iou"), F.asc("b_id")))


def bands(centres, sizes, share: float, grow: bool) -> list[int]:
    """Each item's band: the first begun band whose mean centre is near enough, else a new one.

    Near is ``share`` of the upper median size, at least 4, or with ``grow`` of the band's own mean size if that is more.
    """
    slack = max(4.0, sorted(sizes)[len(sizes) // 2] * share) if len(sizes) else 4.0
    begun: list[list[float]] = []
    out = []
    for c, size in zip(centres, sizes):
        at = next((i for i, (mean, own, _) in enumerate(begun) if abs(c - mean) <= (max(slack, own * share) if grow else slack)), None)
        if at is None:
            at = len(begun)
            begun.append([c, size, 1])
        else:
            band = begun[at]
            band[2] += 1
            band[0] += (c - band[0]) / band[2]
            band[1] += (size - band[1]) / band[2]
        out.append(at)
    by = sorted(range(len(begun)), key=lambda i: (begun[i][0], i))
    place = {b: i for i, b in enumerate(by)}
    return [place[b] for b in out]


def _ordered(boxes: DataFrame, key: str, place, more: tuple[str, ...] = ()) -> DataFrame:
    """Boxes with ``line`` and ``reading_order``; ``place`` gives an asset's places in order, each with its line."""
    from pyspark.sql import types as T

    out = T.StructType([*boxes.schema, T.StructField("line", T.LongType()), T.StructField("reading_order", T.LongType())])

    def run(x, y, w, h, *rest):
        found = place(x, y, [max(1, v) for v in w], [max(1, v) for v in h], *rest)
        return [i for i, _ in found], [[line for _, line in found], list(range(len(found)))]

    return each_asset(boxes, key, ["x", "y", "w", "h", *more], run, out, (F.asc("id"),))


def reading_lines(boxes: DataFrame, *, key: str = "asset") -> DataFrame:
    """Boxes in lines from the top, left to right; tall ones, under 0.55 of their height wide, follow as a last line of their own."""

    def place(x, y, w, h):
        flat = sorted((i for i in range(len(x)) if w[i] >= h[i] * 0.55), key=lambda i: (y[i] + h[i] / 2, x[i]))
        tall = sorted((i for i in range(len(x)) if w[i] < h[i] * 0.55), key=lambda i: (x[i], y[i]))
        lines = bands([y[i] + h[i] / 2 for i in flat], [h[i] for i in flat], 0.42, True)
        found = sorted(zip(flat, lines), key=lambda p: (p[1], x[p[0]], y[p[0]]))
        return found + [(i, max(lines, default=-1) + 1) for i in tall]

    return _ordered(boxes, key, place)


def visual_order(boxes: DataFrame, *, key: str = "asset") -> DataFrame:
    """Boxes in lines from the top, along the line from the right where over half of them have ``rtl`` set."""

    def place(x, y, w, h, rtl):
        rows = sorted(range(len(x)), key=lambda i: (y[i] + h[i] / 2, x[i]))
        way = -1 if 2 * sum(map(bool, rtl)) > len(x) else 1
        lines = bands([y[i] + h[i] / 2 for i in rows], [h[i] for i in rows], 0.42, True)
        return sorted(zip(rows, lines), key=lambda p: (p[1], way * x[p[0]]))

    return _ordered(boxes, key, place, ("rtl",))


def column_order(boxes: DataFrame, *, key: str = "asset") -> DataFrame:
    """Boxes in columns from the right, each from the top."""

    def place(x, y, w, h):
        rows = sorted(range(len(x)), key=lambda i: (-(x[i] + w[i] / 2), y[i]))
        columns = bands([-(x[i] + w[i] / 2) for i in rows], [w[i] for i in rows], 0.6, False)
        return sorted(zip(rows, columns), key=lambda p: (p[1], y[p[0]]))

    return _ordered(boxes, key, place)


def fragment_order(boxes: DataFrame, *, key: str = "asset") -> DataFrame:
    """Boxes in lines whose members are near the line's first box, left to right."""

    def place(x, y, w, h):
        slack = max(4.0, sorted(h)[len(h) // 2] * 0.42)
        line, head, found = -1, None, []
        for i in sorted(range(len(x)), key=lambda i: y[i] + h[i] / 2):
            c = y[i] + h[i] / 2
            if head is None or c - head > slack:
                line, head = line + 1, c
            found.append((i, line))
        return sorted(found, key=lambda p: (p[1], x[p[0]]))

    return _ordered(boxes, key, place)
