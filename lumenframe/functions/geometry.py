"""Column functions on boxes, polygons, colours, hashes and probabilities.

A box is four columns or a struct with x, y, w, h; names with a prefix are passed as such a struct (see ``box``).
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lumenframe.functions.text import as_col


class Box:
    """Four columns by prefix: ``Box("a_")`` stands for a_x, a_y, a_w, a_h."""

    def __init__(self, prefix: str = "", of: str | None = None):
        name = lambda k: F.col(f"{of}.{prefix}{k}" if of else f"{prefix}{k}")
        self.x, self.y, self.w, self.h = map(name, "xywh")

    @property
    def right(self) -> Column:
        return self.x + self.w

    @property
    def bottom(self) -> Column:
        return self.y + self.h

    @property
    def area(self) -> Column:
        return self.w * self.h


def intersection(a: Box, b: Box) -> Column:
    wide = F.least(a.right, b.right) - F.greatest(a.x, b.x)
    high = F.least(a.bottom, b.bottom) - F.greatest(a.y, b.y)
    return F.when((wide > 0) & (high > 0), wide * high).otherwise(0)


def iou(a: Box, b: Box) -> Column:
    """Intersection over union, 0 if disjoint."""
    both = intersection(a, b)
    return F.when(both > 0, both / (a.area + b.area - both)).otherwise(F.lit(0.0))


def containment(inner: Box, outer: Box) -> Column:
    """Share of the inner box inside the outer."""
    return F.when(inner.area > 0, intersection(inner, outer) / inner.area).otherwise(F.lit(0.0))


def overlap_min(a: Box, b: Box) -> Column:
    least = F.least(a.area, b.area)
    return F.when(least > 0, intersection(a, b) / least).otherwise(F.lit(0.0))


def gap(a: Box, b: Box) -> tuple[Column, Column]:
    """Distance along either axis, 0 if the boxes overlap there."""
    return F.greatest(F.lit(0), a.x - b.right, b.x - a.right), F.greatest(F.lit(0), a.y - b.bottom, b.y - a.bottom)


def adjacent(a: Box, b: Box, most: int = 15) -> Column:
    x, y = gap(a, b)
    return (x <= most) & (y <= most)


def is_tall(a: Box) -> Column:
    return a.h > a.w * 1.5


def nearby(a: Box, b: Box, square) -> Column:
    """Whether two texts may belong to one sign: on one line, one above the other, or in one column of square glyphs.

    Distances are allowed in multiples of the larger height; square scripts leave less room between glyphs.
    """
    x, y = gap(a, b)
    unit, wide, narrow = F.greatest(F.lit(1), a.h, b.h), F.greatest(F.lit(1), a.w, b.w), F.greatest(F.lit(1), F.least(a.w, b.w))
    square = as_col(square)
    on_line = (F.abs(a.y + a.h / 2 - b.y - b.h / 2) <= unit * 0.46) & (x <= unit * F.when(square, 1.2).otherwise(2.5))
    shared = F.greatest(F.lit(0), F.least(a.right, b.right) - F.greatest(a.x, b.x))
    stacked = (y <= unit * F.when(square, 0.9).otherwise(1.6)) & (shared / narrow >= 0.18)
    column = square & (F.abs(a.x + a.w / 2 - b.x - b.w / 2) <= wide * 0.6) & (y <= unit * 0.8)
    return on_line | stacked | column


def clip(a: Box, width, height) -> Column:
    """The box inside a frame, null where nothing is left."""
    x, y = F.greatest(a.x, F.lit(0)), F.greatest(a.y, F.lit(0))
    w, h = F.least(a.right, as_col(width)) - x, F.least(a.bottom, as_col(height)) - y
    return F.when((w > 0) & (h > 0), F.struct(x.alias("x"), y.alias("y"), w.alias("w"), h.alias("h")))


def polygon_area(points) -> Column:
    """Shoelace formula over an array of structs x, y."""
    p = as_col(points)
    after = F.concat(F.slice(p, F.lit(2), F.greatest(F.size(p) - 1, F.lit(0))), F.slice(p, 1, 1))
    cross = F.zip_with(p, after, lambda a, b: (a["x"] * b["y"] - b["x"] * a["y"]).cast("double"))
    return F.abs(F.aggregate(cross, F.lit(0.0), lambda s, v: s + v)) / 2


def polygon_box(points) -> Column:
    p = as_col(points)
    xs, ys = F.transform(p, lambda q: q["x"]), F.transform(p, lambda q: q["y"])
    return F.struct(F.array_min(xs).alias("x"), F.array_min(ys).alias("y"), (F.array_max(xs) - F.array_min(xs)).alias("w"), (F.array_max(ys) - F.array_min(ys)).alias("h"))


def harmonise(candidate, truth, tolerance: float = 0.5) -> Column:
    """The candidate's box, as corners, where the truth is its own box (to this area); else the candidate as it is."""
    box = polygon_box(truth)
    upright = F.abs(polygon_area(truth) - (box["w"] * box["h"]).cast("double")) <= tolerance
    own = polygon_box(candidate)
    left, top, right, bottom = own["x"], own["y"], own["x"] + own["w"], own["y"] + own["h"]
    corners = F.array(_point(left, top), _point(right, top), _point(right, bottom), _point(left, bottom))
    return F.when(upright, corners).otherwise(F.transform(as_col(candidate), lambda q: _point(q["x"], q["y"])))


def point_in_polygon(x, y, points) -> Column:
    """Even-odd rule by a ray to the right."""
    x, y, p = as_col(x), as_col(y), as_col(points)
    after = F.concat(F.slice(p, F.lit(2), F.greatest(F.size(p) - 1, F.lit(0))), F.slice(p, 1, 1))
    hits = F.zip_with(p, after, lambda a, b: F.when(((a["y"] > y) != (b["y"] > y)) & (x < (b["x"] - a["x"]) * (y - a["y"]) / F.nullif(b["y"] - a["y"], F.lit(0)) + a["x"]), 1).otherwise(0))
    return F.aggregate(hits, F.lit(0), lambda s, v: s + v) % 2 == 1


def inflate(points, factor) -> Column:
    """Corners moved away from their centre."""
    p = as_col(points)
    n = F.size(p)
    cx = F.aggregate(p, F.lit(0.0), lambda s, q: s + q["x"]) / n
    cy = F.aggregate(p, F.lit(0.0), lambda s, q: s + q["y"]) / n
    return F.transform(p, lambda q: F.struct((cx + (q["x"] - cx) * factor).alias("x"), (cy + (q["y"] - cy) * factor).alias("y")))


def is_convex_quad(points) -> Column:
    """Four corners whose turns all go the same way."""
    p = as_col(points)
    turns = [
        (p[(i + 1) % 4]["x"] - p[i]["x"]) * (p[(i + 2) % 4]["y"] - p[(i + 1) % 4]["y"]) - (p[(i + 1) % 4]["y"] - p[i]["y"]) * (p[(i + 2) % 4]["x"] - p[(i + 1) % 4]["x"])
        for i in range(4)
    ]
    least, most = F.least(*turns), F.greatest(*turns)
    return F.coalesce((F.size(p) == 4) & ((least > 1e-9) | (most < -1e-9)), F.lit(False))


def hamming_hex(a, b) -> Column:
    """Differing bits of two hexadecimal hashes of 16 digits, in halves; null if their lengths differ."""
    a, b = as_col(a), as_col(b)
    half = lambda c, at: F.conv(F.substring(c, at, 8), 16, 10).cast("bigint")
    bits = F.bit_count(half(a, 1).bitwiseXOR(half(b, 1))) + F.bit_count(half(a, 9).bitwiseXOR(half(b, 9)))
    return F.when(F.length(a) == F.length(b), bits)


def visual_similarity(distance, bits: int = 63) -> Column:
    return F.greatest(F.lit(0.0), 1 - as_col(distance) / bits)


def sigmoid(c) -> Column:
    return 1 / (1 + F.exp(-as_col(c)))


def logit(c, clamp: float = 1e-6) -> Column:
    p = F.least(F.greatest(as_col(c), F.lit(clamp)), F.lit(1 - clamp))
    return F.log(p / (1 - p))


def tempered(c, temperature) -> Column:
    return sigmoid(logit(c) / temperature)


def bhattacharyya(a, b) -> Column:
    """Distance of two histograms, 1 if their sizes differ."""
    a, b = as_col(a), as_col(b)
    total = lambda x: F.aggregate(x, F.lit(0.0), lambda s, v: s + v)
    share = F.aggregate(F.zip_with(a, b, lambda x, y: F.sqrt(x * y)), F.lit(0.0), lambda s, v: s + v) / F.sqrt(total(a) * total(b))
    return F.when(F.size(a) == F.size(b), F.sqrt(F.greatest(F.lit(0.0), 1 - share))).otherwise(F.lit(1.0))


def hex_rgb(c) -> Column:
    """#rgb or #rrggbb as a struct of numbers; null otherwise."""
    c = F.lower(F.ltrim(as_col(c), F.lit("#")))
    full = F.when(c.rlike("^[0-9a-f]{3}$"), F.regexp_replace(c, "(.)", "$1$1")).when(c.rlike("^[0-9a-f]{6}$"), c)
    part = lambda at: F.conv(F.substring(full, at, 2), 16, 10).cast("int")
    return F.when(full.isNotNull(), F.struct(part(1).alias("r"), part(3).alias("g"), part(5).alias("b")))


def luminance(r, g, b) -> Column:
    def linear(c):
        c = as_col(c) / 255.0
        return F.when(c <= 0.04045, c / 12.92).otherwise(F.pow((c + 0.055) / 1.055, 2.4))

    return 0.2126 * linear(r) + 0.7152 * linear(g) + 0.0722 * linear(b)


def contrast(a: Column, b: Column) -> Column:
    return (F.greatest(a, b) + 0.05) / (F.least(a, b) + 0.05)


def dot(a, b) -> Column:
    return F.aggregate(F.zip_with(as_col(a), as_col(b), lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, v: s + v)


def sign_hash(vector, low: int, n: int = 32) -> Column:
    """Signs of ``n`` components from ``low`` on, as bits of a number, the first the highest."""
    return F.aggregate(F.slice(as_col(vector), low + 1, n), F.lit(0).cast("bigint"), lambda s, v: s * 2 + F.when(v > 0, 1).otherwise(0))


def _after(p) -> Column:
    """Each corner's successor, round the polygon."""
    return F.concat(F.slice(p, F.lit(2), F.greatest(F.size(p) - 1, F.lit(0))), F.slice(p, 1, 1))


def _point(x, y) -> Column:
    return F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))


def box_polygon(a: Box) -> Column:
    """A box's corners, clockwise on a screen."""
    return F.array(_point(a.x, a.y), _point(a.right, a.y), _point(a.right, a.bottom), _point(a.x, a.bottom))


def clip_convex(subject, convex) -> Column:
    """The part of a polygon inside a convex one of either direction, cut by one side after the other; doubles throughout."""
    subject, convex = as_col(subject), as_col(convex)
    twice = F.aggregate(F.zip_with(convex, _after(convex), lambda a, b: a["x"] * b["y"] - b["x"] * a["y"]), F.lit(0.0), lambda s, v: s + v)
    turned = F.when(twice < 0, F.reverse(convex)).otherwise(convex)
    sides = F.zip_with(turned, _after(turned), lambda a, b: F.struct(a.alias("a"), (b["x"] - a["x"]).alias("dx"), (b["y"] - a["y"]).alias("dy")))
    corners = F.transform(subject, lambda q: _point(q["x"], q["y"]))
    nothing = F.slice(corners, 1, 0)

    def depth(side, q):
        return side["dx"] * (q["y"] - side["a"]["y"]) - side["dy"] * (q["x"] - side["a"]["x"])

    def cut(polygon, side):
        def piece(p, q):
            at, to = depth(side, p), depth(side, q)
            share = at / F.nullif(at - to, F.lit(0.0))
            crossing = F.array(_point(p["x"] + share * (q["x"] - p["x"]), p["y"] + share * (q["y"] - p["y"])))
            return F.concat(F.when(at >= 0, F.array(p)).otherwise(nothing), F.when((at >= 0) != (to >= 0), crossing).otherwise(nothing))

        return F.flatten(F.zip_with(polygon, _after(polygon), piece))

    return F.aggregate(sides, corners, cut)


def polygon_intersection(a, b) -> Column:
    """Common area of a polygon and a convex one."""
    return polygon_area(clip_convex(a, b))


def polygon_iou(a, b) -> Column:
    both = polygon_intersection(a, b)
    return F.when(both > 0, both / (polygon_area(a) + polygon_area(b) - both)).otherwise(F.lit(0.0))


def polygon_containment(inner, outer) -> Column:
    """Share of the inner polygon inside a convex outer one."""
    area = polygon_area(inner)
    return F.when(area > 0, polygon_intersection(inner, outer) / area).otherwise(F.lit(0.0))


def sampled_containment(a: Box, points, side: int = 7) -> Column:
    """Share of a grid of ``side`` by ``side`` cell centres of a box that lie in a polygon of any shape."""
    grid = F.array(*[F.struct((a.x + a.w * ((i + 0.5) / side)).alias("x"), (a.y + a.h * ((j + 0.5) / side)).alias("y")) for i in range(side) for j in range(side)])
    return F.size(F.filter(grid, lambda q: point_in_polygon(q["x"], q["y"], points))) / (side * side)


def association_score(a: Box, b: Box, text_similarity, same_shot) -> Column:
    """How well an observation continues a track: overlap and text, 0 across shots."""
    return F.when(as_col(same_shot), 0.65 * iou(a, b) + 0.35 * as_col(text_similarity)).otherwise(F.lit(0.0))


def lab(r, g, b) -> Column:
    """CIE L*a*b* (D65) of sRGB values of 0 to 255."""

    def linear(c):
        v = as_col(c) / 255
        return F.when(v <= 0.04045, v / 12.92).otherwise(F.pow((v + 0.055) / 1.055, F.lit(2.4)))

    def root(t):
        return F.when(t > (6 / 29) ** 3, F.cbrt(t)).otherwise(t / (3 * (6 / 29) ** 2) + 4 / 29)

    rr, gg, bb = linear(r), linear(g), linear(b)
    # the sRGB primaries' matrix and the D65 white point, fixed values
    x = root((0.4124564 * rr + 0.3575761 * gg + 0.1804375 * bb) / 0.95047)
    y = root(0.2126729 * rr + 0.7151522 * gg + 0.0721750 * bb)
    z = root((0.0193339 * rr + 0.1191920 * gg + 0.9503041 * bb) / 1.08883)
    return F.struct((116 * y - 16).alias("l"), (500 * (x - y)).alias("a"), (200 * (y - z)).alias("b"))


def delta_e(one: Column, other: Column) -> Column:
    """Colour difference of 1976."""
    return F.sqrt(sum((F.pow(one[k] - other[k], F.lit(2)) for k in "ab"), F.pow(one["l"] - other["l"], F.lit(2))))


@F.pandas_udf(T.ArrayType(T.DoubleType()))
def perspective(source: pd.Series, target: pd.Series) -> pd.Series:
    """Eight coefficients of the projection of four source corners [x, y] onto four target ones; null if there is none."""
    out = []
    for a, b in zip(source, target):
        try:
            rows, want = [], []
            for (x, y), (u, v) in zip(a, b, strict=True):
                rows += [[x, y, 1, 0, 0, 0, -u * x, -u * y], [0, 0, 0, x, y, 1, -v * x, -v * y]]
                want += [u, v]
            found = np.linalg.solve(np.array(rows, float), np.array(want, float))
            out.append(found.tolist() if np.isfinite(found).all() else None)
        except (np.linalg.LinAlgError, TypeError, ValueError):
            out.append(None)
    return pd.Series(out, dtype=object)
