"""Polygons, colours, region outcomes, guided blocks, plates and tracks on small fixtures."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumenframe.functions import geometry as geo
from lumenframe.operators import detection, plates
from lumenframe.streaming import tracker

POINTS = "array<struct<x: double, y: double>>"


def one(spark, *columns):
    return spark.range(1).select(*columns).first()


def polygon(*points):
    return F.array(*[F.struct(F.lit(float(x)).alias("x"), F.lit(float(y)).alias("y")) for x, y in points])


def inside_share(polygon_points, x, y):
    hit = False
    for (ax, ay), (bx, by) in zip(polygon_points, polygon_points[1:] + polygon_points[:1]):
        if (ay > y) != (by > y) and x < (bx - ax) * (y - ay) / (by - ay) + ax:
            hit = not hit
    return hit


@pytest.mark.parametrize("reverse", [False, True])
def test_clip_agrees_with_a_fine_grid(spark, reverse):
    star = [(0, 0), (8, 1), (5, 4), (9, 9), (3, 6)]
    diamond = [(4, 0), (8, 4), (4, 8), (0, 4)]
    convex = diamond[::-1] if reverse else diamond
    got = one(spark, geo.polygon_intersection(polygon(*star), polygon(*convex)).alias("v"))["v"]
    step = (np.arange(0, 900) + 0.5) / 100
    grid = sum(inside_share(star, x, y) and inside_share(diamond, x, y) for x in step[::3] for y in step[::3]) * 0.03**2
    assert got == pytest.approx(grid, abs=0.05)


def test_polygon_edge_cases(spark):
    box, far = polygon((0, 0), (2, 0), (2, 2), (0, 2)), polygon((5, 5), (6, 5), (6, 6))
    row = one(spark, geo.polygon_iou(box, box).alias("same"), geo.polygon_iou(box, far).alias("none"), geo.polygon_containment(polygon((0, 0), (1, 0), (1, 1), (0, 1)), box).alias("all"), geo.polygon_area(F.array().cast(POINTS)).alias("empty"))
    assert row["same"] == pytest.approx(1) and row["none"] == 0 and row["all"] == pytest.approx(1) and row["empty"] == 0


def test_colours(spark):
    lab = lambda *c: geo.lab(*map(F.lit, c))
    row = one(spark, lab(255, 255, 255).alias("white"), lab(255, 0, 0).alias("red"), geo.delta_e(lab(10, 20, 30), lab(10, 20, 30)).alias("same"))
    assert tuple(row["white"]) == pytest.approx((100, 0, 0), abs=0.05)
    assert tuple(row["red"]) == pytest.approx((53.24, 80.09, 67.20), abs=0.05)
    assert row["same"] == 0


def test_perspective_maps_corners(spark):
    source, target = [[0.0, 0.0], [10.0, 0.0], [10.0, 10.0], [0.0, 10.0]], [[1.0, 2.0], [12.0, 1.0], [14.0, 13.0], [0.0, 11.0]]
    df = spark.createDataFrame([(source, target), (source, [[0.0, 0.0]] * 3), (None, target), ([[0.0, 0.0]] * 4, target)], "s array<array<double>>, t array<array<double>>")
    got = [r[0] for r in df.select(geo.perspective("s", "t")).collect()]
    a = got[0]
    for (x, y), (u, v) in zip(source, target):
        d = a[6] * x + a[7] * y + 1
        assert ((a[0] * x + a[1] * y + a[2]) / d, (a[3] * x + a[4] * y + a[5]) / d) == pytest.approx((u, v))
    assert got[1:] == [None, None, None]


def boxes(spark, rows, more="", key="asset"):
    return spark.createDataFrame(rows, f"{key} long, id long, x long, y long, w long, h long{more}")


def test_outcomes(spark):
    truth = boxes(spark, [(1, 1, 0, 0, 100, 20), (1, 2, 0, 100, 100, 20), (1, 3, 0, 200, 40, 20), (1, 4, 40, 200, 40, 20), (1, 5, 0, 300, 100, 20), (1, 6, 0, 400, 100, 20), (1, 7, 0, 500, 100, 20)])
    found = boxes(spark, [
        (1, 1, 0, 0, 98, 20, 1), (1, 2, 0, 100, 45, 20, 1), (1, 3, 55, 100, 45, 20, 1), (1, 4, 0, 195, 90, 70, 3),
        (1, 5, 0, 300, 30, 20, 1), (1, 6, 60, 405, 100, 30, 1)], ", ancestors int")
    got = {r["id"]: (r["outcome"], r["merged_by"]) for r in detection.taxonomy(truth, found).collect()}
    assert got == {1: ("matched", None), 2: ("fragmented", None), 3: ("over_merged", "policy"), 4: ("over_merged", "policy"), 5: ("clipped", None), 6: ("displaced", None), 7: ("missed", None)}


def test_blocks_claim_candidates_once(spark):
    asked = spark.createDataFrame([(1, "b1", 0, "Exit here", 1), (1, "b2", 1, "EXIT HERE", None), (1, "b3", 2, "Parking place", None), (1, "b4", 3, "nothing", None), (1, "b5", 4, "", None)], "asset long, block string, place int, text string, expected int")
    pool = spark.createDataFrame([(1, 1, "exit here", False), (1, 2, "exit here", True), (1, 3, "parking plaze", True), (1, 4, None, True), (2, 5, "exit here", True)], "asset long, id long, text string, shipped boolean")
    found = detection.locate(asked, pool)
    assert {(r["block"], r["id"], r["method"]) for r in found.collect()} == {("b1", 2, "exact"), ("b2", 1, "exact"), ("b3", 3, "fuzzy")}
    state = {r["block"]: r["state"] for r in detection.located(asked, found).collect()}
    assert state == {"b1": "found", "b2": "found", "b3": "possible", "b4": "not_detected", "b5": "not_detected"}


def regions(spark):
    rows = [(1, 1, 0, 0, 40, 10, "one", 1), (1, 2, 0, 12, 40, 10, "two", 2), (1, 3, 500, 500, 40, 10, "far", 3), (1, 4, 0, 24, 40, 10, " ", 4), (1, 5, 900, 0, 40, 10, "pin", 5)]
    return spark.createDataFrame([(*r, False, "t" if r[1] == 3 else None, r[1] == 5) for r in rows], "asset long, id long, x long, y long, w long, h long, text string, reading_order int, square boolean, target string, dnt boolean")


def test_plates_keep_their_identity(spark):
    r = regions(spark)
    pinned = spark.createDataFrame([(1, "mine", [5, 99])], "asset long, uid string, members array<long>")
    first = plates.group(r, plates.nearby_edges(r), pinned)
    rows = {tuple(x["members"]): x for x in first.collect()}
    assert set(rows) == {(1, 2), (3,), (5, 99)}
    assert [rows[k]["origin"] for k in ((1, 2), (3,), (5, 99))] == ["derived", "solo", "pinned"]
    assert rows[(1, 2)]["source"] == "one\ntwo" and rows[(5, 99)]["uid"] == "mine" and [rows[k]["plate"] for k in ((1, 2), (3,), (5, 99))] == [1, 2, 3]
    old = spark.createDataFrame([(1, "kept", [1, 2], "one\ntwo"), (1, "lost", [3], "other")], "asset long, uid string, members array<long>, source string")
    again = {tuple(x["members"]): x["uid"] for x in plates.group(r, plates.nearby_edges(r), pinned, old).collect()}
    assert again[(1, 2)] == "kept" and again[(3,)] == rows[(3,)]["uid"]
    assert {(x["uid"], x["problem"]) for x in plates.problems(first, r).collect()} == {("mine", "missing_region")}
    changed = r.withColumn("text", F.when(F.col("id") == 2, "new").otherwise(F.col("text")))
    assert (rows[(1, 2)]["uid"], "stale") in {(x["uid"], x["problem"]) for x in plates.problems(first, changed).collect()}
    sent = {x["region_ids"]: (x["target"], x["status"]) for x in plates.units(first, r).collect()}
    assert sent == {"1,2": ("", "new"), "3": ("t", "translated")}


def test_plates_of_nothing(spark):
    r = regions(spark).limit(0)
    assert plates.group(r, plates.nearby_edges(r)).count() == 0


SEEN = "asset long, shot int, frame long, id long, x long, y long, w long, h long, text string"


def frames():
    rows = [(1, 0, f, f * 10, 5 * f, 0, 50, 20, "STOP") for f in (1, 2, 3, 9, 10)]
    rows += [(1, 0, f, f * 10 + 1, 300, 0, 50, 20, "go" if f < 10 else "other words") for f in (9, 10)]
    rows += [(1, 0, 40, 400, 50, 0, 50, 20, "STOP"), (1, 1, 1, 1000, 0, 0, 50, 20, None)]
    return rows


def test_tracks_survive_gaps_and_split_by_text(spark):
    got = {(r["shot"], r["id"]): (r["track"], r["confirmed"]) for r in tracker.track(spark.createDataFrame(frames(), SEEN)).collect()}
    assert got[(0, 10)] == (0, False) and got[(0, 20)] == got[(0, 30)] == got[(0, 90)] == got[(0, 100)] == (0, True)
    assert got[(0, 91)][0] != got[(0, 101)][0]  # the text changed
    assert got[(0, 400)][0] not in (0, got[(0, 101)][0])  # hidden for too long
    assert got[(1, 1000)] == (0, False)


def test_stream_gives_the_batch_tracks(spark, tmp_path):
    for low, high in ((0, 3), (3, 10), (10, 99)):
        part = [r for r in frames() if low < r[2] <= high]
        spark.createDataFrame(part, SEEN).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(SEEN).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    run = tracker.track_stream(stream).writeStream.format("memory").queryName("tracked").option("checkpointLocation", str(tmp_path / "state")).outputMode("append").trigger(availableNow=True).start()
    run.awaitTermination(120)
    rows = lambda df: sorted(tuple(r) for r in df.collect())
    assert rows(spark.table("tracked")) == rows(tracker.track(spark.createDataFrame(frames(), SEEN)))
