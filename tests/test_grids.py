"""Default grids in degrees and composites of scenes on different grids, against plain loops."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from verdanta.functions import mapping
from verdanta.operators import grids, tiles


def places(spark, points, zone):
    """x, y in a zone of (lon, lat)."""
    rows = spark.createDataFrame(points, "lon double, lat double").select(mapping.to_utm(F.col("lon"), F.col("lat"), zone).alias("m")).collect()
    return [(r["m"]["x"], r["m"]["y"]) for r in rows]


def test_default_grid_of_degrees_is_the_grid_itself(spark):
    """Without a change of system the grid stays, square pixels given."""
    h, w, t = grids.default_grid(spark, 30, 40, (0.25, 0.0, 70.0, 0.0, -0.25, 20.0), 0)
    assert (h, w) == (30, 40) and t == pytest.approx((0.25, 0.0, 70.0, 0.0, -0.25, 20.0))
    h, w, t = grids.default_grid(spark, 10, 10, (0.3, 0.0, 70.0, 0.0, -0.4, 20.0), 0)  # as many pixels to the diagonal
    assert t[0] == pytest.approx(math.hypot(3, 4) / math.hypot(10, 10)) and (h, w) == (round(4 / t[0]), round(3 / t[0]))
    assert grids.default_grid(spark, 1, 1000, (1e-6, 0.0, 0.0, 0.0, -1e-6, 0.0), 0)[:2] == (1, 1000)


@pytest.mark.parametrize("north", [True, False])
def test_default_grid_holds_the_scene(spark, north):
    transform = (30.0, 0.0, 300000.0, 0.0, -30.0, 4600000.0 if north else 5500000.0)
    h, w, t = grids.default_grid(spark, 200, 300, transform, 43, north)
    rng = np.random.default_rng(1)
    points = [(300000.0 + 30 * float(x) * 300, transform[5] - 30 * float(y) * 200) for x, y in rng.random((200, 2))]
    got = spark.createDataFrame(points, "x double, y double").select(mapping.from_utm(F.col("x"), F.col("y"), 43, north).alias("p")).collect()
    cols, rows = [(r["p"]["lon"] - t[2]) / t[0] for r in got], [(r["p"]["lat"] - t[5]) / t[4] for r in got]
    assert -0.01 < min(cols) < max(cols) < w + 0.51 and -0.01 < min(rows) < max(rows) < h + 0.51
    assert max(cols) > w - 12 and max(rows) > h - 12  # and not much more
    small = [(1, r, c, float(r * 9 + c)) for r in range(8) for c in range(9)]
    size, side, there = grids.default_grid(spark, 8, 9, transform, 43, north)
    out = tiles.to_wgs84(spark.createDataFrame(small, "g int, r long, c long, v double"), ["g"], 8, 9, transform, 43, north, size, side, there).collect()
    assert 0.7 * 72 < len(out) <= size * side and all(0 <= r["v"] <= 71 for r in out)


def test_scenes_of_two_zones_on_one_grid(spark):
    """Against mapping every target's centre to every scene; finer, coarser and turned scenes, null values, an unknown scene."""
    target, h, w = (0.00012, 0.0, 77.999, 0.0, -0.00009, 41.501), 15, 17
    (x43, y43), (x44, y44) = (places(spark, [(78.0, 41.5)], z)[0] for z in (43, 44))
    scenes = [(1, 10.0, 0.0, x43 - 80, 0.0, -10.0, y43 + 70, 43, True), (2, 3.0, 0.0, x44 - 60, 0.0, -3.0, y44 + 60, 44, True), (3, 40.0, 9.0, x43 - 150, 9.0, -40.0, y43 + 150, 43, True), (4, 0.0002, 0.0, 77.999, 0.0, -0.0002, 41.501, 0, True), (5, 10.0, 0.0, 1e6, 0.0, -10.0, 9e6, 43, True)]
    rng = np.random.default_rng(3)
    rows, held = [], {}
    for s, n in ((1, 18), (2, 40), (3, 8), (4, 10), (5, 4), (99, 3)):
        for r in range(n):
            for c in range(n):
                v = None if rng.random() < 0.1 else float(rng.random())
                held[s, r, c] = v
                rows.append((s, r, c, v))
    px = spark.createDataFrame(rows, "scene_id long, row long, col long, v double")
    df = spark.createDataFrame(scenes, "scene_id long, a double, b double, c double, d double, e double, f double, zone int, north boolean")
    centres = [(target[2] + target[0] * (c + 0.5), target[5] + target[4] * (r + 0.5)) for r in range(h) for c in range(w)]
    at = {0: centres, 43: places(spark, centres, 43), 44: places(spark, centres, 44)}
    want = {}
    for s, a, b, c0, d, e, f, zone, _ in scenes:
        det = a * e - b * d
        for k, (x, y) in enumerate(at[zone]):
            col, row = math.floor((e * (x - c0) - b * (y - f)) / det), math.floor((a * (y - f) - d * (x - c0)) / det)
            if (s, row, col) in held:
                want[s, k // w, k % w] = held[s, row, col]
    got = {(r["scene_id"], r["row"], r["col"]): r["v"] for r in grids.on_one_grid(px, df, h, w, target).collect()}
    assert got == want and {k[0] for k in want} == {1, 2, 3, 4}
    means = grids.composite_of_grids(px, df, ["v"], h, w, target, reducer="mean").collect()
    for r in means:
        own = [v for (s, a, b), v in want.items() if (a, b) == (r["row"], r["col"]) and v is not None]
        assert r["v"] == (pytest.approx(np.mean(own)) if own else None)
    in_zone = grids.on_one_grid(px.where("scene_id = 1"), df, 5, 5, (10.0, 0.0, x43 - 50, 0.0, -10.0, y43 + 40), 43).collect()
    assert {(r["row"], r["col"]): r["v"] for r in in_zone} == {(r, c): held[1, r + 3, c + 3] for r in range(5) for c in range(5)}


def test_places_are_worked_out_once_and_only_near_the_target(spark):
    """A plan that repeats the mapping at each use took 4 ms a pixel; pixels beyond the target aren't mapped at all."""
    target = (0.0001, 0.0, 77.9985, 0.0, -0.0001, 41.5018)
    scenes = spark.createDataFrame([(z, z, True, 10.0, 0.0, c, 0.0, -10.0, 4598800.0) for z, c in ((43, 750200.0), (44, 249400.0))], "scene_id long, zone int, north boolean, a double, b double, c double, d double, e double, f double")
    pixels = spark.range(2 * 40 * 50).selectExpr("43 + id div 2000 AS scene_id", "id % 2000 div 50 AS row", "id % 50 AS col", "double(id) AS v")
    found = grids.on_one_grid(pixels, scenes, 24, 30, target)
    assert found._jdf.queryExecution().optimizedPlan().toString().upper().count("ATANH") < 100
    told = scenes.select(*grids.TRANSFORM, F.col("zone").alias("scene_zone"), F.col("north").alias("scene_north"))
    bounds = {r["scene_zone"]: r for r in grids.scene_bounds(told, 24, 30, target, F.lit(0), F.lit(True)).collect()}
    spots = pixels.join(found.select("scene_id", "v"), ["scene_id", "v"]).groupBy("scene_id").agg(*[f(x).alias(f"{n}_{x}") for n, f in (("lo", F.min), ("hi", F.max)) for x in ("row", "col")]).collect()
    assert len(spots) == 2
    for s in spots:
        b = bounds[s["scene_id"]]
        assert b["lo_r"] <= s["lo_row"] and s["hi_row"] <= b["hi_r"] and b["lo_c"] <= s["lo_col"] and s["hi_col"] <= b["hi_c"]
        assert b["hi_r"] - b["lo_r"] < 60
    # a scene on the other side of the earth bounds nothing, and its pixels still map nowhere
    far = scenes.withColumn("zone", F.lit(13))
    assert grids.scene_bounds(far.select(*grids.TRANSFORM, F.col("zone").alias("scene_zone"), F.col("north").alias("scene_north")), 24, 30, target, F.lit(0), F.lit(True)).where("lo_r IS NOT NULL").isEmpty()
    assert grids.on_one_grid(pixels, far, 24, 30, target).isEmpty()
