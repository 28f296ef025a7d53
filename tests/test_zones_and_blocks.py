"""Polygons over pixels against point sampling and hand-worked areas; block functions against whole pictures."""

import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from verdanta.operators import blocks, zones

SQUARE = (1.0, 0.0, 0.0, 0.0, 1.0, 0.0)
H, W = 12, 150
SHAPES = {
    1: "POLYGON ((1 1, 5 1, 5 4, 1 4, 1 1))",
    2: "polygon((0.5 0.5,9.25 3.75,4.5 8.125,0.5 0.5))",
    3: "MULTIPOLYGON (((1 1, 8 1, 8 8, 1 8, 1 1), (2.5 2.5, 2.5 6.5, 6.5 6.5, 6.5 2.5, 2.5 2.5)), ((149 9, 151 9, 151 12, 149 12, 149 9)))",
    4: "POLYGON ((-5 -5, 155 -5, 155 20, -5 20, -5 -5))",
    5: "POINT (1 1)",
    6: None,
    7: "POLYGON ((-3.5 2.25, 4.75 -2.5, 200 6, 30 15.5, -3.5 2.25))",
    8: "POLYGON ((3 3, 3 3, 3 3))",
    9: "POLYGON Z ((1e0 2.5 7, 6 2.5 7, 6 3.5 7, +1.0 3.5 7, 1e0 2.5 7))",
    10: "POLYGON ((200 3, 300 3, 300 9, 200 3))",
}


def covered(spark, shapes, transform=SQUARE):
    z = spark.createDataFrame(list(shapes.items()), "id int, wkt string")
    out = {i: np.zeros((H, W)) for i in shapes}
    for r in zones.coverage(z, ["id"], "wkt", transform, H, W).collect():
        assert 0 <= r["c0"] <= r["c1"] < W and 0 <= r["r"] < H
        out[r["id"]][r["r"], r["c0"] : r["c1"] + 1] += r["share"]
    return out


def inside(points, x, y):
    """Even-odd rule over all rings at once."""
    odd = np.zeros(np.broadcast(x, y).shape, bool)
    for ring in points:
        for (x0, y0), (x1, y1) in zip(ring, ring[1:] + ring[:1], strict=True):
            if y0 != y1:
                odd ^= ((y0 > y) != (y1 > y)) & (x < (x1 - x0) * (y - y0) / (y1 - y0) + x0)
    return odd


def test_shares_of_pixels(spark):
    got = covered(spark, SHAPES)
    k = 24
    y, x = (np.arange(H * k)[:, None] + 0.5) / k, (np.arange(W * k)[None] + 0.5) / k
    for i, text in SHAPES.items():
        if not text or i in (5, 9):
            continue
        points = [[tuple(map(float, p.split()[:2])) for p in r.split(",")] for r in re.findall(r"\(([^()]+)\)", text)]
        want = inside(points, x, y).reshape(H, k, W, k).mean((1, 3))
        assert np.abs(got[i] - want).max() < 0.07 and abs(got[i].sum() - want.sum()) < 0.02 * want.sum() + 1e-9, i
    assert [got[i].sum() for i in (1, 3, 4, 5, 6, 8, 9, 10)] == [pytest.approx(a) for a in (12, 49 - 16 + 3, H * W, 0, 0, 0, 5, 0)]
    assert got[3][4, 4] == 0 and got[3][2, 2] == pytest.approx(0.75) and got[9][2, 3] == pytest.approx(0.5)


def test_shares_do_not_depend_on_direction_or_map(spark):
    turned = {1: "POLYGON ((2 1, 2 3, 7 4.5, 2 1))", 2: "POLYGON ((2 1, 7 4.5, 2 3, 2 1))"}
    got = covered(spark, turned)
    assert np.allclose(got[1], got[2]) and got[1].sum() == pytest.approx(5.0)
    north_up = {1: "POLYGON ((1020 1990, 1020 1970, 1070 1955, 1020 1990))"}
    assert np.allclose(covered(spark, north_up, (10.0, 0.0, 1000.0, 0.0, -10.0, 2000.0))[1], got[1])


def test_reduction_over_polygons(spark):
    rows = [(r, c, None if (r, c) == (2, 2) else float(r * 10 + c)) for r in range(H) for c in range(W)]
    z = spark.createDataFrame([(1, "POLYGON ((1.5 1, 4 1, 4 4, 1.5 4, 1.5 1))"), (2, "POLYGON ((300 1, 301 1, 301 2, 300 1))"), (None, "LINESTRING (1 1, 2 2)"), (3, "POLYGON ((2.25 2.25, 2.75 2.25, 2.5 2.75, 2.25 2.25))")], "id int, wkt string")
    got = {r["id"]: r for r in zones.reduced(spark.createDataFrame(rows, "r long, c long, v double"), z, ["id"], "wkt", "v", SQUARE, H, W).collect()}
    share = {(r, c): 0.5 if c == 1 else 1.0 for r in (1, 2, 3) for c in (1, 2, 3) if (r, c) != (2, 2)}
    assert got[1]["n"] == 8 and got[1]["covered"] == pytest.approx(sum(share.values()))
    assert got[1]["mean"] == pytest.approx(sum(w * (r * 10 + c) for (r, c), w in share.items()) / sum(share.values()))
    assert (got[1]["min"], got[1]["max"]) == (11.0, 33.0)
    assert all(got[i]["n"] == 0 and got[i]["mean"] is None for i in (2, 3, None))


def test_a_large_polygon_takes_few_rows(spark):
    z = spark.createDataFrame([(1, "POLYGON ((0 0, 100000 0, 100000 1000, 0 1000, 0 0))")], "id int, wkt string")
    assert zones.coverage(z, ["id"], "wkt", SQUARE, 1000, 100_000).count() <= 3 * 1000


@pytest.mark.parametrize(("block", "halo"), [(16, 2), (4, 2), (7, 3), (100, 2)])
def test_blocks_give_the_whole_picture(spark, block, halo):
    rng = np.random.default_rng(block)
    pictures, rows = {}, []
    for g in ("a", None):
        v = rng.random((30, 23))
        v[rng.random(v.shape) < 0.1] = np.nan
        pictures[g] = v
        rows += [(g, r - 5, c + 100, None if np.isnan(v[r, c]) else float(v[r, c]), 1) for r in range(30) for c in range(23) if (r, c) != (3, 3)]
        v[3, 3] = np.nan
    df = spark.createDataFrame(rows + rows[:5], "g string, r long, c long, v double, r0 int")

    def near(a):
        padded = np.pad(a[0], 2, constant_values=np.nan)
        seen = np.lib.stride_tricks.sliding_window_view(padded, (5, 5)).reshape(*a.shape[1:], 25)
        n = (~np.isnan(seen)).sum(-1)
        return np.stack([np.where(n > 0, np.nansum(seen, -1) / np.maximum(n, 1), np.nan), np.where(a[0] > 0.5, 1.0, np.nan)])

    got = blocks.map_blocks(df, ["g"], near, ["v"], ["mean", "high"], halo, block).collect()
    assert len(got) == 2 * (30 * 23 - 1)
    for r in got:
        want = near(pictures[r["g"]][None])[:, r["r"] + 5, r["c"] - 100]
        for w, x in zip(want, (r["mean"], r["high"]), strict=True):
            assert x is None if np.isnan(w) else x == pytest.approx(w)


def test_blocks_refuse_what_they_cannot_do(spark):
    df = spark.createDataFrame([(1, 0, 0, 1.0)], "g int, r long, c long, v double")
    with pytest.raises(ValueError):
        blocks.map_blocks(df, ["g"], lambda a: a, ["v"], ["x"], 9, 16)
    with pytest.raises(Exception, match="returned"):
        blocks.map_blocks(df, ["g"], lambda a: a[0], ["v"], ["x"]).collect()
    assert blocks.map_blocks(df.where("g > 1"), ["g"], lambda a: a, ["v"], ["x"]).collect() == []
    assert blocks.map_blocks(df.withColumn("g", F.lit(None).cast("int")), ["g"], lambda a: a + 1, ["v"], ["x"]).first()["x"] == 2.0
