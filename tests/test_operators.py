"""Hand-worked cases: nodata, zero denominators, equal thresholds, ties, empty tables, and properties."""

import heapq
import json
import math
import time

import numpy as np
import pandas as pd
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from verdanta.functions import indices, mapping, masks, radiometry
from verdanta.operators import boxes, change, crowns, stats, tiles
from verdanta.sources import imagery
from verdanta.streaming.arrivals import event_window_counts


def one(df):
    return df.collect()[0]


def test_indices_nodata_and_zero_denominator(spark):
    df = spark.createDataFrame([(0.5, 0.1), (0.0, 0.0), (None, 0.3)], "nir double, red double")
    got = [r[0] for r in df.select(indices.ndvi(F.col("nir"), F.col("red"))).collect()]
    assert got[0] == pytest.approx(0.4 / 0.6) and got[1:] == [None, None]
    lai = [r[0] for r in df.select(indices.lai(indices.ndvi(F.col("nir"), F.col("red")))).collect()]
    assert lai[0] == pytest.approx(-math.log((0.69 - 2 / 3) / 0.59) / 0.91) and lai[1:] == [None, None]
    saturated = spark.createDataFrame([(0.9,)], "v double").select(indices.lai(F.col("v")))
    assert one(saturated)[0] == pytest.approx(-math.log(1e-6) / 0.91)
    with pytest.raises(ValueError):
        indices.lai(F.col("nir"), "other")
    assert set(indices.with_indices(df).columns) == {"nir", "red", "ndvi", "savi", "msavi2", "evi2", "lai"}


def test_masks_are_never_null(spark):
    df = spark.createDataFrame([(None, None, None), (2, 64, 0.25), (8, 64 + 8, 0.1)], "scl int, qa int, blue double")
    got = df.select(masks.scl_valid(F.col("scl")), masks.qa_valid(F.col("qa")), masks.bright_valid(F.col("blue"))).collect()
    assert [tuple(r) for r in got] == [(False, False, False), (True, True, False), (False, False, True)]


def test_nodata_ingest(spark):
    df = spark.createDataFrame([(float("nan"),), (-9999.0,), (0.2,)], "nir double")
    assert [r[0] for r in imagery.nodata_to_null(df, ["nir"], -9999.0).collect()] == [None, None, 0.2]


def test_classes_are_inclusive(spark):
    df = spark.createDataFrame([(0.45,), (0.25,), (0.1,), (0.09,), (None,)], "v double")
    assert [r[0] for r in df.select(change.classify(F.col("v"))).collect()] == [3, 2, 1, 0, 255]
    assert [r[0] for r in df.select(change.classify(F.col("v"), {"dense": 0.05})).collect()] == [3, 3, 3, 3, 255]


def test_difference_and_swap(spark):
    rows = [(i, 0, 0.3, 0.3 + (0.4 if i < 3 else -0.4 if i > 17 else 0.01 * (i % 3))) for i in range(20)] + [(20, 0, None, 0.2)]
    pairs = spark.createDataFrame(rows, "row long, col long, n1 double, n2 double")
    d = change.difference(pairs)
    n = one(d.agg(*[F.count(F.when(F.col(c), 1)) for c in ("gain", "loss", "no_change")]))
    assert tuple(n) == (3, 2, 15)
    swapped = change.difference(pairs.select("row", "col", F.col("n2").alias("n1"), F.col("n1").alias("n2")))
    assert (swapped.where("gain").count(), swapped.where("loss").count()) == (2, 3)


def test_change_vectors_modes(spark):
    df = spark.createDataFrame([(0.0, 0.0, 1.0, -1.0), (0.0, 0.0, None, None), (0.0, 0.0, -3.0, 4.0), (0.0, 0.0, 0.0, 0.0)], "a double, b double, c double, d double")
    got = change.change_vectors(df, ["a", "b"], ["c", "d"], k=0.5).collect()
    assert [r["magnitude"] for r in got] == pytest.approx([math.sqrt(2), 0, 5, 0])
    assert [r["change_type"] for r in got] == [0, 0, 2, 0]
    assert change.change_vectors(df, ["a", "b"], ["c", "d"], nodata="drop").collect()[1]["magnitude"] is None
    assert change.change_vectors(df, ["a"], ["c"]).collect()[0]["direction"] is None
    with pytest.raises(ValueError):
        change.change_vectors(df, ["a"], ["c", "d"])


def test_transitions_keep_zeros(spark):
    m = change.transitions(spark.createDataFrame([(0, 3), (0, 3), (255, 1)], "c1 int, c2 int"))
    assert m.count() == 16 and one(m.agg(F.sum("pixels")))[0] == 2
    assert one(change.net_change(m).agg(F.sum("net_ha")))[0] == pytest.approx(0)
    assert tuple(one(change.forest_change(m))) == pytest.approx((0.02, 0.0))


def test_summary_rounds_half_to_even_and_takes_empty(spark):
    schema = "row long, col long, n1 double, n2 double"
    s = one(change.summary(spark.createDataFrame([(0, 0, 0.4, 0.2), (0, 1, 0.4, 0.5), (0, 2, None, 0.9)], schema), 12.5))
    assert (s["estimated_trees_t1"], s["estimated_trees_t2"]) == (1, 0) and s["total_area_ha"] == 0.0
    assert one(change.summary(spark.createDataFrame([], schema), 100.0))["mean_ndvi_t1"] is None


def test_tree_counts(spark):
    got = one(change.tree_counts(spark.createDataFrame([("urban", 1000.0)], "biome string, canopy_area_m2 double")))
    assert tuple(got)[2:] == (67, 33, 1000)
    with pytest.raises(Exception, match="unknown biome"):
        change.tree_counts(spark.createDataFrame([("sea", 1.0)], "biome string, canopy_area_m2 double")).collect()


def test_stats_empty_and_percentile(spark):
    empty = one(stats.column_stats(spark.createDataFrame([], "v double"), "v"))
    assert empty["count"] == 0 and empty["mean"] is None
    df = spark.createDataFrame([(float(i),) for i in range(101)] + [(None,)], "v double")
    x = np.arange(101.0)
    lo, hi = np.percentile(x, [2, 98])
    got = {r["v"]: r["scaled"] for r in stats.clip_to_percentile(df, "v").collect()}
    assert got[50.0] == pytest.approx((50 - lo) / (hi - lo + 1e-9)) and got[None] is None


def test_histogram_match_follows_numpy(spark):
    rng = np.random.default_rng(3)
    a, b = rng.normal(0, 1, 200).round(1), rng.normal(5, 2, 150).round(1)
    make = lambda x: spark.createDataFrame([("n", float(v)) for v in x], "band string, v double")
    got = {r["v"]: r["matched"] for r in stats.histogram_match(make(a), make(b), "v", ["band"]).collect()}
    sv, sn = np.unique(a, return_counts=True)
    rv, rn = np.unique(b, return_counts=True)
    want = np.interp(np.cumsum(sn) / len(a), np.cumsum(rn) / len(b), rv)
    assert [got[float(v)] for v in sv] == pytest.approx(want.tolist())


def grid_frame(spark, v):
    return spark.createDataFrame([(0, r, c, float(v[r, c])) for r in range(len(v)) for c in range(v.shape[1])], "g int, r long, c long, v double")


def test_smoothing_is_a_mirrored_convolution(spark):
    v = np.random.default_rng(1).random((9, 7))
    k = np.array([w for _, w in tiles.gaussian_kernel(1.5)])
    pad = len(k) // 2
    want = np.apply_along_axis(lambda x: np.convolve(np.pad(x, pad, "symmetric"), k, "valid"), 0, v)
    want = np.apply_along_axis(lambda x: np.convolve(np.pad(x, pad, "symmetric"), k, "valid"), 1, want)
    got = np.zeros_like(v)
    for r in tiles.smoothed(grid_frame(spark, v), ["g"], 9, 7).collect():
        got[r["r"], r["c"]] = r["v"]
    assert np.allclose(got, want)


def test_tiles_then_mean_is_identity(spark):
    df = spark.createDataFrame([(r, c, float(r * 20 + c)) for r in range(20) for c in range(20)], "row long, col long, nir double")

    def logits(tile):
        assert tile.shape == (1, 8, 8)
        return tile[0] / 400

    got = tiles.predict_tiles(df, logits, ["nir"], 8, 3).collect()
    assert len(got) == 400 and all(r["probability"] == pytest.approx(1 / (1 + math.exp(-(r["row"] * 20 + r["col"]) / 400))) for r in got)
    assert all(r["canopy"] == (r["probability"] > 0.5) for r in got)
    with pytest.raises(ValueError):
        tiles.tiles(df, 8, 8)


def test_detected_boxes_count_once_and_by_score(spark):
    df = spark.createDataFrame([(r, c, float((r * 7 + c * 3) % 10)) for r in range(30) for c in range(25)], "row long, col long, nir double")

    def detect(tile):
        r, c = np.nonzero(tile[0] > 0)
        return pd.DataFrame({"xmin": c - 0.5, "ymin": r - 0.5, "xmax": c + 1.5, "ymax": r + 1.5, "score": tile[0][r, c] / 10, "label": "Tree"})

    got = tiles.detect_tiles(df, detect, ["nir"], 12, 0.35, 0.4, most_overlap=None)
    want = sorted((c - 0.5, r - 0.5, ((r * 7 + c * 3) % 10) / 10) for r in range(30) for c in range(25) if (r * 7 + c * 3) % 10 >= 4)
    assert sorted((r["xmin"], r["ymin"], r["score"]) for r in got.collect()) == want
    placed = one(crowns.map_boxes(got.where("xmin = 0.5 and ymin = 2.5"), (2.0, 0.0, 100.0, 0.0, -2.0, 50.0)))
    assert (placed["minx"], placed["miny"], placed["maxx"], placed["maxy"]) == (101.0, 41.0, 105.0, 45.0) and placed["label"] == "Tree"
    none = tiles.detect_tiles(df.where("row < 0"), detect, ["nir"], 12, 0.35, 0.4)
    assert none.count() == 0 and none.columns == ["xmin", "ymin", "xmax", "ymax", "score", "label"]


def plain_watershed(smooth, mask, distance, least=0):
    """Labels by one loop over a heap of (value, row, column); peaks by definition."""
    h, w = smooth.shape
    masked = np.where(mask, smooth, -np.inf)
    peaks = []
    for r, c in zip(*np.nonzero(mask), strict=True):
        if distance <= r < h - distance and distance <= c < w - distance:
            near = masked[r - distance : r + distance + 1, c - distance : c + distance + 1]
            y, x = np.unravel_index(np.argmax(near), near.shape)  # the first of equal ones
            if (y, x) == (distance, distance):
                peaks.append((int(r), int(c)))
    peaks.sort(key=lambda p: (-smooth[p], p))
    want = np.zeros((h, w), int)
    heap = [(-smooth[p], *p) for p in peaks]
    for k, p in enumerate(peaks):
        want[p] = k + 1
    heapq.heapify(heap)
    while heap:
        _, r, c = heapq.heappop(heap)
        for p in ((r - 1, c), (r, c - 1), (r, c + 1), (r + 1, c)):
            if 0 <= p[0] < h and 0 <= p[1] < w and mask[p] and not want[p]:
                want[p] = want[r, c]
                heapq.heappush(heap, (-smooth[p], *p))
    sizes = np.bincount(want.ravel())
    return np.where(sizes[want] >= least, want, 0)


def labels_and_smooth(spark, df, by, h, w, **how):
    got, smooth = np.zeros((h, w), int), np.full((h, w), -np.inf)
    rows = crowns.watershed(df, by, h, w, pixel_size=1.0, **how).toPandas()
    assert not rows.duplicated(["r", "c"]).any()
    got[rows["r"], rows["c"]] = rows["label"]
    told = tiles.smoothed(df, by, h, w).toPandas()
    smooth[told["r"], told["c"]] = told["v"].fillna(-np.inf)
    return got, smooth, len(rows)


@pytest.mark.parametrize("tile", [512, 5])
def test_watershed_against_a_plain_loop(spark, monkeypatch, tile):
    """Also where the grid is flooded over tiles."""
    monkeypatch.setattr(crowns, "TILE", tile)
    v = np.random.default_rng(5).random((12, 12))
    got, smooth, _ = labels_and_smooth(spark, grid_frame(spark, v), ["g"], 12, 12, min_area=0.0, threshold=0.4)
    assert (got == plain_watershed(smooth, v > 0.4, 3)).all()


@pytest.mark.parametrize(("tile", "holes", "least"), [(16, 0, 0), (9, 12, 0), (16, 12, 25)])
def test_watershed_of_one_piece_over_many_tiles(spark, tile, holes, least):
    """A canopy that is one piece over all tiles, with missing rows, a null group and equal values."""
    rng = np.random.default_rng(tile)
    v = np.round(0.5 + 0.5 * rng.random((50, 64)), 2)
    v[rng.random(v.shape) < 0.15] = 0
    gone = {k * 64 + 40 + k % 5 for k in range(holes)}  # around them nothing is smoothed
    df = spark.createDataFrame([(None, r, c, float(v[r, c])) for r in range(50) for c in range(64) if r * 64 + c not in gone], "g int, r long, c long, v double")
    got, smooth, n = labels_and_smooth(spark, df, ["g"], 50, 64, min_area=float(least), threshold=0.3, tile=tile)
    there = np.array([i not in gone for i in range(v.size)]).reshape(v.shape)
    assert n == there.sum() and (got == plain_watershed(smooth, (v > 0.3) & there, 3, least)).all()
    assert len(np.unique(got)) > 3


def test_flooding_through_a_maze_of_tiles(spark):
    """A single seed at the end of a spiral: each round carries the water one tile on."""
    n = 33
    open_, (r, c, dr, dc) = np.zeros((n, n), bool), (0, 0, 0, 1)
    open_[0, 0] = True
    while True:
        moved = False
        for _ in range(2):
            while 0 <= r + 2 * dr < n and 0 <= c + 2 * dc < n and not open_[r + 2 * dr, c + 2 * dc]:
                open_[r + dr, c + dc] = open_[r + 2 * dr, c + 2 * dc] = moved = True
                r, c = r + 2 * dr, c + 2 * dc
            dr, dc = dc, -dr
        if not moved:
            break
    s = np.random.default_rng(2).random((n, n))
    rows = [(1, int(y), int(x), float(s[y, x]), 7 if (y, x) == (r, c) else 8 if (y, x) == (0, 0) else 0) for y, x in zip(*np.nonzero(open_), strict=True)]
    df = spark.createDataFrame(rows, "g int, r long, c long, s double, seed long")
    heap, want = [(-s[r, c], r, c), (-s[0, 0], 0, 0)], {(r, c): 7, (0, 0): 8}
    heapq.heapify(heap)
    while heap:
        _, y, x = heapq.heappop(heap)
        for p in ((y - 1, x), (y, x - 1), (y, x + 1), (y + 1, x)):
            if 0 <= p[0] < n and 0 <= p[1] < n and open_[p] and p not in want:
                want[p] = want[y, x]
                heapq.heappush(heap, (-s[p], *p))
    got = {(x["r"], x["c"]): x["label"] for x in crowns.flooded_tiles(df, ["g"], n, 11).collect()}
    assert got == want and len(got) == open_.sum()


def test_smoothing_of_grids_with_missing_rows(spark):
    """A missing pixel counts as one without a value; others don't shift."""
    rng = np.random.default_rng(11)
    v = rng.random((20, 31))
    holes = {(4, 4), (0, 30), (10, 17), (11, 17)} | {(7, c) for c in range(31)}
    rows = [(1, r, c, float(v[r, c])) for r in range(20) for c in range(31) if (r, c) not in holes]
    got = tiles.smoothed(spark.createDataFrame(rows, "g int, r long, c long, v double"), ["g"], 20, 31, 0.8).collect()
    k = np.array([w for _, w in tiles.gaussian_kernel(0.8)])
    pad = len(k) // 2
    for p in holes:
        v[p] = np.nan
    want = np.apply_along_axis(lambda x: np.convolve(np.pad(x, pad, "symmetric"), k, "valid"), 0, v)
    want[tuple(zip(*holes, strict=True))] = np.nan
    want = np.apply_along_axis(lambda x: np.convolve(np.pad(x, pad, "symmetric"), k, "valid"), 1, want)
    assert len(got) == len(rows)
    for r in got:
        w = want[r["r"], r["c"]]
        assert r["v"] is None if np.isnan(w) else r["v"] == pytest.approx(w)
    assert sum(r["v"] is not None for r in got) > 200


def test_connected_pixels_across_tiles(spark):
    rng = np.random.default_rng(8)
    open_ = rng.random((23, 17)) < 0.6
    px = spark.createDataFrame([(1, int(r), int(c)) for r, c in zip(*np.nonzero(open_), strict=True)], "g int, r long, c long")
    want = np.where(open_, np.arange(open_.size).reshape(open_.shape), open_.size)
    while True:
        low = want.copy()
        for a, b in (((slice(1, None), slice(None)), (slice(None, -1), slice(None))), ((slice(None), slice(1, None)), (slice(None), slice(None, -1)))):
            low[a] = np.where(open_[a], np.minimum(low[a], low[b]), low[a])
            low[b] = np.where(open_[b], np.minimum(low[b], low[a]), low[b])
        if (low == want).all():
            break
        want = low
    for tile in (4, 100):
        got = crowns.connected_pixels(px, ["g"], 17, tile).collect()
        assert len(got) == open_.sum() and all(r["component"] == want[r["r"], r["c"]] for r in got)


def test_maxima_at_the_border(spark):
    v = np.zeros((7, 7))
    v[0, 3], v[3, 3], v[6, 0] = 9, 5, 7
    peaks = lambda **how: {(r["r"], r["c"]) for r in tiles.local_maxima(grid_frame(spark, v), ["g"], 2, 7, 7, **how).where("v > 0").collect()}
    assert peaks() == {(3, 3)} and peaks(exclude_border=False) == {(0, 3), (3, 3), (6, 0)}


def test_colours_of_the_public_map(spark):
    rows = spark.createDataFrame([(0.0,), (0.9,), (0.45,), (5.0,), (-1.0,)], "v double")
    got = [tuple(r["x"]) for r in rows.select(radiometry.ndvi_rgba(F.col("v")).alias("x")).collect()]
    assert got[:2] == [(165, 0, 38, 255), (0, 104, 55, 255)] and got[3:] == [got[1], got[0]]
    assert got[2] == (254, 254, 189, 255)  # entry 128 of 256, just past the middle


def test_utm_against_the_meridian_arc(spark):
    a, f, k0 = 6378137.0, 1 / 298.257223563, 0.9996
    e2 = f * (2 - f)
    lat = np.radians(41.5)
    steps = np.linspace(0, lat, 200_001)
    m = a * (1 - e2) / (1 - e2 * np.sin(steps) ** 2) ** 1.5
    arc = float(((m[1:] + m[:-1]) / 2 * np.diff(steps)).sum())
    rows = spark.createDataFrame([(75.0, 41.5), (75.001, 41.5), (77.9, -33.0)], "lon double, lat double")
    got = rows.select("lon", "lat", mapping.to_utm(F.col("lon"), F.col("lat"), 43).alias("m"), mapping.to_utm(F.col("lon"), F.col("lat"), 43, north=False).alias("s")).collect()
    assert got[0]["m"]["x"] == pytest.approx(500000, abs=1e-6) and got[0]["m"]["y"] == pytest.approx(k0 * arc, abs=1e-3)
    assert got[1]["m"]["x"] - 500000 == pytest.approx(k0 * a / math.sqrt(1 - e2 * math.sin(lat) ** 2) * math.cos(lat) * math.radians(0.001), abs=1e-4)
    assert got[2]["s"]["y"] - got[2]["m"]["y"] == pytest.approx(1e7)
    back = spark.createDataFrame([(r["m"]["x"], r["m"]["y"]) for r in got], "x double, y double").select(mapping.from_utm(F.col("x"), F.col("y"), 43).alias("p")).collect()
    assert [tuple(r["p"]) for r in back] == [pytest.approx((r["lon"], r["lat"]), abs=1e-8) for r in got]


def plain_suppression(boxes, most):
    """One by one, the best first."""
    kept = []
    for s, *b in sorted({(-s, x0, y0, x1, y1) for x0, y0, x1, y1, s in boxes}):
        def share(o, b=b):
            w, h = min(o[2], b[2]) - max(o[0], b[0]), min(o[3], b[3]) - max(o[1], b[1])
            both = max(w, 0.0) * max(h, 0.0)
            return both / ((o[2] - o[0]) * (o[3] - o[1]) + (b[2] - b[0]) * (b[3] - b[1]) - both) if both else 0.0
        if all(share(o) <= most for o, _ in kept):
            kept.append((b, -s))
    return sorted((*b, s) for b, s in kept)


@pytest.mark.parametrize(("most", "cell"), [(0.15, 16.0), (0.5, 3.0), (0.0, 200.0)])
def test_suppression_one_by_one(spark, most, cell):
    """Boxes of very different sizes, ties, repeated rows, boxes without area, and groups of which one is null."""
    rng = np.random.default_rng(6)
    rows = []
    for g in (1, None):
        for _ in range(150):
            x, y, w, h = (rng.integers(0, 60, 4) / 2).tolist()
            rows.append((g, x - 10, y - 10, x - 10 + (w if rng.random() < 0.9 else 60), y - 10 + h, float(rng.integers(0, 12)), "t"))
    rows += rows[:20]
    odd = [(1, 5.0, 5.0, 1.0, 9.0, 99.0, "inverted"), (1, None, 0.0, 9.0, 9.0, 99.0, "null"), (1, 0.0, 0.0, 90.0, 90.0, None, "no score"), (1, 0.0, 0.0, float("inf"), 9.0, 99.0, "endless"), (1, 0.0, 0.0, 9.0, 9.0, float("nan"), "no number")]
    df = spark.createDataFrame(rows + odd, "g int, xmin double, ymin double, xmax double, ymax double, score double, label string")
    got = boxes.suppressed(df, ["g"], most, cell).collect()
    for g in (1, None):
        assert sorted(tuple(r[c] for c in ("xmin", "ymin", "xmax", "ymax", "score")) for r in got if r["g"] == g) == plain_suppression([r[1:6] for r in rows if r[0] == g], most)
    assert boxes.suppressed(df.where("g > 1"), ["g"]).count() == 0


@pytest.mark.parametrize(("block", "pairs"), [(32, 1 << 20), (3, 40)])
def test_crowded_boxes_are_moved_by_rows_not_by_pairs(spark, monkeypatch, block, pairs):
    """A crowd in which nearly all pairs overlap, a chain over many tiles, and names of their own for the rows."""
    monkeypatch.setattr(boxes, "BLOCK", block)
    monkeypatch.setattr(boxes, "PAIRS", pairs)
    rng = np.random.default_rng(13)
    crowd = [(x, y, x + 12.0, y + 12.0, float(s)) for x, y, s in zip(*(rng.integers(0, 24, (2, 900)) / 2).tolist(), rng.integers(0, 50, 900).tolist(), strict=True)]
    chain = [(100.0 + 3 * k, 0.0, 104.0 + 3 * k, 4.0, -float(k)) for k in range(40)]
    rows = [(*b, f"box {k}") for k, b in enumerate(crowd + chain)]
    df = spark.createDataFrame(rows, "xmin double, ymin double, xmax double, ymax double, score double, name string")
    jobs = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup(f"crowd {block}", "")
    got = boxes.suppressed(df, None, 0.1, 2.0).collect()
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert sorted(tuple(r)[:5] for r in got) == plain_suppression([r[:5] for r in rows], 0.1) and len({r["name"] for r in got}) == len(got)
    store = spark.sparkContext._jsc.sc().statusStore()
    stages = [store.lastStageAttempt(s) for j in jobs.getJobIdsForGroup(f"crowd {block}") for s in jobs.getJobInfo(j).stageIds]
    moved = sum(s.shuffleWriteRecords() + s.outputRecords() for s in stages)
    assert 0 < moved < 40 * len(rows)


def test_detected_boxes_larger_than_the_overlap_count_once(spark):
    """Neighbouring tiles see parts of one object; the picture as one tile says how many there are."""
    rng = np.random.default_rng(9)
    v = np.zeros((60, 50))
    spots = [(r + int(rng.integers(0, 5)), c + int(rng.integers(0, 5))) for r in range(3, 55, 14) for c in range(3, 45, 13)]
    for k, (r, c) in enumerate(spots):
        v[r, c] = 0.5 + k / 100
    df = spark.createDataFrame([(r, c, float(v[r, c])) for r in range(60) for c in range(50)], "row long, col long, nir double")

    def detect(tile):
        r, c = np.nonzero(tile[0] > 0)
        n = tile.shape[1]
        x0, y0, x1, y1 = np.maximum(c - 5.0, 0), np.maximum(r - 5.0, 0), np.minimum(c + 6.0, n), np.minimum(r + 6.0, n)
        return pd.DataFrame({"xmin": x0, "ymin": y0, "xmax": x1, "ymax": y1, "score": tile[0][r, c] * (x1 - x0) * (y1 - y0) / 121, "label": "Tree"})

    got = tiles.detect_tiles(df, detect, ["nir"], 16, 0.25, 0.1).collect()
    per_tile = tiles.detect_tiles(df, detect, ["nir"], 16, 0.25, 0.1, most_overlap=1.0).collect()
    assert sorted((r["xmin"], r["ymin"], r["xmax"], r["ymax"], r["score"]) for r in got) == plain_suppression([(r["xmin"], r["ymin"], r["xmax"], r["ymax"], r["score"]) for r in per_tile], 0.15)
    assert len(per_tile) > len(spots)


def kernel_weight(method, d):
    sinc = lambda x: 1.0 if abs(x) < 1e-12 else math.sin(math.pi * x) / (math.pi * x)
    if method == "bilinear":
        return max(1 - d, 0.0)
    if method == "cubic":
        return 1.5 * d**3 - 2.5 * d**2 + 1 if d <= 1 else -0.5 * d**3 + 2.5 * d**2 - 4 * d + 2 if d < 2 else 0.0
    return sinc(d) * sinc(d / 3) if d < 3 else 0.0


@pytest.mark.parametrize("method", ["bilinear", "cubic", "lanczos", "average"])
@pytest.mark.parametrize(("h", "w", "nh", "nw"), [(9, 14, 4, 3), (5, 4, 11, 2)])
def test_coarser_pixels_average(spark, method, h, w, nh, nw):
    """Against sums over all pixels, with a missing and an empty pixel."""
    v = np.random.default_rng(h).random((h, w))
    rows = [(1, r, c, None if (r, c) == (h - 1, w - 1) else float(v[r, c])) for r in range(h) for c in range(w) if (r, c) != (0, w - 1)]
    got = {(r["r"], r["c"]): r["v"] for r in tiles.resampled(spark.createDataFrame(rows, "g int, r long, c long, v double"), ["g"], h, w, nh, nw, method).collect()}
    hole = np.zeros((h, w), bool)
    hole[0, w - 1] = hole[h - 1, w - 1] = True

    def weights(n, m, i):
        step = n / m
        at, out = (i + 0.5) * step - 0.5, np.zeros(n)
        for k in range(-40, n + 40):
            if method == "average":
                x = min(at + step / 2, k + 0.5, n - 0.5) - max(at - step / 2, k - 0.5, -0.5)
                x = x if 0 <= k < n and x > 1e-12 else 0.0
            else:
                x = kernel_weight(method, abs(at - k) / max(step, 1.0))
            out[min(max(k, 0), n - 1)] += x
        return np.where(np.abs(out) < 1e-12, 0, out)

    assert len(got) == nh * nw
    for r in range(nh):
        for c in range(nw):
            k = np.outer(weights(h, nh, r), weights(w, nw, c))
            if (k[hole] != 0).any():
                assert got[r, c] is None
            else:
                assert got[r, c] == pytest.approx((k * v).sum() / k.sum())
    whole = tiles.resampled(grid_frame(spark, v), ["g"], h, w, 1, 1, "average").collect()
    assert [r["v"] for r in whole] == [pytest.approx(v.mean())]


@pytest.mark.parametrize("method", ["nearest", "bilinear", "cubic", "lanczos", "other"])
def test_resampling_keeps_planes_and_nodata(spark, method):
    v = np.add.outer(np.arange(10.0), 2 * np.arange(10.0))
    same = {(r["r"], r["c"]): r["v"] for r in tiles.coregistered(grid_frame(spark, v), ["g"], 10, 10, (2.0, 0.0, 5.0, 0.0, -2.0, 9.0), 4, 4, (2.0, 0.0, 11.0, 0.0, -2.0, 3.0), method).collect()}
    assert same == {(r, c): pytest.approx(v[r + 3, c + 3]) for r in range(4) for c in range(4)}
    half = tiles.coregistered(grid_frame(spark, v), ["g"], 10, 10, (2.0, 0.0, 5.0, 0.0, -2.0, 9.0), 3, 3, (2.0, 0.0, 12.0, 0.0, -2.0, 2.0), method).collect()
    if method not in ("nearest", "lanczos"):
        assert all(r["v"] == pytest.approx(r["r"] + 3.5 + 2 * (r["c"] + 3.5)) for r in half)
    outside = tiles.coregistered(grid_frame(spark, v), ["g"], 10, 10, (2.0, 0.0, 5.0, 0.0, -2.0, 9.0), 2, 2, (2.0, 0.0, -50.0, 0.0, -2.0, 9.0), method)
    assert outside.count() == 0
    holed = grid_frame(spark, v).withColumn("v", F.when((F.col("r") == 5) & (F.col("c") == 5), None).otherwise(F.col("v")))
    assert {r["v"] is None for r in tiles.resampled(holed, ["g"], 10, 10, 10, 10, "nearest").where("r = 5 and c = 5").collect()} == {True}


def test_polygons_with_holes_and_pinches(spark):
    ring = [(r, c) for r in range(5) for c in range(5) if not (1 <= r <= 3 and 1 <= c <= 3)]
    rows = [(1, r, c, 1) for r, c in ring] + [(1, 10, 10, 2), (1, 11, 11, 2), (1, 20, 20, 3), (1, 20, 21, 3), (1, 21, 20, 3), (1, 2, 2, 0)]
    got = {r["label"]: r for r in crowns.polygons(spark.createDataFrame(rows, "g int, r long, c long, label long"), ["g"], (2.0, 0.0, 100.0, 0.0, -2.0, 50.0)).collect()}
    assert {k: (len(r["rings"]), r["area_m2"], r["perimeter_m"]) for k, r in got.items()} == {1: (2, 64.0, 64.0), 2: (2, 8.0, 16.0), 3: (1, 12.0, 16.0)}
    assert [len(x) for x in got[1]["rings"]] == [5, 5] and len(got[3]["rings"][0]) == 7
    assert got[1]["rings"][0][0] == [100.0, 50.0]


def plain_rings(label, k):
    """The rings of one label by one loop over all its edges."""
    h, w = label.shape
    mine = lambda r, c: 0 <= r < h and 0 <= c < w and label[r, c] == k
    out = {}
    for r, c in zip(*np.nonzero(label == k), strict=True):
        for (dr, dc), a, b in (((-1, 0), (c, r), (c + 1, r)), ((0, 1), (c + 1, r), (c + 1, r + 1)), ((1, 0), (c + 1, r + 1), (c, r + 1)), ((0, -1), (c, r + 1), (c, r))):
            if not mine(r + dr, c + dc):
                out.setdefault((int(a[0]), int(a[1])), []).append((int(b[0]), int(b[1])))
    rings = []
    while any(out.values()):
        at = min(p for p, ends in out.items() if ends)
        ring, way = [], None
        while out.get(at):
            right = (at[0] - way[1], at[1] + way[0]) if way else None
            to = right if right in out[at] else out[at][0]
            out[at].remove(to)
            if (to[0] - at[0], to[1] - at[1]) != way:
                ring.append(at)
            way, at = (to[0] - at[0], to[1] - at[1]), to
        rings.append([*ring, ring[0]])
    return sorted(rings)


@pytest.mark.parametrize("tile", [5, 8, 100])
def test_polygons_over_tiles(spark, tile):
    """A region over many tiles with holes and islands, and small ones, against one loop."""
    rng = np.random.default_rng(4)
    label = np.where(rng.random((31, 26)) < 0.72, 1, 0)
    label[4:7, 3:20], label[20, 20:25], label[25:30, 1:4], label[27, 2] = 1, 2, 3, 0
    label[0, :] = label[:, 0] = 1
    rows = [(None, int(r), int(c), int(label[r, c])) for r in range(31) for c in range(26)]
    got = {r["label"]: r for r in crowns.polygons(spark.createDataFrame(rows, "g int, r long, c long, label long"), ["g"], (1.0, 0.0, 0.0, 0.0, 1.0, 0.0), tile).collect()}
    assert set(got) == {1, 2, 3}
    for k, r in got.items():
        rings = [[(int(x), int(y)) for x, y in ring] for ring in r["rings"]]
        area = lambda ring: sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(ring, ring[1:], strict=False)) / 2
        assert sum(map(area, rings)) == (label == k).sum() == r["area_m2"]
        edges = lambda rings: sorted((min(a, b), max(a, b)) for ring in rings for a, b in zip(ring, ring[1:], strict=False))
        want = plain_rings(label, k)
        units = lambda rings: sorted((x, y, x2, y2) for ring in rings for a, b in zip(ring, ring[1:], strict=False) for x, y, x2, y2 in steps(a, b))
        assert units(rings) == units(want) and len(edges(rings)) > 0
        if k != 1:
            assert sorted(rings) == want
        assert all(ring[0] == ring[-1] == min(ring) for ring in rings)
        assert all((a[0] - b[0]) * (b[1] - c[1]) != (a[1] - b[1]) * (b[0] - c[0]) for ring in rings for a, b, c in zip(ring[-2:-1] + ring, ring, ring[1:], strict=False))
    again = {r["label"]: r["rings"] for r in crowns.polygons(spark.createDataFrame(rows, "g int, r long, c long, label long"), ["g"], (1.0, 0.0, 0.0, 0.0, 1.0, 0.0), 64).collect()}
    assert {k: r["rings"] for k, r in got.items()} == again


def steps(a, b):
    """Unit edges from a to b."""
    n = max(abs(b[0] - a[0]), abs(b[1] - a[1]))
    dx, dy = (b[0] - a[0]) // n, (b[1] - a[1]) // n
    return [(a[0] + i * dx, a[1] + i * dy, a[0] + (i + 1) * dx, a[1] + (i + 1) * dy) for i in range(n)]


def test_features_in_degrees(spark):
    boxes = spark.createDataFrame([(500000.0, 4600000.0, 500010.0, 4600010.0, 0.5)], "minx double, miny double, maxx double, maxy double, score double")
    feature = json.loads(one(crowns.box_features(boxes, zone=43))["feature"])
    ring = feature["geometry"]["coordinates"][0]
    assert feature["type"] == "Feature" and ring[0] == ring[4] and len(ring) == 5 and feature["properties"] == {"score": 0.5}
    assert ring[0][0] == pytest.approx(75.0) and 41.5 < ring[0][1] < 41.6


def test_percentiles_by_group_and_over_many_partitions(spark):
    rng = np.random.default_rng(4)
    rows = [(g, float(v)) for g in ("a", "b", None) for v in rng.normal(0, 1, 400).round(2)] + [("c", None)]
    df = spark.createDataFrame(rows, "g string, v double").repartition(7)
    got = {r["g"]: r for r in stats.column_stats(df, "v", ["g"]).collect()}
    for g in ("a", "b", None):
        own = [v for k, v in rows if k == g]
        assert got[g]["median"] == pytest.approx(np.median(own)) and got[g]["count"] == 400
    assert got["c"]["median"] is None and got["c"]["count"] == 0
    p = one(stats.percentiles(df, "v", {"p": 0.37}))["p"]
    assert p == pytest.approx(np.percentile([v for _, v in rows if v is not None], 37))


def test_band_files_and_first_matches(spark):
    paths = spark.createDataFrame([(x,) for x in ("/d/a_SR_B2.tif", "/d/b_SR_B2.TIF", "/d/a_SR_B2.TIF", "/d/x_QA_PIXEL.TIF", "/d/readme.txt", "/d/a_SR_B4.TIF")], "path string")
    got = lambda s: {(r["band"], r["path"]) for r in imagery.landsat_band_files(paths, s).collect()}
    assert got("L9") == {("blue", "/d/a_SR_B2.TIF"), ("qa", "/d/x_QA_PIXEL.TIF"), ("red", "/d/a_SR_B4.TIF")}
    assert got("L7") == {("green", "/d/a_SR_B2.TIF"), ("qa", "/d/x_QA_PIXEL.TIF"), ("nir", "/d/a_SR_B4.TIF")}
    left = spark.createDataFrame([(1,), (2,), (2,)], "k int")
    right = spark.createDataFrame([(2, 5, "late"), (2, 3, "first"), (3, 1, "other")], "k int, nr int, v string")
    assert [tuple(r) for r in imagery.save_first(left, right, ["k"], ["nr"]).collect()] == [(2, 3, "first")] * 2


def test_sink_keeps_pixels_and_prunes(spark, tmp_path):
    df = spark.createDataFrame([(s, r, c, float(r * c), float("nan") if c == 3 else 1.0) for s in (1, 2) for r in range(6) for c in range(6)], "scene_id long, row long, col long, nir double, red double")
    imagery.write_pixels(df, f"{tmp_path}/px", 4, 20.0)
    ranges = []
    for file in (tmp_path / "px").glob("*.parquet"):
        meta = pq.ParquetFile(file).metadata
        assert meta.num_row_groups <= 1
        for k in range(meta.num_row_groups):
            told = {meta.row_group(k).column(i).path_in_schema: meta.row_group(k).column(i).statistics for i in range(meta.num_columns)}
            ranges.append((told["scene_id"].min, told["scene_id"].max))
    # a scene's tiles lie side by side: files of other scenes can be skipped
    assert 1 <= len(ranges) <= 8 and sum(lo < hi for lo, hi in ranges) <= 1
    plan = imagery.read_pixels(spark, f"{tmp_path}/px", ["nir"]).where("scene_id = 2 AND row < 3")._jdf.queryExecution().toString()
    assert "EqualTo(scene_id,2)" in plan and "LessThan(row,3)" in plan
    back = imagery.read_pixels(spark, f"{tmp_path}/px", ["nir", "red"])
    assert back.columns == ["scene_id", "row", "col", "nir", "red"] and back.count() == 72
    assert back.where("red IS NULL").count() == 12 and back.where("nir IS NULL").count() == 4
    assert imagery.read_pixels(spark, f"{tmp_path}/px", ["nir", "red"], [2]).columns == ["scene_id", "row", "col", "red"]


def test_sources(spark):
    assert [r["sensor"] for r in imagery.recommend_sensors(spark, 10.0).collect()] == ["CARTOSAT-3-MX", "LISS-IV-MX", "LISS-III"]
    with pytest.raises(ValueError):
        imagery.sensor_info(spark, "none")
    scenes = spark.createDataFrame([(1, None), (2, 5.0), (3, 5.0)], "scene_id long, cloud_cover double")
    assert [r["scene_id"] for r in imagery.clearest_scenes(scenes, 2).collect()] == [2, 3]
    assert one(spark.createDataFrame([(None,)], "v double").select(radiometry.ndvi_rgba(F.col("v")).alias("x")).select("x.*"))["a"] == 0


def test_windows_agree_on_stream_and_table(spark, tmp_path):
    df = spark.sql("SELECT timestamp'2020-01-01 00:30:00' + make_interval(0, 0, 0, 0, 0, cast(id * 10 AS int)) AS ts, 'a' AS event_type, cast(id AS double) AS value FROM range(20)")
    df.write.parquet(str(tmp_path / "in"))
    want = sorted(map(tuple, event_window_counts(df).collect()))
    stream = event_window_counts(spark.readStream.schema(df.schema).parquet(str(tmp_path / "in")))
    run = stream.writeStream.format("memory").queryName("windows").outputMode("complete").option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    run.awaitTermination(120)
    assert sorted(map(tuple, spark.table("windows").collect())) == want


def test_array_change_vectors_agree_with_columns(spark):
    rows = [([0.0] * 9, [0.0] * 8 + [float(i)]) for i in range(4)] + [([1.0, None, 3.0], [2.0, 5.0]), (None, [1.0])]
    df = spark.createDataFrame(rows, "a array<double>, b array<double>")
    got = change.array_change_vectors(df, "a", "b").collect()
    wide = df.select(*[F.get(c, F.lit(i)).alias(f"{c}{i}") for c in "ab" for i in range(9)])
    want = change.change_vectors(wide, [f"a{i}" for i in range(9)], [f"b{i}" for i in range(9)]).collect()
    assert [r["magnitude"] for r in got] == [0, 1, 2, 3, 1, 0] == [r["magnitude"] for r in want]
    assert [(r["threshold"], r["changed"]) for r in got] == [(r["threshold"], r["changed"]) for r in want]


def test_crown_scene_broadcasts_nothing(spark, tmp_path):
    """What few crowns are exploded into looks small to Spark and may be as large as the picture."""
    spark.createDataFrame([(1.0, 1.0, 0.5, 1.5)], "r double, c double, peak double, sigma double").write.parquet(f"{tmp_path}/crowns")
    crowns = spark.read.parquet(f"{tmp_path}/crowns")
    patches = spark.createDataFrame([(0, 0, 3, 4, 0.1, 0.5), (1, 2, 3, 4, 0.3, 0.9)], "r long, c long, height long, width long, low double, high double")
    for own in (None, patches):
        scene = imagery.crown_scene(spark, 6, 7, crowns, patches=own)
        assert "Broadcast" not in scene._jdf.queryExecution().executedPlan().toString()
        got = {(r["row"], r["col"]): r["ndvi"] for r in scene.collect()}
        for r in range(6):
            for c in range(7):
                put = [low + (high - low) * (r - y) / 2 for y, x, low, high in ((0, 0, 0.1, 0.5), (1, 2, 0.3, 0.9)) if own is not None and y <= r < y + 3 and x <= c < x + 4]
                assert abs(got.pop((r, c)) - max(put, default=0.09 + 0.5 * np.exp(-((r - 1) ** 2 + (c - 1) ** 2) / 4.5))) < 1e-12
        assert not got


def test_band_stack_is_one_aggregation(spark):
    """A pixel without any of the bands stays; no aggregation by pixel and band stands before the one by pixel."""
    bands = spark.createDataFrame([(1, "nir", 0.5), (1, "red", None), (1, "red", 0.25), (2, "blue", 0.1)], "pix long, band string, v double")
    stack = imagery.band_stack(bands, ["red", "nir"], ["pix"])
    assert stack.columns == ["pix", "red", "nir"]
    assert sorted(map(tuple, stack.collect())) == [(1, 0.25, 0.5), (2, None, None)]
    assert stack._jdf.queryExecution().optimizedPlan().toString().count("Aggregate") == 1


def test_smoothing_and_resampling_go_with_the_length_of_a_line(spark):
    """A line was worked out again for each of its places, so time grew with the square of its length."""
    n = 16000
    line = spark.range(n).select(F.lit(1).alias("g"), F.col("id").alias("r"), F.lit(0).cast("long").alias("c"), F.col("id").cast("double").alias("v"))
    began = time.time()
    smooth = {r["r"]: r["v"] for r in tiles.smoothed(line, ["g"], n, 1, 1.0).collect()}
    assert len(smooth) == n and all(abs(smooth[r] - r) < 1e-6 for r in range(10, n - 10, 97))
    coarse = {r["r"]: r["v"] for r in tiles.resampled(line, ["g"], n, 1, n // 2, 1, "average").collect()}
    assert len(coarse) == n // 2 and all(abs(coarse[r] - 2 * r - 0.5) < 1e-6 for r in range(0, n // 2, 97))
    assert time.time() - began < 25
