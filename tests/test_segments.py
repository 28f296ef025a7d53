"""Masks found in tiles against the masks of the whole picture."""

import numpy as np

from verdanta.operators import crowns, segments


def test_runs():
    rng = np.random.default_rng(1)
    mask = rng.random((9, 13)) < 0.5
    out = np.zeros_like(mask)
    for r, a, b in zip(*segments.runs_of(mask), strict=True):
        assert not out[r, a : b + 1].any()
        out[r, a : b + 1] = True
    assert (out == mask).all() and not len(segments.runs_of(np.zeros((3, 3), bool))[0])


def test_objects_over_many_tiles_are_one_mask(spark):
    """Discs, some over four tiles and more, that a segmenter sees in parts; overlapping masks of different objects stay apart."""
    h, w, size, overlap = 60, 75, 20, 6
    discs = [(10, 12, 5), (30, 30, 14), (18, 60, 9), (52, 8, 6), (45, 62, 12), (33, 47, 5), (3, 40, 3)]
    y, x = np.mgrid[:h, :w]
    bits = np.zeros((h, w))
    for k, (r, c, d) in enumerate(discs):
        bits += ((y - r) ** 2 + (x - c) ** 2 <= d * d) * 2.0**k
    df = spark.createDataFrame([(r, c, float(bits[r, c])) for r in range(h) for c in range(w)], "row long, col long, bits double")

    def segment(tile):
        return [m for k in range(7) if (m := (tile[0].astype(int) >> k & 1).astype(bool)).any()]

    runs = segments.segment_tiles(df, segment, ["bits"], size, overlap)
    got = {}
    for r in segments.joined_masks(runs, size, overlap).collect():
        got.setdefault(r["label"], np.zeros((h, w), bool))[r["row"], r["c0"] : r["c1"] + 1] = True
    want = {((bits.astype(int) >> k) & 1).astype(bool).tobytes() for k in range(7)}
    assert len(got) == 7 and {m.tobytes() for m in got.values()} == want
    # the filter over masks is that over pixels
    green = [(r, c, (r * 7 + c * 5) % 10 > 2) for r in range(h) for c in range(w)]
    pixels = spark.createDataFrame(green, "row long, col long, vegetation boolean")
    kept = {(r["pixels"], round(r["overlap"], 9)) for r in segments.vegetated_masks(segments.joined_masks(runs, size, overlap), pixels, 40, 500, 0.69).collect()}
    rows = [(k, bool((r * 7 + c * 5) % 10 > 2)) for k, m in got.items() for r, c in zip(*np.nonzero(m), strict=True)]
    plain = crowns.vegetated_segments(spark.createDataFrame(rows, "label long, vegetation boolean").where("label >= 0").selectExpr("label + 1 AS label", "vegetation"), [], 40, 500, 0.69).collect()
    assert kept == {(r["pixels"], round(r["overlap"], 9)) for r in plain} and 0 < len(kept) < 7


def test_tiles_without_masks(spark):
    df = spark.createDataFrame([(r, c, 0.0) for r in range(9) for c in range(9)], "row long, col long, v double")
    assert segments.joined_masks(segments.segment_tiles(df, lambda tile: [], ["v"], 8, 2), 8, 2).count() == 0
    one = segments.joined_masks(segments.segment_tiles(df, lambda tile: [np.ones((8, 8), bool)], ["v"], 8, 2), 8, 2).collect()
    assert len(one) == 9 and {(r["c0"], r["c1"]) for r in one} == {(0, 8)} and len({r["label"] for r in one}) == 1
    assert segments.segment_tiles(df.where("row < 0"), lambda tile: [], ["v"], 8, 2).count() == 0
