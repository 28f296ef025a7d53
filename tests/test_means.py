"""Means at a threshold or equal to each other, in several orders of the rows: queries and their SQL against exact fractions."""

import random
from fractions import Fraction

import duckdb
import pandas as pd
import pytest

from verdanta import catalogue
from verdanta.operators import stats

ROWS, COLS = 40, 18


def quantities(rng, mean, n):
    """``n`` whole numbers from 1 to 50 of exactly this mean, in pairs around it."""
    away = [rng.randint(0, int(min(mean - 1, 50 - mean))) for _ in range(n // 2)]
    return [int(mean + s * (d + (0.5 if mean % 1 else 0))) for d in away for s in (-1, 1)]


@pytest.fixture(scope="module")
def tied(tmp_path_factory):
    """Pixels whose mean of nir is exactly 0.45, 0.5, 0.6, 0.62 or 0.3, as tables of the same rows in three orders, and the exact means."""
    rng = random.Random(3)
    rows, means = [], {}
    for r in range(ROWS):
        for c in range(COLS):
            mean = rng.choice([22.5, 25, 30, 31, 15] if r < 20 else [22.5, 22.5, 25, 30])
            of = quantities(rng, mean, rng.choice([8, 14, 22, 30, 38]))
            assert Fraction(sum(of), len(of)) == Fraction(mean)
            means[r, c] = Fraction(mean) / 50
            rows += [(r * 50 + c, float(q)) for q in of]
    folders = []
    for order in ("mixed", "up", "down"):
        if order == "mixed":
            rng.shuffle(rows)
        else:
            rows.sort(reverse=order == "down")
        table = pd.DataFrame(rows, columns=["l_partkey", "l_quantity"])
        table = table.assign(l_orderkey=range(len(rows)), l_suppkey=1, l_linenumber=1, l_extendedprice=21000.0, l_discount=0.1, l_tax=0.1)
        folder = tmp_path_factory.mktemp(order)
        table.to_parquet(f"{folder}/lineitem.parquet", index=False)
        folders.append(str(folder))
    return folders, means


def both(spark, name, folder):
    """Rows of the query and of its SQL, as sets of dictionaries' items."""
    con = duckdb.connect()
    con.execute(f"CREATE VIEW lineitem AS SELECT * FROM '{folder}/lineitem.parquet'")
    return [sorted(tuple(sorted(r.items())) for r in df.to_dict("records")) for df in (catalogue.QUERIES[name](spark, folder).toPandas(), con.execute(catalogue.ORACLES[name]).df())]


def test_a_mean_does_not_depend_on_the_order(spark):
    rng = random.Random(1)
    for mean in (22.5, 25, 30, 31):
        of = [q / 50 for q in quantities(rng, mean, 46)]
        for rows in (of, sorted(of), sorted(of, reverse=True), of[::2] + of[1::2]):
            assert spark.createDataFrame([(v,) for v in rows], "v double").coalesce(1).agg(stats.steady_mean("v")).first()[0] == mean / 50
    odd = spark.createDataFrame([("a", 0.1), ("a", None), ("b", None), ("c", float("nan")), ("c", 1.0)], "k string, v double").groupBy("k").agg(stats.steady_mean("v").alias("m"))
    got = {r["k"]: r["m"] for r in odd.collect()}
    assert got["a"] == 0.1 and got["b"] is None and got["c"] != got["c"]


def test_canopy_at_its_threshold(spark, tied):
    folders, means = tied
    label = {p: 1 if m > Fraction(1, 2) else 2 for p, m in means.items()}
    want = []
    for k in (1, 2):
        own = [p for p in label if label[p] == k]
        sides = sum(label.get((r + dr, c + dc)) != k for r, c in own for dr, dc in ((0, 1), (1, 0), (0, -1), (-1, 0)))
        want.append((("area_m2", len(own) * 100.0), ("label", k), ("perimeter_m", sides * 10.0), ("picture", "mean")))
    for folder in folders:
        query, sql = both(spark, "canopy_polygons", folder)
        assert query == want and sql == want


def test_large_boxes_of_equal_means(spark, tied):
    """Bright pixels are those above 0.6, not at it; of equal means the first box by its corners is the best."""
    folders, means = tied
    boxes = set()
    for (r, c), m in means.items():
        for top in range(0, ROWS, 12):
            for left in range(0, 50, 12):
                if m > Fraction(3, 5) and top <= r < top + 16 and left <= c < left + 16:
                    boxes.add((-m, max(c - 4, left), max(r - 4, top), min(c + 5, left + 16), min(r + 5, top + 16)))
    kept = []
    for m, *a in sorted(boxes):
        def overlap(b):
            shared = max(min(a[2], b[2]) - max(a[0], b[0]), 0) * max(min(a[3], b[3]) - max(a[1], b[1]), 0)
            return Fraction(shared, (a[2] - a[0]) * (a[3] - a[1]) + (b[2] - b[0]) * (b[3] - b[1]) - shared)
        if all(overlap(b) <= Fraction(15, 100) for _, *b in kept):
            kept.append((m, *a))
    want = sorted((("label", "Tree"), ("score", float(-m)), ("xmax", float(x1)), ("xmin", float(x0)), ("ymax", float(y1)), ("ymin", float(y0))) for m, x0, y0, x1, y1 in kept)
    assert len(want) > 3
    for folder in folders:
        query, sql = both(spark, "detect_large_boxes", folder)
        assert query == want and sql == want


def test_masks_of_pixels_at_the_threshold(spark, tied):
    """A mean of exactly 0.45 is no vegetation, though half of the pixels of some fields have it."""
    folders, means = tied
    fields = {}
    for (r, c), m in means.items():
        fields.setdefault((r // 20 * 20, c // 9 * 9), []).append(m > Fraction(45, 100))
    shares = {p: sum(v) / (len(v) + 1e-6) for p, v in fields.items()}
    want = sorted((("col", c), ("overlap", round(shares[r, c], 6)), ("pixels", len(v)), ("row", r)) for (r, c), v in fields.items() if shares[r, c] >= 0.6)
    assert 0 < len(want) < len(fields)
    for folder in folders:
        query, sql = both(spark, "segment_masks", folder)
        assert query == want and sql == want
