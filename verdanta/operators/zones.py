"""Reductions over polygons, with every pixel weighed by the exact share of it that a polygon covers."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.mapping import Affine, inverse, map_x, map_y

STRETCH = 64
POINTS = "array<struct<x:double,y:double>>"


def rings(wkt: Column) -> Column:
    """The rings of a POLYGON or MULTIPOLYGON text: struct of hole (boolean) and points (closed); NULL for other texts."""
    number = r"[-+]?[0-9.]+(?:[eE][-+]?[0-9]+)?"
    fits = F.regexp_like(wkt, F.lit(r"^\s*(?i:MULTI)?(?i:POLYGON)\s*(?i:Z|M|ZM)?\s*\("))
    # a ring that opens a polygon has two brackets before it
    found = F.regexp_extract_all(wkt, F.lit(r"(\(?\s*\([^()]+\))"), F.lit(1))

    def points(ring: Column) -> Column:
        pairs = F.regexp_extract_all(ring, F.lit(rf"({number}\s+{number})(?:\s+{number})*"), F.lit(1))
        return F.transform(pairs, lambda p: (lambda xy: F.struct(xy[0].cast("double").alias("x"), xy[1].cast("double").alias("y")))(F.split(p, r"\s+")))

    return F.when(fits, F.transform(found, lambda r: F.struct((~F.regexp_like(r, F.lit(r"^\(\s*\("))).alias("hole"), points(r).alias("points"))))


def coverage(zones: DataFrame, by: list[str], wkt: str, transform: Affine, height: int, width: int) -> DataFrame:
    """(by, r, c0, c1, share): stretches of pixels, c0 to c1 inclusive, with the share of each pixel that the zone covers.

    Every edge is cut at the borders of rows, then of columns; a piece covers what lies to its right: a part of its own
    pixel, and the whole height of the piece in all pixels beyond. Sums of these along a row give each pixel's share,
    and between two pixels with edges it is constant, so the inside of a polygon takes a row of output for each of its
    rows, not for each of its pixels. A hole's area counts against its zone. Parts beyond the picture are cut off.
    """
    back = inverse(transform)
    ring = zones.select(*by, F.inline(rings(F.col(wkt))))
    ring = ring.withColumn("p", F.transform("points", lambda p: F.struct(map_x(p["y"], p["x"], back).alias("u"), map_y(p["y"], p["x"], back).alias("v"))))
    sides = F.zip_with("p", F.concat(F.slice("p", F.lit(2), F.greatest(F.size("p") - 1, F.lit(0))), F.slice("p", 1, 1)), lambda a, b: F.struct(a.alias("a"), b.alias("b")))
    turn = F.aggregate(sides, F.lit(0.0), lambda t, s: t + s["a"]["u"] * s["b"]["v"] - s["b"]["u"] * s["a"]["v"])
    # going down on the right is the way round that counts as covered
    way = F.when(F.col("hole"), -F.signum(turn)).otherwise(F.signum(turn))
    edge = ring.select(*by, way.alias("way"), F.explode(sides).alias("s")).select(*by, "way", "s.*").where("a.v <> b.v")
    upper, lower = F.when(F.col("a.v") < F.col("b.v"), F.col("a")).otherwise(F.col("b")), F.when(F.col("a.v") < F.col("b.v"), F.col("b")).otherwise(F.col("a"))
    edge = edge.select(*by, (-F.col("way") * F.signum(F.col("b.v") - F.col("a.v"))).alias("way"), upper.alias("hi"), lower.alias("lo"))
    edge = edge.where((F.col("hi.v") < height) & (F.col("lo.v") > 0))
    rows = F.sequence(F.greatest(F.floor("hi.v"), F.lit(0)).cast("long"), F.least(F.ceil("lo.v") - 1, F.lit(height - 1)).cast("long"))
    piece = edge.withColumn("r", F.explode(rows))
    at = lambda v: F.col("hi.u") + (F.col("lo.u") - F.col("hi.u")) * (v - F.col("hi.v")) / (F.col("lo.v") - F.col("hi.v"))
    top, end = F.greatest(F.col("hi.v"), F.col("r").cast("double")), F.least(F.col("lo.v"), F.col("r") + F.lit(1.0))
    piece = piece.select(*by, "r", ((end - top) * F.col("way")).alias("dy"), at(top).alias("ua"), at(end).alias("ub"))
    piece = piece.select(*by, "r", "dy", F.least("ua", "ub").alias("u0"), F.greatest("ua", "ub").alias("u1")).where(F.col("u0") < width)
    # what lies to the left of the picture is one column -1
    columns = F.sequence(F.greatest(F.floor("u0"), F.lit(-1)).cast("long"), F.least(F.greatest(F.ceil("u1") - 1, F.floor("u0"), F.lit(-1)), F.lit(width - 1)).cast("long"))
    cell = piece.withColumn("c", F.explode(columns))
    low, high = F.when(F.col("c") < 0, F.col("u0")).otherwise(F.greatest(F.col("u0"), F.col("c").cast("double"))), F.least(F.col("u1"), F.col("c") + F.lit(1.0))
    part = F.when(F.col("u1") > F.col("u0"), (high - low) / (F.col("u1") - F.col("u0"))).otherwise(F.lit(1.0)) * F.col("dy")
    own = F.when(F.col("c") < 0, F.lit(0.0)).otherwise(part * (F.col("c") + F.lit(1.0) - (low + high) / 2))
    cells = cell.select(*by, "r", "c", part.alias("dy"), own.alias("area")).groupBy(*by, "r", "c").agg(F.sum("dy").alias("dy"), F.sum("area").alias("area"))
    order = Window.partitionBy(*by, "r").orderBy("c")
    before = F.coalesce(F.sum("dy").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    told = cells.select(*by, "r", "c", "area", "dy", before.alias("before"), F.coalesce(F.lead("c").over(order), F.lit(width).cast("long")).alias("next"))
    spans = F.array(F.struct(F.col("c").alias("c0"), F.col("c").alias("c1"), (F.col("area") + F.col("before")).alias("share")), F.struct((F.col("c") + 1).alias("c0"), (F.col("next") - 1).alias("c1"), (F.col("before") + F.col("dy")).alias("share")))
    return told.select(*by, "r", F.inline(spans)).where("c0 <= c1 AND c0 >= 0 AND share > 1e-9").withColumn("share", F.least("share", F.lit(1.0)))


def zone_pixels(pixels: DataFrame, spans: DataFrame, by: list[str]) -> DataFrame:
    """``pixels`` (r, c, ...) once for each zone that covers a part of them, with ``by`` and ``share``.

    Stretches are cut into blocks of columns, so pixels meet only stretches of their row and block.
    """
    block = F.explode(F.sequence(F.expr(f"c0 div {STRETCH}"), F.expr(f"c1 div {STRETCH}")))
    cut = spans.withColumn("block", block)
    joined = pixels.withColumn("block", F.expr(f"c div {STRETCH}")).join(cut, ["r", "block"])
    return joined.where(F.col("c").between(F.col("c0"), F.col("c1"))).drop("block", "c0", "c1")


def reduced(pixels: DataFrame, zones: DataFrame, by: list[str], wkt: str, value: str, transform: Affine, height: int, width: int) -> DataFrame:
    """Per zone: n (pixels with a value that it covers at least in part), covered (their shares), mean weighed by the shares, min and max.

    Zones that cover no pixel with a value have n = 0 and NULLs, as have zones that aren't polygons.
    """
    met = zone_pixels(pixels.where(F.col(value).isNotNull()).select("r", "c", F.col(value).alias("v")), coverage(zones, by, wkt, transform, height, width), by)
    sums = met.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.sum("share").alias("covered"), (F.sum(F.col("share") * F.col("v")) / F.sum("share")).alias("mean"), F.min("v").alias("min"), F.max("v").alias("max"))
    return zones.select(*by).distinct().join(sums, by, "left").withColumn("n", F.coalesce("n", F.lit(0)))
