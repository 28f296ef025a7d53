"""Grids in degrees that fit scenes in map zones, and composites of scenes that lie on different grids."""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.mapping import Affine, bound, from_utm, inverse, map_x, map_y, to_utm
from .change import composite
from .stats import beside

#: points along each side of a scene whose places bound it
STEPS = 20
TRANSFORM = ("a", "b", "c", "d", "e", "f")


def placed(row: Column, col: Column) -> tuple[Column, Column]:
    """Map x and y of a place in pixels, by the columns a to f."""
    a, b, c, d, e, f = (F.col(n) for n in TRANSFORM)
    return a * col + b * row + c, d * col + e * row + f


def unplaced(x: Column, y: Column) -> tuple[Column, Column]:
    """Row and column of map x and y, by the columns a to f."""
    a, b, c, d, e, f = (F.col(n) for n in TRANSFORM)
    det = a * e - b * d
    return (a * (y - f) - d * (x - c)) / det, (e * (x - c) - b * (y - f)) / det


def degrees(x: Column, y: Column, zone: Column, north: Column) -> Column:
    """Struct lon, lat; zone 0 means that x and y are degrees."""
    same = lambda p: F.struct(p["x"].alias("lon"), p["y"].alias("lat"))
    return bound(F.struct(x.alias("x"), y.alias("y")), lambda p: F.when(zone == 0, same(p)).otherwise(from_utm(p["x"], p["y"], zone, north)))


def metres(place: Column, zone: Column, north: Column) -> Column:
    """Struct x, y in a zone of a struct lon, lat; zone 0 means degrees."""
    same = lambda p: F.struct(p["lon"].alias("x"), p["lat"].alias("y"))
    return bound(place, lambda p: F.when(zone == 0, same(p)).otherwise(to_utm(p["lon"], p["lat"], zone, north)))


def default_grids(scenes: DataFrame) -> DataFrame:
    """``scenes`` (height, width, a to f, zone, north) with the grid in degrees that holds each: new_height, new_width, west, top, pixel.

    A scene's sides are bent in degrees, so its bounds are those of points along them. Pixels are square and as many to
    the scene's diagonal as before; sizes are rounded, one at least, and the grid begins at the bounds' upper left.
    """
    share = F.transform(F.sequence(F.lit(0), F.lit(STEPS)), lambda k: k / F.lit(float(STEPS)))
    side = lambda row, col: F.transform(share, lambda s: F.struct(row(s).alias("r"), col(s).alias("c")))
    h, w, zero = F.col("height").cast("double"), F.col("width").cast("double"), F.lit(0.0)
    edge = F.concat(side(lambda s: zero, lambda s: w * s), side(lambda s: h, lambda s: w * s), side(lambda s: h * s, lambda s: zero), side(lambda s: h * s, lambda s: w))
    place = lambda p: degrees(*placed(p["r"], p["c"]), F.col("zone"), F.col("north"))
    first, last = place(F.struct(zero.alias("r"), zero.alias("c"))), place(F.struct(h.alias("r"), w.alias("c")))
    out = scenes.withColumns({"around": F.transform(edge, place), "corner": first, "far": last})
    limit = lambda reduce, n: reduce(F.transform("around", lambda p: p[n]))
    pixel = F.hypot(F.col("far.lon") - F.col("corner.lon"), F.col("far.lat") - F.col("corner.lat")) / F.sqrt(h * h + w * w)
    out = out.withColumns({"west": limit(F.array_min, "lon"), "east": limit(F.array_max, "lon"), "bottom": limit(F.array_min, "lat"), "top": limit(F.array_max, "lat"), "pixel": pixel})
    size = lambda low, high: F.greatest(F.floor((F.col(high) - F.col(low)) / F.col("pixel") + F.lit(0.5)), F.lit(1)).cast("long")
    return out.withColumns({"new_height": size("bottom", "top"), "new_width": size("west", "east")}).drop("around", "corner", "far", "east", "bottom")


def default_grid(spark: SparkSession, height: int, width: int, transform: Affine, zone: int, north: bool = True) -> tuple[int, int, Affine]:
    """Height, width and transform of the grid in degrees for one grid in a zone, as ``to_wgs84`` takes them."""
    one = spark.createDataFrame([(height, width, *map(float, transform), zone, north)], f"height long, width long, {', '.join(f'{n} double' for n in TRANSFORM)}, zone int, north boolean")
    got = default_grids(one).first()
    return got["new_height"], got["new_width"], (got["pixel"], 0.0, got["west"], 0.0, -got["pixel"], got["top"])


def scene_bounds(grids: DataFrame, height: int, width: int, transform: Affine, here: Column, up: Column) -> DataFrame:
    """``grids`` (a to f, scene_zone, scene_north) with the rows and columns that a target grid takes up in each: lo_r, hi_r, lo_c, hi_c.

    They are those of points along the target's sides, widened by a pixel and a twentieth, far more than sides bend between two
    points. A target that isn't mapped well into a scene's zone, more than 60 degrees from its meridian or near a pole, bounds nothing: NULL.
    """
    share = F.transform(F.sequence(F.lit(0), F.lit(STEPS)), lambda k: k / F.lit(float(STEPS)))
    side = lambda row, col: F.transform(share, lambda s: F.struct(row(s).alias("r"), col(s).alias("c")))
    h, w, zero = F.lit(float(height)), F.lit(float(width)), F.lit(0.0)
    edge = F.concat(side(lambda s: zero, lambda s: w * s), side(lambda s: h, lambda s: w * s), side(lambda s: h * s, lambda s: zero), side(lambda s: h * s, lambda s: w))
    points = grids.withColumn("p", F.explode(edge)).withColumn("p", degrees(map_x(F.col("p.r"), F.col("p.c"), transform), map_y(F.col("p.r"), F.col("p.c"), transform), here, up))
    near = (F.abs(F.col("p.lon") - (F.col("scene_zone") * 6.0 - 183.0)) < 60.0) & (F.abs(F.col("p.lat")) < 85.0)
    points = points.withColumn("near", (F.col("scene_zone") == 0) | near).withColumn("p", metres(F.col("p"), F.col("scene_zone"), F.col("scene_north")))
    r, c = unplaced(F.col("p.x"), F.col("p.y"))
    points = points.select(*grids.columns, "near", r.alias("at_r"), c.alias("at_c")).withColumn("near", F.col("near") & (F.abs("at_r") < 1e15) & (F.abs("at_c") < 1e15))
    ends = points.groupBy(*grids.columns).agg(F.min("near").alias("near"), *[f(f"at_{x}").alias(f"{n}_{x}") for n, f in (("lo", F.min), ("hi", F.max)) for x in "rc"])
    wide = lambda x: F.lit(1.0) + (F.col(f"hi_{x}") - F.col(f"lo_{x}")) / F.lit(20.0)
    kept = lambda value: F.when(F.col("near"), value.cast("long"))
    return ends.select(*grids.columns, *[e for x in "rc" for e in (kept(F.floor(F.col(f"lo_{x}") - wide(x))).alias(f"lo_{x}"), kept(F.ceil(F.col(f"hi_{x}") + wide(x))).alias(f"hi_{x}"))])


def on_one_grid(pixels: DataFrame, scenes: DataFrame, height: int, width: int, transform: Affine, zone: int = 0, north: bool = True) -> DataFrame:
    """``pixels`` (scene_id, row, col, ...) at the pixels of one target grid: row and col become those of the target.

    A target pixel has, of each scene (scene_id, a to f, zone, north), the pixel that its centre lies in. The targets
    that may lie in a pixel are those within the bounds of its corners; which of them do is told by mapping their
    centres back. So neither the target grid nor a scene's place is ever joined with all others: the scenes' few columns
    are the only join. Of each grid that scenes have, the rows and columns that the target takes up are worked out
    once, and only pixels within them are mapped. Pixels of scenes that aren't known, and what lies beyond the target, are left out.
    """
    kept = [c for c in pixels.columns if c not in ("row", "col")]
    back = inverse(transform)
    here, up = F.lit(zone), F.lit(north)

    def target(row: Column, col: Column) -> Column:
        """Place in the target's pixels of a place in the scene's."""
        there = metres(degrees(*placed(row, col), F.col("scene_zone"), F.col("scene_north")), here, up)
        return bound(there, lambda m: F.struct(map_y(m["y"], m["x"], back).alias("r"), map_x(m["y"], m["x"], back).alias("c")))

    told = scenes.select("scene_id", *TRANSFORM, F.col("zone").alias("scene_zone"), F.col("north").alias("scene_north"))
    grid = [c for c in told.columns if c != "scene_id"]
    told = beside(told, scene_bounds(told.select(*grid).distinct(), height, width, transform, here, up), grid)
    x = pixels.select("scene_id", F.col("row").alias("r0"), F.col("col").alias("c0"), F.struct(*kept).alias("rest")).join(told, "scene_id")
    within = lambda at, n: F.coalesce((F.col(at) >= F.col(f"lo_{n}")) & (F.col(at) <= F.col(f"hi_{n}")), F.lit(True))
    x = x.where(within("r0", "r") & within("c0", "c")).drop("lo_r", "hi_r", "lo_c", "hi_c")
    corners = F.array(*[target(F.col("r0") + dr, F.col("c0") + dc) for dr in (0, 1) for dc in (0, 1)])
    # a hundredth of a pixel for sides that aren't quite straight
    low = lambda cs, n: F.greatest(F.ceil(F.array_min(F.transform(cs, lambda p: p[n])) - F.lit(0.51)), F.lit(0)).cast("long")
    high = lambda cs, n, most: F.least(F.floor(F.array_max(F.transform(cs, lambda p: p[n])) - F.lit(0.49)), F.lit(most - 1)).cast("long")

    def cells(b: Column) -> Column:
        """The targets within bounds, none where these are empty."""
        upto = lambda first, last: F.filter(F.sequence(first, F.greatest(first, last)), lambda i: i <= last)
        line = lambda r: F.transform(upto(b["left"], b["right"]), lambda c: F.struct(r.alias("row"), c.alias("col")))
        return F.flatten(F.transform(upto(b["top"], b["bottom"]), line))

    def meets(p: Column) -> Column:
        centre = p["row"] + F.lit(0.5), p["col"] + F.lit(0.5)
        there = metres(degrees(map_x(*centre, transform), map_y(*centre, transform), here, up), F.col("scene_zone"), F.col("scene_north"))
        placed_at = lambda m: F.struct(*[v.alias(n) for v, n in zip(unplaced(m["x"], m["y"]), "rc", strict=True)])
        return bound(bound(there, placed_at), lambda q: (F.floor(q["r"]) == F.col("r0")) & (F.floor(q["c"]) == F.col("c0")))

    # one expression, in which each step is bound to a name: as columns and a filter, Spark works them out again at each use
    bounds = bound(corners, lambda cs: F.struct(low(cs, "r").alias("top"), high(cs, "r", height).alias("bottom"), low(cs, "c").alias("left"), high(cs, "c", width).alias("right")))
    return x.select("rest", F.inline(F.filter(bound(bounds, cells), meets))).select("rest.*", "row", "col")


def composite_of_grids(pixels: DataFrame, scenes: DataFrame, bands: list[str], height: int, width: int, transform: Affine, zone: int = 0, north: bool = True, reducer: str = "median", by: tuple[str, ...] = ()) -> DataFrame:
    """The composite by pixel of a target grid (and ``by``) of scenes on grids of their own, by one aggregation."""
    return composite(on_one_grid(pixels, scenes, height, width, transform, zone, north), bands, ["row", "col", *by], reducer)
