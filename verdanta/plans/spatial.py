"""Queries over statistics, catalogs, tiles, neighbourhoods and crowns, each with its SQL."""

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import indices as ix
from ..functions import mapping as mp
from ..operators import blocks as bl
from ..operators import boxes as bx
from ..operators import crowns as cr
from ..operators import grids as gr
from ..operators import segments as sg
from ..operators import stats as st
from ..operators import tiles as ti
from ..operators import zones as zo
from ..sources import imagery as im
from ..streaming.arrivals import event_window_counts
from . import vegetation as vg

QUERIES: dict[str, vg.Query] = {}
ORACLES: dict[str, str] = {}


def register(name: str, query: vg.Query, sql: str | None = None) -> None:
    QUERIES[name] = query
    if sql:
        ORACLES[name] = sql


def rounded(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(c, 6) for c in columns})


register(
    "array_stats",
    lambda spark, d: rounded(st.column_stats(im.table(spark, d, "events"), "value", ["event_type"]), "min", "max", "mean", "std", "median"),
    "SELECT event_type, round(min(value), 6) AS min, round(max(value), 6) AS max, round(avg(value), 6) AS mean, round(stddev_pop(value), 6) AS std, round(median(value), 6) AS median, count(value)::BIGINT AS count FROM events GROUP BY event_type",
)
register(
    "clip_percentile",
    lambda spark, d: rounded(st.clip_to_percentile(im.table(spark, d, "events").select("event_id", "value"), "value").select("event_id", "scaled"), "scaled"),
    "WITH p AS (SELECT quantile_cont(value, 0.02::DOUBLE) AS lo, quantile_cont(value, 0.98::DOUBLE) AS hi FROM events) SELECT event_id, round((least(greatest(value, lo), hi) - lo) / (hi - lo + 1e-9::DOUBLE), 6) AS scaled FROM events CROSS JOIN p",
)


def matched(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = im.table(spark, sf_dir, "events").select("event_type", "value")
    side = lambda name: events.where(F.col("event_type") == name).select(F.lit("value").alias("band"), "value")
    return rounded(st.histogram_match(side("view"), side("purchase"), "value", ["band"]), "v", "matched").select("v", "matched")


register(
    "histogram_match",
    matched,
    """WITH s AS (SELECT value AS v, sum(count(*)) OVER (ORDER BY value) / (SELECT count(*)::DOUBLE FROM events WHERE event_type = 'view') AS q FROM events WHERE event_type = 'view' GROUP BY value),
    r AS (SELECT value AS v, sum(count(*)) OVER (ORDER BY value) / (SELECT count(*)::DOUBLE FROM events WHERE event_type = 'purchase') AS q FROM events WHERE event_type = 'purchase' GROUP BY value),
    a AS (SELECT s.v, s.q, lo.q AS lq, lo.v AS lv FROM s ASOF LEFT JOIN r lo ON s.q >= lo.q), b AS (SELECT a.*, hi.q AS hq, hi.v AS hv FROM a ASOF LEFT JOIN r hi ON a.q <= hi.q)
    SELECT round(v, 6) AS v, round(CASE WHEN lv IS NULL THEN hv WHEN hv IS NULL THEN lv WHEN hq = lq THEN lv ELSE lv + (q - lq) / (hq - lq) * (hv - lv) END, 6) AS matched FROM b""",
)
#: the registry as SQL: sensor, satellite, resolution, revisit days, swath, place in the list; and each sensor's bands
_SENSORS_SQL = "sensors(sensor, satellite, resolution_m, revisit_days, swath_km, nr) AS (VALUES " + ", ".join(f"('{x[0]}', '{x[1]}', {x[2]}::DOUBLE, {x[5]}, {x[6]}, {k})" for k, x in enumerate(im.SENSORS)) + ")"
_BANDS_SQL = "bands(sensor, code, name, low, high, for_ndvi) AS (VALUES " + ", ".join(f"('{x[0]}', '{code}', '{band[0]}', {band[1]}::DOUBLE, {band[2]}::DOUBLE, {str(bool(x[4]) and code in x[4]).lower()})" for x in im.SENSORS for code, band in x[3].items()) + ")"


def sensor_scenes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The scenes, with one of the registry's sensors each."""
    names = F.array(*[F.lit(x[0]) for x in im.SENSORS])
    return im.scenes(spark, sf_dir).withColumn("sensor", F.get(names, (F.col("scene_id") % len(im.SENSORS)).cast("int")))


register(
    "sensor_recommend",
    lambda spark, d: im.recommended(im.table(spark, d, "part").select("p_partkey", "p_size"), "p_size").select("p_partkey", "sensor", "resolution_m"),
    f"WITH {_SENSORS_SQL}, {_BANDS_SQL} SELECT p_partkey, sensor, resolution_m FROM part JOIN sensors ON resolution_m <= 5 * p_size WHERE sensor IN (SELECT sensor FROM bands WHERE name = 'NIR')",
)
register(
    "sensor_bands",
    lambda spark, d: im.with_sensor(sensor_scenes(spark, d)).select("sensor", F.explode("bands").alias("code", "band"), "ndvi_bands").select("sensor", "code", "band.name", "band.low", "band.high", F.coalesce((F.col("code") == F.col("ndvi_bands.nir")) | (F.col("code") == F.col("ndvi_bands.red")), F.lit(False)).alias("for_ndvi")).groupBy("sensor", "code", "name", "low", "high", "for_ndvi").agg(F.count(F.lit(1)).alias("scenes")),
    f"WITH {_SENSORS_SQL}, {_BANDS_SQL} SELECT sensor, code, name, low, high, for_ndvi, count(*)::BIGINT AS scenes FROM orders JOIN sensors ON nr = o_orderkey % {len(im.SENSORS)} JOIN bands USING (sensor) GROUP BY ALL",
)
register(
    "sensor_info",
    lambda spark, d: im.with_sensor(sensor_scenes(spark, d)).groupBy("sensor", "satellite", "resolution_m", F.size("bands").alias("n_bands"), "revisit_days", "swath_km").agg(F.count(F.lit(1)).alias("scenes"), F.min("acquired").alias("first")),
    f"WITH {_SENSORS_SQL}, {_BANDS_SQL} SELECT sensor, satellite, resolution_m, (SELECT count(*) FROM bands b WHERE b.sensor = s.sensor)::INTEGER AS n_bands, revisit_days, swath_km, count(*)::BIGINT AS scenes, min(o_orderdate) AS first FROM orders JOIN sensors s ON nr = o_orderkey % {len(im.SENSORS)} GROUP BY ALL",
)


def boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("n_nationkey")
    corner = F.struct((k * 2).alias("min_lon"), k.alias("min_lat"), (k * 2 + 1).alias("max_lon"), (k + 1).alias("max_lat"))
    return im.table(spark, sf_dir, "nation").select("n_nationkey", im.wms_url("https://maps.test/wms", "ndvi", corner).alias("url"))


register("wms_url", boxes, "SELECT n_nationkey, 'https://maps.test/wms?SERVICE=WMS&VERSION=1.1.1&REQUEST=GetMap&LAYERS=ndvi&BBOX=' || n_nationkey * 2 || ',' || n_nationkey || ',' || n_nationkey * 2 + 1 || ',' || n_nationkey + 1 || '&WIDTH=512&HEIGHT=512&FORMAT=image/png&SRS=EPSG:4326' AS url FROM nation")
register(
    "band_files",
    lambda spark, d: im.band_files(im.table(spark, d, "orders").select(F.format_string("/data/LC08_%d_SR_B%d.TIF", "o_orderkey", F.col("o_orderkey") % 7 + 1).alias("path"))),
    "SELECT '/data/LC08_' || o_orderkey || '_SR_B' || (o_orderkey % 7 + 1) || '.TIF' AS path, 'SR_B' || (o_orderkey % 7 + 1) AS band, 'LC08_' || o_orderkey AS scene FROM orders",
)
register(
    "landsat_bands",
    lambda spark, d: im.landsat_band_files(im.table(spark, d, "orders").select(F.format_string("/data/LC08_%d/LC08_%d_%s.%s", F.expr("o_orderkey div 7"), F.expr("o_orderkey div 7"), F.when(F.col("o_orderkey") % 11 == 0, "QA_PIXEL").otherwise(F.concat(F.lit("SR_B"), F.col("o_orderkey") % 8 + 1)), F.when(F.col("o_orderkey") % 3 == 0, "tif").otherwise("TIF")).alias("path"))),
    """WITH f AS (SELECT '/data/LC08_' || o_orderkey // 7 AS folder, CASE WHEN o_orderkey % 11 = 0 THEN 'QA_PIXEL' ELSE 'SR_B' || (o_orderkey % 8 + 1) END AS code, CASE WHEN o_orderkey % 3 = 0 THEN 'tif' ELSE 'TIF' END AS ending, '/data/LC08_' || o_orderkey // 7 || '/LC08_' || o_orderkey // 7 || '_' || code || '.' || ending AS path FROM orders),
    b(band, want) AS (VALUES ('blue', 'SR_B2'), ('green', 'SR_B3'), ('red', 'SR_B4'), ('nir', 'SR_B5'), ('swir1', 'SR_B6'), ('swir2', 'SR_B7'), ('qa', 'QA_PIXEL'))
    SELECT folder, band, path FROM (SELECT *, row_number() OVER (PARTITION BY folder, band ORDER BY ending = 'tif', path) AS k FROM f JOIN b ON code = want) WHERE k = 1""",
)
register(
    "safe_bands",
    lambda spark, d: im.safe_band_files(im.table(spark, d, "orders").select(F.format_string("/s/P%d.SAFE/GRANULE/R%dm/T43_%s.jp2", F.expr("o_orderkey div 9"), F.col("o_orderkey") % 2 * 10 + 10, F.get(F.array(*[F.lit(x) for x in ("B02_10m", "B8A", "B09_60m", "B12_20m", "B04_10m")]), (F.col("o_orderkey") % 5).cast("int"))).alias("path"))),
    """WITH f AS (SELECT '/s/P' || o_orderkey // 9 || '.SAFE' AS product, ['B02_10m', 'B8A', 'B09_60m', 'B12_20m', 'B04_10m'][o_orderkey % 5 + 1] AS name, '/s/P' || o_orderkey // 9 || '.SAFE/GRANULE/R' || (o_orderkey % 2 * 10 + 10) || 'm/T43_' || name || '.jp2' AS path FROM orders)
    SELECT product, left(name, 3) AS band, max(path) AS path FROM f WHERE name <> 'B09_60m' GROUP BY 1, 2""",
)
register(
    "bbox_centre",
    lambda spark, d: im.table(spark, d, "nation").select("n_nationkey", mp.bbox_centre(F.struct((F.col("n_nationkey") * 2).alias("min_lon"), F.col("n_nationkey").alias("min_lat"), (F.col("n_nationkey") * 2 + 1).alias("max_lon"), (F.col("n_nationkey") + 1).alias("max_lat"))).alias("m")).select("n_nationkey", "m.lat", "m.lon"),
    "SELECT n_nationkey, n_nationkey + 0.5::DOUBLE AS lat, n_nationkey * 2 + 0.5::DOUBLE AS lon FROM nation",
)



def crowns_of_suppliers(spark: SparkSession, sf_dir: str) -> tuple[int, DataFrame]:
    """Rows of a picture, and a crown per supplier in it."""
    k = F.col("s_suppkey")
    suppliers = im.table(spark, sf_dir, "supplier")
    height = 2 * ((suppliers.agg(F.max(k).alias("n")).first()["n"] or 0) + 1)
    return height, suppliers.select((k * 2).cast("double").alias("r"), (k * 37 % 100).cast("double").alias("c"), (k % 5 / 10 + 0.3).alias("peak"), (k % 4 / 2 + 1.5).alias("sigma"))


def patches_of_nations(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("n_nationkey").cast("long")
    return im.table(spark, sf_dir, "nation").select((k % 5 * 4).alias("r"), (k * 7 % 90).alias("c"), F.lit(3).cast("long").alias("height"), F.lit(4).cast("long").alias("width"), F.lit(0.1).alias("low"), (k / 50 + 0.1).alias("high"))


_CROWNED = """k AS (SELECT s_suppkey * 2 AS r, s_suppkey * 37 % 100 AS c, s_suppkey % 5 / 10::DOUBLE + 0.3::DOUBLE AS peak, s_suppkey % 4 / 2::DOUBLE + 1.5::DOUBLE AS sigma FROM supplier),
    g AS (SELECT i // 100 AS "row", i % 100 AS col FROM (SELECT unnest(range((SELECT 200 * (max(s_suppkey) + 1) FROM supplier))) AS i)),
    s AS (SELECT "row", col, 0.09::DOUBLE + coalesce(sum(peak * exp(-(("row" - r) * ("row" - r) + (col - c) * (col - c)) / (2::DOUBLE * sigma * sigma))), 0::DOUBLE) AS x FROM g LEFT JOIN k ON abs("row" - r) <= ceil(6 * sigma) AND abs(col - c) <= ceil(6 * sigma) GROUP BY 1, 2)"""


def synthetic_scene(spark: SparkSession, sf_dir: str) -> DataFrame:
    height, crowns_ = crowns_of_suppliers(spark, sf_dir)
    return rounded(im.crown_scene(spark, height, 100, crowns_), "ndvi")


def synthetic_change(spark: SparkSession, sf_dir: str) -> DataFrame:
    height, crowns_ = crowns_of_suppliers(spark, sf_dir)
    noise = ((F.col("row") * 7 + F.col("col") * 13) % 11 - 5) / 400.0
    return rounded(im.crown_scene(spark, height, 100, crowns_, patches=patches_of_nations(spark, sf_dir), noise=noise), "ndvi")


register("synthetic_scene", synthetic_scene, f'WITH {_CROWNED} SELECT "row", col, round(least(x, 1::DOUBLE), 6) AS ndvi FROM s')
register(
    "synthetic_change",
    synthetic_change,
    f"""WITH {_CROWNED}, p AS (SELECT n_nationkey % 5 * 4 AS r, n_nationkey * 7 % 90 AS c, 0.1::DOUBLE AS low, n_nationkey / 50::DOUBLE + 0.1::DOUBLE AS high FROM nation),
    o AS (SELECT "row", col, max(low + (high - low) * ("row" - r) / 2) AS put FROM g JOIN p ON "row" BETWEEN r AND r + 2 AND col BETWEEN c AND c + 3 GROUP BY 1, 2)
    SELECT "row", col, round(coalesce(put, least(greatest(x + (("row" * 7 + col * 13) % 11 - 5) / 400::DOUBLE, 0::DOUBLE), 1::DOUBLE)), 6) AS ndvi FROM s LEFT JOIN o USING ("row", col)""",
)

# tiles over the grid of the pixel table's composites
SIZE, OVERLAP = 16, 4
GRID = f'{vg.PIXELS}, grid AS (SELECT "row", col, avg(nir) AS nir, avg(red) AS red FROM pixels GROUP BY 1, 2)'
TILED = f"""{GRID}, tiled AS (SELECT tile_r, tile_c, "row", col, "row" - tile_r * 12 AS r, col - tile_c * 12 AS c, nir, red FROM grid,
    unnest(range(greatest(floor(("row" - 16) / 12::DOUBLE) + 1, 0)::BIGINT, "row" // 12 + 1)) a(tile_r), unnest(range(greatest(floor((col - 16) / 12::DOUBLE) + 1, 0)::BIGINT, col // 12 + 1)) b(tile_c))"""
#: the grid of ``steady_grid``, and its tiles
STEADY = f'{vg.PIXELS}, grid AS (SELECT "row", col, avg(round(nir * {st.PARTS!r}::DOUBLE)) / {st.PARTS!r}::DOUBLE AS nir FROM pixels GROUP BY 1, 2)'
STEADY_TILED = TILED.replace(GRID, STEADY).replace("nir, red FROM grid", "nir FROM grid")


def grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return im.pixels(spark, sf_dir).groupBy("row", "col").agg(F.avg("nir").alias("nir"), F.avg("red").alias("red"))


def steady_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mean of nir alone, the same in every order of the rows, for queries whose rows hang on a threshold or a rank of it."""
    return im.pixels(spark, sf_dir).groupBy("row", "col").agg(st.steady_mean("nir").alias("nir"))


register(
    "tile_explode",
    lambda spark, d: ti.tiles(grid(spark, d), SIZE, OVERLAP).groupBy("tile_r", "tile_c").agg(F.count(F.lit(1)).alias("pixels"), F.min("r").alias("r0"), F.max("c").alias("c1"), F.round(F.avg("nir"), 6).alias("nir")),
    f"WITH {TILED} SELECT tile_r, tile_c, count(*)::BIGINT AS pixels, min(r) AS r0, max(c) AS c1, round(avg(nir), 6) AS nir FROM tiled GROUP BY 1, 2",
)


def logits(tile: np.ndarray) -> np.ndarray:
    """A stand-in for a network: linear in the bands, lower away from the tile's first pixel."""
    r, c = np.indices(tile.shape[1:])
    return 4 * (tile[0] - tile[1]) - 0.01 * (r + c)


register(
    "tile_predict_avg",
    lambda spark, d: rounded(ti.predict_tiles(grid(spark, d), logits, ["nir", "red"], SIZE, OVERLAP), "probability"),
    f'WITH {TILED} SELECT "row", col, round(avg(1 / (1 + exp(-(4::DOUBLE * (nir - red) - 0.01::DOUBLE * (r + c))))), 6) AS probability, (avg(1 / (1 + exp(-(4::DOUBLE * (nir - red) - 0.01::DOUBLE * (r + c))))) > 0.5)::INT AS canopy FROM tiled GROUP BY 1, 2',
)


def bright_boxes(tile: np.ndarray) -> pd.DataFrame:
    """A stand-in for a detector: a box of one pixel wherever the bands differ."""
    r, c = np.nonzero(tile[0] > tile[1])
    return pd.DataFrame({"xmin": c, "ymin": r, "xmax": c + 1.0, "ymax": r + 1.0, "score": (tile[0] - tile[1])[r, c], "label": "Tree"}).astype({"xmin": float, "ymin": float})


MAP = (10.0, 0.0, 500000.0, 0.0, -10.0, 4600000.0)
register(
    "detect_boxes",
    lambda spark, d: rounded(cr.map_boxes(ti.detect_tiles(grid(spark, d), bright_boxes, ["nir", "red"], SIZE, 0.25, 0.1), MAP), "score"),
    f'WITH {GRID} SELECT col * 10::DOUBLE + 500000 AS minx, 4600000 - ("row" + 1) * 10::DOUBLE AS miny, (col + 1) * 10::DOUBLE + 500000 AS maxx, 4600000 - "row" * 10::DOUBLE AS maxy, round(nir - red, 6) AS score, \'Tree\' AS label FROM grid WHERE nir - red >= 0.1::DOUBLE',
)



def found_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A box per line of an order, in the picture of its supplier."""
    x, y, size = (F.col("l_partkey") * 7 % 400) / F.lit(2.0), (F.col("l_orderkey") * 3 % 400) / F.lit(2.0), F.col("l_quantity")
    return im.table(spark, sf_dir, "lineitem").select("l_suppkey", x.alias("xmin"), y.alias("ymin"), (x + size).alias("xmax"), (y + size / 2 + 1).alias("ymax"), F.col("l_extendedprice").alias("score"))


register(
    "suppress_boxes",
    lambda spark, d: bx.suppressed(found_boxes(spark, d), ["l_suppkey"], 0.15, 32.0),
    """WITH b AS (SELECT DISTINCT l_suppkey, (l_partkey * 7 % 400) / 2::DOUBLE AS xmin, (l_orderkey * 3 % 400) / 2::DOUBLE AS ymin, (l_partkey * 7 % 400) / 2::DOUBLE + l_quantity AS xmax, (l_orderkey * 3 % 400) / 2::DOUBLE + l_quantity / 2 + 1 AS ymax, l_extendedprice AS score FROM lineitem),
    l AS (SELECT l_suppkey, list([{'x0': xmin, 'y0': ymin, 'x1': xmax, 'y1': ymax, 's': score}] ORDER BY score DESC, xmin, ymin, xmax, ymax) AS boxes FROM b GROUP BY 1),
    k AS (SELECT l_suppkey, unnest(list_reduce(boxes, lambda kept, b: CASE WHEN len(list_filter(kept, lambda o: greatest(least(o.x1, b[1].x1) - greatest(o.x0, b[1].x0), 0) * greatest(least(o.y1, b[1].y1) - greatest(o.y0, b[1].y0), 0)
        > 0.15::DOUBLE * ((o.x1 - o.x0) * (o.y1 - o.y0) + (b[1].x1 - b[1].x0) * (b[1].y1 - b[1].y0) - greatest(least(o.x1, b[1].x1) - greatest(o.x0, b[1].x0), 0) * greatest(least(o.y1, b[1].y1) - greatest(o.y0, b[1].y0), 0)))) > 0 THEN kept ELSE kept || b END)) AS o FROM l)
    SELECT l_suppkey, o.x0 AS xmin, o.y0 AS ymin, o.x1 AS xmax, o.y1 AS ymax, o.s AS score FROM k""",
)


def large_boxes(tile: np.ndarray) -> pd.DataFrame:
    """A stand-in for a detector whose boxes are larger than the tiles' overlap: around every bright pixel, as far as the tile shows it."""
    r, c = np.nonzero(tile[0] > 0.6)
    edge = tile.shape[1]
    return pd.DataFrame({"xmin": np.maximum(c - 4.0, 0), "ymin": np.maximum(r - 4.0, 0), "xmax": np.minimum(c + 5.0, edge), "ymax": np.minimum(r + 5.0, edge), "score": tile[0][r, c], "label": "Tree"})


def _large_boxes_sql() -> str:
    """The boxes of all tiles, clipped to what each tile shows, then the best again and again without those that it overlaps."""
    side = lambda k: f"greatest(least(o.{k}1, b[1].{k}1) - greatest(o.{k}0, b[1].{k}0), 0)"
    area = lambda x: f"({x}.x1 - {x}.x0) * ({x}.y1 - {x}.y0)"
    shared = f"{side('x')} * {side('y')}"
    return f"""WITH {STEADY_TILED}, b AS (SELECT DISTINCT tile_c * 12 + greatest(c - 4::DOUBLE, 0) AS xmin, tile_r * 12 + greatest(r - 4::DOUBLE, 0) AS ymin, tile_c * 12 + least(c + 5::DOUBLE, 16) AS xmax, tile_r * 12 + least(r + 5::DOUBLE, 16) AS ymax, nir AS score FROM tiled WHERE nir > 0.6::DOUBLE),
    l AS (SELECT list([{{'x0': xmin, 'y0': ymin, 'x1': xmax, 'y1': ymax, 's': score}}] ORDER BY score DESC, xmin, ymin, xmax, ymax) AS boxes FROM b),
    k AS (SELECT unnest(list_reduce(boxes, lambda kept, b: CASE WHEN len(list_filter(kept, lambda o: {shared} / ({area('o')} + {area('b[1]')} - {shared}) > 0.15::DOUBLE)) > 0 THEN kept ELSE kept || b END)) AS o FROM l)
    SELECT o.x0 AS xmin, o.y0 AS ymin, o.x1 AS xmax, o.y1 AS ymax, round(o.s, 6) AS score, 'Tree' AS label FROM k"""


register("detect_large_boxes", lambda spark, d: rounded(ti.detect_tiles(steady_grid(spark, d), large_boxes, ["nir"], SIZE, 0.25, 0.1), "score"), _large_boxes_sql())



def around(picture: np.ndarray) -> np.ndarray:
    """A stand-in for an opaque function: mean and spread of the values within two pixels."""
    padded = np.pad(picture[0], 2, constant_values=np.nan)
    near = np.lib.stride_tricks.sliding_window_view(padded, (5, 5)).reshape(*picture.shape[1:], 25)
    n = (~np.isnan(near)).sum(-1)
    return np.stack([np.nansum(near, -1) / np.maximum(n, 1), np.nanmax(near, -1) - np.nanmin(near, -1)])


register(
    "block_filter",
    lambda spark, d: rounded(bl.map_blocks(grid(spark, d).select(F.lit("mean").alias("picture"), F.col("row").alias("r"), F.col("col").alias("c"), "nir"), ["picture"], around, ["nir"], ["mean", "spread"], 2, SIZE), "mean", "spread"),
    f"""WITH {GRID} SELECT 'mean' AS picture, a."row" AS r, a.col AS c, round(avg(b.nir), 6) AS mean, round(max(b.nir) - min(b.nir), 6) AS spread
    FROM grid a JOIN grid b ON b."row" BETWEEN a."row" - 2 AND a."row" + 2 AND b.col BETWEEN a.col - 2 AND a.col + 2 GROUP BY 1, 2, 3""",
)


def triangles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A triangle on the map per nation."""
    k = F.col("n_nationkey")
    corner = lambda dx, dy: F.concat(((k % 5) * 9 + F.lit(dx)) * 10 + 500000, F.lit(" "), F.lit(4600000) - (F.expr("n_nationkey div 5") * 7 + F.lit(dy)) * 10)
    first = corner(0.25, 0.5)
    return im.table(spark, sf_dir, "nation").select("n_nationkey", F.concat(F.lit("POLYGON (("), F.concat_ws(", ", first, corner(8.5, 1.25), corner(3.0, 6.75), first), F.lit("))")).alias("wkt"))


def zone_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    size = im.pixels(spark, sf_dir).agg(F.max("row").alias("h")).first()
    picture = grid(spark, sf_dir).withColumnsRenamed({"row": "r", "col": "c"})
    return rounded(zo.reduced(picture, triangles(spark, sf_dir), ["n_nationkey"], "wkt", "nir", MAP, (size["h"] or 0) + 1, 50), "covered", "mean", "min", "max")


def _clipped_sql() -> str:
    """Every pixel's square cut by the three sides of a triangle, one after the other."""
    side = lambda p, i: f"(t[{i % 3 + 1}].x - t[{i}].x) * ({p}.y - t[{i}].y) - (t[{i % 3 + 1}].y - t[{i}].y) * ({p}.x - t[{i}].x)"
    p, q = "poly[i]", "poly[i % len(poly) + 1]"
    steps = ["c0 AS (SELECT *, [{'x': col, 'y': \"row\"}, {'x': col + 1::DOUBLE, 'y': \"row\"}, {'x': col + 1::DOUBLE, 'y': \"row\" + 1::DOUBLE}, {'x': col, 'y': \"row\" + 1::DOUBLE}] AS poly FROM near)"]
    for i in (1, 2, 3):
        a, b = side(p, i), side(q, i)
        cut = f"{{'x': {p}.x + ({q}.x - {p}.x) * ({a}) / (({a}) - ({b})), 'y': {p}.y + ({q}.y - {p}.y) * ({a}) / (({a}) - ({b}))}}"
        steps.append(f"c{i} AS (SELECT k, t, \"row\", col, nir, flatten(list_transform(range(1, len(poly) + 1), lambda i: CASE WHEN {a} >= 0 THEN [{p}] ELSE [] END || CASE WHEN ({a}) * ({b}) < 0 THEN [{cut}] ELSE [] END)) AS poly FROM c{i - 1})")
    return ", ".join(steps)


register(
    "zone_means",
    zone_means,
    f"""WITH {GRID}, z AS (SELECT n_nationkey AS k, n_nationkey % 5 * 9 AS x, n_nationkey // 5 * 7 AS y FROM nation),
    tri AS (SELECT k, x, y, [{{'x': x + 0.25::DOUBLE, 'y': y + 0.5::DOUBLE}}, {{'x': x + 8.5::DOUBLE, 'y': y + 1.25::DOUBLE}}, {{'x': x + 3::DOUBLE, 'y': y + 6.75::DOUBLE}}] AS t FROM z),
    near AS (SELECT k, t, "row"::DOUBLE AS "row", col::DOUBLE AS col, nir FROM tri JOIN grid ON "row" BETWEEN y AND y + 7 AND col BETWEEN x AND x + 9),
    {_clipped_sql()}, a AS (SELECT k, nir, abs(list_sum(list_transform(range(1, len(poly) + 1), lambda i: poly[i].x * poly[i % len(poly) + 1].y - poly[i % len(poly) + 1].x * poly[i].y))) / 2 AS share FROM c3),
    r AS (SELECT k, count(*) AS n, sum(share) AS covered, sum(share * nir) / sum(share) AS mean, min(nir) AS lo, max(nir) AS hi FROM a WHERE share > 1e-9 GROUP BY 1)
    SELECT n_nationkey, coalesce(n, 0)::BIGINT AS n, round(covered, 6) AS covered, round(mean, 6) AS mean, round(lo, 6) AS min, round(hi, 6) AS max FROM nation LEFT JOIN r ON k = n_nationkey""",
)



def by_field(tile: np.ndarray) -> list[np.ndarray]:
    """A stand-in for a segmenter: a mask for each number in the second band, as far as the tile shows it."""
    return [tile[1] == k for k in np.unique(tile[1]) if k > 0]


def segment_masks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fields of 20 x 9 pixels that a segmenter sees in parts, tile by tile, filtered by size and vegetation."""
    picture = steady_grid(spark, sf_dir).withColumn("field", F.expr("cast((row div 20) * 100 + col div 9 + 1 AS double)"))
    masks = sg.joined_masks(sg.segment_tiles(picture, by_field, ["nir", "field"], SIZE, OVERLAP), SIZE, OVERLAP)
    kept = sg.vegetated_masks(masks, picture.select("row", "col", (F.col("nir") > 0.45).alias("vegetation")), 30, 200)
    places = masks.groupBy("label").agg(F.min("row").alias("row"), F.min("c0").alias("col"))
    return rounded(kept.join(places, "label").drop("label"), "overlap")


register(
    "segment_masks",
    segment_masks,
    f"""WITH {STEADY} SELECT count(*)::BIGINT AS pixels, round(count(*) FILTER (WHERE nir > 0.45) / (count(*) + 1e-6::DOUBLE), 6) AS overlap, min("row") AS "row", min(col) AS col
    FROM grid GROUP BY "row" // 20, col // 9 HAVING count(*) BETWEEN 30 AND 200 AND count(*) FILTER (WHERE nir > 0.45) / (count(*) + 1e-6::DOUBLE) >= 0.6::DOUBLE""",
)

# 8 x 8 grids: one per embedding
GRIDS = "g AS (SELECT vec_id, (i - 1) // 8 AS r, (i - 1) % 8 AS c, embedding[i]::DOUBLE AS v FROM embeddings, unnest(range(1, 65)) t(i))"


def small_grids(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = im.table(spark, sf_dir, "embeddings").select("vec_id", F.posexplode("embedding").alias("i", "v"))
    return e.select("vec_id", F.expr("cast(i div 8 AS long)").alias("r"), (F.col("i") % 8).cast("long").alias("c"), F.col("v").cast("double").alias("v"))


def _smooth_sql(source: str) -> str:
    kernel = ", ".join(f"({o}, {w!r}::DOUBLE)" for o, w in ti.gaussian_kernel(1.5))
    mirrored = lambda x: f"CASE WHEN (({x}) % 16 + 16) % 16 < 8 THEN (({x}) % 16 + 16) % 16 ELSE 15 - (({x}) % 16 + 16) % 16 END"
    return f"""k(o, w) AS (VALUES {kernel}), s1 AS (SELECT t.vec_id, t.r, t.c, sum(s.v * w) AS v FROM {source} t CROSS JOIN k JOIN {source} s ON s.vec_id = t.vec_id AND s.c = t.c AND s.r = {mirrored('t.r + o')} GROUP BY 1, 2, 3),
    s2 AS (SELECT t.vec_id, t.r, t.c, sum(s.v * w) AS v FROM s1 t CROSS JOIN k JOIN s1 s ON s.vec_id = t.vec_id AND s.r = t.r AND s.c = {mirrored('t.c + o')} GROUP BY 1, 2, 3)"""


register("gauss_smooth", lambda spark, d: rounded(ti.smoothed(small_grids(spark, d), ["vec_id"], 8, 8), "v"), f"WITH {GRIDS}, {_smooth_sql('g')} SELECT vec_id, r, c, {vg.r6("v")} AS v FROM s2")
register(
    "local_maxima",
    lambda spark, d: rounded(ti.local_maxima(small_grids(spark, d), ["vec_id"], 2, 8, 8), "v"),
    f"WITH {GRIDS} SELECT vec_id, r, c, {vg.r6("v")} AS v FROM g a WHERE r BETWEEN 2 AND 5 AND c BETWEEN 2 AND 5 AND NOT EXISTS (SELECT 1 FROM g b WHERE b.vec_id = a.vec_id AND abs(b.r - a.r) <= 2 AND abs(b.c - a.c) <= 2 AND (b.v > a.v OR b.v = a.v AND (b.r < a.r OR b.r = a.r AND b.c < a.c)))",
)


def crowns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cr.watershed(small_grids(spark, sf_dir), ["vec_id"], 8, 8, pixel_size=1.0, min_area=2.0, threshold=0.0)


def _crowns_sql(height: str, width: int, sigma: float, threshold: float, distance: int, least: int) -> str:
    """Crowns of ``g`` (vec_id, r, c, v) as ``crowns``, by what flooding means rather than by its order.

    Pixels are numbered by (value, row, column). A pixel is as hard to reach as the last number on the easiest way
    from a seed, which is what the first recursion relaxes. If that is another pixel, it has that pixel's label; else
    it has its easiest neighbour's. The second recursion follows these pointers from the seeds.
    """
    kernel = ", ".join(f"({o}, {w!r}::DOUBLE)" for o, w in ti.gaussian_kernel(sigma))
    mirrored = lambda x, n: f"least((({x}) % (2 * {n}) + 2 * {n}) % (2 * {n}), 2 * {n} - 1 - (({x}) % (2 * {n}) + 2 * {n}) % (2 * {n}))"
    return f"""kernel(o, w) AS (VALUES {kernel}),
    s1 AS (SELECT t.vec_id, t.r, t.c, sum(s.v * w ORDER BY o) AS v FROM g t CROSS JOIN kernel JOIN g s ON s.vec_id = t.vec_id AND s.c = t.c AND s.r = {mirrored("t.r + o", height)} GROUP BY 1, 2, 3),
    s2 AS (SELECT t.vec_id, t.r, t.c, sum(s.v * w ORDER BY o) AS v FROM s1 t CROSS JOIN kernel JOIN s1 s ON s.vec_id = t.vec_id AND s.r = t.r AND s.c = {mirrored("t.c + o", width)} GROUP BY 1, 2, 3),
    open AS (SELECT vec_id, r, c, row_number() OVER (PARTITION BY vec_id ORDER BY s2.v DESC, r, c) AS p FROM s2 JOIN g USING (vec_id, r, c) WHERE g.v > {threshold}::DOUBLE),
    seed AS (SELECT vec_id, p, row_number() OVER (PARTITION BY vec_id ORDER BY p) AS label FROM open a WHERE r BETWEEN {distance} AND {height} - 1 - {distance} AND c BETWEEN {distance} AND {width} - 1 - {distance}
        AND NOT EXISTS (SELECT 1 FROM open b WHERE b.vec_id = a.vec_id AND b.r BETWEEN a.r - {distance} AND a.r + {distance} AND b.c BETWEEN a.c - {distance} AND a.c + {distance} AND b.p < a.p)),
    step AS (SELECT a.vec_id, a.p AS a, b.p AS b FROM open a CROSS JOIN (VALUES (0, 1), (1, 0), (0, -1), (-1, 0)) d(dr, dc) JOIN open b ON b.vec_id = a.vec_id AND b.r = a.r + dr AND b.c = a.c + dc),
    reach(vec_id, p, k) USING KEY (vec_id, p) AS (SELECT vec_id, p, p FROM seed UNION
        SELECT s.vec_id, s.b, min(greatest(t.k, s.b)) FROM reach t JOIN step s ON s.vec_id = t.vec_id AND s.a = t.p LEFT JOIN recurring.reach o ON o.vec_id = s.vec_id AND o.p = s.b
        WHERE o.k IS NULL OR greatest(t.k, s.b) < o.k GROUP BY 1, 2),
    easiest AS (SELECT s.vec_id, s.a AS p, arg_min(s.b, (t.k, s.b)) AS n FROM step s JOIN reach t ON t.vec_id = s.vec_id AND t.p = s.b GROUP BY 1, 2),
    pointer AS (SELECT vec_id, p, CASE WHEN k <> p THEN k ELSE n END AS n FROM reach JOIN easiest USING (vec_id, p) WHERE (vec_id, p) NOT IN (SELECT (vec_id, p) FROM seed)),
    found AS (SELECT * FROM seed UNION ALL SELECT pointer.vec_id, pointer.p, label FROM found JOIN pointer ON pointer.vec_id = found.vec_id AND pointer.n = found.p),
    large AS (SELECT vec_id, p, label FROM found QUALIFY count(*) OVER (PARTITION BY vec_id, label) >= {least}),
    crowns AS (SELECT g.vec_id, g.r, g.c, coalesce(label, 0)::BIGINT AS label FROM g LEFT JOIN open USING (vec_id, r, c) LEFT JOIN large USING (vec_id, p))"""


CROWNS = f"WITH RECURSIVE {GRIDS}, {_crowns_sql('8', 8, 1.5, 0.0, 3, 2)}"
register("crowns_watershed", crowns, f"{CROWNS} SELECT * FROM crowns")


def crowns_over_tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Crowns of the mean picture as one grid, flooded over tiles of 32 x 32 pixels."""
    size = im.pixels(spark, sf_dir).agg(F.max("row").alias("h")).first()
    picture = grid(spark, sf_dir).select(F.lit(1).alias("scene"), F.col("row").alias("r"), F.col("col").alias("c"), F.col("nir").alias("v"))
    return cr.watershed(picture, ["scene"], (size["h"] or 0) + 1, 50, pixel_size=1.0, min_area=4.0, sigma=1.0, threshold=0.2, tile=32)


register(
    "crowns_over_tiles",
    crowns_over_tiles,
    f"""WITH RECURSIVE {GRID.removeprefix("WITH ")}, g AS (SELECT 1 AS vec_id, "row" AS r, col AS c, nir AS v FROM grid), size AS (SELECT max(r) + 1 AS h FROM g),
    {_crowns_sql("(SELECT h FROM size)", 50, 1.0, 0.2, 3, 4)} SELECT vec_id AS scene, r, c, label FROM crowns""",
)
register(
    "crown_outlines",
    lambda spark, d: cr.outlines(crowns(spark, d), ["vec_id"], MAP),
    f"""{CROWNS}, box AS (SELECT vec_id, label, 10::DOUBLE * min(c) + 500000 AS minx, -10::DOUBLE * (max(r) + 1) + 4600000 AS miny, 10::DOUBLE * (max(c) + 1) + 500000 AS maxx, -10::DOUBLE * min(r) + 4600000 AS maxy, count(*) * 100::DOUBLE AS area_m2 FROM crowns WHERE label > 0 GROUP BY 1, 2)
    SELECT *, printf('POLYGON ((%.1f %.1f, %.1f %.1f, %.1f %.1f, %.1f %.1f, %.1f %.1f))', minx, miny, maxx, miny, maxx, maxy, minx, maxy, minx, miny) AS wkt FROM box""",
)
SEGMENTS = f"{GRIDS}, s AS (SELECT vec_id, r, c, v, (r // 3) * 3 + c // 3 + 1 AS label FROM g)"


def blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return small_grids(spark, sf_dir).withColumn("label", F.expr("(r div 3) * 3 + c div 3 + 1"))


register("crown_sizes", lambda spark, d: cr.segment_sizes(blocks(spark, d).where("v > 0"), ["vec_id"]), f"WITH {SEGMENTS} SELECT vec_id, label, count(*)::BIGINT AS pixels FROM s WHERE v > 0 GROUP BY 1, 2")
register(
    "min_area_crowns",
    lambda spark, d: cr.large_segments(blocks(spark, d), ["vec_id"], 6),
    f"WITH {SEGMENTS} SELECT vec_id, r, c, CASE WHEN count(*) OVER (PARTITION BY vec_id, label) >= 6 THEN label ELSE 0 END AS label FROM s",
)
register(
    "segment_filter",
    lambda spark, d: rounded(cr.vegetated_segments(blocks(spark, d).withColumn("vegetation", F.col("v") > 0), ["vec_id"], 4, 9), "overlap"),
    f"WITH {SEGMENTS} SELECT vec_id, label, count(*)::BIGINT AS pixels, round(count(*) FILTER (WHERE v > 0) / (count(*) + 1e-6::DOUBLE), 6) AS overlap FROM s GROUP BY 1, 2 HAVING count(*) BETWEEN 4 AND 9 AND count(*) FILTER (WHERE v > 0) / (count(*) + 1e-6::DOUBLE) >= 0.6::DOUBLE",
)
register(
    "segment_outlines",
    lambda spark, d: cr.outlines(blocks(spark, d), ["vec_id"], MAP).drop("wkt"),
    f"WITH {SEGMENTS} SELECT vec_id, label, 10::DOUBLE * min(c) + 500000 AS minx, -10::DOUBLE * (max(r) + 1) + 4600000 AS miny, 10::DOUBLE * (max(c) + 1) + 500000 AS maxx, -10::DOUBLE * min(r) + 4600000 AS maxy, count(*) * 100::DOUBLE AS area_m2 FROM s GROUP BY 1, 2",
)
_TARGET = "t AS (SELECT i // 12 AS nr, i % 12 AS nc, (i // 12 + 0.5::DOUBLE) * (8 / 12::DOUBLE) - 0.5::DOUBLE AS y, (i % 12 + 0.5::DOUBLE) * (8 / 12::DOUBLE) - 0.5::DOUBLE AS x FROM (SELECT unnest(range(144)) AS i))"
_AT = lambda x, d: f"least(greatest(floor({x})::BIGINT + {d}, 0), 7)"
register(
    "crown_polygons",
    lambda spark, d: cr.polygons(blocks(spark, d).withColumn("label", F.when(F.col("v") > -0.05, F.col("label")).otherwise(0)), ["vec_id"], MAP).select("vec_id", "label", F.round("area_m2", 6).alias("area_m2"), F.round("perimeter_m", 6).alias("perimeter_m")),
    f"""WITH {SEGMENTS}, k AS (SELECT vec_id, r, c, label FROM s WHERE v > -0.05::DOUBLE), d(dr, dc) AS (VALUES (0, 1), (1, 0), (0, -1), (-1, 0))
    SELECT k.vec_id, k.label, count(*) * 25::DOUBLE AS area_m2, (count(*) - count(o.r)) * 10::DOUBLE AS perimeter_m FROM k CROSS JOIN d LEFT JOIN k o ON o.vec_id = k.vec_id AND o.label = k.label AND o.r = k.r + dr AND o.c = k.c + dc GROUP BY 1, 2""",
)

def canopy_polygons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The canopy of the whole picture as one region, traced over tiles of 16 x 16 pixels, and its background as another."""
    label = F.when(F.col("nir") > 0.5, 1).otherwise(2).cast("long")
    pixels_ = steady_grid(spark, sf_dir).select(F.lit("mean").alias("picture"), F.col("row").alias("r"), F.col("col").alias("c"), label.alias("label"))
    return cr.polygons(pixels_, ["picture"], MAP, SIZE).select("picture", "label", F.round("area_m2", 6).alias("area_m2"), F.round("perimeter_m", 6).alias("perimeter_m"))


register(
    "canopy_polygons",
    canopy_polygons,
    f"""WITH {STEADY}, k AS (SELECT "row" AS r, col AS c, CASE WHEN nir > 0.5 THEN 1 ELSE 2 END AS label FROM grid), d(dr, dc) AS (VALUES (0, 1), (1, 0), (0, -1), (-1, 0))
    SELECT 'mean' AS picture, k.label::BIGINT AS label, count(*) * 25::DOUBLE AS area_m2, (count(*) - count(o.r)) * 10::DOUBLE AS perimeter_m FROM k CROSS JOIN d LEFT JOIN k o ON o.label = k.label AND o.r = k.r + dr AND o.c = k.c + dc GROUP BY 1, 2""",
)
register(
    "crown_features",
    lambda spark, d: cr.box_features(cr.outlines(blocks(spark, d), ["vec_id"], MAP)).select("vec_id", "feature"),
    f"""WITH {SEGMENTS}, b AS (SELECT vec_id, label, 10::DOUBLE * min(c) + 500000 AS x0, -10::DOUBLE * (max(r) + 1) + 4600000 AS y0, 10::DOUBLE * (max(c) + 1) + 500000 AS x1, -10::DOUBLE * min(r) + 4600000 AS y1, count(*) * 100::DOUBLE AS area FROM s GROUP BY 1, 2)
    SELECT vec_id, to_json({{'type': 'Feature', 'geometry': {{'type': 'Polygon', 'coordinates': [[[x0, y0], [x1, y0], [x1, y1], [x0, y1], [x0, y0]]]}}, 'properties': {{'area_m2': area, 'label': label}}}})::VARCHAR AS feature FROM b""",
)
register(
    "resample_nearest",
    lambda spark, d: rounded(ti.resampled(small_grids(spark, d), ["vec_id"], 8, 8, 12, 12, "nearest"), "v"),
    f"WITH {GRIDS}, {_TARGET} SELECT vec_id, nr AS r, nc AS c, {vg.r6("v")} AS v FROM t JOIN g ON g.r = {_AT('y + 0.5::DOUBLE', 0)} AND g.c = {_AT('x + 0.5::DOUBLE', 0)}",
)
register(
    "resample_bilinear",
    lambda spark, d: rounded(ti.resampled(small_grids(spark, d), ["vec_id"], 8, 8, 12, 12), "v"),
    f"""WITH {GRIDS}, {_TARGET}, taps AS (SELECT nr, nc, y, x, dy, dx FROM t, unnest([0, 1]) a(dy), unnest([0, 1]) b(dx))
    SELECT vec_id, nr AS r, nc AS c, {vg.r6("sum(v * (CASE WHEN dy = 1 THEN y - floor(y) ELSE 1 - (y - floor(y)) END) * (CASE WHEN dx = 1 THEN x - floor(x) ELSE 1 - (x - floor(x)) END))")} AS v
    FROM taps JOIN g ON g.r = {_AT('y', 'dy')} AND g.c = {_AT('x', 'dx')} GROUP BY 1, 2, 3""",
)
_WEIGHTS = {
    "cubic": (2, lambda d: f"CASE WHEN {d} <= 1 THEN 1.5::DOUBLE * {d} ** 3 - 2.5::DOUBLE * {d} ** 2 + 1 WHEN {d} < 2 THEN -0.5::DOUBLE * {d} ** 3 + 2.5::DOUBLE * {d} ** 2 - 4 * {d} + 2 ELSE 0 END"),
    "lanczos": (3, lambda d: f"CASE WHEN {d} < 1e-12::DOUBLE THEN 1 WHEN {d} < 3 THEN sin(pi() * {d}) / (pi() * {d}) * sin(pi() * {d} / 3) / (pi() * {d} / 3) ELSE 0 END"),
    "bilinear": (1, lambda d: f"greatest(1 - {d}, 0)"),
}


def sampled_sql(targets: str, method: str, scale: float = 1.0) -> str:
    """SQL that takes t(nr, nc, y, x) from the 8 x 8 grids, with kernels ``scale`` times as wide."""
    reach, weight = _WEIGHTS[method]
    wide = int(-(-reach * scale // 1))
    taps = f"unnest(range({1 - wide}, {wide + 1}))"
    away = lambda x: f"(abs({x} - floor({x}) - d{x}) / {scale!r}::DOUBLE)"
    return f"""WITH {GRIDS}, {targets}, taps AS (SELECT nr, nc, y, x, dy, dx, {weight(away('y'))} AS wy, {weight(away('x'))} AS wx FROM t, {taps} a(dy), {taps} b(dx))
    SELECT vec_id, nr AS r, nc AS c, {vg.r6("sum(v * wy * wx) / sum(wy * wx)")} AS v FROM taps JOIN g ON g.r = {_AT('y', 'dy')} AND g.c = {_AT('x', 'dx')} GROUP BY 1, 2, 3"""


for _method in ("cubic", "lanczos"):
    register(f"resample_{_method}", lambda spark, d, m=_method: rounded(ti.resampled(small_grids(spark, d), ["vec_id"], 8, 8, 12, 12, m), "v"), sampled_sql(_TARGET, _method))

_COARSE = "t AS (SELECT i // 3 AS nr, i % 3 AS nc, (i // 3 + 0.5::DOUBLE) * (8 / 3::DOUBLE) - 0.5::DOUBLE AS y, (i % 3 + 0.5::DOUBLE) * (8 / 3::DOUBLE) - 0.5::DOUBLE AS x FROM (SELECT unnest(range(9)) AS i))"
for _method in ("bilinear", "cubic", "lanczos"):
    register(f"coarsen_{_method}", lambda spark, d, m=_method: rounded(ti.resampled(small_grids(spark, d), ["vec_id"], 8, 8, 3, 3, m), "v"), sampled_sql(_COARSE, _method, 8 / 3))


def averaged_sql(targets: str, size: float) -> str:
    """SQL of area means over targets of ``size`` pixels of the 8 x 8 grids."""
    part = lambda at, i: f"(least({at} + {size / 2!r}::DOUBLE, {i} + 0.5::DOUBLE, 7.5::DOUBLE) - greatest({at} - {size / 2!r}::DOUBLE, {i} - 0.5::DOUBLE, -0.5::DOUBLE))"
    w = f"{part('y', 'r')} * {part('x', 'c')}"
    return f"WITH {GRIDS}, {targets} SELECT vec_id, nr AS r, nc AS c, {vg.r6(f'sum(v * {w}) / sum({w})')} AS v FROM t JOIN g ON {part('y', 'r')} > 1e-9::DOUBLE AND {part('x', 'c')} > 1e-9::DOUBLE GROUP BY 1, 2, 3"


register("coarsen_average", lambda spark, d: rounded(ti.resampled(small_grids(spark, d), ["vec_id"], 8, 8, 3, 3, "average"), "v"), averaged_sql(_COARSE, 8 / 3))
register(
    "coregister_coarser",
    lambda spark, d: rounded(ti.coregistered(small_grids(spark, d), ["vec_id"], 8, 8, MAP, 3, 4, (25.0, 0.0, 500005.0, 0.0, -25.0, 4600010.0), "average"), "v"),
    averaged_sql("t AS (SELECT i // 4 AS nr, i % 4 AS nc, (4600000 - (4600010 - 25 * (i // 4 + 0.5::DOUBLE))) / 10 - 0.5::DOUBLE AS y, (500005 + 25 * (i % 4 + 0.5::DOUBLE) - 500000) / 10 - 0.5::DOUBLE AS x FROM (SELECT unnest(range(12)) AS i) WHERE x BETWEEN -0.5 AND 7.5 AND y BETWEEN -0.5 AND 7.5)", 2.5),
)

REFERENCE = (7.0, 0.0, 500005.0, 0.0, -7.0, 4599990.0)
register(
    "coregister",
    lambda spark, d: rounded(ti.coregistered(small_grids(spark, d), ["vec_id"], 8, 8, MAP, 9, 9, REFERENCE, "cubic"), "v"),
    sampled_sql("t AS (SELECT i // 9 AS nr, i % 9 AS nc, (4600000 - (4599990 - 7 * (i // 9 + 0.5::DOUBLE))) / 10 - 0.5::DOUBLE AS y, (500005 + 7 * (i % 9 + 0.5::DOUBLE) - 500000) / 10 - 0.5::DOUBLE AS x FROM (SELECT unnest(range(81)) AS i))", "cubic"),
)

# a grid of degrees that lies inside the map grid, in zone 43
DEGREES, ZONE = (0.00012, 0.0, 75.00005, 0.0, -0.00009, 41.55165), 43


def _utm_sql() -> str:
    e = 2 * mp.N**0.5 / (1 + mp.N)
    x, y = "eta", "xi"
    for j, a in enumerate(mp.ALPHA, 1):
        x += f" + {a!r}::DOUBLE * cos({2 * j} * xi) * sinh({2 * j} * eta)"
        y += f" + {a!r}::DOUBLE * sin({2 * j} * xi) * cosh({2 * j} * eta)"
    k = mp.SCALE * mp.RADIUS
    return f"""d AS (SELECT i // 6 AS nr, i % 6 AS nc, radians({DEGREES[2]}::DOUBLE + {DEGREES[0]}::DOUBLE * (i % 6 + 0.5::DOUBLE) - 75) AS away, sin(radians({DEGREES[5]}::DOUBLE + {DEGREES[4]}::DOUBLE * (i // 6 + 0.5::DOUBLE))) AS s FROM (SELECT unnest(range(36)) AS i)),
    tt AS (SELECT nr, nc, away, sinh(atanh(s) - {e!r}::DOUBLE * atanh({e!r}::DOUBLE * s)) AS tau FROM d), xe AS (SELECT nr, nc, atan2(tau, cos(away)) AS xi, atanh(sin(away) / sqrt(1 + tau * tau)) AS eta FROM tt),
    t AS (SELECT nr, nc, (4600000 - {k!r}::DOUBLE * ({y})) / 10 - 0.5::DOUBLE AS y, ({k!r}::DOUBLE * ({x})) / 10 - 0.5::DOUBLE AS x FROM xe)"""


register(
    "reproject_wgs84",
    lambda spark, d: ti.to_wgs84(small_grids(spark, d), ["vec_id"], 8, 8, MAP, ZONE, True, 6, 6, DEGREES).withColumn("v", F.round("v", 4)),
    sampled_sql(_utm_sql(), "bilinear").replace(", 6) END AS v", ", 4) END AS v"),
)


def map_scenes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A scene of its own place and size per nation, in zones north and south."""
    k = F.col("n_nationkey")
    number = lambda x: F.lit(x) if isinstance(x, float) else x.cast("double")
    columns = {"height": k * 7 + 100, "width": 300 - k, "a": number(30.0), "b": number(0.0), "c": number(k * 10000 + 400000), "d": number(0.0), "e": number(-30.0), "f": number(k * 150000 + 3000000), "zone": k + 20, "north": k % 2 == 0}
    return im.table(spark, sf_dir, "nation").select("n_nationkey", *[c.alias(n) for n, c in columns.items()])


def _degrees_sql() -> str:
    """lon and lat of x, y in a zone (0 to 60, north or not), as SQL over p(..., x, y, zone, north)."""
    k = mp.SCALE * mp.RADIUS
    xi0, eta0, lat = "xi", "eta", "chi"
    for j, b in enumerate(mp.BETA, 1):
        xi0 += f" - {b!r}::DOUBLE * sin({2 * j} * xi) * cosh({2 * j} * eta)"
        eta0 += f" - {b!r}::DOUBLE * cos({2 * j} * xi) * sinh({2 * j} * eta)"
    for j, d in enumerate(mp.DELTA, 1):
        lat += f" + {d!r}::DOUBLE * sin({2 * j} * chi)"
    return f"""q AS (SELECT *, (y - CASE WHEN north THEN 0 ELSE 10000000 END) / {k!r}::DOUBLE AS xi, (x - 500000) / {k!r}::DOUBLE AS eta FROM p), q0 AS (SELECT *, {xi0} AS xi0, {eta0} AS eta0 FROM q),
    q1 AS (SELECT *, asin(sin(xi0) / cosh(eta0)) AS chi FROM q0), geo AS (SELECT *, degrees(radians(6 * zone - 183) + atan2(sinh(eta0), cos(xi0))) AS lon, degrees({lat}) AS lat FROM q1)"""


register(
    "default_grids",
    lambda spark, d: gr.default_grids(map_scenes(spark, d)).select("n_nationkey", "new_height", "new_width", F.round("west", 7).alias("west"), F.round("top", 7).alias("top"), F.round("pixel", 9).alias("pixel")),
    f"""WITH s AS (SELECT n_nationkey AS k, n_nationkey * 7 + 100 AS h, 300 - n_nationkey AS w, n_nationkey * 10000 + 400000 AS c, n_nationkey * 150000 + 3000000 AS f, n_nationkey + 20 AS zone, n_nationkey % 2 = 0 AS north FROM nation),
    e AS (SELECT *, unnest(range(21)) / 20::DOUBLE AS t FROM s), o AS (SELECT *, 0 AS pr, w * t AS pc FROM e UNION ALL SELECT *, h, w * t FROM e UNION ALL SELECT *, h * t, 0 FROM e UNION ALL SELECT *, h * t, w FROM e),
    p AS (SELECT *, c + 30::DOUBLE * pc AS x, f - 30::DOUBLE * pr AS y FROM o), {_degrees_sql()},
    g AS (SELECT k, h, w, min(lon) AS west, max(lon) AS east, min(lat) AS low, max(lat) AS top, max(lon) FILTER (pr = 0 AND pc = 0) AS lon0, max(lat) FILTER (pr = 0 AND pc = 0) AS lat0, max(lon) FILTER (pr = h AND pc = w) AS lon1, max(lat) FILTER (pr = h AND pc = w) AS lat1 FROM geo GROUP BY 1, 2, 3),
    r AS (SELECT *, sqrt((lon1 - lon0) ** 2 + (lat1 - lat0) ** 2) / sqrt(h * h + w * w) AS pixel FROM g)
    SELECT k AS n_nationkey, floor((top - low) / pixel + 0.5::DOUBLE)::BIGINT AS new_height, floor((east - west) / pixel + 0.5::DOUBLE)::BIGINT AS new_width, round(west, 7) AS west, round(top, 7) AS top, round(pixel, 9) AS pixel FROM r""",
)

#: the target of scenes on both sides of the meridian where zones 43 and 44 meet, and where each zone's scenes lie
MEETING = (0.0001, 0.0, 77.9985, 0.0, -0.0001, 41.5018)
SIDES = {43: 750200.0, 44: 249400.0}


def composite_grids(spark: SparkSession, sf_dir: str) -> DataFrame:
    scenes = im.scenes(spark, sf_dir).select("scene_id", (F.col("scene_id") % 2 + 43).cast("int").alias("zone"))
    west = F.when(F.col("zone") == 43, SIDES[43]).otherwise(SIDES[44])
    scenes = scenes.select("scene_id", "zone", F.lit(True).alias("north"), *[F.lit(x).alias(n) for n, x in (("a", 10.0), ("b", 0.0), ("d", 0.0), ("e", -10.0), ("f", 4598800.0))], west.alias("c"))
    return rounded(gr.composite_of_grids(im.pixels(spark, sf_dir).select("scene_id", "row", "col", "nir", "swir1"), scenes, ["nir", "swir1"], 24, 30, MEETING), "nir", "swir1")


def _meeting_sql() -> str:
    e = 2 * mp.N**0.5 / (1 + mp.N)
    x, y = "eta", "xi"
    for j, a in enumerate(mp.ALPHA, 1):
        x += f" + {a!r}::DOUBLE * cos({2 * j} * xi) * sinh({2 * j} * eta)"
        y += f" + {a!r}::DOUBLE * sin({2 * j} * xi) * cosh({2 * j} * eta)"
    k = mp.SCALE * mp.RADIUS
    return f"""d AS (SELECT i // 30 AS tr, i % 30 AS tc, z AS zone, west, radians({MEETING[2]}::DOUBLE + {MEETING[0]}::DOUBLE * (i % 30 + 0.5::DOUBLE) - (6 * z - 183)) AS away, sin(radians({MEETING[5]}::DOUBLE + {MEETING[4]}::DOUBLE * (i // 30 + 0.5::DOUBLE))) AS s
        FROM (SELECT unnest(range(720)) AS i), (VALUES (43, {SIDES[43]}::DOUBLE), (44, {SIDES[44]}::DOUBLE)) v(z, west)),
    tt AS (SELECT *, sinh(atanh(s) - {e!r}::DOUBLE * atanh({e!r}::DOUBLE * s)) AS tau FROM d), xe AS (SELECT *, atan2(tau, cos(away)) AS xi, atanh(sin(away) / sqrt(1 + tau * tau)) AS eta FROM tt),
    m AS (SELECT tr, tc, zone, floor((4598800 - {k!r}::DOUBLE * ({y})) / 10)::BIGINT AS r, floor((500000 + {k!r}::DOUBLE * ({x}) - west) / 10)::BIGINT AS c FROM xe)"""


register(
    "composite_grids",
    composite_grids,
    f'WITH {vg.PIXELS}, {_meeting_sql()} SELECT tr AS "row", tc AS col, round(median(nir), 6) AS nir, round(median(swir1), 6) AS swir1 FROM m JOIN pixels p ON p."row" = m.r AND p.col = m.c AND p.scene_id % 2 + 43 = m.zone GROUP BY 1, 2',
)
register(
    "regional_reduce",
    lambda spark, d: im.pixels(spark, d).where(F.col("col").between(10, 30)).agg(F.round(F.avg(ix.ndvi(F.col("nir"), F.col("red"))), 6).alias("mean_ndvi"), F.count(F.lit(1)).alias("n")),
    f"WITH {vg.PIXELS} SELECT round(avg({vg.NDVI}), 6) AS mean_ndvi, count(*)::BIGINT AS n FROM pixels WHERE col BETWEEN 10 AND 30",
)
register(
    "event_windows",
    lambda spark, d: event_window_counts(im.table(spark, d, "events")).select("window_start", "event_type", "n", F.round("mean_value", 6).alias("mean_value")),
    "SELECT time_bucket(INTERVAL 1 HOUR, ts) AS window_start, event_type, count(*)::BIGINT AS n, round(avg(value), 6) AS mean_value FROM events GROUP BY 1, 2",
)
