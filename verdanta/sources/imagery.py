"""Scenes and pixel observations as DataFrames, the sensor registry, band files, and synthetic scenes."""

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BANDS = ["blue", "green", "red", "red_edge", "nir", "swir1", "swir2"]
SPLIT = "1998-05-01"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def select_bands(df: DataFrame, pattern: str, *others: str) -> DataFrame:
    """``others``, then the columns whose whole names match the pattern."""
    return df.select(*others, *[F.col(f"`{c}`") for c in df.columns if re.fullmatch(pattern, c) and c not in others])


def nodata_to_null(df: DataFrame, bands: list[str], nodata: float | None = None) -> DataFrame:
    """NaN and the nodata value become NULL, the only nodata inside the engine."""
    def clean(c: str) -> Column:
        x = F.nanvl(F.col(c), F.lit(None).cast("double"))
        return x if nodata is None else F.nullif(x, F.lit(nodata))

    return df.withColumns({c: clean(c) for c in bands})


def scenes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """scene_id, acquired, cloud_cover, sensor."""
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("scene_id"), F.col("o_orderdate").alias("acquired"), (F.col("o_totalprice") / F.lit(5000.0)).alias("cloud_cover"), F.col("o_orderstatus").alias("sensor"))


def pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per observation of a pixel: scene_id, pix, row, col, bands, scl, qa_pixel, cloud_prob."""
    c = F.col
    nir, red = c("l_quantity") / F.lit(50.0), c("l_extendedprice") / F.lit(210000.0)
    return table(spark, sf_dir, "lineitem").select(
        c("l_orderkey").alias("scene_id"), c("l_partkey").alias("pix"), F.expr("l_partkey div 50").alias("row"), (c("l_partkey") % 50).alias("col"),
        (c("l_tax") * F.lit(2.5)).alias("blue"), (c("l_discount") * F.lit(4.0)).alias("green"), red.alias("red"), ((red + nir) / F.lit(2.0)).alias("red_edge"), nir.alias("nir"),
        ((c("l_suppkey") % 100) / F.lit(200.0)).alias("swir1"), (c("l_linenumber") / F.lit(14.0)).alias("swir2"),
        (c("l_orderkey") % 12).alias("scl"), (c("l_orderkey") % 256).alias("qa_pixel"), ((c("l_orderkey") * 7) % 100).alias("cloud_prob"),
    )


def observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pixels with their scene's acquired, cloud_cover and sensor, and the period (1 before SPLIT, else 2)."""
    period = F.when(F.col("acquired") < F.expr(f"TIMESTAMP_NTZ'{SPLIT}'"), 1).otherwise(2)
    return pixels(spark, sf_dir).join(scenes(spark, sf_dir), "scene_id").withColumn("period", period)


def collection(df: DataFrame, bounds: tuple[int, int, int, int] | None = None, start: str | None = None, end: str | None = None, max_cloud: float | None = None, inclusive: bool = False, sensor: str | None = None) -> DataFrame:
    """Scenes or observations within bounds (min col, min row, max col, max row), [start, end) and below a cloud cover."""
    if bounds:
        df = df.where(F.col("col").between(bounds[0], bounds[2]) & F.col("row").between(bounds[1], bounds[3]))
    if start:
        df = df.where(F.col("acquired") >= F.expr(f"TIMESTAMP_NTZ'{start}'"))
    if end:
        df = df.where(F.col("acquired") < F.expr(f"TIMESTAMP_NTZ'{end}'"))
    if max_cloud is not None:
        df = df.where(F.col("cloud_cover") <= max_cloud if inclusive else F.col("cloud_cover") < max_cloud)
    return df.where(F.col("sensor") == sensor) if sensor else df


def clearest_scenes(df: DataFrame, n: int) -> DataFrame:
    """The n scenes of least cloud; an unknown cloud cover counts as 100."""
    return df.orderBy(F.coalesce("cloud_cover", F.lit(100.0)), "scene_id").limit(n)


#: sensor, satellite, resolution in metres, bands by code with wavelengths in micrometres, NIR and red band, revisit days, swath in km: fixed values
_FOUR = {"B2": ("Green", 0.52, 0.59), "B3": ("Red", 0.62, 0.68), "B4": ("NIR", 0.77, 0.86), "B5": ("SWIR", 1.55, 1.70)}
_THREE = {"B2": ("Green", 0.52, 0.59), "B3": ("Red", 0.62, 0.68), "B4": ("NIR", 0.77, 0.86)}
_FINE = {"B1": ("Blue", 0.45, 0.52), "B2": ("Green", 0.52, 0.60), "B3": ("Red", 0.63, 0.69), "B4": ("NIR", 0.77, 0.89)}
SENSORS = [
    ("LISS-III", "Resourcesat-2/2A", 23.5, _FOUR, ("B4", "B3"), 24, 141),
    ("LISS-IV-MX", "Resourcesat-2/2A", 5.8, _THREE, ("B4", "B3"), 5, 70),
    ("LISS-IV-PAN", "Resourcesat-2/2A", 5.8, {"PAN": ("Panchromatic", 0.50, 0.75)}, None, 5, 23),
    ("AWiFS", "Resourcesat-2/2A", 56.0, _FOUR, ("B4", "B3"), 5, 740),
    ("CARTOSAT-3-PAN", "Cartosat-3", 0.25, {"PAN": ("Panchromatic", 0.45, 0.90)}, None, 4, 16),
    ("CARTOSAT-3-MX", "Cartosat-3", 1.0, _FINE, ("B4", "B3"), 4, 16),
]


def sensors(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(SENSORS, "sensor string, satellite string, resolution_m double, bands map<string,struct<name:string,low:double,high:double>>, ndvi_bands struct<nir:string,red:string>, revisit_days int, swath_km int")


def sensor_info(spark: SparkSession, name: str) -> DataFrame:
    if name not in {s[0] for s in SENSORS}:
        raise ValueError(f"unknown sensor {name!r}")
    return sensors(spark).where(F.col("sensor") == name)


def with_sensor(scenes: DataFrame) -> DataFrame:
    """``scenes`` (sensor, ...) with what the registry says of their sensor; scenes of others go. The registry's few rows are broadcast."""
    return scenes.join(F.broadcast(sensors(scenes.sparkSession)), "sensor")


def recommended(wishes: DataFrame, resolution: str, requires_nir: bool = True) -> DataFrame:
    """``wishes`` once for each sensor at most five times as coarse as the wished ``resolution``, with a NIR band if asked for: sensor and resolution_m."""
    fit = sensors(wishes.sparkSession)
    fit = fit.where(F.exists(F.map_values("bands"), lambda b: b["name"] == "NIR")) if requires_nir else fit
    known = fit.select("sensor", "resolution_m")
    return wishes.join(F.broadcast(known), F.col("resolution_m") <= F.lit(5.0) * F.col(resolution))


def recommend_sensors(spark: SparkSession, resolution: float, requires_nir: bool = True) -> DataFrame:
    """Sensors at most five times as coarse, with a NIR band if asked for, the finest first."""
    fit = sensors(spark).where(F.col("resolution_m") <= F.lit(5.0 * resolution))
    fit = fit.where(F.exists(F.map_values("bands"), lambda b: b["name"] == "NIR")) if requires_nir else fit
    return fit.orderBy("resolution_m", "sensor")


def wms_url(base: str, layer: str, bbox: Column, width: int = 512, height: int = 512) -> Column:
    """GetMap request of a rendered picture for a struct bbox of min_lon, min_lat, max_lon, max_lat."""
    corners = F.concat_ws(",", *[bbox[n].cast("string") for n in ("min_lon", "min_lat", "max_lon", "max_lat")])
    return F.concat(F.lit(f"{base}?SERVICE=WMS&VERSION=1.1.1&REQUEST=GetMap&LAYERS={layer}&BBOX="), corners, F.lit(f"&WIDTH={width}&HEIGHT={height}&FORMAT=image/png&SRS=EPSG:4326"))


#: dataset of each Landsat (8 and 9 share one), and which file code holds which band: fixed values
DATASETS = {"L9": "landsat_ot_c2_l2", "L8": "landsat_ot_c2_l2", "L7": "landsat_etm_c2_l2", "L5": "landsat_tm_c2_l2"}
LATER = {"blue": "SR_B2", "green": "SR_B3", "red": "SR_B4", "nir": "SR_B5", "swir1": "SR_B6", "swir2": "SR_B7", "qa": "QA_PIXEL"}
EARLIER = {"blue": "SR_B1", "green": "SR_B2", "red": "SR_B3", "nir": "SR_B4", "swir1": "SR_B5", "swir2": "SR_B7", "qa": "QA_PIXEL"}
SAFE_BANDS = ["B02", "B03", "B04", "B05", "B06", "B07", "B08", "B8A", "B11", "B12"]


def search_landsat(scenes: DataFrame, satellite: str, bounds: tuple[int, int, int, int] | None = None, start: str | None = None, end: str | None = None, max_cloud: float = 30.0, max_results: int = 20) -> DataFrame:
    """At most ``max_results`` scenes of the satellite's dataset, the earliest first; the cloud limit is inclusive."""
    found = collection(scenes.where(F.col("dataset") == DATASETS[satellite]), bounds, start, end, max_cloud, inclusive=True)
    return found.orderBy("acquired", "scene_id").limit(max_results)


def band_files(paths: DataFrame) -> DataFrame:
    """(path) with the band code in its file name (``_B04_``, ``_SR_B4`` or at the end) and the scene before it."""
    name = F.regexp_extract("path", r"([^/]+)\.(?i:tif|jp2)$", 1)
    return paths.select("path", F.regexp_extract(name, r"_((?:SR_|ST_)?B[0-9]{1,2}A?)(?:_|$)", 1).alias("band"), F.regexp_extract(name, r"^(.*?)_(?:SR_|ST_)?B[0-9]", 1).alias("scene")).where("band <> ''")


def _in_folder(paths: DataFrame) -> DataFrame:
    split = F.regexp_extract("path", r"^(.*)/([^/]+)\.([A-Za-z0-9]+)$", 1), F.regexp_extract("path", r"([^/]+)\.[A-Za-z0-9]+$", 1), F.regexp_extract("path", r"\.([A-Za-z0-9]+)$", 1)
    return paths.select("path", split[0].alias("folder"), split[1].alias("stem"), split[2].alias("ending"))


def landsat_band_files(paths: DataFrame, satellite: str = "L8") -> DataFrame:
    """(folder, band, path) of extracted scenes: the first file whose name holds the band's code, ``TIF`` before ``tif``, then by path."""
    codes = LATER if satellite in ("L8", "L9") else EARLIER
    band = F.explode(F.filter(F.array(*[F.when(F.contains("stem", F.lit(code)), F.lit(name)) for name, code in codes.items()]), lambda b: b.isNotNull()))
    files = _in_folder(paths).where(F.col("ending").isin("TIF", "tif")).select("folder", band.alias("band"), "path", "ending")
    return files.groupBy("folder", "band").agg(F.min(F.struct("ending", "path")).alias("first")).select("folder", "band", "first.path")


def safe_band_files(paths: DataFrame) -> DataFrame:
    """(product, band, path) of SAFE folders: the last file by path whose name holds ``_B04_`` or ends in ``_B04``, of the 10 m and 20 m bands."""
    files = _in_folder(paths).where("ending = 'jp2'").select("path", F.regexp_extract("path", r"^(.*?\.SAFE)(?:/|$)", 1).alias("product"), "stem")
    hit = lambda b: F.contains("stem", F.lit(f"_{b}_")) | F.endswith("stem", F.lit(f"_{b}"))
    band = F.explode(F.filter(F.array(*[F.when(hit(b), F.lit(b)) for b in SAFE_BANDS]), lambda b: b.isNotNull()))
    return files.select("product", band.alias("band"), "path").groupBy("product", "band").agg(F.max("path").alias("path"))


def save_first(primary: DataFrame, secondary: DataFrame, on: list[str], order: list[str]) -> DataFrame:
    """``primary`` with the first match of ``secondary`` in its order; rows without a match go."""
    rest = [c for c in secondary.columns if c not in on]
    first = secondary.groupBy(*on).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("first"))
    return primary.join(first, on).select(*primary.columns, *[F.col("first")[c].alias(c) for c in rest])


def band_stack(bands: DataFrame, names: list[str], by: list[str]) -> DataFrame:
    """One row per pixel from one row per pixel and band (by, band, v); a band that a pixel hasn't is NULL."""
    # one aggregation; pivot() holds two more by pixel and band in the same task
    return bands.groupBy(*by).agg(*[F.first(F.when(F.col("band") == n, F.col("v")), ignorenulls=True).alias(n) for n in names])


#: the layers of forest change that are used: fixed values
HANSEN = ["treecover2000", "loss", "lossyear", "gain"]


def hansen_layers(df: DataFrame, by: list[str]) -> DataFrame:
    return df.select(*by, *HANSEN)


def loss_by_year(df: DataFrame, pixel_area: float, cover: int = 30) -> DataFrame:
    """Hectares lost by year (2000 and the layer's number) where tree cover in 2000 was at least ``cover`` per cent."""
    lost = df.where((F.col("loss") == 1) & (F.col("treecover2000") >= cover))
    return lost.groupBy((F.col("lossyear") + 2000).alias("year")).agg((F.count(F.lit(1)) * F.lit(pixel_area) / F.lit(10000.0)).alias("loss_ha"))


def write_pixels(df: DataFrame, path: str, tile: int = 512, nodata: float | None = None) -> None:
    """Pixels (scene_id, row, col, bands) as Parquet in the order of scene and tile; NaN and nodata become NULL.

    Rows are range-partitioned by scene and tile and sorted, so a file holds neighbouring tiles, however small they
    are, and a reader of some scenes, rows or columns skips files and row groups by their statistics.
    """
    bands = [c for c, t in df.dtypes if t in ("double", "float") and c not in ("row", "col")]
    order = ["scene_id", F.expr(f"row div {tile}"), F.expr(f"col div {tile}")]
    out = nodata_to_null(df, bands, nodata)
    out.repartitionByRange(*order).sortWithinPartitions(*order, "row", "col").write.mode("overwrite").parquet(path)


def read_pixels(spark: SparkSession, path: str, names: list[str], indices: list[int] | None = None) -> DataFrame:
    """Pixels with the bands at 1-based ``indices`` of ``names``; without indices, or with none, all of them."""
    wanted = [names[i - 1] for i in indices] if indices else names
    return spark.read.parquet(path).select("scene_id", "row", "col", *wanted)


def crown_scene(spark: SparkSession, height: int, width: int, crowns: DataFrame, base: float = 0.09, patches: DataFrame | None = None, noise: Column | None = None) -> DataFrame:
    """NDVI of a grid with Gaussian crowns (r, c, peak, sigma); the crowns near a pixel are found by cells, not by a cross join.

    A crown reaches six sigma; beyond that its part is below 2e-8 of its peak and counts as nothing. ``noise`` of row
    and col is added before values are cut to 0 and 1. Then ``patches`` (r, c, height, width, low, high), as of loss
    and regrowth, put a slope from low to high over their rows; of patches that overlap, the higher one counts.
    """
    # tasks of at most a million pixels, however large the grid
    tasks = max(spark.sparkContext.defaultParallelism, (height * width >> 20) + 1)
    grid = spark.range(0, height * width, 1, tasks).select((F.col("id") / width).cast("long").alias("row"), (F.col("id") % width).alias("col"))
    reach = F.ceil(F.lit(6.0) * F.col("sigma")).cast("long")
    seq = lambda first, last, most: F.sequence(F.greatest(first, F.lit(0).cast("long")), F.least(last, F.lit(most - 1).cast("long")))
    around = lambda x, most: seq(F.col(x).cast("long") - reach, F.col(x).cast("long") + reach, most)
    # the few rows are dealt out before each becomes many, neighbours together
    near = crowns.repartitionByRange(tasks, "r").withColumn("row", F.explode(around("r", height))).withColumn("col", F.explode(around("c", width)))
    d2 = (F.col("row") - F.col("r")) * (F.col("row") - F.col("r")) + (F.col("col") - F.col("c")) * (F.col("col") - F.col("c"))
    part = F.col("peak") * F.exp(-d2 / (F.lit(2.0) * F.col("sigma") * F.col("sigma")))
    none = F.lit(None).cast("double")
    # one aggregation instead of joins: what is exploded looks small to Spark, which would broadcast it by way of the driver
    parts = grid.select("row", "col", F.lit(0.0).alias("crown"), none.alias("put")).unionByName(near.select("row", "col", part.alias("crown"), none.alias("put")))
    if patches is not None:
        inside = patches.withColumn("row", F.explode(seq(F.col("r"), F.col("r") + F.col("height") - 1, height))).withColumn("col", F.explode(seq(F.col("c"), F.col("c") + F.col("width") - 1, width)))
        put = F.col("low") + (F.col("high") - F.col("low")) * (F.col("row") - F.col("r")) / F.greatest(F.col("height") - 1, F.lit(1))
        parts = parts.unionByName(inside.select("row", "col", none.alias("crown"), put.alias("put")))
    cut = lambda x: F.least(F.greatest(x, F.lit(0.0)), F.lit(1.0))
    value = F.lit(base) + F.coalesce("crown", F.lit(0.0)) + (F.lit(0.0) if noise is None else noise)
    out = parts.groupBy("row", "col").agg(F.sum("crown").alias("crown"), F.max("put").alias("put"))
    return out.select("row", "col", F.when(F.col("put").isNull(), cut(value)).otherwise(cut(F.col("put"))).alias("ndvi"))
