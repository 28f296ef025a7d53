"""Composites and change between two dates: differencing, change vectors, class transitions, summaries."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.indices import ndvi

#: NDVI from which a class begins, and the class of nodata: fixed values
CLASSES = {"sparse": 0.10, "moderate": 0.25, "dense": 0.45}
NODATA_CLASS = 255
NAMES = ["bare", "sparse", "moderate", "dense"]


def composite(df: DataFrame, bands: list[str], by: list[str], reducer: str = "median") -> DataFrame:
    """Per group the exact median, or the mean, of each band; NULL observations are skipped."""
    reduce = {"median": F.median, "mean": F.avg}[reducer]
    return df.groupBy(*by).agg(*[reduce(b).alias(b) for b in bands])


def pair(df: DataFrame, bands: list[str], reducer: str = "median") -> DataFrame:
    """Per pixel the composites of periods 1 and 2 as <band>_1 and <band>_2, by one aggregation and no join."""
    reduce = {"median": F.median, "mean": F.avg}[reducer]
    return df.groupBy("row", "col").agg(*[reduce(F.when(F.col("period") == p, F.col(b))).alias(f"{b}_{p}") for p in (1, 2) for b in bands])


def ndvi_pair(df: DataFrame) -> DataFrame:
    """row, col, n1, n2."""
    c = F.col
    return pair(df, ["nir", "red"]).select("row", "col", ndvi(c("nir_1"), c("red_1")).alias("n1"), ndvi(c("nir_2"), c("red_2")).alias("n2"))


def classify(x: Column, thresholds: dict[str, float] | None = None) -> Column:
    """3 dense, 2 moderate, 1 sparse, 0 bare, 255 nodata; thresholds are inclusive."""
    t = CLASSES | (thresholds or {})
    return F.when(x.isNull(), NODATA_CLASS).when(x >= t["dense"], 3).when(x >= t["moderate"], 2).when(x >= t["sparse"], 1).otherwise(0)


def difference(pairs: DataFrame, k: float = 1.5) -> DataFrame:
    """``pairs`` with delta, threshold, gain, loss and no_change; the threshold is k population deviations of delta."""
    delta = F.col("n2") - F.col("n1")
    limit = pairs.agg((F.lit(k) * F.stddev_pop(delta)).alias("threshold"))  # one row
    out = pairs.withColumn("delta", delta).crossJoin(F.broadcast(limit))
    gain = F.coalesce(F.col("delta") > F.col("threshold"), F.lit(False))
    loss = F.coalesce(F.col("delta") < -F.col("threshold"), F.lit(False))
    return out.withColumns({"gain": gain, "loss": loss}).withColumn("no_change", F.col("delta").isNotNull() & ~F.col("gain") & ~F.col("loss"))


def _exceeding(df: DataFrame, k: float) -> DataFrame:
    """``df`` with threshold, k population deviations of the magnitude above its mean, and changed."""
    limit = df.agg((F.avg("magnitude") + F.lit(k) * F.stddev_pop("magnitude")).alias("threshold"))
    return df.crossJoin(F.broadcast(limit)).withColumn("changed", F.coalesce(F.col("magnitude") > F.col("threshold"), F.lit(False)))


def change_vectors(df: DataFrame, before: list[str], after: list[str], k: float = 1.5, nodata: str = "zero") -> DataFrame:
    """``df`` with magnitude, threshold, changed, direction and change_type.

    ``nodata`` "zero": an unknown difference counts as 0 and all pixels enter the threshold; "drop": only
    pixels that are known in all features do. Direction and types 1 to 3 exist for two features only.
    """
    if len(before) != len(after):
        raise ValueError("feature lists differ in length")
    if nodata not in ("zero", "drop"):
        raise ValueError(f"unknown nodata mode {nodata!r}")
    deltas = [F.col(b) - F.col(a) for a, b in zip(before, after, strict=True)]
    known = deltas[0].isNotNull()
    for d in deltas[1:]:
        known = known & d.isNotNull()
    total = F.lit(0.0)
    for d in deltas:
        total = total + F.coalesce(d * d, F.lit(0.0))
    out = _exceeding(df.withColumn("magnitude", F.sqrt(total) if nodata == "zero" else F.when(known, F.sqrt(total))), k)
    if len(deltas) != 2:
        return out.withColumns({"direction": F.lit(None).cast("double"), "change_type": F.lit(0)})
    d0, d1 = deltas
    kind = F.when(~F.col("changed"), 0).when((d0 > 0) & (d1 <= 0), 1).when((d0 < 0) & (d1 >= 0), 2).otherwise(3)
    return out.withColumns({"direction": F.degrees(F.atan2(d0, d1)), "change_type": kind})


def array_change_vectors(df: DataFrame, before: str, after: str, k: float = 1.5) -> DataFrame:
    """``df`` with magnitude, threshold, changed and change_type 0, over all elements of two array columns.

    An unknown difference counts as 0, also where an array is missing or the shorter one.
    """
    squares = F.zip_with(before, after, lambda a, b: F.coalesce(F.pow(b.cast("double") - a.cast("double"), 2), F.lit(0.0)))
    total = F.coalesce(F.aggregate(squares, F.lit(0.0), lambda s, x: s + x), F.lit(0.0))
    return _exceeding(df.withColumn("magnitude", F.sqrt(total)), k).withColumn("change_type", F.lit(0))


def transitions(classes: DataFrame, pixel_area: float = 100.0) -> DataFrame:
    """All 16 (c1, c2) with pixel counts and hectares, of pairs that are both known; absent ones are 0."""
    spark = classes.sparkSession
    grid = spark.range(16).select((F.col("id") / 4).cast("int").alias("c1"), (F.col("id") % 4).cast("int").alias("c2"))
    counts = classes.where((F.col("c1") != NODATA_CLASS) & (F.col("c2") != NODATA_CLASS)).groupBy("c1", "c2").agg(F.count(F.lit(1)).alias("n"))
    n = F.coalesce("n", F.lit(0)).cast("long")
    return grid.join(F.broadcast(counts), ["c1", "c2"], "left").select("c1", "c2", n.alias("pixels"), (n * F.lit(pixel_area) / F.lit(10000.0)).alias("area_ha"))


def net_change(matrix: DataFrame) -> DataFrame:
    """Per class the hectares after less those before."""
    sides = matrix.select(F.col("c2").alias("class"), F.col("area_ha").alias("ha")).unionByName(matrix.select(F.col("c1").alias("class"), (-F.col("area_ha")).alias("ha")))
    return sides.groupBy("class").agg(F.sum("ha").alias("net_ha"))


def forest_change(matrix: DataFrame) -> DataFrame:
    """Hectares that became dense, and that were dense and no longer are."""
    dense = 3
    moved = lambda new, old: F.sum(F.when((F.col(new) == dense) & (F.col(old) != dense), F.col("area_ha")).otherwise(0.0))
    return matrix.agg(moved("c2", "c1").alias("forest_gain_ha"), moved("c1", "c2").alias("forest_loss_ha"))


def summary(pairs: DataFrame, pixel_area: float, threshold: float = 0.35, crown_area: float = 25.0, by: list[str] | None = None) -> DataFrame:
    """Headline numbers over pixels known at both dates, for the whole area or by zones; rounding is half to even."""
    valid = pairs.where("n1 IS NOT NULL AND n2 IS NOT NULL")
    over = lambda x: F.count(F.when(F.col(x) > threshold, 1)).cast("double")
    agg = valid.groupBy(*(by or [])).agg(F.count(F.lit(1)).cast("double").alias("n"), over("n1").alias("v1"), over("n2").alias("v2"), F.avg("n1").alias("m1"), F.avg("n2").alias("m2"))
    ha = lambda x: F.col(x) * F.lit(pixel_area) / F.lit(10000.0)
    trees = lambda x: F.bround(F.col(x) * F.lit(pixel_area) / F.lit(crown_area), 0).cast("long")
    change = ha("v2") - ha("v1")
    return agg.select(
        *(by or []), F.bround(ha("n"), 2).alias("total_area_ha"), F.bround(ha("v1"), 2).alias("veg_area_t1_ha"), F.bround(ha("v2"), 2).alias("veg_area_t2_ha"), F.bround(change, 2).alias("veg_change_ha"),
        F.bround(change / (ha("v1") + F.lit(1e-6)) * F.lit(100.0), 1).alias("veg_change_pct"), trees("v1").alias("estimated_trees_t1"), trees("v2").alias("estimated_trees_t2"), (trees("v2") - trees("v1")).alias("estimated_trees_delta"),
        F.bround("m1", 4).alias("mean_ndvi_t1"), F.bround("m2", 4).alias("mean_ndvi_t2"), F.lit(threshold).alias("ndvi_threshold"), F.lit(crown_area).alias("mean_crown_area_m2"),
    )


def report(summary: DataFrame, matrix: DataFrame, vectors: DataFrame, pixel_area: float, **labels: str) -> DataFrame:
    """One row with ``report``, a JSON text of the labels, a summary, change vectors and transitions; hectares to four places."""
    ha = lambda kind: F.bround(F.count(F.when(F.col("change_type") == kind, 1)) * F.lit(pixel_area) / F.lit(10000.0), 4)
    cva = vectors.agg(F.struct(ha(1).alias("gain_ha"), ha(2).alias("loss_ha"), F.bround(F.max("threshold"), 4).alias("threshold_magnitude")).alias("cva"))
    net = net_change(matrix).agg(F.struct(*[F.bround(F.sum(F.when(F.col("class") == k, F.col("net_ha"))), 4).alias(n) for k, n in enumerate(NAMES)]).alias("net_change_ha"))
    forest = forest_change(matrix).select(*[F.bround(c, 4).alias(c) for c in ("forest_gain_ha", "forest_loss_ha")])
    # one row each
    parts = summary.select(F.struct("*").alias("summary")).crossJoin(cva).crossJoin(forest).crossJoin(net)
    pcc = F.struct("forest_gain_ha", "forest_loss_ha", "net_change_ha").alias("pcc")
    return parts.select(F.to_json(F.struct(*[F.lit(v).alias(k) for k, v in labels.items()], "summary", "cva", pcc)).alias("report"))


#: biome, mean crown area and its deviation in square metres: fixed values
BIOMES = [("tropical_wet", 40.0, 20.0), ("tropical_dry", 25.0, 12.0), ("subtropical", 20.0, 10.0), ("temperate", 18.0, 8.0), ("boreal", 12.0, 5.0), ("urban", 15.0, 8.0)]


def tree_counts(areas: DataFrame) -> DataFrame:
    """(biome, canopy_area_m2) with estimate, lower and upper tree counts; an unknown biome is an error."""
    known = areas.sparkSession.createDataFrame(BIOMES, "biome string, mean double, sd double")
    mean = F.when(F.col("mean").isNull(), F.raise_error(F.concat(F.lit("unknown biome "), F.coalesce("biome", F.lit("NULL")))).cast("double")).otherwise(F.col("mean"))
    count = lambda d: F.bround(F.col("canopy_area_m2") / d, 0).cast("long")
    joined = areas.join(F.broadcast(known), "biome", "left").withColumn("mean", mean)
    return joined.select("biome", "canopy_area_m2", count(F.col("mean")).alias("estimate"), count(F.col("mean") + F.lit(1.96) * F.col("sd")).alias("lower"), count(F.greatest(F.col("mean") - F.lit(1.96) * F.col("sd"), F.lit(1.0))).alias("upper"))
