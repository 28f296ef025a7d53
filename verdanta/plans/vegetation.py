"""Queries over the observation tables: indices, masks, composites, change and summaries, each with its SQL."""

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import indices as ix
from ..functions import masks as mk
from ..functions import radiometry as rad
from ..operators import change as ch
from ..sources import imagery as im
from ..sources import raster as ra
from ..sources.shared import shared_dir

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

PIXELS = """pixels AS (
    SELECT l_orderkey AS scene_id, l_partkey AS pix, l_partkey // 50 AS "row", l_partkey % 50 AS col,
           l_tax * 2.5::DOUBLE AS blue, l_discount * 4::DOUBLE AS green, l_extendedprice / 210000::DOUBLE AS red,
           (l_extendedprice / 210000::DOUBLE + l_quantity / 50::DOUBLE) / 2::DOUBLE AS red_edge, l_quantity / 50::DOUBLE AS nir,
           (l_suppkey % 100) / 200::DOUBLE AS swir1, l_linenumber / 14::DOUBLE AS swir2,
           l_orderkey % 12 AS scl, l_orderkey % 256 AS qa_pixel, (l_orderkey * 7) % 100 AS cloud_prob
    FROM lineitem)"""
SCENES = "scenes AS (SELECT o_orderkey AS scene_id, o_orderdate AS acquired, o_totalprice / 5000::DOUBLE AS cloud_cover, o_orderstatus AS sensor FROM orders)"
OBS = f"""{PIXELS}, {SCENES}, obs AS (
    SELECT p.*, s.acquired, s.cloud_cover, s.sensor, CASE WHEN s.acquired < TIMESTAMP '{im.SPLIT}' THEN 1 ELSE 2 END AS period FROM pixels p JOIN scenes s USING (scene_id))"""
CLEAR = "cloud_cover < 50 AND scl NOT IN (0, 1, 3, 8, 9, 10, 11)"


def sd(num: str, den: str) -> str:
    return f"CASE WHEN ({den}) <> 0 THEN ({num}) / ({den}) END"


PAIR = f"""{OBS}, comp AS (
    SELECT "row", col, median(nir) FILTER (WHERE period = 1) AS nir1, median(red) FILTER (WHERE period = 1) AS red1,
           median(nir) FILTER (WHERE period = 2) AS nir2, median(red) FILTER (WHERE period = 2) AS red2
    FROM obs WHERE {CLEAR} GROUP BY "row", col),
    pair AS (SELECT "row", col, {sd("nir1 - red1", "nir1 + red1")} AS n1, {sd("nir2 - red2", "nir2 + red2")} AS n2 FROM comp)"""


def r6(x: str) -> str:
    """Rounded, and never the negative zero that DuckDB's round can give."""
    return f"CASE WHEN abs({x}) < 5e-7::DOUBLE THEN 0::DOUBLE ELSE round({x}, 6) END"


def class_sql(x: str) -> str:
    return f"CASE WHEN {x} IS NULL THEN 255 WHEN {x} >= 0.45::DOUBLE THEN 3 WHEN {x} >= 0.25::DOUBLE THEN 2 WHEN {x} >= 0.1::DOUBLE THEN 1 ELSE 0 END"


CLASSES = f"{PAIR}, classes AS (SELECT \"row\", col, {class_sql('n1')} AS c1, {class_sql('n2')} AS c2 FROM pair)"
MATRIX = f"""{CLASSES}, matrix AS (
    SELECT a.c AS c1, b.c AS c2, count(k.c1)::BIGINT AS pixels, count(k.c1) * 100::DOUBLE / 10000::DOUBLE AS area_ha
    FROM (SELECT unnest(range(4))::INT AS c) a CROSS JOIN (SELECT unnest(range(4))::INT AS c) b LEFT JOIN classes k ON k.c1 = a.c AND k.c2 = b.c GROUP BY 1, 2)"""


def register(name: str, query: Query, sql: str | None = None) -> None:
    QUERIES[name] = query
    if sql:
        ORACLES[name] = sql


def clear_observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return im.collection(im.observations(spark, sf_dir), max_cloud=50).where(mk.scl_valid(F.col("scl")))


def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ch.ndvi_pair(clear_observations(spark, sf_dir))


def classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pairs(spark, sf_dir).select("row", "col", ch.classify(F.col("n1")).alias("c1"), ch.classify(F.col("n2")).alias("c2"))


# indices: one value per observation
NDVI = sd("nir - red", "nir + red")
CLIPPED = f"least(greatest({NDVI}, 0::DOUBLE), 1::DOUBLE)"
INDICES: dict[str, tuple[Callable[[], Column], str]] = {
    "ndvi": (lambda: ix.ndvi(F.col("nir"), F.col("red")), NDVI),
    "evi": (lambda: ix.evi(F.col("nir"), F.col("red"), F.col("blue")), f"2.5::DOUBLE * ({sd('nir - red', 'nir + 6::DOUBLE * red - 7.5::DOUBLE * blue + 1::DOUBLE')})"),
    "evi2": (lambda: ix.evi2(F.col("nir"), F.col("red")), f"2.5::DOUBLE * ({sd('nir - red', 'nir + 2.4::DOUBLE * red + 1::DOUBLE')})"),
    "ndre": (lambda: ix.ndre(F.col("nir"), F.col("red_edge")), sd("nir - red_edge", "nir + red_edge")),
    "savi": (lambda: ix.savi(F.col("nir"), F.col("red")), f"({sd('nir - red', 'nir + red + 0.5::DOUBLE')}) * 1.5::DOUBLE"),
    "msavi2": (lambda: ix.msavi2(F.col("nir"), F.col("red")), "((2::DOUBLE * nir + 1::DOUBLE) - sqrt(greatest((2::DOUBLE * nir + 1::DOUBLE) * (2::DOUBLE * nir + 1::DOUBLE) - 8::DOUBLE * (nir - red), 0::DOUBLE))) / 2::DOUBLE"),
    "ndwi": (lambda: ix.ndwi(F.col("green"), F.col("nir")), sd("green - nir", "green + nir")),
    "mndwi": (lambda: ix.mndwi(F.col("green"), F.col("swir1")), sd("green - swir1", "green + swir1")),
    "nbr": (lambda: ix.nbr(F.col("nir"), F.col("swir2")), sd("nir - swir2", "nir + swir2")),
    "lai_baret": (lambda: ix.lai(ix.ndvi(F.col("nir"), F.col("red"))), f"CASE WHEN ({NDVI}) IS NOT NULL THEN greatest(-ln(greatest((0.69::DOUBLE - {CLIPPED}) / 0.59::DOUBLE, 1e-6::DOUBLE)) / 0.91::DOUBLE, 0::DOUBLE) END"),
    "lai_chen": (lambda: ix.lai(ix.ndvi(F.col("nir"), F.col("red")), "chen1996"), f"CASE WHEN ({NDVI}) IS NOT NULL THEN greatest(4.9::DOUBLE * {CLIPPED} - 0.46::DOUBLE, 0::DOUBLE) END"),
}


def index_query(name: str) -> Query:
    return lambda spark, d: im.pixels(spark, d).select("scene_id", "pix", F.round(INDICES[name][0](), 6).alias(name))


for _name, (_, _sql) in INDICES.items():
    register(f"idx_{_name}", index_query(_name), f"WITH {PIXELS} SELECT scene_id, pix, {r6(_sql)} AS {_name} FROM pixels")

ALL = {"ndvi": "ndvi", "evi": "evi", "evi2": "evi2", "ndre": "ndre", "savi": "savi", "msavi2": "msavi2", "ndwi": "ndwi", "mndwi": "mndwi", "nbr": "nbr", "lai": "lai_baret"}
register(
    "idx_all",
    lambda spark, d: ix.with_indices(im.pixels(spark, d)).groupBy("pix").agg(*[F.round(F.avg(n), 6).alias(n) for n in ALL]),
    f"WITH {PIXELS} SELECT pix, {', '.join(f'round(avg({INDICES[k][1]}), 6) AS {n}' for n, k in ALL.items())} FROM pixels GROUP BY pix",
)

# masks
MASKS: dict[str, tuple[Callable[[], Column], str]] = {
    "scl": (lambda: mk.scl_valid(F.col("scl")), "scl NOT IN (0, 1, 3, 8, 9, 10, 11)"),
    "qa": (lambda: mk.qa_valid(F.col("qa_pixel")), "(qa_pixel & 64) <> 0 AND (qa_pixel & 63) = 0"),
    "qa_gee": (lambda: mk.qa_collection_valid(F.col("qa_pixel")), "(qa_pixel & 24) = 0"),
    "cloudprob": (lambda: mk.cloud_probability_valid(F.col("cloud_prob")), "cloud_prob < 35"),
    "bright": (lambda: mk.bright_valid(F.col("blue")), "blue < 0.25::DOUBLE"),
}


def mask_query(name: str) -> Query:
    return lambda spark, d: im.pixels(spark, d).where(MASKS[name][0]()).groupBy("scene_id").agg(F.count(F.lit(1)).alias("valid_pixels"), F.round(F.avg("nir"), 6).alias("mean_nir"))


for _name, (_, _sql) in MASKS.items():
    register(f"mask_{_name}", mask_query(_name), f"WITH {PIXELS} SELECT scene_id, count(*)::BIGINT AS valid_pixels, round(avg(nir), 6) AS mean_nir FROM pixels WHERE {_sql} GROUP BY scene_id")

register(
    "cloud_fraction",
    lambda spark, d: im.pixels(spark, d).groupBy("pix").agg(*[F.round(mk.cloud_fraction(m()), 6).alias(n) for n, (m, _) in MASKS.items()]),
    f"WITH {PIXELS} SELECT pix, {', '.join(f'round(avg(CASE WHEN {s} THEN 0::DOUBLE ELSE 1::DOUBLE END), 6) AS {n}' for n, (_, s) in MASKS.items())} FROM pixels GROUP BY pix",
)
register(
    "apply_mask",
    lambda spark, d: mk.apply_mask(im.pixels(spark, d), mk.scl_valid(F.col("scl")), im.BANDS).groupBy("pix").agg(*[F.count(b).alias(b) for b in im.BANDS]),
    f"WITH {PIXELS} SELECT pix, {', '.join(f'(count({b}) FILTER (WHERE {MASKS["scl"][1]}))::BIGINT AS {b}' for b in im.BANDS)} FROM pixels GROUP BY pix",
)

# radiometry
register(
    "scale_s2",
    lambda spark, d: rad.scale_sentinel2(im.pixels(spark, d).select("scene_id", "pix", (F.col("nir") * 10000.0).alias("nir"), (F.col("red") * 10000.0).alias("red")), ["nir", "red"]).withColumns({b: F.round(b, 6) for b in ("nir", "red")}),
    f"WITH {PIXELS} SELECT scene_id, pix, round(nir * 10000::DOUBLE / 10000::DOUBLE, 6) AS nir, round(red * 10000::DOUBLE / 10000::DOUBLE, 6) AS red FROM pixels",
)
register(
    "scale_landsat",
    lambda spark, d: rad.scale_landsat(im.pixels(spark, d).select("scene_id", "pix", (F.col("nir") * 40000.0).alias("SR_B5"), (F.col("swir2") * 50000.0).alias("ST_B10"))).withColumns({b: F.round(b, 6) for b in ("SR_B5", "ST_B10")}),
    f"WITH {PIXELS} SELECT scene_id, pix, round(nir * 40000::DOUBLE * 0.0000275::DOUBLE + -0.2::DOUBLE, 6) AS SR_B5, round(swir2 * 50000::DOUBLE * 0.00341802::DOUBLE + 149::DOUBLE, 6) AS ST_B10 FROM pixels",
)
register(
    "select_regex",
    lambda spark, d: (lambda got: got.groupBy("pix").agg(*[F.sum(F.col(b).cast("decimal(38,12)")).cast("decimal(38,9)").cast("double").alias(b) for b in got.columns if b != "pix"]))(im.select_bands(im.pixels(spark, d), r"(n|r)\w*", "pix")),
    f'WITH {PIXELS} SELECT pix, {", ".join(f"sum({b}::DECIMAL(38,12))::DECIMAL(38,9)::DOUBLE AS {b}" for b in ("red", "red_edge", "nir"))}, sum("row"::DECIMAL(38,12))::DECIMAL(38,9)::DOUBLE AS "row" FROM pixels GROUP BY 1',
)
register(
    "scale_dn",
    lambda spark, d: im.pixels(spark, d).select("scene_id", "pix", F.round(rad.dn_to_reflectance(F.col("nir") * 12000.0, 1.1, -50.0), 6).alias("reflectance")),
    f"WITH {PIXELS} SELECT scene_id, pix, round(least(greatest((nir * 12000::DOUBLE * 1.1::DOUBLE + -50::DOUBLE) / 10000::DOUBLE, 0::DOUBLE), 1::DOUBLE), 6) AS reflectance FROM pixels",
)


# composites and collections
def composite_query(reducer: str) -> Query:
    return lambda spark, d: ch.composite(clear_observations(spark, d), im.BANDS, ["row", "col", "period"], reducer).withColumns({b: F.round(b, 9) for b in im.BANDS})


for _name, _sql in (("median", "median"), ("mean", "avg")):
    register(f"composite_{_name}", composite_query(_name), f'WITH {OBS} SELECT "row", col, period, {", ".join(f"round({_sql}({b}), 9) AS {b}" for b in im.BANDS)} FROM obs WHERE {CLEAR} GROUP BY "row", col, period')

BOX = (5, 2, 40, 30)
register(
    "collection_s2",
    lambda spark, d: im.collection(im.observations(spark, d), BOX, "1996-01-01", "1997-12-31", 30).where(mk.cloud_probability_valid(F.col("cloud_prob"))).groupBy("row", "col").agg(F.count(F.lit(1)).alias("n"), F.round(F.median("nir"), 6).alias("nir")),
    f"WITH {OBS} SELECT \"row\", col, count(*)::BIGINT AS n, round(median(nir), 6) AS nir FROM obs WHERE col BETWEEN 5 AND 40 AND \"row\" BETWEEN 2 AND 30 AND acquired >= TIMESTAMP '1996-01-01' AND acquired < TIMESTAMP '1997-12-31' AND cloud_cover < 30 AND cloud_prob < 35 GROUP BY \"row\", col",
)
register(
    "collection_landsat",
    lambda spark, d: im.collection(im.observations(spark, d), BOX, "1996-01-01", "1997-12-31", 20, sensor="F").where(mk.qa_collection_valid(F.col("qa_pixel"))).groupBy("row", "col").agg(F.count(F.lit(1)).alias("n"), F.round(F.median("nir"), 6).alias("nir")),
    f"WITH {OBS} SELECT \"row\", col, count(*)::BIGINT AS n, round(median(nir), 6) AS nir FROM obs WHERE col BETWEEN 5 AND 40 AND \"row\" BETWEEN 2 AND 30 AND acquired >= TIMESTAMP '1996-01-01' AND acquired < TIMESTAMP '1997-12-31' AND cloud_cover < 20 AND sensor = 'F' AND (qa_pixel & 24) = 0 GROUP BY \"row\", col",
)


def cloud_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A secondary collection with several scenes for one of the primary's."""
    return im.scenes(spark, sf_dir).select(F.expr("scene_id div 2").alias("scene_id"), F.col("scene_id").alias("nr"), "acquired", F.col("cloud_cover").alias("score"))


register(
    "join_savefirst",
    lambda spark, d: im.save_first(im.pixels(spark, d).select("scene_id", "pix"), cloud_scores(spark, d), ["scene_id"], ["acquired", "nr"]).groupBy("scene_id").agg(F.count(F.lit(1)).alias("pixels"), F.min("nr").alias("nr"), F.min("score").alias("score")),
    f"""WITH {PIXELS}, {SCENES}, f AS (SELECT scene_id // 2 AS scene_id, scene_id AS nr, cloud_cover AS score, row_number() OVER (PARTITION BY scene_id // 2 ORDER BY acquired, scene_id) AS k FROM scenes)
    SELECT scene_id, count(*)::BIGINT AS pixels, min(nr) AS nr, min(score) AS score FROM pixels JOIN f USING (scene_id) WHERE k = 1 GROUP BY 1""",
)
register("scene_topk", lambda spark, d: im.clearest_scenes(im.scenes(spark, d), 5), f"WITH {SCENES} SELECT * FROM scenes ORDER BY coalesce(cloud_cover, 100), scene_id LIMIT 5")
register(
    "scene_search",
    lambda spark, d: im.collection(im.scenes(spark, d), start="1995-06-01", end="1996-06-01", max_cloud=20, inclusive=True, sensor="O"),
    f"WITH {SCENES} SELECT * FROM scenes WHERE acquired >= TIMESTAMP '1995-06-01' AND acquired < TIMESTAMP '1996-06-01' AND cloud_cover <= 20 AND sensor = 'O'",
)
register(
    "band_stack",
    lambda spark, d: im.band_stack(im.pixels(spark, d).groupBy("pix").agg(*[F.round(F.avg(b), 6).alias(b) for b in im.BANDS]).select("pix", F.explode(F.create_map(*[x for b in im.BANDS for x in (F.lit(b), F.col(b))])).alias("band", "v")), ["green", "nir", "red"], ["pix"]),
    f"WITH {PIXELS} SELECT pix, round(avg(green), 6) AS green, round(avg(nir), 6) AS nir, round(avg(red), 6) AS red FROM pixels GROUP BY pix",
)

# change
_LIMIT = ", lim AS (SELECT 1.5::DOUBLE * stddev_pop(n2 - n1) AS t FROM pair)"
register(
    "pair_difference",
    lambda spark, d: ch.difference(pairs(spark, d)).select("row", "col", F.round("delta", 6).alias("delta"), "gain", "loss", "no_change"),
    f'WITH {PAIR}{_LIMIT} SELECT "row", col, {r6("n2 - n1")} AS delta, coalesce(n2 - n1 > t, false) AS gain, coalesce(n2 - n1 < -t, false) AS loss, n2 - n1 IS NOT NULL AND NOT (n2 - n1 > t) AND NOT (n2 - n1 < -t) AS no_change FROM pair CROSS JOIN lim',
)
register(
    "gain_loss_area",
    lambda spark, d: ch.difference(pairs(spark, d)).agg(*[F.round(F.count(F.when(F.col(n), 1)) * 100.0 / 10000.0, 6).alias(f"{n}_ha") for n in ("gain", "loss", "no_change")]),
    f"WITH {PAIR}{_LIMIT} SELECT round(count(*) FILTER (WHERE n2 - n1 > t) / 100::DOUBLE, 6) AS gain_ha, round(count(*) FILTER (WHERE n2 - n1 < -t) / 100::DOUBLE, 6) AS loss_ha, round(count(*) FILTER (WHERE n2 - n1 <= t AND n2 - n1 >= -t) / 100::DOUBLE, 6) AS no_change_ha FROM pair CROSS JOIN lim",
)


def feature_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = ch.pair(clear_observations(spark, sf_dir), ["nir", "red", "swir1"])
    c = F.col
    return p.select("row", "col", *[ix.ndvi(c(f"nir_{k}"), c(f"red_{k}")).alias(f"n{k}") for k in (1, 2)], *[c(f"swir1_{k}").alias(f"s{k}") for k in (1, 2)])


_CVA = f"""WITH {OBS}, f AS (SELECT "row", col, {', '.join(f'median({b}) FILTER (WHERE period = {k}) AS {b}{k}' for k in (1, 2) for b in ('nir', 'red', 'swir1'))} FROM obs WHERE {CLEAR} GROUP BY "row", col),
    dd AS (SELECT "row", col, ({sd('nir2 - red2', 'nir2 + red2')}) - ({sd('nir1 - red1', 'nir1 + red1')}) AS d0, swir12 - swir11 AS d1 FROM f),
    m AS (SELECT *, sqrt(0::DOUBLE + coalesce(d0 * d0, 0::DOUBLE) + coalesce(d1 * d1, 0::DOUBLE)) AS mag FROM dd), lim AS (SELECT avg(mag) + 1.5::DOUBLE * stddev_pop(mag) AS t FROM m)"""
register(
    "cva_2d",
    lambda spark, d: ch.change_vectors(feature_pairs(spark, d), ["n1", "s1"], ["n2", "s2"]).select("row", "col", F.round("magnitude", 6).alias("magnitude"), "changed", F.round("direction", 6).alias("direction"), "change_type"),
    f'{_CVA} SELECT "row", col, round(mag, 6) AS magnitude, mag > t AS changed, round(degrees(atan2(d0, d1)), 6) AS direction, CASE WHEN NOT mag > t THEN 0 WHEN d0 > 0 AND d1 <= 0 THEN 1 WHEN d0 < 0 AND d1 >= 0 THEN 2 ELSE 3 END AS change_type FROM m CROSS JOIN lim',
)


def embedding_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Feature vectors of odd ids beside those of the even ids before them."""
    e = im.table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    side = lambda k: F.first(F.when(F.col("vec_id") % 2 == k, F.col("embedding")), ignorenulls=True)
    return e.groupBy(F.expr("vec_id div 2").alias("pair")).agg(side(0).alias("a"), side(1).alias("b"))


register(
    "cva_nd",
    lambda spark, d: ch.array_change_vectors(embedding_pairs(spark, d), "a", "b").select("pair", F.round("magnitude", 6).alias("magnitude"), "changed", "change_type"),
    f"""WITH e AS (SELECT vec_id // 2 AS pair, any_value(embedding) FILTER (WHERE vec_id % 2 = 0) AS a, any_value(embedding) FILTER (WHERE vec_id % 2 = 1) AS b FROM embeddings GROUP BY 1),
    m AS (SELECT pair, sqrt(coalesce(list_sum(list_transform(list_zip(a, b), lambda z: coalesce((z[2]::DOUBLE - z[1]::DOUBLE) * (z[2]::DOUBLE - z[1]::DOUBLE), 0::DOUBLE))), 0::DOUBLE)) AS mag FROM e), lim AS (SELECT avg(mag) + 1.5::DOUBLE * stddev_pop(mag) AS t FROM m)
    SELECT pair, round(mag, 6) AS magnitude, mag > t AS changed, 0 AS change_type FROM m CROSS JOIN lim""",
)
register("classify", classes, f'WITH {CLASSES} SELECT "row", col, c1, c2 FROM classes')
register("pcc_matrix", lambda spark, d: ch.transitions(classes(spark, d)), f"WITH {MATRIX} SELECT * FROM matrix")
register(
    "pcc_net",
    lambda spark, d: ch.net_change(ch.transitions(classes(spark, d))).select("class", F.round("net_ha", 6).alias("net_ha")),
    f"WITH {MATRIX} SELECT c AS class, round(sum(ha), 6) AS net_ha FROM (SELECT c2 AS c, area_ha AS ha FROM matrix UNION ALL SELECT c1, -area_ha FROM matrix) GROUP BY 1",
)
register(
    "pcc_forest",
    lambda spark, d: ch.forest_change(ch.transitions(classes(spark, d))).select(*[F.round(c, 6).alias(c) for c in ("forest_gain_ha", "forest_loss_ha")]),
    f"WITH {MATRIX} SELECT round(sum(area_ha) FILTER (WHERE c2 = 3 AND c1 <> 3), 6) AS forest_gain_ha, round(sum(area_ha) FILTER (WHERE c1 = 3 AND c2 <> 3), 6) AS forest_loss_ha FROM matrix",
)


def summary_sql(by: str = "", join: str = "") -> str:
    head = f"{by}, " if by else ""
    ha = lambda x: f"{x} * 100::DOUBLE / 10000::DOUBLE"
    trees = lambda x: f"round_even({x} * 100::DOUBLE / 25::DOUBLE, 0)::BIGINT"
    return f"""WITH {PAIR}, a AS (SELECT {head}count(*)::DOUBLE AS n, (count(*) FILTER (WHERE n1 > 0.35::DOUBLE))::DOUBLE AS v1, (count(*) FILTER (WHERE n2 > 0.35::DOUBLE))::DOUBLE AS v2, avg(n1) AS m1, avg(n2) AS m2
        FROM pair {join} WHERE n1 IS NOT NULL AND n2 IS NOT NULL {"GROUP BY " + by if by else ""})
    SELECT {head}round_even({ha('n')}, 2) AS total_area_ha, round_even({ha('v1')}, 2) AS veg_area_t1_ha, round_even({ha('v2')}, 2) AS veg_area_t2_ha, round_even({ha('v2')} - {ha('v1')}, 2) AS veg_change_ha,
        round_even(({ha('v2')} - {ha('v1')}) / ({ha('v1')} + 1e-6::DOUBLE) * 100::DOUBLE, 1) AS veg_change_pct, {trees('v1')} AS estimated_trees_t1, {trees('v2')} AS estimated_trees_t2, {trees('v2')} - {trees('v1')} AS estimated_trees_delta,
        round_even(m1, 4) AS mean_ndvi_t1, round_even(m2, 4) AS mean_ndvi_t2, 0.35::DOUBLE AS ndvi_threshold, 25::DOUBLE AS mean_crown_area_m2 FROM a"""


def zoned(spark: SparkSession, sf_dir: str) -> DataFrame:
    zones = im.table(spark, sf_dir, "part").select(F.expr("p_partkey div 50").alias("row"), (F.col("p_partkey") % 50).alias("col"), F.col("p_brand").alias("zone"))
    return pairs(spark, sf_dir).join(zones, ["row", "col"])


register("summary", lambda spark, d: ch.summary(pairs(spark, d), 100.0), summary_sql())
register("zonal_summary", lambda spark, d: ch.summary(zoned(spark, d), 100.0, by=["zone"]), summary_sql("zone", 'JOIN (SELECT p_partkey // 50 AS "row", p_partkey % 50 AS col, p_brand AS zone FROM part) USING ("row", col)'))


def canopy_areas(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = F.array(*[F.lit(b[0]) for b in ch.BIOMES])
    return im.table(spark, sf_dir, "part").groupBy(F.element_at(names, (F.col("p_partkey") % 6 + 1).cast("int")).alias("biome")).agg((F.count(F.lit(1)) * 137.0).alias("canopy_area_m2"))


register(
    "allometry",
    lambda spark, d: ch.tree_counts(canopy_areas(spark, d)),
    f"""WITH b(i, biome, m, s) AS (VALUES {', '.join(f"({i}, '{n}', {m}::DOUBLE, {s}::DOUBLE)" for i, (n, m, s) in enumerate(ch.BIOMES))}), a AS (SELECT p_partkey % 6 AS i, count(*) * 137::DOUBLE AS area FROM part GROUP BY 1)
    SELECT biome, area AS canopy_area_m2, round_even(area / m, 0)::BIGINT AS estimate, round_even(area / (m + 1.96::DOUBLE * s), 0)::BIGINT AS lower, round_even(area / greatest(m - 1.96::DOUBLE * s, 1::DOUBLE), 0)::BIGINT AS upper FROM a JOIN b USING (i)""",
)
register(
    "rgba_change",
    lambda spark, d: ch.difference(pairs(spark, d)).select("row", "col", rad.change_rgba(F.col("gain"), F.col("loss")).alias("x")).select("row", "col", "x.*"),
    f'WITH {PAIR}{_LIMIT}, g AS (SELECT "row", col, coalesce(n2 - n1 > t, false) AS gain, coalesce(n2 - n1 < -t, false) AS loss FROM pair CROSS JOIN lim) SELECT "row", col, CASE WHEN loss THEN 220 ELSE 0 END AS r, CASE WHEN gain AND NOT loss THEN 200 ELSE 0 END AS g, 0 AS b, CASE WHEN loss OR gain THEN 165 ELSE 0 END AS a FROM g',
)


# the public colour map again, written out for SQL
RDYLGN = "[165, 215, 244, 253, 254, 255, 217, 166, 102, 26, 0] AS red, [0, 48, 109, 174, 224, 255, 239, 217, 189, 152, 104] AS green, [38, 39, 67, 97, 139, 191, 139, 106, 99, 80, 55] AS blue"
_MIXED = lambda c: f"coalesce(floor({c}[k + 1] + (place - k) * ({c}[k + 2] - {c}[k + 1]) + 1e-9::DOUBLE)::INT, 0)"
register(
    "rgba_ndvi",
    lambda spark, d: pairs(spark, d).select("row", "col", rad.ndvi_rgba(F.col("n2")).alias("x")).select("row", "col", "x.*"),
    f"""WITH {PAIR}, v AS (SELECT "row", col, CASE WHEN n2 IS NOT NULL THEN least(greatest((n2 - 0::DOUBLE) / 0.9::DOUBLE, 0::DOUBLE), 1::DOUBLE) END AS t FROM pair),
    u AS (SELECT "row", col, t, least(floor(t * 256), 255) * 10::DOUBLE / 255::DOUBLE AS place, {RDYLGN} FROM v), w AS (SELECT *, least(floor(place), 9)::INT AS k FROM u)
    SELECT "row", col, {_MIXED("red")} AS r, {_MIXED("green")} AS g, {_MIXED("blue")} AS b, CASE WHEN t IS NULL THEN 0 ELSE 255 END AS a FROM w""",
)


def full_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    matrix, vectors = ch.transitions(classes(spark, sf_dir)), ch.change_vectors(feature_pairs(spark, sf_dir), ["n1", "s1"], ["n2", "s2"])
    return ch.report(ch.summary(pairs(spark, sf_dir), 100.0), matrix, vectors, 100.0, aoi="site", source="sentinel2")


register(
    "report_full",
    full_report,
    f"""WITH s AS ({summary_sql()}), mx AS (WITH {MATRIX} SELECT * FROM matrix), v AS ({_CVA} SELECT mag > t AS changed, d0, d1, t FROM m CROSS JOIN lim),
    n AS (SELECT c AS class, sum(ha) AS ha FROM (SELECT c2 AS c, area_ha AS ha FROM mx UNION ALL SELECT c1, -area_ha FROM mx) GROUP BY 1),
    net AS (SELECT round_even(sum(ha) FILTER (WHERE class = 0), 4) AS bare, round_even(sum(ha) FILTER (WHERE class = 1), 4) AS sparse, round_even(sum(ha) FILTER (WHERE class = 2), 4) AS moderate, round_even(sum(ha) FILTER (WHERE class = 3), 4) AS dense FROM n),
    p AS (SELECT round_even(sum(area_ha) FILTER (WHERE c2 = 3 AND c1 <> 3), 4) AS gain, round_even(sum(area_ha) FILTER (WHERE c1 = 3 AND c2 <> 3), 4) AS loss FROM mx),
    c AS (SELECT round_even(count(*) FILTER (WHERE changed AND d0 > 0 AND d1 <= 0) * 100::DOUBLE / 10000::DOUBLE, 4) AS gain, round_even(count(*) FILTER (WHERE changed AND d0 < 0 AND d1 >= 0) * 100::DOUBLE / 10000::DOUBLE, 4) AS loss, round_even(max(t), 4) AS t FROM v)
    SELECT to_json({{'aoi': 'site', 'source': 'sentinel2', 'summary': s, 'cva': {{'gain_ha': c.gain, 'loss_ha': c.loss, 'threshold_magnitude': c.t}},
        'pcc': {{'forest_gain_ha': p.gain, 'forest_loss_ha': p.loss, 'net_change_ha': {{'bare': net.bare, 'sparse': net.sparse, 'moderate': net.moderate, 'dense': net.dense}}}}}})::VARCHAR AS report FROM s, c, p, net""",
)
register(
    "report_json",
    lambda spark, d: ch.forest_change(ch.transitions(classes(spark, d))).select(F.to_json(F.struct(F.lit("site").alias("aoi"), F.bround("forest_gain_ha", 2).alias("forest_gain_ha"), F.bround("forest_loss_ha", 2).alias("forest_loss_ha"))).alias("report")),
    f"WITH {MATRIX} SELECT '{{\"aoi\":\"site\",\"forest_gain_ha\":' || round_even(sum(area_ha) FILTER (WHERE c2 = 3 AND c1 <> 3), 2)::DOUBLE || ',\"forest_loss_ha\":' || round_even(sum(area_ha) FILTER (WHERE c1 = 3 AND c2 <> 3), 2)::DOUBLE || '}}' AS report FROM matrix",
)


def hansen(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = im.table(spark, sf_dir, "part")
    return im.hansen_layers(p.select(F.col("p_partkey").alias("pix"), (F.col("p_partkey") % 101).alias("treecover2000"), (F.col("p_size") % 2).alias("loss"), (F.col("p_partkey") % 23).alias("lossyear"), (F.col("p_size") % 3).alias("gain"), "p_brand"), ["pix"])


register(
    "hansen_area",
    lambda spark, d: hansen(spark, d).agg(F.sum((F.col("treecover2000") >= 30).cast("long")).alias("forest_pixels"), F.sum("loss").cast("long").alias("loss_pixels"), F.round(F.sum(F.col("gain") * 900.0) / 10000.0, 6).alias("gain_ha")),
    "SELECT count(*) FILTER (WHERE p_partkey % 101 >= 30)::BIGINT AS forest_pixels, sum(p_size % 2)::BIGINT AS loss_pixels, round(sum((p_size % 3) * 900::DOUBLE) / 10000::DOUBLE, 6) AS gain_ha FROM part",
)
register(
    "hansen_loss_by_year",
    lambda spark, d: im.loss_by_year(hansen(spark, d), 900.0).select("year", F.round("loss_ha", 6).alias("loss_ha")),
    "SELECT p_partkey % 23 + 2000 AS year, round(count(*) * 900::DOUBLE / 10000::DOUBLE, 6) AS loss_ha FROM part WHERE p_size % 2 = 1 AND p_partkey % 101 >= 30 GROUP BY 1",
)


def dated_scenes(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = F.array(*[F.lit(n) for n in ("landsat_ot_c2_l2", "landsat_etm_c2_l2", "landsat_tm_c2_l2")])
    return im.scenes(spark, sf_dir).withColumn("dataset", F.get(names, (F.col("scene_id") % 3).cast("int")))


register(
    "search_landsat",
    lambda spark, d: im.search_landsat(dated_scenes(spark, d), "L9", start="1995-06-01", end="1997-06-01", max_cloud=25.0),
    f"WITH {SCENES} SELECT *, 'landsat_ot_c2_l2' AS dataset FROM scenes WHERE scene_id % 3 = 0 AND acquired >= TIMESTAMP '1995-06-01' AND acquired < TIMESTAMP '1997-06-01' AND cloud_cover <= 25 ORDER BY acquired, scene_id LIMIT 20",
)
register(
    "segment_ndvi",
    lambda spark, d: im.pixels(spark, d).select("scene_id", "pix", F.round(mk.ndvi_or_zero(F.col("nir") - 0.3, F.col("red") - 0.3), 6).alias("ndvi")),
    f"WITH {PIXELS} SELECT scene_id, pix, CASE WHEN nir - 0.3::DOUBLE + (red - 0.3::DOUBLE) > 0 THEN {r6('((nir - 0.3::DOUBLE) - (red - 0.3::DOUBLE)) / ((nir - 0.3::DOUBLE) + (red - 0.3::DOUBLE) + 1e-9::DOUBLE)')} ELSE 0::DOUBLE END AS ndvi FROM pixels",
)


def sunk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Composites written by scene and tile and read back with two of their bands."""
    made = im.observations(spark, sf_dir).groupBy(F.col("period").cast("long").alias("scene_id"), "row", "col").agg(*[F.avg(b).alias(b) for b in ("green", "nir", "red")])
    path = shared_dir(spark)
    im.write_pixels(made.withColumn("red", F.when(F.col("row") % 7 == 0, F.lit(-9999.0)).otherwise(F.col("red"))), path, 64, -9999.0)
    return im.read_pixels(spark, path, ["green", "nir", "red"], [2, 3]).groupBy("scene_id").agg(F.count(F.lit(1)).alias("pixels"), F.count("red").alias("known"), F.round(F.avg("nir"), 6).alias("nir"), F.round(F.avg("red"), 6).alias("red"))


register(
    "pixel_sink",
    sunk,
    f"""WITH {OBS}, k AS (SELECT period::BIGINT AS scene_id, "row", col, avg(nir) AS nir, avg(red) AS red FROM obs GROUP BY 1, 2, 3)
    SELECT scene_id, count(*)::BIGINT AS pixels, count(*) FILTER (WHERE "row" % 7 <> 0)::BIGINT AS known, round(avg(nir), 6) AS nir, round(avg(red) FILTER (WHERE "row" % 7 <> 0), 6) AS red FROM k GROUP BY 1""",
)
def raster_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Composites of both periods written as raster files of 64 x 64 pixels, and all their pixels read back from two of three bands."""
    made = im.observations(spark, sf_dir).groupBy(F.col("period").alias("scene_id"), "row", "col").agg(*[F.avg(b).alias(b) for b in ("green", "nir", "red")])
    made = made.withColumn("red", F.when(F.col("row") % 7 == 0, F.lit(-9999.0)).otherwise(F.col("red")))
    size = im.pixels(spark, sf_dir).agg(F.max("row").alias("h"), F.max("col").alias("w")).first()
    path = shared_dir(spark)
    ra.write_rasters(made, path, ["green", "nir", "red"], (size["h"] or 0) + 1, (size["w"] or 0) + 1, nodata=-9999.0, dtype="float64", block=64)
    back = ra.read_rasters(spark, path, [2, 3]).where("b2 IS NOT NULL OR b3 IS NOT NULL")
    return back.select("scene", "row", "col", F.round("b2", 6).alias("nir"), F.round("b3", 6).alias("red"))


register(
    "raster_files",
    raster_files,
    f"""WITH {OBS} SELECT period::VARCHAR AS scene, "row", col, round(avg(nir), 6) AS nir, CASE WHEN "row" % 7 <> 0 THEN round(avg(red), 6) END AS red FROM obs GROUP BY 1, 2, 3""",
)


def raster_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A window of one band of the maximum-value picture, read from its raster files without the chunks beside it."""
    made = im.pixels(spark, sf_dir).groupBy(F.lit(1).alias("scene_id"), "row", "col").agg(F.max("nir").alias("nir"), F.max("swir1").alias("swir1"))
    size = im.pixels(spark, sf_dir).agg(F.max("row").alias("h")).first()
    path = shared_dir(spark)
    ra.write_rasters(made, path, ["nir", "swir1"], (size["h"] or 0) + 1, 50, dtype="float64", block=16)
    return ra.read_rasters(spark, path, [2], rows=(1, 30), cols=(10, 40)).where("b2 IS NOT NULL").select("row", "col", F.round("b2", 6).alias("swir1"))


register(
    "raster_window",
    raster_window,
    f'WITH {PIXELS} SELECT "row", col, round(max(swir1), 6) AS swir1 FROM pixels WHERE "row" BETWEEN 1 AND 29 AND col BETWEEN 10 AND 39 GROUP BY 1, 2',
)
register(
    "gedi_stats",
    lambda spark, d: im.pixels(spark, d).select("pix", (F.col("nir") * 40.0 - 5.0).alias("rh98")).where("rh98 > 0").groupBy("pix").agg(F.avg("rh98").alias("height")).agg(F.round(F.avg("height"), 6).alias("mean_height"), F.round(F.stddev_pop("height"), 6).alias("std_height"), F.count(F.lit(1)).alias("pixels")),
    f"WITH {PIXELS}, h AS (SELECT pix, avg(nir * 40::DOUBLE - 5::DOUBLE) AS height FROM pixels WHERE nir * 40::DOUBLE - 5::DOUBLE > 0 GROUP BY 1) SELECT round(avg(height), 6) AS mean_height, round(stddev_pop(height), 6) AS std_height, count(*)::BIGINT AS pixels FROM h",
)
