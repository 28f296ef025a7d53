"""Masks that a segmenter finds in tiles, kept as runs of pixels along rows and joined where tiles overlap."""

from collections.abc import Callable, Iterable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import Scratch, stored
from .tiles import patch, tiles
from .zones import zone_pixels

RUNS = "tile_r long, tile_c long, id long, row long, c0 long, c1 long"


def runs_of(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, first and last column of every run of a mask."""
    edge = np.diff(np.pad(mask.astype(np.int8), ((0, 0), (1, 1))), axis=1)
    row, first = np.nonzero(edge == 1)
    return row, first, np.nonzero(edge == -1)[1] - 1


def segment_tiles(df: DataFrame, segment: Callable[[np.ndarray], Iterable[np.ndarray]], bands: list[str], size: int = 1024, overlap: int = 128) -> DataFrame:
    """(tile_r, tile_c, id, row, c0, c1): the masks of each tile of pixels (row, col, bands), as runs in the picture's rows and columns.

    ``segment`` gets a whole tile (bands, size, size), padded with zeros, and returns masks (size, size), which may
    overlap. A mask counts as far as the picture has pixels. A task holds one tile and its masks one after the other.
    """
    step = size - overlap

    def run(tile: pd.DataFrame) -> pd.DataFrame:
        r, c = int(tile["tile_r"].iloc[0]), int(tile["tile_c"].iloc[0])
        there = np.zeros((size, size), bool)
        there[tile["r"], tile["c"]] = True
        parts = []
        for k, mask in enumerate(segment(patch(tile, bands, size))):
            row, first, last = runs_of(np.asarray(mask, bool) & there)
            # numbers that no other tile gives: up to a million masks a tile and tiles a row
            parts.append(pd.DataFrame({"tile_r": r, "tile_c": c, "id": (r << 40) + (c << 20) + k, "row": row + r * step, "c0": first + c * step, "c1": last + c * step}))
        return pd.concat(parts) if parts else pd.DataFrame({n: np.zeros(0, np.int64) for n in ("tile_r", "tile_c", "id", "row", "c0", "c1")})

    return tiles(df.select("row", "col", *bands), size, overlap).groupBy("tile_r", "tile_c").applyInPandas(run, RUNS)


def least_linked(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """(id, label): of all ids in edges (a, b) the least that they are linked with, directly or not."""
    both = scratch.stored(edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = scratch.stored(both.select(F.col("a").alias("id"), F.col("a").alias("label")).distinct())
    while True:
        # each takes the least label around it, then that one's label
        around = both.join(labels.withColumnRenamed("id", "b"), "b").groupBy(F.col("a").alias("id")).agg(F.min("label").alias("low"))
        lower = labels.join(around, "id").select("id", F.col("label").alias("was"), F.least("label", "low").alias("low"))
        jump = lower.select(F.col("id").alias("low"), F.col("low").alias("next"))
        new = scratch.stored(lower.join(jump, "low", "left").select("id", "was", F.least("low", "next").alias("label")))
        if new.where("label <> was").isEmpty():
            return new.select("id", "label")
        labels = new.drop("was")


def joined_masks(runs: DataFrame, size: int = 1024, overlap: int = 128, share: float = 0.5) -> DataFrame:
    """(label, row, c0, c1): masks of ``segment_tiles`` that are parts of one object made one, named by the least number of its parts.

    Two masks of neighbouring tiles belong together if, where both tiles look, their intersection is at least
    ``share`` of their union. Runs are compared within one row of one pair of tiles. Runs of a label that overlap or touch become one.
    """
    step = size - overlap
    scratch = Scratch()
    runs = scratch.stored(runs)
    first = lambda x: F.greatest(F.floor((F.col(x) - F.lit(size)) / F.lit(step)) + 1, F.lit(0)).cast("long")
    last = lambda x: F.floor(F.col(x) / F.lit(step)).cast("long")
    # the parts of a mask that another tile sees, too
    seen = runs.withColumn("other_r", F.explode(F.sequence(first("row"), last("row")))).withColumn("other_c", F.explode(F.sequence(first("c0"), last("c1"))))
    seen = seen.where("other_r <> tile_r OR other_c <> tile_c").withColumns({"c0": F.greatest("c0", F.col("other_c") * step), "c1": F.least("c1", F.col("other_c") * step + size - 1)}).where("c0 <= c1")
    seen = scratch.stored(seen.where((F.col("row") >= F.col("other_r") * step) & (F.col("row") < F.col("other_r") * step + size)))
    area = seen.groupBy("id", "other_r", "other_c").agg(F.sum(F.col("c1") - F.col("c0") + 1).alias("area"))
    a = seen.where((F.col("tile_r") < F.col("other_r")) | (F.col("tile_r") == F.col("other_r")) & (F.col("tile_c") < F.col("other_c")))
    b = seen.select(F.col("id").alias("b"), "row", F.col("tile_r").alias("other_r"), F.col("tile_c").alias("other_c"), F.col("other_r").alias("tile_r"), F.col("other_c").alias("tile_c"), F.col("c0").alias("b0"), F.col("c1").alias("b1"))
    met = a.join(b, ["row", "tile_r", "tile_c", "other_r", "other_c"]).where("c0 <= b1 AND b0 <= c1")
    common = met.groupBy(F.col("id").alias("a"), "b", "tile_r", "tile_c", "other_r", "other_c").agg(F.sum(F.least("c1", "b1") - F.greatest("c0", "b0") + 1).alias("both"))
    common = common.join(area.withColumnsRenamed({"id": "a", "area": "area_a"}), ["a", "other_r", "other_c"])
    common = common.join(area.select(F.col("id").alias("b"), F.col("other_r").alias("tile_r"), F.col("other_c").alias("tile_c"), F.col("area").alias("area_b")), ["b", "tile_r", "tile_c"])
    edges = common.where(F.col("both") >= F.lit(share) * (F.col("area_a") + F.col("area_b") - F.col("both"))).select("a", "b")
    labels = least_linked(edges, scratch)
    named = runs.join(labels, "id", "left").select(F.coalesce("label", "id").alias("label"), "row", "c0", "c1")
    line = Window.partitionBy("label", "row").orderBy("c0", "c1")
    reach = F.max("c1").over(line.rowsBetween(Window.unboundedPreceding, -1))
    group = F.sum(F.col("new").cast("int")).over(line.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    merged = named.withColumn("new", F.coalesce(F.col("c0") > reach + 1, F.lit(True))).withColumn("group", group)
    return stored(merged.groupBy("label", "row", "group").agg(F.min("c0").alias("c0"), F.max("c1").alias("c1")).drop("group"), then=scratch)


def vegetated_masks(masks: DataFrame, pixels: DataFrame, least: int, most: int, overlap: float = 0.6) -> DataFrame:
    """Masks (label, row, c0, c1) of a fitting size and share of vegetation: label, pixels, overlap.

    ``pixels`` (row, col, vegetation) meet the runs of their row and block of columns; the size is that of the runs.
    """
    sizes = masks.groupBy("label").agg(F.sum(F.col("c1") - F.col("c0") + 1).alias("pixels")).where(F.col("pixels").between(least, most))
    green = pixels.where("vegetation").select(F.col("row").alias("r"), F.col("col").alias("c"))
    met = zone_pixels(green, masks.withColumnRenamed("row", "r"), ["label"]).groupBy("label").agg(F.count(F.lit(1)).alias("veg"))
    out = sizes.join(met, "label", "left").withColumn("overlap", F.coalesce("veg", F.lit(0)) / (F.col("pixels") + F.lit(1e-6)))
    return out.where(F.col("overlap") >= overlap).drop("veg")
