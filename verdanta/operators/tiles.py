"""Overlapping tiles, neighbourhoods and resampling of pixel tables."""

from collections.abc import Callable
from functools import reduce
from math import exp, pi

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.mapping import Affine, bound, inverse, map_x, map_y, to_utm
from .boxes import suppressed


def tiles(df: DataFrame, size: int = 256, overlap: int = 64) -> DataFrame:
    """Every pixel once per tile that covers it: tile_r, tile_c, and its place in the tile."""
    if not 0 <= overlap < size:
        raise ValueError("overlap must be at least 0 and below the tile size")
    step = size - overlap
    first = lambda x: F.greatest(F.floor((F.col(x) - F.lit(size)) / F.lit(step)) + 1, F.lit(0))
    ids = lambda x: F.explode(F.sequence(first(x).cast("long"), F.floor(F.col(x) / F.lit(step)).cast("long")))
    out = df.withColumn("tile_r", ids("row")).withColumn("tile_c", ids("col"))
    return out.withColumns({"r": F.col("row") - F.col("tile_r") * step, "c": F.col("col") - F.col("tile_c") * step})


def patch(tile: pd.DataFrame, bands: list[str], size: int) -> np.ndarray:
    """(bands, size, size) of a tile's rows; where the picture ends or has no value, zero."""
    out = np.zeros((len(bands), size, size))
    out[:, tile["r"], tile["c"]] = tile[bands].fillna(0.0).to_numpy().T
    return out


def predict_tiles(df: DataFrame, predict: Callable[[np.ndarray], np.ndarray], bands: list[str], size: int = 256, overlap: int = 64, threshold: float = 0.5) -> DataFrame:
    """Mean over the tiles of a model's probability per pixel, and whether it is above the threshold.

    ``predict`` gets a whole tile (bands, size, size), padded with zeros, and returns its logits (size, size).
    """

    def run(tile: pd.DataFrame) -> pd.DataFrame:
        logits = predict(patch(tile, bands, size))[tile["r"], tile["c"]]
        return pd.DataFrame({"row": tile["row"], "col": tile["col"], "p": 1 / (1 + np.exp(-logits))})

    part = tiles(df.select("row", "col", *bands), size, overlap).groupBy("tile_r", "tile_c").applyInPandas(run, "row long, col long, p double")
    return averaged(part, threshold)


def averaged(parts: DataFrame, threshold: float = 0.5) -> DataFrame:
    return parts.groupBy("row", "col").agg(F.avg("p").alias("probability")).withColumn("canopy", (F.col("probability") > threshold).cast("int"))


def detect_tiles(df: DataFrame, detect: Callable[[np.ndarray], pd.DataFrame], bands: list[str], size: int = 400, overlap: float = 0.05, score_threshold: float = 0.4, most_overlap: float | None = 0.15) -> DataFrame:
    """Boxes (xmin, ymin, xmax, ymax in pixels, score, label) that a detector finds in tiles, of a sufficient score.

    ``detect`` gets a whole tile (bands, size, size), padded with zeros, and returns boxes in the tile's pixels. Of
    boxes that overlap by more than ``most_overlap``, in one tile or in several, the best remains (see ``suppressed``). If
    that is None boxes may overlap as they like, and of tiles that overlap, the one in whose inner half of the
    overlap a box's centre lies keeps it.
    """
    shared = int(size * overlap)
    step = size - shared

    def run(tile: pd.DataFrame) -> pd.DataFrame:
        r, c = int(tile["tile_r"].iloc[0]), int(tile["tile_c"].iloc[0])
        found = detect(patch(tile, bands, size))
        x, y = (found["xmin"] + found["xmax"]) / 2, (found["ymin"] + found["ymax"]) / 2
        own = found["score"] >= score_threshold
        if most_overlap is None:
            own &= (x < size - shared / 2) & (y < size - shared / 2) & ((c == 0) | (x >= shared / 2)) & ((r == 0) | (y >= shared / 2))
        found = found[own]
        return pd.DataFrame({"xmin": found["xmin"] + c * step, "ymin": found["ymin"] + r * step, "xmax": found["xmax"] + c * step, "ymax": found["ymax"] + r * step, "score": found["score"], "label": found["label"]})

    part = tiles(df.select("row", "col", *bands), size, shared)
    boxes = part.groupBy("tile_r", "tile_c").applyInPandas(run, "xmin double, ymin double, xmax double, ymax double, score double, label string")
    return boxes if most_overlap is None else suppressed(boxes, most=most_overlap, cell=max(size / 4, 1.0))


def gaussian_kernel(sigma: float, truncate: float = 4.0) -> list[tuple[int, float]]:
    """(offset, weight) of a Gaussian cut at truncate sigmas."""
    radius = int(truncate * sigma + 0.5)
    raw = [(i, exp(-0.5 * (i / sigma) ** 2)) for i in range(-radius, radius + 1)]
    total = sum(w for _, w in raw)
    return [(i, w / total) for i, w in raw]


def reflected(i: Column, n: Column | int) -> Column:
    """Index of the mirror image (d c b a | a b c d | d c b a)."""
    n = F.lit(n) if isinstance(n, int) else n
    k = F.pmod(i, n * 2)
    return F.when(k < n, k).otherwise(n * 2 - 1 - k)


def lines(df: DataFrame, line: list[str], axis: str, n: int) -> DataFrame:
    """One row per line of a grid: its pixels in order (``line``), and (at, v) of all n places along ``axis``, NULL where there is no pixel (``full``)."""
    out = df.groupBy(*line).agg(F.array_sort(F.collect_list(F.struct(axis, *[c for c in df.columns if c != axis and c not in line]))).alias("line"))
    values = F.transform("line", lambda t: F.struct(t[axis].cast("int").alias("at"), t["v"].alias("v")))
    absent = F.array_except(F.sequence(F.lit(0), F.lit(n - 1)), F.transform("line", lambda t: t[axis].cast("int")))
    gaps = F.transform(absent, lambda i: F.struct(i.alias("at"), F.lit(None).cast(df.schema["v"].dataType).alias("v")))
    return out.withColumn("full", F.when(F.size("line") == n, values).otherwise(F.array_sort(F.concat(values, gaps))))


def smoothed(df: DataFrame, by: list[str], height: int, width: int, sigma: float = 1.5) -> DataFrame:
    """Gaussian smoothing of v on grids (by, r, c, v); other columns of df stay.

    Each column, then each row of a grid becomes one array, over which the kernel slides; a value whose
    neighbourhood has a NULL is NULL. A pixel whose row is missing is like one with a NULL, but stays missing.
    """
    kernel = gaussian_kernel(sigma)
    radius = len(kernel) // 2

    def one(x: DataFrame, axis: str, n: int) -> DataFrame:
        line = [*by, "c" if axis == "r" else "r"]
        rest = [c for c in x.columns if c not in line]
        out = lines(x, line, axis, n)
        # bound, as Spark would otherwise work out the whole line again for each of its places
        mirrored = bound(F.col("full"), lambda full: F.transform(F.sequence(F.lit(-radius), F.lit(n - 1 + radius)), lambda i: F.get(full, reflected(i, n))["v"]))
        out = out.withColumn("wide", mirrored)
        slide = lambda i: reduce(lambda a, b: a + b, [F.get("wide", i + o + radius) * F.lit(w) for o, w in kernel])
        cells = F.transform("line", lambda t: F.struct(*[slide(t[axis].cast("int")).alias("v") if c == "v" else t[c].alias(c) for c in rest]))
        return out.select(*line, F.inline(cells))

    return one(one(df, "r", height), "c", width).select(*df.columns)


def with_maxima(df: DataFrame, by: list[str], distance: int, height: int, width: int, exclude_border: bool = True) -> DataFrame:
    """``df`` with ``peak``: whether v is the largest within ``distance`` in both directions; of equal ones the first by r, then c.

    Pixels without a value are no maxima, but stay for the second pass, which reads what the first left at them.
    Nearer than ``distance`` to the border there are no peaks, unless it isn't excluded.
    """
    best = F.when(F.col("v").isNotNull(), F.struct("v", (-F.col("r")).alias("nr"), (-F.col("c")).alias("nc")))
    near = lambda keep, order: Window.partitionBy(*by, keep).orderBy(order).rangeBetween(-distance, distance)
    out = df.withColumn("best", best).withColumn("m", F.max("best").over(near("r", "c"))).withColumn("m", F.max("m").over(near("c", "r")))
    inside = F.col("r").between(distance, height - 1 - distance) & F.col("c").between(distance, width - 1 - distance)
    peak = F.coalesce(F.col("m") == F.col("best"), F.lit(False))
    return out.withColumn("peak", peak & inside if exclude_border else peak).drop("best", "m")


def local_maxima(df: DataFrame, by: list[str], distance: int, height: int, width: int, exclude_border: bool = True) -> DataFrame:
    """The peaks of full grids (by, r, c, v)."""
    return with_maxima(df, by, distance, height, width, exclude_border).where("peak").select(*by, "r", "c", "v")


def _linear(d: Column) -> Column:
    return F.greatest(F.lit(1.0) - d, F.lit(0.0))


def _cubic(d: Column) -> Column:
    inner, outer = F.lit(1.5) * d**3 - F.lit(2.5) * d**2 + F.lit(1.0), F.lit(-0.5) * d**3 + F.lit(2.5) * d**2 - F.lit(4.0) * d + F.lit(2.0)
    return F.when(d <= 1, inner).when(d < 2, outer).otherwise(F.lit(0.0))


def _lanczos(d: Column) -> Column:
    sinc = lambda x: F.sin(F.lit(pi) * x) / (F.lit(pi) * x)
    return F.when(d < 1e-12, F.lit(1.0)).when(d < 3, sinc(d) * sinc(d / F.lit(3.0))).otherwise(F.lit(0.0))


#: by name, how far a kernel reaches and its weight at a distance; an unknown name is bilinear
KERNELS: dict[str, tuple[int, Callable[[Column], Column]]] = {"bilinear": (1, _linear), "cubic": (2, _cubic), "lanczos": (3, _lanczos)}


def sampled(df: DataFrame, by: list[str], height: int, width: int, targets: DataFrame, method: str = "bilinear") -> DataFrame:
    """Values of full grids (by, r, c, v) at ``targets`` (nr, nc, y, x), whose y and x are places in pixels of the grids, 0 at the first centre.

    Beyond the border a grid goes on with its border's values; a NULL under the kernel makes NULL.
    """
    inside = lambda i, n: F.least(F.greatest(i.cast("long"), F.lit(0).cast("long")), F.lit(n - 1).cast("long"))
    if method == "nearest":
        taps = targets.select("nr", "nc", inside(F.floor(F.col("y") + F.lit(0.5)), height).alias("r"), inside(F.floor(F.col("x") + F.lit(0.5)), width).alias("c"), F.lit(1.0).alias("w"))
    else:
        reach, weight = KERNELS.get(method, KERNELS["bilinear"])

        def along(at: str, n: int) -> Column:
            raw = F.transform(F.sequence(F.lit(1 - reach), F.lit(reach)), lambda k: F.struct(inside(F.floor(at) + k, n).alias("i"), weight(F.abs(F.col(at) - F.floor(at) - k)).alias("w")))
            return raw

        taps = targets.select("nr", "nc", along("y", height).alias("ys"), along("x", width).alias("xs"))
        total = lambda c: F.aggregate(c, F.lit(0.0), lambda s, t: s + t["w"])
        taps = taps.withColumn("all", total("ys") * total("xs")).select("nr", "nc", "all", "xs", F.inline("ys")).withColumnsRenamed({"i": "r", "w": "wy"})
        taps = taps.select("nr", "nc", "all", "r", "wy", F.inline("xs")).select("nr", "nc", "r", F.col("i").alias("c"), (F.col("wy") * F.col("w") / F.col("all")).alias("w"))
        taps = taps.groupBy("nr", "nc", "r", "c").agg(F.sum("w").alias("w"))
    taps = taps.where("w <> 0")
    return df.join(taps, ["r", "c"]).groupBy(*by, "nr", "nc").agg(F.when(F.count(F.lit(1)) == F.count("v"), F.sum(F.col("v") * F.col("w"))).alias("v")).withColumnsRenamed({"nr": "r", "nc": "c"})


def grid_cells(df: DataFrame, height: int, width: int) -> DataFrame:
    """(nr, nc) of a grid."""
    return df.sparkSession.range(height * width).select((F.col("id") / width).cast("long").alias("nr"), (F.col("id") % width).alias("nc"))


def along(x: DataFrame, by: list[str], axis: str, n: int, m: int, step: float, shift: float, method: str) -> DataFrame:
    """Grids (by, r, c, v) with the n pixels along ``axis`` sampled at (i + 0.5) * step + shift for i below m, where that lies in the grid.

    Where pixels become coarser (a step of more than 1) a kernel's reach grows with the step, so every pixel counts;
    ``average`` weighs pixels by how much of them a target covers. Beyond the border a grid goes on with its border's values.
    """
    line = [*by, "c" if axis == "r" else "r"]
    scale = max(1.0, abs(step))
    last = F.lit(n - 1)

    place = lambda i: (i + F.lit(0.5)) * F.lit(step) + F.lit(shift)

    def sampled_at(i: Column, full: Column) -> Column:
        at = place(i)
        value = lambda k: F.get(full, F.least(F.greatest(k, F.lit(0)), last))["v"]
        if method == "nearest":
            return value(F.floor(at + F.lit(0.5)).cast("int"))
        if method == "average":
            low, high = F.greatest(at - F.lit(abs(step) / 2), F.lit(-0.5)), F.least(at + F.lit(abs(step) / 2), F.lit(n - 0.5))
            first, end = F.floor(low + F.lit(0.5)), F.ceil(high + F.lit(0.5)) - 1
            weight = lambda k: F.least(high, k + F.lit(0.5)) - F.greatest(low, k - F.lit(0.5))
        else:
            reach, kernel = KERNELS.get(method, KERNELS["bilinear"])
            wide = int(-(-reach * scale // 1))
            first, end = F.floor(at) + (1 - wide), F.floor(at) + wide
            weight = lambda k: kernel(F.abs(at - k) / F.lit(scale))

        def add(t: Column, k: Column) -> Column:
            w = weight(k)
            return F.when(F.abs(w) < 1e-12, t).otherwise(F.struct((t["v"] + value(k) * w).alias("v"), (t["w"] + w).alias("w")))

        zero = F.struct(F.lit(0.0).alias("v"), F.lit(0.0).alias("w"))
        return F.aggregate(F.sequence(first.cast("int"), F.greatest(first, end).cast("int")), zero, add, lambda t: t["v"] / t["w"])

    inside = F.filter(F.sequence(F.lit(0), F.lit(m - 1)), lambda i: place(i).between(-0.5, n - 0.5))
    # bound, as Spark would otherwise work out the whole line again for each of its places
    cells = bound(F.col("full"), lambda full: F.transform(inside, lambda i: F.struct(i.cast("long").alias(axis), sampled_at(i, full).alias("v"))))
    return lines(x, line, axis, n).select(*line, F.inline(cells))


def separable(df: DataFrame, by: list[str], rows: tuple[int, int, float, float], cols: tuple[int, int, float, float], method: str) -> DataFrame:
    """Grids sampled along rows, then along columns (each old size, new size, step, shift): two shuffles, of the pixels and of what the first pass leaves."""
    x = df.select(*by, "r", "c", F.col("v").cast("double").alias("v"))
    return along(along(x, by, "r", *rows, method), by, "c", *cols, method).select(*by, "r", "c", "v")


def resampled(df: DataFrame, by: list[str], height: int, width: int, new_height: int, new_width: int, method: str = "bilinear") -> DataFrame:
    """Grids (by, r, c, v) on another number of rows and columns over the same extent; a NULL or missing pixel under the kernel makes NULL.

    Methods: nearest, bilinear, cubic, lanczos, average; an unknown name is bilinear.
    """
    axis = lambda old, new: (old, new, old / new, -0.5)
    return separable(df, by, axis(height, new_height), axis(width, new_width), method)


def _covered(targets: DataFrame, height: int, width: int) -> DataFrame:
    """Targets whose centre lies in the grids; others have no value."""
    return targets.where(F.col("y").between(-0.5, height - 0.5) & F.col("x").between(-0.5, width - 0.5))


def coregistered(df: DataFrame, by: list[str], height: int, width: int, transform: Affine, new_height: int, new_width: int, new_transform: Affine, method: str = "bilinear") -> DataFrame:
    """Grids on the grid of a reference in the same map system; reference pixels outside of them are left out.

    Without a rotation between them rows and columns are sampled apart, and coarser pixels average finer ones.
    """
    a, b, c, d, e, f = transform
    na, nb, nc, nd, ne, nf = new_transform
    if b == d == nb == nd == 0:
        rows, cols = (height, new_height, ne / e, (nf - f) / e - 0.5), (width, new_width, na / a, (nc - c) / a - 0.5)
        return separable(df, by, rows, cols, method)
    cells = grid_cells(df, new_height, new_width)
    row, col = F.col("nr") + F.lit(0.5), F.col("nc") + F.lit(0.5)
    mx, my = map_x(row, col, new_transform), map_y(row, col, new_transform)
    back = inverse(transform)
    places = cells.select("nr", "nc", (map_y(my, mx, back) - F.lit(0.5)).alias("y"), (map_x(my, mx, back) - F.lit(0.5)).alias("x"))
    return sampled(df, by, height, width, _covered(places, height, width), method)


def to_wgs84(df: DataFrame, by: list[str], height: int, width: int, transform: Affine, zone: int, north: bool, new_height: int, new_width: int, new_transform: Affine, method: str = "bilinear") -> DataFrame:
    """Full grids in a UTM zone on a grid of longitudes and latitudes; pixels outside of them are left out."""
    cells = grid_cells(df, new_height, new_width)
    row, col = F.col("nr") + F.lit(0.5), F.col("nc") + F.lit(0.5)
    here = cells.select("nr", "nc", to_utm(map_x(row, col, new_transform), map_y(row, col, new_transform), zone, north).alias("m"))
    back = inverse(transform)
    mx, my = F.col("m")["x"], F.col("m")["y"]
    places = here.select("nr", "nc", (map_y(my, mx, back) - F.lit(0.5)).alias("y"), (map_x(my, mx, back) - F.lit(0.5)).alias("x"))
    return sampled(df, by, height, width, _covered(places, height, width), method)
