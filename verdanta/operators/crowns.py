"""Crown segmentation: seeded flooding over tiles, segment filters, outlines and features."""

import heapq
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.mapping import Affine, from_utm, map_x, map_y, pixel_area
from ..sources.shared import Scratch, stored
from .stats import beside, carried, in_order
from .tiles import smoothed, with_maxima

#: rows and columns of a grid that one task floods
TILE = 512


def flooded_tile(r: np.ndarray, c: np.ndarray, s: np.ndarray, seed: np.ndarray, halo: tuple[np.ndarray, ...] | None, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """How water that rises from the seeds reaches the open pixels (r, c, value s, seed's label or 0) of one tile.

    The highest values are flooded first, of equal ones that with the smallest place r * width + c. A pixel is as
    hard to reach as the last pixel to be flooded on the easiest way to it. Returns of each pixel that pixel's value
    and place, and where the pixel's label comes from: a seed's label, or -1 - the place of such a pixel beyond the tile.
    ``halo`` is (r, c, value, place) of pixels around the tile that have been reached, as this function returns them.
    """
    place = r * width + c
    hr, hc, hv, hp = halo if halo is not None else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0), np.zeros(0, np.int64))
    values, places = np.concatenate([s, hv]), np.concatenate([place, hp])
    order = np.lexsort((places, -values))
    values, places = values[order], places[order]
    new = np.ones(len(order), bool)
    new[1:] = (values[1:] != values[:-1]) | (places[1:] != places[:-1])
    rank = np.empty(len(order), np.int64)
    rank[order] = np.cumsum(new) - 1
    values, places = values[new], places[new]
    top, left = int(r.min()) - 1, int(c.min()) - 1
    wide = int(c.max()) - left + 2
    cells = (int(r.max()) - top + 2) * wide
    at, around = (r - top) * wide + c - left, (hr - top) * wide + hc - left
    near = (hr >= top) & (hr <= r.max() + 1) & (hc >= left) & (hc <= c.max() + 1)  # others touch no pixel of the tile
    keys, reached, origin = [-1] * cells, [-1] * cells, [0] * cells
    for i, k in zip(at.tolist(), rank[: len(at)].tolist(), strict=True):
        keys[i] = k
    heap = []
    for i, k, label in zip(at[seed > 0].tolist(), rank[: len(at)][seed > 0].tolist(), seed[seed > 0].tolist(), strict=True):
        reached[i], origin[i] = k, label
        heap.append(k * cells + i)
    for i, k, p in zip(around[near].tolist(), rank[len(at) :][near].tolist(), hp[near].tolist(), strict=True):
        reached[i], origin[i] = k, -1 - p
        heap.append(k * cells + i)
    heapq.heapify(heap)
    while heap:
        now, i = divmod(heapq.heappop(heap), cells)
        for j in (i - wide, i - 1, i + 1, i + wide):
            if 0 <= j < cells and keys[j] >= 0 and reached[j] < 0:
                reached[j], origin[j] = max(now, keys[j]), origin[i]
                heapq.heappush(heap, reached[j] * cells + j)
    reached = np.array(reached)[at]
    return np.where(reached >= 0, values[reached], np.nan), np.where(reached >= 0, places[reached], -1), np.array(origin)[at]


def joined(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least of the 0 .. n - 1 that each is connected with by the edges (a, b)."""
    least = np.arange(n)
    while True:
        low = np.minimum(least[a], least[b])
        new = least.copy()
        for ends in (a, b, least[a], least[b]):
            np.minimum.at(new, ends, low)
        new = new[new]
        if (new == least).all():
            return least
        least = new


def connected_pixels(pixels: DataFrame, by: list[str], width: int, tile: int | None = None) -> DataFrame:
    """``pixels`` (by, r, c, ...) with the component of 4-neighbours each is in, named by its least place r * width + c.

    Tiles are labelled each by itself; then labels that meet at the tiles' borders are joined.
    """
    tile = tile or TILE

    @F.pandas_udf("array<long>")
    def local(rows: pd.Series, cols: pd.Series) -> pd.Series:
        out = []
        for r, c in zip(rows, cols, strict=True):
            place = r * width + c
            at = np.argsort(place)
            p, column = place[at], c[at]
            edges = []
            for step, ok in ((1, column + 1 < width), (width, np.ones(len(p), bool))):
                spot = np.minimum(np.searchsorted(p, p + step), len(p) - 1)
                there = (p[spot] == p + step) & ok
                edges.append((np.flatnonzero(there), spot[there]))
            least = joined(len(p), *(np.concatenate(x) for x in zip(*edges, strict=True)))
            own = np.empty(len(p), np.int64)
            own[at] = p[least]
            out.append(own)
        return pd.Series(out)

    key = [F.expr(f"{x} div {tile}").alias(f"tile_{x}") for x in "rc"]
    scratch = Scratch()
    cells = pixels.groupBy(*by, *key).agg(F.collect_list(F.struct(*[c for c in pixels.columns if c not in by])).alias("px"))
    cells = cells.withColumn("part", local(F.col("px.r"), F.col("px.c")))
    labelled = scratch.stored(cells.select(*by, F.inline(F.transform("px", lambda t, i: F.struct(t.alias("t"), F.get("part", i).alias("part"))))).select(*by, "t.*", "part"))

    def meets(dr: int, dc: int) -> DataFrame:
        x, n = ("r", dr) if dr else ("c", dc)
        here = labelled.where(F.col(x) % tile == tile - 1).select(*by, (F.col("r") + dr).alias("r"), (F.col("c") + dc).alias("c"), F.col("part").alias("a"))
        return here.join(labelled.where(F.col(x) % tile == 0).select(*by, "r", "c", F.col("part").alias("b")), [*by, "r", "c"]).select(*by, "a", "b")

    edges = scratch.stored(meets(1, 0).unionByName(meets(0, 1)).distinct())
    both = edges.unionByName(edges.select(*by, F.col("b").alias("a"), F.col("a").alias("b")))
    labels = scratch.stored(both.select(*by, F.col("a").alias("part")).distinct().withColumn("component", F.col("part")))
    while True:
        # each takes the least label around it, then that one's label
        around = both.join(labels.withColumnsRenamed({"part": "b"}), [*by, "b"]).groupBy(*by, F.col("a").alias("part")).agg(F.min("component").alias("low"))
        lower = labels.join(around, [*by, "part"]).select(*by, "part", F.col("component").alias("was"), F.least("component", "low").alias("low"))
        jump = lower.select(*by, F.col("part").alias("low"), F.col("low").alias("next"))
        new = scratch.stored(lower.join(jump, [*by, "low"], "left").select(*by, "part", "was", F.least("low", "next").alias("component")))
        if new.where("component <> was").isEmpty():
            break
        labels = new.drop("was")
    return stored(labelled.join(labels, [*by, "part"], "left").withColumn("component", F.coalesce("component", "part")).drop("part"), then=scratch)


def flooded_tiles(pixels: DataFrame, by: list[str], width: int, tile: int) -> DataFrame:
    """(by, r, c, label) of open pixels (by, r, c, s, seed), flooded from their seeds as one grid, though no task sees more than a tile.

    Rounds over the tiles exchange how hard the pixels at their borders are to reach, until no tile learns anything new;
    after the first, a round takes only tiles next to a change. Then each tile says where its pixels' labels come
    from: all pixels that the same last pixel has opened up have its label, and its own comes from a neighbour
    that was reached earlier. So what crosses borders is a pointer to a pixel that is strictly easier to reach, and the
    few pixels that others point to find their seeds by pointer jumping.
    """
    scratch = Scratch()
    place = ["tile_r", "tile_c"]
    key = [F.expr(f"{x} div {tile}").cast("long").alias(f"tile_{x}") for x in "rc"]
    cells = scratch.stored(pixels.groupBy(*by, *key).agg(F.collect_list(F.struct("r", "c", "s", "seed")).alias("px")))
    halo_type = "array<struct<r:bigint,c:bigint,v:double,p:bigint>>"

    @F.pandas_udf("struct<v:array<double>,p:array<long>,origin:array<long>>")
    def reach(r: pd.Series, c: pd.Series, s: pd.Series, seed: pd.Series, hr: pd.Series, hc: pd.Series, hv: pd.Series, hp: pd.Series) -> pd.DataFrame:
        told = [flooded_tile(*own[:4], own[4:] if own[4] is not None and len(own[4]) else None, width) for own in zip(r, c, s, seed, hr, hc, hv, hp, strict=True)]
        return pd.DataFrame({n: [t[i] for t in told] for i, n in enumerate(("v", "p", "origin"))})

    def run(tiles: DataFrame) -> DataFrame:
        told = tiles.withColumn("told", reach(*[F.col(f"px.{n}") for n in ("r", "c", "s", "seed")], *[F.col(f"halo.{n}") for n in "rcvp"]))
        cell = F.transform("px", lambda t, i: F.struct(t["r"].alias("r"), t["c"].alias("c"), *[F.get(f"told.{n}", i).alias(n) for n in ("v", "p", "origin")]))
        return told.select(*by, *place, F.inline(cell))

    def border(told: DataFrame) -> DataFrame:
        edge = [F.col(x) % tile == k for x in "rc" for k in (0, tile - 1)]
        return told.where(reduce(lambda a, b: a | b, edge) & F.col("v").isNotNull() & ~F.isnan("v")).select(*by, *place, "r", "c", "v", "p")

    def beyond(ring: DataFrame) -> DataFrame:
        """Per tile the reached pixels around it, and whether any has changed."""
        sides = F.array(*[F.when(F.col(x) % tile == k, F.struct(*[(F.col(f"tile_{y}") + (step if x == y else 0)).alias(f"tile_{y}") for y in "rc"])) for x in "rc" for k, step in ((0, -1), (tile - 1, 1))])
        to = ring.select(*by, F.explode(F.filter(sides, lambda t: t.isNotNull())).alias("to"), F.struct("r", "c", "v", "p").alias("t"), "moved")
        return to.groupBy(*by, "to.tile_r", "to.tile_c").agg(F.collect_list("t").alias("halo"), F.max("moved").alias("moved"))

    ring = scratch.stored(border(run(cells.withColumn("halo", F.lit(None).cast(halo_type)))).withColumn("moved", F.lit(True)))
    while not ring.where("moved").isEmpty():
        again = beside(cells, beyond(ring).where("moved").drop("moved"), [*by, *place])
        new = scratch.stored(border(run(again)))
        was = ring.select(*by, "r", "c", F.struct("v", "p").alias("was"))
        moved = F.col("was").isNull() | (F.struct("v", "p") != F.col("was"))
        fresh = beside(new, was, [*by, "r", "c"], "left").withColumn("moved", moved).drop("was")
        # tiles that weren't run again keep what they had
        ring = scratch.stored(fresh.unionByName(beside(ring, new.select(*by, *place).distinct(), [*by, *place], "left_anti").withColumn("moved", F.lit(False))))
    known = beyond(ring).drop("moved")
    told = scratch.stored(run(beside(cells, known, [*by, *place], "left").select(*by, *place, "px", "halo")).select(*by, "r", "c", "origin"))
    if told.where("origin < 0").isEmpty():
        return stored(told.withColumnRenamed("origin", "label"), then=scratch)
    wanted = told.where("origin < 0").select(*by, "origin").distinct()
    at = told.select(*by, (-1 - (F.col("r") * width + F.col("c"))).alias("origin"), F.col("origin").alias("next"))
    links = scratch.stored(beside(at, wanted, [*by, "origin"], "left_semi"))
    while not links.where("next < 0").isEmpty():
        jump = links.select(*by, F.col("origin").alias("next"), F.col("next").alias("far"))
        links = scratch.stored(beside(links, jump, [*by, "next"], "left").select(*by, "origin", F.coalesce("far", "next").alias("next")))
    found = beside(told.where("origin < 0"), links, [*by, "origin"], "left").select(*by, "r", "c", F.col("next").alias("label"))
    return stored(found.unionByName(told.where("origin >= 0").withColumnRenamed("origin", "label")), then=scratch)


def watershed(df: DataFrame, by: list[str], height: int, width: int, pixel_size: float = 5.8, min_area: float = 10.0, sigma: float = 1.5, threshold: float = 0.3, tile: int | None = None) -> DataFrame:
    """(by, r, c, label) of grids (by, r, c, v): smoothing, local maxima as seeds, flooding, and the smallest crowns removed (label 0).

    Seeds are numbered from the highest, then by row and column; pixels are flooded by (value, row, column) too. A
    grid of more than ``tile`` by ``tile`` pixels (TILE by default) is flooded over tiles, which gives the same labels. Rows that the
    grid lacks are outside the mask.
    """
    tile = tile or TILE
    distance, least = max(2, int(3.0 / pixel_size)), int(min_area / pixel_size**2)
    scratch = Scratch()
    smooth = smoothed(df.select(*by, "r", "c", "v", F.col("v").alias("raw")), by, height, width, sigma)
    mask = F.coalesce(F.col("raw") > threshold, F.lit(False))
    rows = smooth.select(*by, F.col("r").cast("long").alias("r"), F.col("c").cast("long").alias("c"), F.coalesce("v", F.lit(float("-inf"))).alias("s"), mask.alias("mask"), F.when(mask, F.col("v")).alias("v"))
    rows = with_maxima(rows, by, distance, height, width).drop("v")
    if height * width <= tile * tile:

        @F.pandas_udf("array<long>")
        def labels_of(r: pd.Series, c: pd.Series, s: pd.Series, mask: pd.Series, peak: pd.Series) -> pd.Series:
            out = []
            for y, x, values, open_, top in zip(r, c, s, mask, peak, strict=True):
                open_, top = open_.astype(bool), np.flatnonzero(top)
                top = top[np.lexsort((x[top], y[top], -values[top]))]
                seed = np.zeros(len(y), np.int64)
                seed[top] = np.arange(1, len(top) + 1)
                found = np.zeros(len(y), np.int64)
                if open_.any():
                    found[open_] = flooded_tile(y[open_], x[open_], values[open_], seed[open_], None, width)[2]
                names, of, sizes = np.unique(found, return_inverse=True, return_counts=True)
                out.append(np.where(sizes >= least, names, 0)[of])
            return pd.Series(out)

        whole = rows.groupBy(*by).agg(F.collect_list(F.struct("r", "c", "s", "mask", "peak")).alias("px"))
        told = whole.withColumn("labels", labels_of(*[F.col(f"px.{n}") for n in ("r", "c", "s", "mask", "peak")]))
        return told.select(*by, F.inline(F.transform("px", lambda t, i: F.struct(t["r"].alias("r"), t["c"].alias("c"), F.get("labels", i).alias("label")))))
    rows = scratch.stored(rows)
    numbered = in_order(rows.where("peak").select(*by, "r", "c", F.struct((-F.col("s")).alias("s"), "r", "c").alias("key")), by, "key")
    before = carried(numbered, by, before=(F.count(F.lit(1)), "sum"))
    nth = F.row_number().over(Window.partitionBy("part", *by).orderBy("key"))
    seeds = beside(numbered.withColumn("nth", nth), before, ["part", *by]).select(*by, "r", "c", (F.col("nth") + F.coalesce("before", F.lit(0))).alias("seed"))
    seeded = beside(rows.where("mask").select(*by, "r", "c", "s"), seeds, [*by, "r", "c"], "left").withColumn("seed", F.coalesce("seed", F.lit(0)))
    labels = large_segments(flooded_tiles(seeded, by, width, tile), by, least)
    return stored(labels.unionByName(rows.where("NOT mask").select(*by, "r", "c", F.lit(0).cast("long").alias("label"))), then=scratch)


def segment_sizes(labels: DataFrame, by: list[str]) -> DataFrame:
    return labels.where("label > 0").groupBy(*by, "label").agg(F.count(F.lit(1)).alias("pixels"))


def large_segments(labels: DataFrame, by: list[str], least: int) -> DataFrame:
    """Labels of segments with fewer pixels become 0; no row is dropped."""
    keep = segment_sizes(labels, by).where(F.col("pixels") >= least).withColumn("kept", F.lit(True)).drop("pixels")
    return beside(labels, keep, [*by, "label"], "left").select(*by, "r", "c", F.when(F.col("kept"), F.col("label")).otherwise(0).alias("label"))


def vegetated_segments(pixels: DataFrame, by: list[str], least: int, most: int, overlap: float = 0.6) -> DataFrame:
    """Segments of (by, label, vegetation boolean) with a fitting size and share of vegetation."""
    out = pixels.where("label > 0").groupBy(*by, "label").agg(F.count(F.lit(1)).alias("pixels"), F.count(F.when(F.col("vegetation"), 1)).alias("veg"))
    out = out.withColumn("overlap", F.col("veg") / (F.col("pixels") + F.lit(1e-6)))
    return out.where(F.col("pixels").between(least, most) & (F.col("overlap") >= overlap)).drop("veg")


def outlines(labels: DataFrame, by: list[str], transform: Affine) -> DataFrame:
    """Per segment its box in map units, area and the box as WKT."""
    box = labels.where("label > 0").groupBy(*by, "label").agg(F.min("r").alias("r0"), F.max("r").alias("r1"), F.min("c").alias("c0"), F.max("c").alias("c1"), F.count(F.lit(1)).alias("pixels"))
    x0, y0 = map_x(F.col("r0"), F.col("c0"), transform), map_y(F.col("r0"), F.col("c0"), transform)
    x1, y1 = map_x(F.col("r1") + 1, F.col("c1") + 1, transform), map_y(F.col("r1") + 1, F.col("c1") + 1, transform)
    out = box.select(*by, "label", F.least(x0, x1).alias("minx"), F.least(y0, y1).alias("miny"), F.greatest(x0, x1).alias("maxx"), F.greatest(y0, y1).alias("maxy"), (F.col("pixels") * F.lit(pixel_area(transform))).alias("area_m2"))
    return out.withColumn("wkt", F.format_string("POLYGON ((%.1f %.1f, %.1f %.1f, %.1f %.1f, %.1f %.1f, %.1f %.1f))", "minx", "miny", "maxx", "miny", "maxx", "maxy", "minx", "maxy", "minx", "miny"))


WAYS = [(1, 0), (0, 1), (-1, 0), (0, -1)]
PATHS = "array<struct<closed:boolean,sx:bigint,sy:bigint,d0:int,ex:bigint,ey:bigint,d1:int,points:array<struct<x:bigint,y:bigint>>>>"


def traced(edges: list[tuple[int, int, int]], tile: int) -> list[dict]:
    """Directed unit edges (x, y, way) that begin in one tile as closed rings and as paths that leave it, without points amid straight runs.

    Where four edges meet, a ring turns right. A path ends at the vertex of another tile where the next one begins;
    its first vertex counts as a corner, as what lies before it isn't known here.
    """
    out: dict[tuple[int, int], list[int]] = {}
    for x, y, d in edges:
        out.setdefault((x, y), []).append(d)
    after = {}
    for x, y, d in edges:
        to = x + WAYS[d][0], y + WAYS[d][1]
        if (to[0] // tile, to[1] // tile) == (x // tile, y // tile):
            options = out[to]
            after[x, y, d] = (*to, (d + 1) % 4 if (d + 1) % 4 in options else options[0])
    heads = set(edges) - set(after.values())
    done, found = set(), []
    for start in [*sorted(heads), *sorted(edges)]:
        if start in done:
            continue
        at, last, points = start, None, []
        while True:
            done.add(at)
            if at[2] != last:
                points.append(at[:2])
            last, ahead = at[2], after.get(at)
            if ahead is None or ahead == start:
                break
            at = ahead
        closed = ahead is not None
        if closed and last == start[2]:
            points = points[1:]
        end = at[0] + WAYS[last][0], at[1] + WAYS[last][1]
        found.append({"closed": closed, "sx": start[0], "sy": start[1], "d0": start[2], "ex": end[0], "ey": end[1], "d1": last, "points": [{"x": x, "y": y} for x, y in points]})
    return found


def ring_parts(paths: DataFrame, by: list[str], scratch: Scratch) -> DataFrame:
    """Paths (by, id, sx, sy, d0, ex, ey, d1, points) with the ring each is in and its place in it, by pointer jumping.

    A path is followed by the one that begins where it ends, to the right if there are two. Pointers double their reach
    until every path knows the least number of its ring; there the ring is cut, and doubling again counts the steps to its end.
    """
    heads = paths.select(*by, F.col("sx").alias("ex"), F.col("sy").alias("ey"), F.col("id").alias("next"), F.col("d0").alias("way"))
    meets = beside(paths.select(*by, "ex", "ey", "id", "d1"), heads, [*by, "ex", "ey"])
    links = meets.groupBy("id").agg(F.min_by("next", F.when(F.col("way") == (F.col("d1") + 1) % 4, 0).otherwise(1)).alias("next"))
    now = scratch.stored(links.select("id", "next", F.least("id", "next").alias("ring")))
    while True:
        far = now.select(F.col("id").alias("next"), F.col("next").alias("after"), F.col("ring").alias("low"))
        new = scratch.stored(now.join(far, "next").select("id", F.col("after").alias("next"), F.least("ring", "low").alias("ring"), (F.col("low") < F.col("ring")).alias("moved")))
        if new.where("moved").isEmpty():
            break
        now = new.drop("moved")
    rings = scratch.stored(links.join(now.select("id", "ring"), "id"))
    steps = scratch.stored(rings.select("id", F.when(F.col("next") != F.col("ring"), F.col("next")).alias("next"), F.when(F.col("next") != F.col("ring"), 1).otherwise(0).cast("long").alias("left")))
    while not steps.where("next IS NOT NULL").isEmpty():
        far = steps.select(F.col("id").alias("next"), F.col("next").alias("after"), F.col("left").alias("more"))
        steps = scratch.stored(steps.where("next IS NOT NULL").join(far, "next").select("id", F.col("after").alias("next"), (F.col("left") + F.col("more")).alias("left")).unionByName(steps.where("next IS NULL")))
    return paths.join(rings.select("id", "ring"), "id").join(steps.select("id", "left"), "id")


def polygons(labels: DataFrame, by: list[str], transform: Affine, tile: int | None = None) -> DataFrame:
    """Per segment its rings in map units (arrays of x, y; holes run the other way round), and area and perimeter of these.

    A pixel's side is part of a ring if the segment has it once. The sides of a segment in a tile are traced in one task;
    rings that cross tiles are put together from their paths, so only the corners of a ring, which are the
    result, come to one place.
    """
    tile = tile or TILE
    scratch = Scratch()
    key = [*by, "label"]
    c, r = F.col("c").cast("long"), F.col("r").cast("long")
    corner = [(c, r), (c + 1, r), (c + 1, r + 1), (c, r + 1)]
    # sides go round a pixel; the side between two pixels has one place, whichever pixel it comes from
    side = lambda k: F.struct(corner[k][0].alias("x"), corner[k][1].alias("y"), F.lit(k).alias("d"), F.least(corner[k][0], corner[(k + 1) % 4][0]).alias("px"), F.least(corner[k][1], corner[(k + 1) % 4][1]).alias("py"), F.lit(k % 2).alias("upright"))
    sides = labels.where("label > 0").select(*key, F.inline(F.array(*[side(k) for k in range(4)])))
    edges = sides.groupBy(*key, "px", "py", "upright").agg(F.count(F.lit(1)).alias("n"), F.first(F.struct("x", "y", "d")).alias("s")).where("n = 1").select(*key, "s.*")
    place = [F.floor(F.col(x) / F.lit(tile)).alias(f"tile_{x}") for x in "xy"]
    cells = edges.groupBy(*key, *place).agg(F.collect_list(F.struct("x", "y", "d")).alias("edges"))

    @F.arrow_udf(PATHS)
    def paths_of(x: pa.Array, y: pa.Array, d: pa.Array) -> pa.Array:
        kind = pa.struct([("closed", pa.bool_()), ("sx", pa.int64()), ("sy", pa.int64()), ("d0", pa.int32()), ("ex", pa.int64()), ("ey", pa.int64()), ("d1", pa.int32()), ("points", pa.list_(pa.struct([("x", pa.int64()), ("y", pa.int64())])))])
        return pa.array([traced(list(zip(*own, strict=True)), tile) for own in zip(x.to_pylist(), y.to_pylist(), d.to_pylist(), strict=True)], pa.list_(kind))

    paths = scratch.stored(cells.select(*key, F.inline(paths_of("edges.x", "edges.y", "edges.d"))).withColumn("id", F.monotonically_increasing_id()))
    whole = paths.where("closed").select(*key, "points")
    open_ = paths.where("NOT closed")
    if not open_.isEmpty():
        parts = ring_parts(open_.drop("closed"), key, scratch)
        joined_ = parts.groupBy(*key, "ring").agg(F.array_sort(F.collect_list(F.struct((-F.col("left")).alias("at"), "d0", "d1", "points"))).alias("ps"))
        # a joint that goes straight on is no corner
        before = lambda i: F.get("ps", F.when(i == 0, F.size("ps") - 1).otherwise(i - 1))["d1"]
        points = F.flatten(F.transform("ps", lambda p, i: F.when(before(i) == p["d0"], F.slice(p["points"], F.lit(2), F.size(p["points"]))).otherwise(p["points"])))
        whole = whole.unionByName(joined_.select(*key, points.alias("points")))
    # a ring begins at its least corner
    least = F.array_position("points", F.array_min("points")).cast("int")
    turned = F.concat(F.slice("points", least, F.size("points")), F.slice("points", F.lit(1), least))
    rings = whole.select(*key, turned.alias("points")).groupBy(*key).agg(F.array_sort(F.collect_list("points")).alias("points"))
    a, b, cc, d, e, f = transform
    put = lambda p: F.array(F.lit(a) * p["x"] + F.lit(b) * p["y"] + F.lit(cc), F.lit(d) * p["x"] + F.lit(e) * p["y"] + F.lit(f))
    out = rings.select(*key, F.transform("points", lambda ring: F.transform(ring, put)).alias("rings"))
    added = lambda ring, term: F.aggregate(F.sequence(F.lit(0), F.size(ring) - 2), F.lit(0.0), lambda t, i: t + term(F.get(ring, i), F.get(ring, i + 1)))
    area = F.abs(F.aggregate("rings", F.lit(0.0), lambda t, ring: t + added(ring, lambda p, q: (p[0] * q[1] - q[0] * p[1]) / 2.0)))
    length = F.aggregate("rings", F.lit(0.0), lambda t, ring: t + added(ring, lambda p, q: F.hypot(q[0] - p[0], q[1] - p[1])))
    return stored(out.withColumns({"area_m2": area, "perimeter_m": length}), then=scratch)


def box_features(boxes: DataFrame, zone: int | None = None, north: bool = True) -> DataFrame:
    """``boxes`` (minx, miny, maxx, maxy in map units) with ``feature``, a GeoJSON feature of the polygon.

    Its properties are those of score, area_m2 and label that there are. With a UTM zone the corners are put in degrees.
    """
    corner = lambda x, y: (lambda p: F.array(p["lon"], p["lat"]))(from_utm(F.col(x), F.col(y), zone, north)) if zone else F.array(F.col(x), F.col(y))
    ring = F.array(*[corner(x, y) for x, y in (("minx", "miny"), ("maxx", "miny"), ("maxx", "maxy"), ("minx", "maxy"), ("minx", "miny"))])
    shown = [c for c in ("score", "area_m2", "label") if c in boxes.columns]
    properties = F.struct(*shown) if shown else F.create_map().cast("map<string,string>")
    geometry = F.struct(F.lit("Polygon").alias("type"), F.array(ring).alias("coordinates"))
    return boxes.withColumn("feature", F.to_json(F.struct(F.lit("Feature").alias("type"), geometry.alias("geometry"), properties.alias("properties"))))


def map_boxes(boxes: DataFrame, transform: Affine) -> DataFrame:
    """Detected boxes (xmin, ymin, xmax, ymax in pixels) in map units, as minx, miny, maxx, maxy; other columns stay."""
    x0, y0 = map_x(F.col("ymin"), F.col("xmin"), transform), map_y(F.col("ymin"), F.col("xmin"), transform)
    x1, y1 = map_x(F.col("ymax"), F.col("xmax"), transform), map_y(F.col("ymax"), F.col("xmax"), transform)
    made = {"minx": F.least(x0, x1), "miny": F.least(y0, y1), "maxx": F.greatest(x0, x1), "maxy": F.greatest(y0, y1)}
    return boxes.withColumns(made).drop("xmin", "ymin", "xmax", "ymax")
