"""Suppression of overlapping boxes over a whole picture: tiles settle what they see alone, rounds what several tiles see."""

from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import stored

CORNERS = ("xmin", "ymin", "xmax", "ymax")
# what a tile says of a box: a box that stays removes it; one that may stay would; nothing left in the tile outranks it; it stays
GONE, OPEN, CLEAR, KEPT = range(4)
# cells along a tile's side: few boxes of a cell's size lie in two tiles
TILE = 8
# boxes that are compared with all others of a tile in one step, and pairs of such a step at most
BLOCK, PAIRS = 32, 1 << 20


def overlap_shares(some: np.ndarray, others: np.ndarray) -> np.ndarray:
    """Intersection over union of each of some boxes with others, all columns of corners and area; boxes without area overlap nothing."""
    some = some[:, :, None]
    width, height = (np.maximum(np.minimum(some[hi], others[hi]) - np.maximum(some[lo], others[lo]), 0.0) for lo, hi in ((0, 2), (1, 3)))
    shared = width * height
    return np.divide(shared, some[4] + others[4] - shared, out=np.zeros_like(shared), where=shared > 0)


def tile_votes(corners: np.ndarray, taken: np.ndarray, alone: np.ndarray, most: float) -> np.ndarray:
    """What a tile says of its boxes, best first; ``taken`` ones stay by what all tiles said, ``alone`` ones no other tile sees."""
    votes = np.full(len(taken), CLEAR)
    left, at = np.arange(len(taken)), np.vstack([corners, (corners[2] - corners[0]) * (corners[3] - corners[1])])
    while left.size:
        head = left[: max(min(BLOCK, PAIRS // left.size), 1)]
        over = overlap_shares(at[:, : head.size], at) > most
        gone, waits = np.zeros(left.size, bool), votes[left] == OPEN
        for k, best in enumerate(head):
            if gone[k]:
                continue
            if taken[best] or (alone[best] and not waits[k]):
                votes[best] = KEPT
                gone[k + 1 :] |= over[k, k + 1 :]
            else:
                waits[k + 1 :] |= over[k, k + 1 :]
        votes[left[gone]] = GONE
        votes[left[waits & ~gone & (votes[left] != KEPT)]] = OPEN
        stay = ~gone
        stay[: head.size] = False
        left, at = left[stay], at[:, stay]
    return votes


def voted(rows: DataFrame, by: list[str], most: float, side: float) -> DataFrame:
    """``rows`` with what each of their tiles says (``standing``): boxes that stay once, others once per tile unless that tile alone removes them."""
    names = [c for c in rows.columns if c != "standing"]
    tile = [*by, "tile_x", "tile_y"]
    place = lambda c: F.floor(F.col(c).cast("double") / F.lit(side)).cast("long")
    dealt = rows.withColumn("tile_x", F.explode(F.sequence(place("xmin"), place("xmax")))).withColumn("tile_y", F.explode(F.sequence(place("ymin"), place("ymax"))))
    # repeated rows meet in their tiles, so that this exchange is the only one
    met = dealt.repartition(*tile).dropDuplicates()
    rank = Window.partitionBy(*tile).orderBy(F.col("score").cast("double").desc(), *[F.col(c).cast("double") for c in CORNERS], *[c for c in names if c not in (*by, *CORNERS)])
    met = met.withColumn("rank", F.row_number().over(rank))
    met = met.withColumn("alone", (place("xmin") == place("xmax")) & (place("ymin") == place("ymax"))).withColumn("first", (place("xmin") == F.col("tile_x")) & (place("ymin") == F.col("tile_y")))

    def settle(table: pa.Table) -> pa.Table:
        ranked = np.argsort(table["rank"].to_numpy())
        corners = np.stack([pc.cast(table[c], pa.float64()).to_numpy() for c in CORNERS])
        taken, alone, first = table["standing"].to_numpy() == KEPT, table["alone"].to_numpy(), table["first"].to_numpy()
        votes = np.empty(len(ranked), np.int32)
        votes[ranked] = tile_votes(corners[:, ranked], taken[ranked], alone[ranked], most)
        said = np.where(votes == KEPT, first, ~alone | (votes != GONE))
        return table.select(names).append_column("standing", pa.array(votes)).filter(pa.array(said))

    return met.groupBy(*tile).applyInArrow(settle, rows.select(*names, "standing").schema)


def suppressed(boxes: DataFrame, by: list[str] | None = None, most: float = 0.15, cell: float = 128.0) -> DataFrame:
    """The boxes (xmin, ymin, xmax, ymax, score, ...) that remain if the best one is taken again and again and those go that it overlaps by more than ``most``.

    Overlap is intersection over union, within the groups ``by``. Of equal scores the box that is first by its corners
    ranks first; repeated rows count once; a box with a null or an infinite or inverted corner, or a null score, is no box and goes.
    ``cell`` is about the side of a large box. Tiles of 8 x 8 cells settle by themselves what no other tile sees or waits
    for. Of the rest a round takes the boxes that nothing left outranks in any of their tiles, so there are as many rounds
    as a chain of boxes, each of which outranks and overlaps the next, goes on among those that several tiles see. Pairs
    are never written: a round moves the boxes that are still open, once per tile.
    """
    names = boxes.columns
    sound = F.col("score").isNotNull() & ~F.isnan("score")
    for lo, hi in (("xmin", "xmax"), ("ymin", "ymax")):
        sound = sound & (F.col(lo) <= F.col(hi)) & (F.abs(lo) < float("inf")) & (F.abs(hi) < float("inf"))
    rows = boxes.where(F.coalesce(sound, F.lit(False))).withColumn("standing", F.lit(OPEN))
    kept = []
    while True:
        # written, so that all that follows reads the same rows
        votes = stored(voted(rows, by or [], most, TILE * cell))
        kept.append(votes.where(F.col("standing") == KEPT).select(names))
        shared = votes.where(F.col("standing") < KEPT)
        if shared.isEmpty():
            return reduce(DataFrame.union, kept)
        # gone by one tile's word, taken by that of all
        rows = shared.groupBy(*names).agg(F.min("standing").alias("standing")).where(F.col("standing") > GONE).withColumn("standing", F.when(F.col("standing") == CLEAR, KEPT).otherwise(OPEN))
