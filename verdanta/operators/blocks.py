"""Functions of whole neighbourhoods, applied block by block with borders from the neighbouring blocks."""

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def map_blocks(df: DataFrame, by: list[str], function: Callable[[np.ndarray], np.ndarray], bands: list[str], names: list[str], halo: int = 0, block: int = 512, fill: float = float("nan")) -> DataFrame:
    """(by, r, c, names) of pixels (by, r, c, bands): what ``function`` makes of arrays, for any size of picture.

    ``function`` gets (bands, height, width) of a block and ``halo`` pixels around it and returns (names, height, width); a pixel
    that there isn't, or that has NULL, is ``fill`` in the array, and NaN comes back as NULL. If it looks no farther than
    ``halo``, the result is that of the whole picture at once. Every pixel is in one block's core and goes to at most
    three others' halos, so a shuffle moves the picture a little over once; a task holds one block at a time.
    Pictures may begin anywhere, also at negative rows; repeated pixels of one place count once.
    """
    if not 0 <= 2 * halo <= block:
        raise ValueError("halo must be at most half a block")

    def blocks_of(x: str) -> Column:
        own, at = F.floor(F.col(x) / F.lit(block)).cast("long"), F.pmod(F.col(x), F.lit(block))
        near = F.when(at < halo, F.array(own, own - 1)).when(at >= block - halo, F.array(own, own + 1)).otherwise(F.array(own))
        return F.explode(near)

    rows = df.select(*by, F.col("r").cast("long").alias("r"), F.col("c").cast("long").alias("c"), *[F.col(b).cast("double").alias(b) for b in bands])
    spread = rows.withColumn("block_r", blocks_of("r")).withColumn("block_c", blocks_of("c"))
    kinds = ", ".join([*[f"`{c}` {t}" for c, t in df.dtypes if c in by], "r bigint", "c bigint", *[f"`{n}` double" for n in names]])
    order = [c for c, _ in df.dtypes if c in by]

    def run(key: tuple, pixels: pd.DataFrame) -> pd.DataFrame:
        top, left = key[-2] * block - halo, key[-1] * block - halo
        r, c = pixels["r"].to_numpy() - top, pixels["c"].to_numpy() - left
        core = (r >= halo) & (r < block + halo) & (c >= halo) & (c < block + halo)
        out = pd.DataFrame({n: pd.Series(dtype=object) for n in [*order, "r", "c", *names]})
        if not core.any():
            return out
        # no larger than the block's pixels need
        r0, c0 = r.min(), c.min()
        held = np.full((len(bands), r.max() - r0 + 1, c.max() - c0 + 1), fill)
        values = pixels[bands].to_numpy(dtype=np.float64).T
        held[:, r - r0, c - c0] = np.where(np.isnan(values), fill, values)
        made = np.asarray(function(held), np.float64)
        if made.shape != (len(names), *held.shape[1:]):
            raise ValueError(f"the function returned {made.shape} for {held.shape}")
        spots = np.unique(r[core] * (block + 2 * halo) + c[core])
        r, c = spots // (block + 2 * halo), spots % (block + 2 * halo)
        told = made[:, r - r0, c - c0]
        columns = dict(zip(by, (pd.Series([k] * len(r), dtype=object) for k in key[:-2]), strict=True))
        columns |= {"r": r + top, "c": c + left}
        columns |= {n: pd.Series(told[i]).astype(object).where(~np.isnan(told[i]), None) for i, n in enumerate(names)}
        return pd.DataFrame(columns)[[*order, "r", "c", *names]]

    return spread.groupBy(*by, "block_r", "block_c").applyInPandas(run, kinds).select(*by, "r", "c", *names)
