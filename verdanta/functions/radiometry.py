"""Digital numbers to reflectance, and values to colours."""

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .indices import clip

#: gain and offset of Collection 2 Level 2: fixed values
OPTICAL = (0.0000275, -0.2)
THERMAL = (0.00341802, 149.0)


def dn_to_reflectance(dn: Column, gain: float, offset: float) -> Column:
    return clip((dn * F.lit(gain) + F.lit(offset)) / F.lit(10000.0), 0.0, 1.0)


def scale_sentinel2(df: DataFrame, bands: list[str]) -> DataFrame:
    return df.withColumns({b: F.col(b) / F.lit(10000.0) for b in bands})


def scale_landsat(df: DataFrame) -> DataFrame:
    """Columns named SR_B and one sign are optical, ST_B and any thermal; others stay."""
    made = {}
    for pattern, (gain, offset) in ((r"SR_B.", OPTICAL), (r"ST_B.*", THERMAL)):
        made |= {c: F.col(c) * F.lit(gain) + F.lit(offset) for c in df.columns if re.fullmatch(pattern, c)}
    return df.withColumns(made)


#: the public red-yellow-green colour map, 11 stops at tenths: fixed values
STOPS = ((165, 0, 38), (215, 48, 39), (244, 109, 67), (253, 174, 97), (254, 224, 139), (255, 255, 191), (217, 239, 139), (166, 217, 106), (102, 189, 99), (26, 152, 80), (0, 104, 55))
LEVELS = 256


def ndvi_rgba(value: Column, low: float = 0.0, high: float = 0.9) -> Column:
    """Struct r, g, b, a of a value on the colour map, of which ``LEVELS`` colours are used; NULL is transparent."""
    t = clip((value - F.lit(low)) / F.lit(high - low), 0.0, 1.0)
    place = F.least(F.floor(t * LEVELS), F.lit(LEVELS - 1)) * F.lit(10) / F.lit(float(LEVELS - 1))
    k = F.least(F.floor(place), F.lit(9)).cast("int")

    def channel(c: int) -> Column:
        stops = F.array(*[F.lit(float(s[c])) for s in STOPS])
        lower, upper = F.get(stops, k), F.get(stops, k + 1)
        # a whisker up, so that whole numbers stay whole
        return F.coalesce(F.floor(lower + (place - k) * (upper - lower) + F.lit(1e-9)).cast("int"), F.lit(0))

    return F.struct(*[channel(c).alias(n) for c, n in enumerate("rgb")], F.when(t.isNull(), 0).otherwise(255).alias("a"))


def change_rgba(gain: Column, loss: Column) -> Column:
    """Loss red over gain green, both at alpha 165; else transparent."""
    pick = lambda l, g: F.when(loss, l).when(gain, g).otherwise(0)
    return F.struct(pick(220, 0).alias("r"), pick(0, 200).alias("g"), pick(0, 0).alias("b"), pick(165, 165).alias("a"))
