"""Validity masks (true: keep). A mask is never NULL: an unknown value is invalid."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: scene classes that don't show the ground (nodata, saturated, shadow, clouds, cirrus, snow): fixed values
SCL_INVALID = (0, 1, 3, 8, 9, 10, 11)


def known(mask: Column) -> Column:
    return F.coalesce(mask, F.lit(False))


def bit(x: Column, n: int) -> Column:
    return F.getbit(x, F.lit(n)) == 1


def scl_valid(scl: Column) -> Column:
    return known(~scl.isin(*SCL_INVALID))


def qa_valid(qa: Column, cirrus: bool = True, shadow: bool = True, snow: bool = True) -> Column:
    """Clear bit set; fill, dilated cloud and cloud unset, and the chosen ones of cirrus, shadow and snow."""
    wrong = [0, 1, 3] + [b for b, on in ((2, cirrus), (4, shadow), (5, snow)) if on]
    out = bit(qa, 6)
    for b in wrong:
        out = out & ~bit(qa, b)
    return known(out)


def qa_collection_valid(qa: Column) -> Column:
    """The looser test of image collections: neither cloud nor cloud shadow."""
    return known(qa.bitwiseAND(F.lit(1 << 3 | 1 << 4)) == 0)


def cloud_probability_valid(probability: Column, below: float = 35) -> Column:
    return known(probability < below)


def bright_valid(blue: Column, threshold: float = 0.25) -> Column:
    return known(blue < threshold)


def apply_mask(df: DataFrame, mask: Column, bands: list[str]) -> DataFrame:
    """Every band becomes NULL where the mask doesn't hold."""
    return df.withColumns({b: F.when(mask, F.col(b)) for b in bands})


def cloud_fraction(mask: Column) -> Column:
    """Aggregate: share of invalid pixels."""
    return F.avg(F.when(mask, 0.0).otherwise(1.0))


def ndvi_or_zero(nir: Column, red: Column) -> Column:
    """NDVI for masks of segments: 0 where both bands together aren't above 0."""
    return F.when(nir + red > 0, (nir - red) / (nir + red + F.lit(1e-9))).otherwise(F.lit(0.0))
