"""Spectral indices as Column expressions; nodata is NULL, and a zero denominator gives NULL."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def safe_divide(num: Column, den: Column) -> Column:
    return F.when(den != 0, num / den)


def clip(x: Column, low: float, high: float) -> Column:
    """NULL stays NULL; greatest and least alone would skip it."""
    return F.when(x.isNotNull(), F.least(F.greatest(x, F.lit(low)), F.lit(high)))


def ndvi(nir: Column, red: Column) -> Column:
    return safe_divide(nir - red, nir + red)


def evi(nir: Column, red: Column, blue: Column, gain: float = 2.5, c1: float = 6.0, c2: float = 7.5, l: float = 1.0) -> Column:
    return F.lit(gain) * safe_divide(nir - red, nir + F.lit(c1) * red - F.lit(c2) * blue + F.lit(l))


def evi2(nir: Column, red: Column, gain: float = 2.5, c: float = 2.4, l: float = 1.0) -> Column:
    return F.lit(gain) * safe_divide(nir - red, nir + F.lit(c) * red + F.lit(l))


def ndre(nir: Column, red_edge: Column) -> Column:
    return safe_divide(nir - red_edge, nir + red_edge)


def savi(nir: Column, red: Column, l: float = 0.5) -> Column:
    return safe_divide(nir - red, nir + red + F.lit(l)) * F.lit(1.0 + l)


def msavi2(nir: Column, red: Column) -> Column:
    t = F.lit(2.0) * nir + F.lit(1.0)
    inner = t * t - F.lit(8.0) * (nir - red)
    return (t - F.sqrt(F.when(inner.isNotNull(), F.greatest(inner, F.lit(0.0))))) / F.lit(2.0)


def ndwi(green: Column, nir: Column) -> Column:
    return safe_divide(green - nir, green + nir)


def mndwi(green: Column, swir1: Column) -> Column:
    return safe_divide(green - swir1, green + swir1)


def nbr(nir: Column, swir2: Column) -> Column:
    return safe_divide(nir - swir2, nir + swir2)


def lai(ndvi_: Column, method: str = "baret1991") -> Column:
    """Leaf area index from NDVI clipped to [0, 1]."""
    v = clip(ndvi_, 0.0, 1.0)
    if method == "baret1991":
        raw = -F.ln(F.when(v.isNotNull(), F.greatest((F.lit(0.69) - v) / F.lit(0.59), F.lit(1e-6)))) / F.lit(0.91)
    elif method == "chen1996":
        raw = F.lit(4.9) * v - F.lit(0.46)
    else:
        raise ValueError(f"unknown LAI method {method!r}")
    return F.when(raw.isNotNull(), F.greatest(raw, F.lit(0.0)))


def with_indices(df: DataFrame) -> DataFrame:
    """``df`` with every index that its band columns allow, in one projection."""
    have, c = set(df.columns), F.col
    made: dict[str, Column] = {}
    if {"nir", "red"} <= have:
        made |= {"ndvi": ndvi(c("nir"), c("red")), "savi": savi(c("nir"), c("red")), "msavi2": msavi2(c("nir"), c("red")), "evi2": evi2(c("nir"), c("red"))}
        made["lai"] = lai(made["ndvi"])
        if "blue" in have:
            made["evi"] = evi(c("nir"), c("red"), c("blue"))
    for name, f, a, b in (("ndre", ndre, "nir", "red_edge"), ("ndwi", ndwi, "green", "nir"), ("mndwi", mndwi, "green", "swir1"), ("nbr", nbr, "nir", "swir2")):
        if {a, b} <= have:
            made[name] = f(c(a), c(b))
    return df.withColumns(made)
