"""Pixel places, map coordinates and the transverse Mercator zones of WGS 84, as Column expressions."""

from collections.abc import Callable
from math import pi, sqrt

from pyspark.sql import Column
from pyspark.sql import functions as F

Affine = tuple[float, float, float, float, float, float]


def bound(value: Column, function: Callable[[Column], Column]) -> Column:
    """``function`` of a value that is worked out once, however often the function names it."""
    return F.element_at(F.transform(F.array(value), function), 1)


def map_x(row: Column, col: Column, t: Affine) -> Column:
    a, b, c, _, _, _ = t
    return F.lit(a) * col + F.lit(b) * row + F.lit(c)


def map_y(row: Column, col: Column, t: Affine) -> Column:
    _, _, _, d, e, f = t
    return F.lit(d) * col + F.lit(e) * row + F.lit(f)


def inverse(t: Affine) -> Affine:
    """From map coordinates to (column, row)."""
    a, b, c, d, e, f = t
    det = a * e - b * d
    return e / det, -b / det, (b * f - c * e) / det, -d / det, a / det, (c * d - a * f) / det


def pixel_area(t: Affine) -> float:
    return abs(t[0] * t[4])


def bbox_centre(bbox: Column) -> Column:
    """Struct lat, lon of the middle of a struct min_lon, min_lat, max_lon, max_lat."""
    return F.struct(((bbox["min_lat"] + bbox["max_lat"]) / F.lit(2.0)).alias("lat"), ((bbox["min_lon"] + bbox["max_lon"]) / F.lit(2.0)).alias("lon"))


#: ellipsoid, scale and false origin of the zones: fixed values
MAJOR, FLATTENING = 6378137.0, 1 / 298.257223563
SCALE, FALSE_EAST, FALSE_NORTH = 0.9996, 500000.0, 10000000.0
#: Krueger's series to the third power of the third flattening
N = FLATTENING / (2 - FLATTENING)
RADIUS = MAJOR / (1 + N) * (1 + N**2 / 4 + N**4 / 64)
ALPHA = (N / 2 - 2 * N**2 / 3 + 5 * N**3 / 16, 13 * N**2 / 48 - 3 * N**3 / 5, 61 * N**3 / 240)
BETA = (N / 2 - 2 * N**2 / 3 + 37 * N**3 / 96, N**2 / 48 + N**3 / 15, 17 * N**3 / 480)
DELTA = (2 * N - 2 * N**2 / 3 - 2 * N**3, 7 * N**2 / 3 - 8 * N**3 / 5, 56 * N**3 / 15)


def _meridian(zone: int | Column) -> Column:
    return (zone * F.lit(6.0) - F.lit(183.0)) * F.lit(pi / 180) if isinstance(zone, Column) else F.lit((6 * zone - 183) * pi / 180)


def _northing(north: bool | Column) -> Column:
    return F.when(north, F.lit(0.0)).otherwise(F.lit(FALSE_NORTH)) if isinstance(north, Column) else F.lit(0.0 if north else FALSE_NORTH)


def to_utm(lon: Column, lat: Column, zone: int | Column, north: bool | Column = True) -> Column:
    """Struct x, y in metres of a place in degrees."""
    e = 2 * sqrt(N) / (1 + N)
    away = F.radians(lon) - _meridian(zone)
    tangent = lambda s: F.sinh(F.atanh(s) - F.lit(e) * F.atanh(F.lit(e) * s))
    sphere = lambda q: F.struct(F.atan2(q["t"], F.cos(q["away"])).alias("xi"), F.atanh(F.sin(q["away"]) / F.sqrt(F.lit(1.0) + q["t"] * q["t"])).alias("eta"))

    def place(q: Column) -> Column:
        x, y = q["eta"], q["xi"]
        for j, a in enumerate(ALPHA, 1):
            x = x + F.lit(a) * F.cos(q["xi"] * (2 * j)) * F.sinh(q["eta"] * (2 * j))
            y = y + F.lit(a) * F.sin(q["xi"] * (2 * j)) * F.cosh(q["eta"] * (2 * j))
        return F.struct((F.lit(FALSE_EAST) + F.lit(SCALE * RADIUS) * x).alias("x"), (_northing(north) + F.lit(SCALE * RADIUS) * y).alias("y"))

    return bound(bound(F.struct(bound(F.sin(F.radians(lat)), tangent).alias("t"), away.alias("away")), sphere), place)


def from_utm(x: Column, y: Column, zone: int | Column, north: bool | Column = True) -> Column:
    """Struct lon, lat in degrees of a place in a zone."""

    def sphere(q: Column) -> Column:
        xi0, eta0 = q["xi"], q["eta"]
        for j, b in enumerate(BETA, 1):
            xi0 = xi0 - F.lit(b) * F.sin(q["xi"] * (2 * j)) * F.cosh(q["eta"] * (2 * j))
            eta0 = eta0 - F.lit(b) * F.cos(q["xi"] * (2 * j)) * F.sinh(q["eta"] * (2 * j))
        return F.struct(xi0.alias("xi0"), eta0.alias("eta0"))

    def place(q: Column) -> Column:
        def latitude(chi: Column) -> Column:
            lat = chi
            for j, d in enumerate(DELTA, 1):
                lat = lat + F.lit(d) * F.sin(chi * (2 * j))
            return lat

        lon = F.degrees(_meridian(zone) + F.atan2(F.sinh(q["eta0"]), F.cos(q["xi0"])))
        return F.struct(lon.alias("lon"), F.degrees(bound(F.asin(F.sin(q["xi0"]) / F.cosh(q["eta0"])), latitude)).alias("lat"))

    start = F.struct(((y - _northing(north)) / F.lit(SCALE * RADIUS)).alias("xi"), ((x - F.lit(FALSE_EAST)) / F.lit(SCALE * RADIUS)).alias("eta"))
    return bound(bound(start, sphere), place)
