"""Rounding, parsing, classes, formats and projections of numbers, as columns."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The GRS80 ellipsoid and the projection of the Polish plane system 1992.
AXIS, FLAT, LON0, SCALE, EAST, NORTH = 6378137.0, 1 / 298.257222101, 19.0, 0.9993, 500000.0, -5300000.0
_N = FLAT / (2 - FLAT)
RADIUS = AXIS / (1 + _N) * (1 + _N**2 / 4 + _N**4 / 64)
FORWARD = (_N / 2 - 2 * _N**2 / 3 + 5 * _N**3 / 16, 13 * _N**2 / 48 - 3 * _N**3 / 5, 61 * _N**3 / 240)
BACKWARD = (_N / 2 - 2 * _N**2 / 3 + 37 * _N**3 / 96, _N**2 / 48 + _N**3 / 15, 17 * _N**3 / 480)
LATITUDE = (2 * _N - 2 * _N**2 / 3 - 2 * _N**3, 7 * _N**2 / 3 - 8 * _N**3 / 5, 56 * _N**3 / 15)
_E = 2 * math.sqrt(_N) / (1 + _N)


def to_plane(lon: Column, lat: Column) -> tuple[Column, Column]:
    """Longitude and latitude in degrees as easting and northing of the plane system 1992, by Krüger's series."""
    phi, lam = F.radians(lat), F.radians(lon - LON0)
    atanh = lambda v: 0.5 * F.log((1 + v) / (1 - v))
    t = F.sinh(atanh(F.sin(phi)) - _E * atanh(_E * F.sin(phi)))
    xi, eta = F.atan2(t, F.cos(lam)), atanh(F.sin(lam) / F.sqrt(1 + t * t))
    north, east = xi, eta
    for j, a in enumerate(FORWARD, 1):
        north = north + a * F.sin(2 * j * xi) * F.cosh(2 * j * eta)
        east = east + a * F.cos(2 * j * xi) * F.sinh(2 * j * eta)
    return EAST + SCALE * RADIUS * east, NORTH + SCALE * RADIUS * north


def to_degrees(x: Column, y: Column) -> tuple[Column, Column]:
    """Easting and northing as longitude and latitude in degrees."""
    xi0, eta0 = (y - NORTH) / (SCALE * RADIUS), (x - EAST) / (SCALE * RADIUS)
    xi, eta = xi0, eta0
    for j, b in enumerate(BACKWARD, 1):
        xi = xi - b * F.sin(2 * j * xi0) * F.cosh(2 * j * eta0)
        eta = eta - b * F.cos(2 * j * xi0) * F.sinh(2 * j * eta0)
    chi = F.asin(F.sin(xi) / F.cosh(eta))
    phi = chi
    for j, d in enumerate(LATITUDE, 1):
        phi = phi + d * F.sin(2 * j * chi)
    return LON0 + F.degrees(F.atan2(F.sinh(eta), F.cos(xi))), F.degrees(phi)


def even(c: Column, digits: int = 0) -> Column:
    """Rounded half to even, minus zero as zero."""
    return F.bround(c, digits) + F.lit(0.0)


def positive_int(c: Column) -> Column:
    """A whole number above 0 from text; anything else is null."""
    n = F.trim(c).try_cast("bigint")
    return F.when(n > 0, n)


def version_of(c: Column) -> Column:
    """A version such as `2024-05-01T10:00:00Z`, `20240501` or `01.05.2024` as a timestamp; anything else is null."""
    return F.coalesce(F.try_to_timestamp(c), F.try_to_timestamp(c, F.lit("yyyyMMdd")), F.try_to_timestamp(c, F.lit("dd.MM.yyyy")))


def return_period(years: Column) -> Column:
    """Flood probability class of a return period in years."""
    return F.when(years.isNull() | (years <= 0), "unknown").when(years <= 10, "high").when(years <= 100, "medium").when(years <= 500, "low").otherwise("extreme")


def age_label(seconds: Column) -> Column:
    """An age in words: minutes below an hour, hours below two days, else days."""
    n = lambda by, unit: F.concat(F.floor(seconds / by).cast("string"), F.lit(unit))
    return F.when(seconds.isNull() | (seconds < 0), "unknown").when(seconds < 3600, n(60, " min")).when(seconds < 172800, n(3600, " h")).otherwise(n(86400, " d"))


def area_label(sqm: Column) -> Column:
    """An area as m² below one hectare, else as ha."""
    return F.when(sqm < 10000, F.concat(F.format_number(F.bround(sqm, 1), 1), F.lit(" m²"))).otherwise(F.concat(F.format_number(F.bround(sqm / 10000, 2), 2), F.lit(" ha")))


def theme_class(value: Column, breaks: Sequence[float]) -> Column:
    """The number of breaks at or below a value; null for null or negative values."""
    out = F.lit(0)
    for i, b in enumerate(sorted(breaks), 1):
        out = F.when(value >= b, i).otherwise(out)
    return F.when(value.isNotNull() & (value >= 0), out)


def by_alias(props: Column, aliases: Sequence[str]) -> Column:
    """The first non-empty value under one of several names, compared without case."""
    low = F.map_from_entries(F.array_sort(F.transform(F.map_entries(props), lambda e: F.struct(F.lower(e["key"]).alias("k"), e["value"].alias("v")))))
    return F.coalesce(*(F.nullif(F.trim(low[a.lower()]), F.lit("")) for a in aliases))


def snapped(x0: Column, y0: Column, x1: Column, y1: Column, step: float) -> tuple[Column, ...]:
    """A box moved outwards to a grid."""
    return F.floor(x0 / step) * step, F.floor(y0 / step) * step, F.ceil(x1 / step) * step, F.ceil(y1 / step) * step


#: Fixed value: half the width of the web-mercator square.
HALF = math.pi * 6378137.0


def tile_envelope(z: Column, x: Column, y: Column) -> tuple[Column, ...]:
    """x0, y0, x1, y1 of a tile in web mercator."""
    size = 2 * HALF / F.pow(F.lit(2.0), z)
    return x * size - HALF, HALF - (y + 1) * size, (x + 1) * size - HALF, HALF - y * size


def affine(m: Sequence[float], x: Column, y: Column) -> tuple[Column, Column]:
    """(a, b, c, d, e, f): x' = a x + b y + c, y' = d x + e y + f."""
    a, b, c, d, e, f = m
    return a * x + b * y + c, d * x + e * y + f
