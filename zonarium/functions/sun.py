"""Sun, shadows and map projections as Column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_M = 6378137.0


def sun(lat: Column, lon: Column, day: Column, hour: Column) -> tuple[Column, Column]:
    """Elevation and azimuth in degrees (two decimals) at a full UTC hour of a day of the year."""
    g = 2 * math.pi / 365.0 * (day - 1 + (hour - 12) / 24.0)
    decl = 0.006918 - 0.399912 * F.cos(g) + 0.070257 * F.sin(g) - 0.006758 * F.cos(2 * g) + 0.000907 * F.sin(2 * g) - 0.002697 * F.cos(3 * g) + 0.001480 * F.sin(3 * g)
    minutes = 229.18 * (0.000075 + 0.001868 * F.cos(g) - 0.032077 * F.sin(g) - 0.014615 * F.cos(2 * g) - 0.040849 * F.sin(2 * g))
    angle = (hour * 60 + minutes + 4.0 * lon) / 4.0 - 180.0
    ha, la = F.radians(angle), F.radians(lat)
    s = F.sin(la) * F.sin(decl) + F.cos(la) * F.cos(decl) * F.cos(ha)
    elevation = F.degrees(F.asin(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), s))))
    c = (F.sin(decl) * F.cos(la) - F.cos(decl) * F.sin(la) * F.cos(ha)) / F.greatest(F.cos(F.radians(elevation)), F.lit(1e-10))
    west = F.degrees(F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), c))))
    return F.round(elevation, 2), F.round(F.when(angle > 0, 360.0 - west).otherwise(west), 2)


def facade_lit(azimuth: Column, elevation: Column, facade: Column, half: float = 45.0) -> Column:
    apart = F.abs(azimuth - facade) % 360.0
    return (elevation > 0.5) & (F.least(apart, 360.0 - apart) <= half)


def shadow_length(height: Column, elevation: Column) -> Column:
    return F.when(elevation > 0.5, height / F.tan(F.radians(elevation)))


def shadow_offset(height: Column, elevation: Column, azimuth: Column) -> tuple[Column, Column]:
    """Where the top of a vertical edge falls (metres east and north), away from the sun."""
    away = F.radians(azimuth + 180.0)
    length = shadow_length(height, elevation)
    return length * F.sin(away), length * F.cos(away)


def mercator(lon: Column, lat: Column) -> tuple[Column, Column]:
    return EARTH_M * F.radians(lon), EARTH_M * F.log(F.tan(F.lit(math.pi / 4) + F.radians(lat) / 2))


def from_mercator(x: Column, y: Column) -> tuple[Column, Column]:
    return F.degrees(x / EARTH_M), F.degrees(2 * F.atan(F.exp(y / EARTH_M)) - F.lit(math.pi / 2))


def tile_edge(z: Column, x: Column, y: Column) -> tuple[Column, Column]:
    """Longitude and latitude of a tile's north-west corner."""
    n = F.pow(F.lit(2.0), z)
    return x / n * 360.0 - 180.0, F.degrees(F.atan(F.sinh(math.pi * (1 - 2 * y / n))))


def utm29(lon: Column, lat: Column) -> tuple[Column, Column]:
    """Easting and northing in zone 29 north (central meridian 9 west), by the usual series."""
    a, e2, k0 = EARTH_M, 0.00669438002290, 0.9996
    ep = e2 / (1 - e2)
    la = F.radians(lat)
    n = a / F.sqrt(1 - e2 * F.pow(F.sin(la), 2))
    t, c = F.pow(F.tan(la), 2), ep * F.pow(F.cos(la), 2)
    d = F.cos(la) * F.radians(lon + 9.0)
    m = a * (
        (1 - e2 / 4 - 3 * e2**2 / 64 - 5 * e2**3 / 256) * la
        - (3 * e2 / 8 + 3 * e2**2 / 32 + 45 * e2**3 / 1024) * F.sin(2 * la)
        + (15 * e2**2 / 256 + 45 * e2**3 / 1024) * F.sin(4 * la)
        - (35 * e2**3 / 3072) * F.sin(6 * la)
    )
    east = k0 * n * (d + (1 - t + c) * F.pow(d, 3) / 6 + (5 - 18 * t + t * t + 72 * c - 58 * ep) * F.pow(d, 5) / 120) + 500000.0
    north = k0 * (m + n * F.tan(la) * (d * d / 2 + (5 - t + 9 * c + 4 * c * c) * F.pow(d, 4) / 24 + (61 - 58 * t + t * t + 600 * c - 330 * ep) * F.pow(d, 6) / 720))
    return east, north


def metric_crs(lon: Column) -> Column:
    """The metric reference system of a longitude."""
    return F.when(lon <= -6.0, "EPSG:25829").otherwise("EPSG:25830")
