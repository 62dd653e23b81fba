"""Distances, bearings, boxes and grid cells on the sphere, in degrees and kilometres."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_KM = 6371.0088
COMPASS = ("N", "NE", "E", "SE", "S", "SW", "W", "NW")


def haversine_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Great-circle distance; null if a coordinate is null."""
    a, b = F.radians(lat1), F.radians(lat2)
    h = F.pow(F.sin((b - a) / 2), 2) + F.cos(a) * F.cos(b) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return F.when(h.isNotNull(), F.lit(2 * EARTH_KM) * F.asin(F.sqrt(F.least(F.lit(1.0), h))))


def bearing8(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """The eighth of the compass in which the second point lies; N for equal points."""
    a, b, d = F.radians(lat1), F.radians(lat2), F.radians(lon2 - lon1)
    y, x = F.sin(d) * F.cos(b), F.cos(a) * F.sin(b) - F.sin(a) * F.cos(b) * F.cos(d)
    at = F.floor((F.degrees(F.atan2(y, x)) + F.lit(382.5)) / 45) % 8
    return F.element_at(F.array(*[F.lit(x) for x in COMPASS]), (at + 1).cast("int"))


def distance_bucket(km: Column) -> Column:
    return F.when(km < 1, "0-1km").when(km < 5, "1-5km").when(km < 10, "5-10km").when(km < 20, "10-20km").when(km >= 20, "20+km")


def in_box(lat: Column, lon: Column, south: float, north: float, west: float, east: float, kind: str = "double") -> Column:
    """Both ends included. For float columns pass kind='float', so that the bounds are narrowed like the column."""
    s, n, w, e = (F.lit(x).cast(kind) for x in (south, north, west, east))
    return (lat >= s) & (lat <= n) & (lon >= w) & (lon <= e)


def cell_sizes(km: float, max_lat: float) -> tuple[float, float]:
    """Degrees of latitude and longitude that km never exceeds up to the latitude, a hair more."""
    lat = km / (EARTH_KM * math.pi / 180) * 1.000001
    return lat, lat / max(math.cos(math.radians(min(89.0, abs(max_lat) + lat))), 1e-3)
