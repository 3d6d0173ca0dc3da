"""Geographic helpers. Distances are great circles on a sphere of 6 371 000 m."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

RADIUS = 6_371_000.0


def distance(lat: Column, lng: Column, to_lat: float, to_lng: float) -> Column:
    """Haversine distance in metres."""
    a = F.radians(lat)
    b, c = math.radians(to_lat), math.radians(to_lng)
    h = F.pow(F.sin((a - b) / 2), 2) + F.cos(a) * math.cos(b) * F.pow(F.sin((F.radians(lng) - c) / 2), 2)
    return F.asin(F.sqrt(F.least(F.lit(1.0), h))) * (2 * RADIUS)


def distance_between(a: tuple[float, float], b: tuple[float, float]) -> float:
    p, q = math.radians(a[0]), math.radians(b[0])
    h = math.sin((p - q) / 2) ** 2 + math.cos(p) * math.cos(q) * math.sin(math.radians(a[1] - b[1]) / 2) ** 2
    return 2 * RADIUS * math.asin(math.sqrt(min(1.0, h)))


def lat_lng_to_xyz(lat: float, lng: float) -> tuple[float, float, float]:
    a, b = math.radians(lat), math.radians(lng)
    return math.cos(a) * math.cos(b), math.cos(a) * math.sin(b), math.sin(a)


#: DuckDB twin of ``distance``.
SQL = "2 * 6371000.0 * asin(sqrt(least(1.0, pow(sin((radians({lat}) - radians({to_lat})) / 2), 2) + cos(radians({lat})) * cos(radians({to_lat})) * pow(sin((radians({lng}) - radians({to_lng})) / 2), 2))))"
