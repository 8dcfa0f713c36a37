"""Geometry as built-in column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from transitframe.rules import EARTH_RADIUS_KM, MERCATOR_RADIUS_M


def haversine_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """GE1: great-circle distance."""
    dlat, dlon = F.radians(lat2) - F.radians(lat1), F.radians(lon2) - F.radians(lon1)
    half = F.pow(F.sin(dlat / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(dlon / 2), 2)
    return F.lit(2 * EARTH_RADIUS_KM) * F.atan2(F.sqrt(half), F.sqrt(F.lit(1.0) - half))


def mercator_x(lon: Column) -> Column:
    return F.radians(lon) * MERCATOR_RADIUS_M


def mercator_y(lat: Column) -> Column:
    return F.log(F.tan(F.radians(lat) / 2 + F.lit(0.7853981633974483))) * MERCATOR_RADIUS_M


def lon_of(x: Column) -> Column:
    return F.degrees(x / MERCATOR_RADIUS_M)


def lat_of(y: Column) -> Column:
    return F.degrees(F.atan(F.exp(y / MERCATOR_RADIUS_M)) * 2 - F.lit(1.5707963267948966))


def crosses(lon: Column, lat: Column, x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    """GE5: whether the ray east of the point meets an edge: half-open in y, inclusive in x; a vertical edge always counts."""
    at = (lat - y1) * (x2 - x1) / F.nullif(y2 - y1, F.lit(0.0)) + x1
    return (lat > F.least(y1, y2)) & (lat <= F.greatest(y1, y2)) & (lon <= F.greatest(x1, x2)) & ((x1 == x2) | (lon <= at))


def crosses_strict(lon: Column, lat: Column, x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    """GE7: the rule of shapes with holes: half-open at the other end, strict in x."""
    at = (x1 - x2) * (lat - y2) / F.nullif(y1 - y2, F.lit(0.0)) + x2
    return ((y2 > lat) != (y1 > lat)) & (lon < at)


def ring_contains(lon: Column, lat: Column, ring: Column) -> Column:
    """GE5: whether a ring, closed or not, holds the point; for many rings or points see ``operators.cells``."""
    edges = F.zip_with(
        ring, F.concat(F.slice(ring, 2, F.size(ring)), F.slice(ring, 1, 1)), lambda a, b: F.struct(a.alias("a"), b.alias("b"))
    )
    odd = lambda e: crosses(lon, lat, e["a"]["lon"], e["a"]["lat"], e["b"]["lon"], e["b"]["lat"])
    return F.size(F.filter(edges, odd)) % 2 == 1


def ring_area(ring: Column) -> Column:
    """GE11: shoelace area of a closed ring, for comparing sizes."""
    pairs = F.zip_with(
        F.slice(ring, 1, F.greatest(F.size(ring) - 1, F.lit(0))),
        F.slice(ring, 2, F.greatest(F.size(ring) - 1, F.lit(0))),
        lambda a, b: a["lon"] * b["lat"] - b["lon"] * a["lat"],
    )
    return F.abs(F.aggregate(pairs, F.lit(0.0), lambda acc, v: acc + v)) / 2
