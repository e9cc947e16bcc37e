"""Distances, polygons and boxes as columns. A ring is an array of struct(lon, lat), a polygon an array
of rings of which all but the first are holes, a multipolygon an array of polygons."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_M = 6_371_000


def metres(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Great-circle distance (haversine), unrounded."""
    half = lambda a, b: F.pow(F.sin(F.radians(b - a) / 2), 2)
    h = half(lat1, lat2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * half(lon1, lon2)
    return 2 * EARTH_M * F.asin(F.sqrt(F.when(h > 1, 1.0).otherwise(h)))  # null if a coordinate is


def in_ring(lon: Column, lat: Column, ring: Column) -> Column:
    """Even-odd rule: whether a ray to the east crosses the ring's edges an odd number of times. The
    last point is joined to the first."""
    edges = F.arrays_zip(ring.alias("a"), F.concat(F.slice(ring, 2, F.greatest(F.size(ring), F.lit(1))), F.slice(ring, 1, 1)).alias("b"))

    def crosses(e: Column) -> Column:
        a, b = e["a"], e["b"]
        spans = (a["lat"] > lat) != (b["lat"] > lat)
        at = (b["lon"] - a["lon"]) * (lat - a["lat"]) / F.nullif(b["lat"] - a["lat"], F.lit(0.0)) + a["lon"]
        return F.coalesce(spans & (lon < at), F.lit(False))

    return F.size(F.filter(edges, crosses)) % 2 == 1


def in_polygon(lon: Column, lat: Column, polygon: Column) -> Column:
    """In the first ring and in none of the others."""
    holes = F.slice(polygon, 2, F.greatest(F.size(polygon), F.lit(1)))
    return in_ring(lon, lat, F.get(polygon, F.lit(0))) & ~F.exists(holes, lambda r: in_ring(lon, lat, r))


def in_multipolygon(lon: Column, lat: Column, polygons: Column) -> Column:
    return F.exists(polygons, lambda p: in_polygon(lon, lat, p))


def bounding_box(polygons: Column, padding: float = 0.0) -> Column:
    """struct(west, south, east, north) of a multipolygon, wider by a padding on all sides."""
    points = F.flatten(F.flatten(polygons))
    edge = lambda pick, field, by: pick(F.transform(points, lambda p: p[field])) + by
    return F.struct(edge(F.array_min, "lon", -padding).alias("west"), edge(F.array_min, "lat", -padding).alias("south"), edge(F.array_max, "lon", padding).alias("east"), edge(F.array_max, "lat", padding).alias("north"))
