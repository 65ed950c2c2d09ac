"""Geometry as column expressions, on a sphere or in the flat latitude/longitude plane."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_RADIUS_M = 6_371_000.0


def haversine_m(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Great-circle distance in metres; null if any coordinate is."""
    half_lat, half_lon = F.radians(lat2 - lat1) / 2, F.radians(lon2 - lon1) / 2
    chord = F.pow(F.sin(half_lat), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(half_lon), 2)
    return F.asin(F.sqrt(F.when(chord > 1, 1.0).otherwise(chord))) * (2 * EARTH_RADIUS_M)


def flat_distance(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Distance in degrees, as if latitude and longitude were a plane."""
    return F.sqrt(F.pow(lat2 - lat1, 2) + F.pow(lon2 - lon1, 2))


def mercator(lat: Column, lon: Column) -> tuple[Column, Column]:
    """x (eastward) and y (southward) of Mercator's projection, in radians."""
    return F.radians(lon), -F.ln(F.tan(F.lit(math.pi / 4) + F.radians(lat) / 2))


def hex_cell(x: Column, y: Column, radius: float) -> tuple[Column, Column]:
    """Axial coordinates (q, r) of the pointy-top hexagon whose centre is nearest to (x, y): cube rounding."""
    q, r = (x * (math.sqrt(3) / 3) - y / 3) / radius, y * (2 / 3) / radius
    s = -q - r
    rq, rr, rs = F.rint(q), F.rint(r), F.rint(s)
    dq, dr, ds = F.abs(rq - q), F.abs(rr - r), F.abs(rs - s)
    col = F.when((dq > dr) & (dq > ds), -rr - rs).otherwise(rq)
    row = F.when((dq > dr) & (dq > ds), rr).when(dr > ds, -rq - rs).otherwise(rr)
    return col.cast("long"), row.cast("long")


def compass_point(degrees: Column, n: int = 16) -> Column:
    """Name of the nearest of 16, 8 or (any other n) 4 compass points."""
    # The names of the points.
    names = {16: "N NNE NE ENE E ESE SE SSE S SSW SW WSW W WNW NW NNW", 8: "N NE E SE S SW W NW"}.get(n, "N E S W").split()
    index = F.pmod(F.floor(wrap360(degrees) / (360 / len(names)) + 0.5), F.lit(len(names)))
    return F.element_at(F.array(*[F.lit(x) for x in names]), (index + 1).cast("int"))


def wrap360(degrees: Column) -> Column:
    return F.pmod(degrees.cast("double"), F.lit(360.0))
