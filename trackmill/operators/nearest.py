"""Nearest point of a coastline to each fix.

Within a feature (a line, or a single point) the nearest point is found in the flat latitude/longitude plane;
among features the one whose nearest point is closest on the sphere wins (ties: the smaller feature id). A fix
without any feature, or without a position on earth, keeps nulls.

A fix meets the few segments that its cell of a grid keeps (see grid.py) in one join by cell, and finds the nearest of
them within its own row: fixes are neither regrouped nor held against the whole coast, and nothing of the coastline
passes through the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.geo import haversine_m
from . import grid


def nearest_land(points: DataFrame, segments: DataFrame, size: float = grid.SIZE, few: int = grid.FEW_PARTS) -> DataFrame:
    """points plus nearest_land_lat and nearest_land_lon; segments: feature_id, seg_id, lat1, lon1, lat2, lon2 (null: a point).

    size, few: degrees of the grid's smallest cell and the segments up to which every square chooses among all, which only matter for speed.
    """
    met = grid.attach(points, segments, "feature_id", sphere=True, size=size, name="__land", few=few)
    return met.withColumns({"nearest_land_lat": F.col("__land.y"), "nearest_land_lon": F.col("__land.x")}).drop("__land")


def distance_to_land(points: DataFrame) -> DataFrame:
    return points.withColumn("distance_to_land", haversine_m(F.col("lat"), F.col("lon"), F.col("nearest_land_lat"), F.col("nearest_land_lon")))
