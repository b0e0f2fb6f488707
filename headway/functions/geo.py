"""Distances on the sphere, walking times, and grid cells."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Metres of the Earth's radius and of a degree of latitude; walking speed, detour factor and least seconds.
EARTH_M, DEGREE_M = 6_371_000.0, 111_320.0
DETOUR, SPEED, LEAST_SECONDS = 1.3, 1.33, 60
#: How much larger than the radius a grid cell is, so that no pair within the radius is two cells apart.
MARGIN = 1.01


def haversine(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Metres between two points."""
    half = F.pow(F.sin(F.radians(lat2 - lat1) / 2), F.lit(2.0)) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), F.lit(2.0))
    return F.lit(2 * EARTH_M) * F.asin(F.sqrt(F.least(half, F.lit(1.0))))


def walk_seconds(metres: Column) -> Column:
    return F.greatest(F.lit(LEAST_SECONDS), (metres * DETOUR / SPEED).cast("int"))


def grid_sizes(radius_m: float, furthest_lat: float) -> tuple[float, float]:
    """Degrees of latitude and longitude that a cell needs for ``radius_m``, at the latitude where degrees of longitude are shortest."""
    return MARGIN * radius_m / DEGREE_M, MARGIN * radius_m / (DEGREE_M * max(math.cos(math.radians(min(89.0, furthest_lat))), 0.01))


def cell(lat: Column, lon: Column, sizes: tuple[float, float]) -> Column:
    return F.struct(F.floor(lat / sizes[0]).alias("y"), F.floor(lon / sizes[1]).alias("x"))


def cells_around(lat: Column, lon: Column, sizes: tuple[float, float]) -> Column:
    """The nine cells that hold all points within the radius."""
    steps = F.array(*[F.struct(F.lit(dy).alias("dy"), F.lit(dx).alias("dx")) for dy in (-1, 0, 1) for dx in (-1, 0, 1)])
    own = cell(lat, lon, sizes)
    return F.transform(steps, lambda s: F.struct((own["y"] + s["dy"]).alias("y"), (own["x"] + s["dx"]).alias("x")))


def metres_between(lat1: float, lon1: float, lat2: float, lon2: float) -> float:
    """haversine of numbers, for tasks that hold the points of a group."""
    half = math.sin(math.radians(lat2 - lat1) / 2) ** 2 + math.cos(math.radians(lat1)) * math.cos(math.radians(lat2)) * math.sin(math.radians(lon2 - lon1) / 2) ** 2
    return 2 * EARTH_M * math.asin(math.sqrt(min(half, 1.0)))
