"""Walking: footpaths between stops, and stops near points."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geo import LEAST_SECONDS, cell, cells_around, grid_sizes, haversine, walk_seconds
from ..storage import Scratch

MAX_WALK_M, ACCESS_WALK_M, ACCESS_STOPS = 400.0, 800.0, 8
#: Stops of a grid cell that are one key of a join, and how often a cell is cut into quarters at most.
CROWDED, MOST_QUARTERS = 2000, 6
#: Degrees that a feed's bounds are padded with.
PAD = 0.15


def placed(stops: DataFrame) -> DataFrame:
    """Stops with coordinates.  NaN is above every number to Spark, so it is filtered by name."""
    return stops.filter(~F.isnan("lat") & ~F.isnan("lon"))


def furthest_lat(stops: DataFrame) -> float:
    return placed(stops).agg(F.max(F.abs("lat"))).first()[0] or 0.0


def within(probes: DataFrame, points: DataFrame, radius_m: float, furthest: float, crowded: int = CROWDED) -> DataFrame:
    """probes (lat, lon, ...) and points (lat2, lon2, ...) within radius_m of each other, with their ``metres``.

    A probe meets the points in its own and the eight neighbouring cells of a
    grid by an equi-join.  Cells with more than ``crowded`` points are cut
    into quarters, as often as their count asks for, and a probe meets those
    parts of them that its radius reaches.
    """
    sizes, scratch = grid_sizes(radius_m, furthest), Scratch(probes.sparkSession, "within")
    points = points.withColumn("cell", cell(F.col("lat2"), F.col("lon2"), sizes))
    probes = probes.withColumn("cell", F.explode(cells_around(F.col("lat"), F.col("lon"), sizes)))
    full = points.groupBy("cell").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > crowded)
    levels = scratch.write(full.select("cell", F.least(F.ceil(F.log2(F.col("n") / crowded) / 2), F.lit(MOST_QUARTERS)).cast("int").alias("level")))
    keys = ["cell"]
    if not levels.isEmpty():
        parts = F.pow(F.lit(2.0), F.col("level"))
        place = lambda x, axis, size: (F.col(x) / size - F.col(f"cell.{axis}")) * parts
        whole = F.struct(F.lit(0).cast("long").alias("y"), F.lit(0).cast("long").alias("x"))
        own = F.struct(F.floor(place("lat2", "y", sizes[0])).alias("y"), F.floor(place("lon2", "x", sizes[1])).alias("x"))
        points = points.join(levels, "cell", "left").withColumn("part", F.when(F.col("level").isNotNull(), own).otherwise(whole)).drop("level")

        def reached(x: str, axis: str, size: float) -> Column:
            """The numbers of the parts along one axis that are within a cell's size of the probe."""
            at, last = place(x, axis, size), parts - 1
            low, high = F.greatest(F.floor(at - parts), F.lit(0)).cast("long"), F.least(F.floor(at + parts), last).cast("long")
            return F.when(low <= high, F.sequence(low, high)).otherwise(F.expr("cast(array() as array<bigint>)"))

        ys, xs = reached("lat", "y", sizes[0]), reached("lon", "x", sizes[1])
        met = F.flatten(F.transform(ys, lambda y: F.transform(xs, lambda x: F.struct(y.alias("y"), x.alias("x")))))
        probes = probes.join(levels, "cell", "left").withColumn("part", F.explode(F.when(F.col("level").isNotNull(), met).otherwise(F.array(whole)))).drop("level")
        keys = ["cell", "part"]
    metres = haversine(F.col("lat"), F.col("lon"), F.col("lat2"), F.col("lon2"))
    # Sorted and merged: Spark takes the probes for as small as before each was listed under nine cells, and would broadcast them.
    return probes.hint("merge").join(points, keys).withColumn("metres", metres).filter(F.col("metres") <= radius_m).drop(*keys)


def generated_footpaths(stops: DataFrame, max_walk_m: float = MAX_WALK_M, crowded: int = CROWDED) -> DataFrame:
    """(from_stop, to_stop, seconds) of all pairs of different stops within max_walk_m of each other."""
    here = placed(stops).select("stop_id", "lat", "lon")
    near = here.select(F.col("stop_id").alias("to_stop"), F.col("lat").alias("lat2"), F.col("lon").alias("lon2"))
    pairs = within(here.withColumnRenamed("stop_id", "from_stop"), near, max_walk_m, furthest_lat(stops), crowded)
    return pairs.filter(F.col("from_stop") != F.col("to_stop")).select("from_stop", "to_stop", walk_seconds(F.col("metres")).alias("seconds"))


def footpaths(stops: DataFrame, declared: DataFrame, max_walk_m: float = MAX_WALK_M) -> DataFrame:
    """Generated footpaths, each replaced by a declared transfer of its direction if there is one; declared ones of any length are added."""
    own = declared.select("from_stop", "to_stop", F.greatest("seconds", F.lit(LEAST_SECONDS)).cast("int").alias("declared"))
    both = generated_footpaths(stops, max_walk_m).join(own, ["from_stop", "to_stop"], "full_outer")
    return both.select("from_stop", "to_stop", F.coalesce("declared", "seconds").alias("seconds"))


def walkable_from(points: DataFrame, stops: DataFrame, radius_m: float = ACCESS_WALK_M, limit: int = ACCESS_STOPS, crowded: int = CROWDED) -> DataFrame:
    """(point_id, stop_id, rank, seconds): the nearest boardable stops of each point (point_id, lat, lon), ranked from 1.

    Points at one place are answered once.
    """
    furthest = max(furthest_lat(stops), points.agg(F.max(F.abs("lat"))).first()[0] or 0.0)
    near = placed(stops).filter("location_type = 0").select("stop_id", F.col("lat").alias("lat2"), F.col("lon").alias("lon2"))
    found = within(points.select("lat", "lon").distinct(), near, radius_m, furthest, crowded)
    ranked = found.withColumn("rank", F.row_number().over(Window.partitionBy("lat", "lon").orderBy("metres", "stop_id")))
    nearest = ranked.filter(F.col("rank") <= limit).select("lat", "lon", "stop_id", "rank", walk_seconds(F.col("metres")).alias("seconds"))
    return points.select("point_id", "lat", "lon").hint("merge").join(nearest, ["lat", "lon"]).select("point_id", "stop_id", "rank", "seconds")


def bounds(stops: DataFrame) -> DataFrame:
    """One row (south, west, north, east) around all stops, padded; null without stops."""
    return placed(stops).agg((F.min("lat") - PAD).alias("south"), (F.min("lon") - PAD).alias("west"), (F.max("lat") + PAD).alias("north"), (F.max("lon") + PAD).alias("east"))
