"""A synthetic city of any size as a GTFS folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.time import format_time

#: The city's corner, and degrees between stops of its grid.
SOUTH, WEST, STEP_LAT, STEP_LON = 47.0, 8.0, 0.004, 0.005


def city(spark: SparkSession, n_stops: int, n_routes: int, trips_per_route: int, seed: int) -> dict[str, DataFrame]:
    """The feed's tables.  Routes follow rows and columns of a jittered grid; hops take one to three minutes."""
    side = max(2, int(n_stops**0.5))
    k = F.col("id")
    jitter = lambda name: (F.pmod(F.xxhash64(F.lit(seed), F.lit(name), k), F.lit(1000)) / 1000 - 0.5) * 0.3
    stops = spark.range(n_stops).select(
        F.concat(F.lit("S"), k.cast("string")).alias("stop_id"), F.concat(F.lit("Street "), F.floor(k / side).cast("string"), F.lit(" / Avenue "), (k % side).cast("string")).alias("stop_name"),
        (SOUTH + (F.floor(k / side) + jitter("lat")) * STEP_LAT).alias("stop_lat"), (WEST + (k % side + jitter("lon")) * STEP_LON).alias("stop_lon"),
    )
    routes = spark.range(n_routes).select(F.concat(F.lit("R"), k.cast("string")).alias("route_id"), (k + 1).cast("string").alias("route_short_name"), F.concat(F.lit("Line "), (k + 1).cast("string")).alias("route_long_name"), F.lit(3).alias("route_type"))
    trip = spark.range(n_routes * trips_per_route).select(F.floor(k / trips_per_route).alias("route"), (k % trips_per_route).alias("number"), k.alias("trip"))
    trips = trip.select(F.concat(F.lit("R"), F.col("route").cast("string")).alias("route_id"), F.lit("DAILY").alias("service_id"), F.concat(F.lit("T"), F.col("trip").cast("string")).alias("trip_id"), F.concat(F.lit("End "), F.col("route").cast("string")).alias("trip_headsign"))
    length = F.least(F.lit(side), F.lit(5) + F.pmod(F.xxhash64(F.lit(seed), "route"), F.lit(max(1, min(35, side - 4)))))
    line = F.pmod(F.floor(F.col("route") / 2), F.lit(side))
    at = F.when(F.col("route") % 2 == 0, line * side + F.col("pos")).otherwise(F.col("pos") * side + line)
    hop = lambda p: 60 + F.pmod(F.xxhash64(F.lit(seed), F.col("route"), p), F.lit(121))
    ride = F.when(F.col("pos") > 0, F.aggregate(F.transform(F.sequence(F.lit(1), F.greatest("pos", F.lit(1))), lambda p: hop(p)), F.lit(0).cast("long"), lambda a, b: a + b)).otherwise(0)
    start = F.lit(5 * 3600) + F.floor(F.col("number") * (20 * 3600) / trips_per_route)
    calls = trip.select("*", F.explode(F.sequence(F.lit(0), (length - 1).cast("int"))).alias("pos"))
    time = format_time(start + ride)
    stop_times = calls.filter(at < n_stops).select(F.concat(F.lit("T"), F.col("trip").cast("string")).alias("trip_id"), time.alias("arrival_time"), time.alias("departure_time"), F.concat(F.lit("S"), at.cast("string")).alias("stop_id"), (F.col("pos") + 1).alias("stop_sequence"))
    days = ("monday", "tuesday", "wednesday", "thursday", "friday", "saturday", "sunday")
    calendar = spark.range(1).select(F.lit("DAILY").alias("service_id"), *[F.lit(1).alias(d) for d in days], F.lit("20260101").alias("start_date"), F.lit("20271231").alias("end_date"))
    return {"stops": stops, "routes": routes, "trips": trips, "stop_times": stop_times, "calendar": calendar}


def generate(spark: SparkSession, folder: str, n_stops: int = 6000, n_routes: int = 220, trips_per_route: int = 220, seed: int = 7) -> None:
    """Write the city's files into ``folder``, each a folder of CSV parts, which load_feed reads like a file."""
    for name, df in city(spark, n_stops, n_routes, trips_per_route, seed).items():
        df.write.mode("overwrite").csv(f"{folder}/{name}.txt", header=True)
