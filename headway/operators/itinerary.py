"""Journeys from legs: metrics, door-to-door walks, and text."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import route_label, route_mode
from ..functions.time import clock, format_time
from ..sources.gtfs import Feed

JOURNEY = ("query_id", "journey")


def journeys(legs: DataFrame, queries: DataFrame) -> DataFrame:
    """(query_id, journey, depart, arrive, transfers, walking_s, wait_s, door_to_door_s) of legs and queries (query_id, depart)."""
    asked = queries.select("query_id", F.col("depart").alias("asked"))
    rides, walks = F.count_if(F.col("kind") == "ride"), F.sum(F.when(F.col("kind") == "walk", F.col("arrive") - F.col("depart")).otherwise(0))
    each = legs.groupBy(*JOURNEY).agg(
        F.min_by("depart", "leg_no").alias("depart"), F.max_by("arrive", "leg_no").alias("arrive"), F.greatest(rides - 1, F.lit(0)).cast("int").alias("transfers"), walks.alias("walking_s")
    )
    return each.join(asked, "query_id").select(
        *JOURNEY, "depart", "arrive", "transfers", "walking_s", F.greatest(F.col("depart") - F.col("asked"), F.lit(0)).alias("wait_s"), F.greatest(F.col("arrive") - F.col("asked"), F.lit(0)).alias("door_to_door_s")
    )


def tags(found: DataFrame) -> DataFrame:
    """found with ``tag``: the first journey of a query is the fastest, others have fewer changes; and with ``badge``: where there are several, the first is fastest, the last has the fewest changes, others are empty."""
    last = F.max("journey").over(Window.partitionBy("query_id"))
    badge = F.when(F.col("_last") == 0, "").when(F.col("journey") == 0, "fastest").when(F.col("journey") == F.col("_last"), "fewest changes").otherwise("")
    return found.withColumn("_last", last).withColumns({"tag": F.when(F.col("journey") == 0, "fastest").otherwise("fewer changes"), "badge": badge}).drop("_last")


def with_doors(legs: DataFrame, endpoints: DataFrame) -> DataFrame:
    """legs (query_id, journey, leg_no, kind, from_stop, to_stop, depart, arrive) with a walk from and to the door where an endpoint has one.

    The first leaves as late as it can.  A door's place is the empty string.
    """
    columns = [*JOURNEY, "leg_no", "kind", "from_stop", "to_stop", "depart", "arrive"]
    side = lambda name: endpoints.filter((F.col("side") == name) & (F.col("walk") > 0)).groupBy("query_id", "stop_id").agg(F.min("walk").alias("walk"))
    door = F.lit("").cast(dict(legs.dtypes)["from_stop"]) if dict(legs.dtypes)["from_stop"] == "string" else F.lit(None).cast(dict(legs.dtypes)["from_stop"])
    ends = legs.groupBy(*JOURNEY).agg(F.min(F.struct("leg_no", "from_stop", "depart")).alias("a"), F.max(F.struct("leg_no", "to_stop", "arrive")).alias("b"))
    origin, target = side("origin").withColumnRenamed("stop_id", "from_stop"), side("target").withColumnRenamed("stop_id", "to_stop")
    first = ends.select(*JOURNEY, "a.leg_no", "a.from_stop", "a.depart").join(origin, ["query_id", "from_stop"])
    first = first.select(*JOURNEY, (F.col("leg_no") - 1).alias("leg_no"), F.lit("walk").alias("kind"), door.alias("from_stop"), F.col("from_stop").alias("to_stop"), (F.col("depart") - F.col("walk")).alias("depart"), F.col("depart").alias("arrive"))
    last = ends.select(*JOURNEY, "b.leg_no", "b.to_stop", "b.arrive").join(target, ["query_id", "to_stop"])
    last = last.select(*JOURNEY, (F.col("leg_no") + 1).alias("leg_no"), F.lit("walk").alias("kind"), F.col("to_stop").alias("from_stop"), door.alias("to_stop"), F.col("arrive").alias("depart"), (F.col("arrive") + F.col("walk")).alias("arrive"))
    return _numbered(legs.select(*columns).unionByName(first).unionByName(last))


def _numbered(legs: DataFrame) -> DataFrame:
    return legs.withColumn("leg_no", F.row_number().over(Window.partitionBy(*JOURNEY).orderBy("leg_no")) - 1)


def merge_walks(legs: DataFrame) -> DataFrame:
    """legs with each run of walks that follow each other without a gap as one walk."""
    order = Window.partitionBy(*JOURNEY).orderBy("leg_no")
    goes_on = (F.col("kind") == "walk") & (F.lag("kind").over(order) == "walk") & (F.lag("arrive").over(order) == F.col("depart"))
    island = F.sum(F.when(F.coalesce(goes_on, F.lit(False)), 0).otherwise(1)).over(order)
    merged = legs.withColumn("_island", island).groupBy(*JOURNEY, "_island").agg(
        F.min("leg_no").alias("leg_no"), F.first("kind").alias("kind"), F.min_by("from_stop", "leg_no").alias("from_stop"), F.max_by("to_stop", "leg_no").alias("to_stop"), F.min("depart").alias("depart"), F.max("arrive").alias("arrive")
    )
    return _numbered(merged.drop("_island"))


def named_legs(legs: DataFrame, feed: Feed) -> DataFrame:
    """legs with from_name, to_name, route, headsign, color, text_color, mode, and the clock times and minutes that a page shows."""
    stops = feed.stops.select("stop_id", "name")
    trips = feed.trips.join(feed.routes, "route_id", "left").select("trip_id", "headsign", route_label(F.col("short_name"), F.col("long_name"), F.col("route_id").cast("string")).alias("route"), "color", "text_color", route_mode(F.col("route_type")).alias("mode"))
    out = legs.join(stops.select(F.col("stop_id").alias("from_stop"), F.col("name").alias("from_name")), "from_stop", "left").join(stops.select(F.col("stop_id").alias("to_stop"), F.col("name").alias("to_name")), "to_stop", "left").join(trips, "trip_id", "left")
    blank = {"route": "", "headsign": "", "color": "", "text_color": ""}
    out = out.withColumns({"from_name": F.coalesce("from_name", "from_stop"), "to_name": F.coalesce("to_name", "to_stop"), "mode": F.when(F.col("kind") == "walk", "walk").otherwise(F.coalesce("mode", F.lit("bus")))} | {c: F.coalesce(c, F.lit(v)) for c, v in blank.items()})
    return out.withColumns({"depart_clock": clock(F.col("depart")), "arrive_clock": clock(F.col("arrive")), "minutes": F.greatest(F.lit(1), F.floor((F.col("arrive") - F.col("depart")) / 60).cast("int"))})


def with_points(legs: DataFrame, feed: Feed) -> DataFrame:
    """legs with ``points``, an array of (stop_id, name, lat, lon) in their order: all stops of a ride, and the ends of a walk.  Stops that are unknown or have no coordinates are left out.

    The stops of all legs meet the feed's in one join, under their places in
    their legs, and are gathered again.
    """
    ids = F.when(F.size("stops") > 0, F.col("stops")).otherwise(F.array("from_stop", "to_stop"))
    each = legs.select(*JOURNEY, "leg_no", F.posexplode(ids).alias("place", "stop_id"))
    known = feed.stops.filter(~F.isnan("lat") & ~F.isnan("lon")).select("stop_id", "name", "lat", "lon")
    gathered = each.join(known, "stop_id").groupBy(*JOURNEY, "leg_no").agg(F.array_sort(F.collect_list(F.struct("place", "stop_id", "name", "lat", "lon"))).alias("p"))
    points = F.transform("p", lambda p: F.struct(p["stop_id"].alias("id"), p["name"].alias("name"), p["lat"].alias("lat"), p["lon"].alias("lon")))
    none = f"cast(array() as {gathered.select(points.alias('x')).schema['x'].dataType.simpleString()})"
    out = legs.join(gathered.select(*JOURNEY, "leg_no", points.alias("points")), [*JOURNEY, "leg_no"], "left")
    return out.withColumn("points", F.coalesce("points", F.expr(none)))


def describe(named: DataFrame) -> DataFrame:
    """(query_id, journey, leg_no, line) of named_legs: a line for each walk, two for each ride, joined by a newline."""
    hops = F.when(F.col("n_hops") > 0, F.concat(F.lit(" ("), F.col("n_hops").cast("string"), F.lit(" stops)"))).otherwise("")
    heading = F.when(F.col("headsign") != "", F.concat(F.lit(" to "), F.col("headsign"))).otherwise("")
    walk = F.concat(format_time(F.col("depart")), F.lit("  walk "), F.floor((F.col("arrive") - F.col("depart")) / 60).cast("string"), F.lit(" min to "), F.col("to_name"))
    ride = F.concat(format_time(F.col("depart")), F.lit("  route "), F.col("route"), heading, F.lit(" from "), F.col("from_name"), hops, F.lit("\n"), format_time(F.col("arrive")), F.lit("  arrive "), F.col("to_name"))
    return named.select(*JOURNEY, "leg_no", F.when(F.col("kind") == "walk", walk).otherwise(ride).alias("line"))


def summary(found: DataFrame) -> DataFrame:
    """(query_id, journey, line) of journeys: times, minutes from asking, wait of a minute or more, transfers, walking."""
    minutes = lambda c: F.floor(F.col(c) / 60).cast("string")
    wait = F.when(F.col("wait_s") >= 60, F.concat(F.lit(", "), minutes("wait_s"), F.lit(" min wait"))).otherwise("")
    plural = F.when(F.col("transfers") == 1, "").otherwise("s")
    line = F.concat(format_time(F.col("depart")), F.lit(" → "), format_time(F.col("arrive")), F.lit("  ("), minutes("door_to_door_s"), F.lit(" min total"), wait, F.lit(", "), F.col("transfers").cast("string"), F.lit(" transfer"), plural, F.lit(", "), minutes("walking_s"), F.lit(" min walking)"))
    return found.select(*JOURNEY, line.alias("line"))


def as_json(found: DataFrame, named: DataFrame) -> DataFrame:
    """(query_id, payload): each query's journeys and their legs as one JSON text; of named_legs that have points, with these."""
    points = ["points"] if "points" in named.columns else []
    leg = F.struct("leg_no", "kind", F.col("from_name").alias("from"), F.col("to_name").alias("to"), "route", "headsign", "mode", "color", "text_color", "n_hops", F.col("depart_clock").alias("depart"), F.col("arrive_clock").alias("arrive"), F.col("depart").alias("depart_seconds"), F.col("arrive").alias("arrive_seconds"), "minutes", *points)
    gathered = named.groupBy(*JOURNEY).agg(F.array_sort(F.collect_list(leg)).alias("legs"))
    one = F.struct("journey", "tag", "badge", clock(F.col("depart")).alias("depart"), clock(F.col("arrive")).alias("arrive"), F.floor(F.col("door_to_door_s") / 60).alias("total_minutes"), F.floor(F.col("wait_s") / 60).alias("wait_minutes"), "transfers", F.floor(F.col("walking_s") / 60).alias("walk_minutes"), "legs")
    whole = tags(found).join(gathered, list(JOURNEY)).groupBy("query_id").agg(F.array_sort(F.collect_list(one)).alias("journeys"))
    return whole.select("query_id", F.to_json(F.struct("journeys")).alias("payload"))


def benchmark_stats(found: DataFrame, queries: DataFrame, measure: str = "door_to_door_s") -> DataFrame:
    """One row (n, solved, mean, median, p95, slowest) of the fastest journey of each query that has one.

    Equal measures are counted together first, so that what is put in order
    grows with the different measures, at most the seconds of a day or two.
    """
    fastest = found.filter("journey = 0").select("query_id", F.col(measure).alias("m"))
    counted = queries.join(fastest, "query_id", "left").groupBy("m").agg(F.count(F.lit(1)).alias("k"))
    solved = counted.agg(F.sum("k").alias("n"), F.sum(F.when(F.col("m").isNotNull(), F.col("k")).otherwise(0)).alias("solved"), (F.sum(F.col("m") * F.col("k")) / F.sum(F.when(F.col("m").isNotNull(), F.col("k")))).alias("mean"), F.max("m").alias("slowest"))
    up_to = F.sum("k").over(Window.orderBy("m"))
    placed = counted.filter("m is not null").withColumn("last", up_to).join(F.broadcast(solved.select("solved")))
    # The values of ranks from 0: the middle ones, and the one that 95 % are below.
    at = lambda rank: F.min(F.when(F.col("last") > rank, F.col("m")))
    ranks = placed.agg(((at(F.floor((F.col("solved") - 1) / 2)) + at(F.floor(F.col("solved") / 2))) / 2).alias("median"), at(F.floor(F.col("solved") * 0.95)).alias("p95"))
    return solved.join(F.broadcast(ranks)).select("n", "solved", "mean", "median", "p95", "slowest")
