"""What a batch of travellers typed, as endpoints of searches."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import lookup_key, short_address
from ..storage import Scratch
from .calendar import covers
from .places import resolve_places, search_places
from .transfers import ACCESS_STOPS, ACCESS_WALK_M, bounds, walkable_from


@dataclass(frozen=True)
class Answers:
    """answers(request_id, status, origin_name, target_name, origin_stops, target_stops)
    suggestions(token, rank, place_id, name): what an ambiguous token may mean
    endpoints(request_id, side, stop_id, walk) of the requests that are ready to be searched

    status is blank (an end is missing), ambiguous or missing (of the first end
    that is either), same (both ends are the same stops), outside window (no
    service that day), or ready.
    """

    answers: DataFrame
    suggestions: DataFrame
    endpoints: DataFrame


def located(tokens: DataFrame, gazetteer: DataFrame, stops: DataFrame) -> DataFrame:
    """(token, name, stop_id, walk) of tokens (token) that a gazetteer (name, lat, lon, rank) places inside the stops' bounds and within a walk of any.

    Names are compared without regard to case and white space, up to their
    first comma or in full; of several the lowest rank counts.  What is
    outside the bounds does not count at all.
    """
    box = F.broadcast(bounds(stops))  # a row
    inside = gazetteer.join(box, F.col("lat").between(F.col("south"), F.col("north")) & F.col("lon").between(F.col("west"), F.col("east")))
    keys = F.array_distinct(F.array(lookup_key(F.col("name")), lookup_key(F.substring_index("name", ",", 1))))
    known = inside.select(F.explode(keys).alias("key"), F.struct("rank", "name", "lat", "lon").alias("at")).groupBy("key").agg(F.min("at").alias("at"))
    found = Scratch(tokens.sparkSession, "located").write(tokens.select("token", lookup_key(F.col("token")).alias("key")).filter("key <> ''").join(known, "key").select("token", short_address(F.col("at.name")).alias("name"), "at.lat", "at.lon"))
    near = walkable_from(found.select(F.col("token").alias("point_id"), "lat", "lon"), stops, ACCESS_WALK_M, ACCESS_STOPS)
    return found.select("token", "name").join(near.select(F.col("point_id").alias("token"), "stop_id", F.col("seconds").alias("walk")), "token")


def answer(requests: DataFrame, places: DataFrame, stops: DataFrame, gazetteer: DataFrame, window: DataFrame, suggest: int = 6) -> Answers:
    """Answer requests (request_id, origin, target, day): each end by place or stop, then by gazetteer if no place could be meant at all.

    window is one row (first_day, last_day).  Each different text is looked up
    once, however many requests hold it.
    """
    scratch = Scratch(requests.sparkSession, "requests")
    blank = lambda c: F.trim(F.coalesce(F.col(c), F.lit("")))
    asked = scratch.write(requests.select("request_id", blank("origin").alias("origin"), blank("target").alias("target"), "day"))
    tokens = scratch.write(asked.select(F.explode(F.array("origin", "target")).alias("token")).distinct().filter("token <> ''"))
    named = tokens.withColumnRenamed("token", "query")
    meant = scratch.write(resolve_places(places, stops, named).select(F.col("query").alias("token"), "name", "stop_ids"))
    unclear = scratch.write(tokens.join(meant, "token", "left_anti"))
    listed = search_places(places, unclear.withColumnRenamed("token", "query"), suggest)
    suggestions = scratch.write(listed.select(F.col("query").alias("token"), "rank", "place_id", "name"))
    unknown = unclear.join(suggestions.select("token"), "token", "left_anti")
    ends = scratch.write(
        meant.select("token", "name", F.explode("stop_ids").alias("stop_id"), F.lit(0).alias("walk"))
        .unionByName(located(unknown, gazetteer, stops))
    )
    known = ends.groupBy("token").agg(F.first("name").alias("name"), F.array_sort(F.collect_set("stop_id")).alias("stops"))
    state = tokens.join(known, "token", "left").join(suggestions.select("token", F.lit(True).alias("several")).distinct(), "token", "left")
    state = scratch.write(state.select("token", "name", "stops", F.when(F.col("stops").isNotNull(), "known").when(F.col("several"), "ambiguous").otherwise("missing").alias("state")))
    side = lambda end: state.select(F.col("token").alias(end), *[F.col(c).alias(f"{end}_{c}") for c in ("name", "stops", "state")])
    both = asked.join(side("origin"), "origin", "left").join(side("target"), "target", "left").join(F.broadcast(window))  # a row
    unclear_end = lambda end: F.when(F.col(f"{end}_state") != "known", F.col(f"{end}_state"))
    status: Column = F.when((F.col("origin") == "") | (F.col("target") == ""), "blank").otherwise(
        F.coalesce(
            unclear_end("origin"), unclear_end("target"), F.when(F.col("origin_stops") == F.col("target_stops"), "same"),
            F.when(~covers(F.col("first_day"), F.col("last_day"), F.col("day")), "outside window"), F.lit("ready"),
        )
    )
    count = lambda c: F.when(F.col(c).isNotNull(), F.size(c)).otherwise(0)
    answers = scratch.write(both.select("request_id", status.alias("status"), "origin", "target", "origin_name", "target_name", count("origin_stops").alias("origin_stops"), count("target_stops").alias("target_stops")))
    ready = answers.filter("status = 'ready'")
    walks = ends.select("token", "stop_id", "walk")
    endpoints = ready.select("request_id", F.explode(F.array(*[F.struct(F.lit(e).alias("side"), F.col(e).alias("token")) for e in ("origin", "target")])).alias("end")).select("request_id", "end.side", "end.token").join(walks, "token")
    return Answers(answers.drop("origin", "target"), suggestions, endpoints.select("request_id", "side", "stop_id", "walk"))
