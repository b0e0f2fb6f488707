"""Command line: info, stops, plan and benchmark over a GTFS feed."""

from __future__ import annotations

import argparse
import datetime as dt
import logging
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.time import query_date, query_time
from .operators.calendar import covers, running_trips, service_window
from .operators.itinerary import as_json, benchmark_stats, describe, journeys, named_legs, summary, tags, with_points
from .operators.pairs import random_pairs
from .operators.patterns import Timetable, build_timetable, timetable_counts
from .operators.places import build_places, place_counts, resolve_places, search_places
from .operators.router import journey_legs, plan
from .operators.transfers import MAX_WALK_M, footpaths
from .session import session
from .sources.gtfs import Feed, FeedError, feed_counts, load_feed


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="headway", description=__doc__)
    commands = top.add_subparsers(dest="command", required=True)

    def command(name: str, about: str, day: bool = False) -> argparse.ArgumentParser:
        p = commands.add_parser(name, help=about)
        p.add_argument("feed", help="a GTFS folder or zip file")
        p.add_argument("--quiet", action="store_true", help="log errors only")
        p.add_argument("--max-walk", type=float, default=MAX_WALK_M, help="longest footpath in metres")
        if day:
            p.add_argument("--at", default="08:00")
            p.add_argument("--date")
            p.add_argument("--weekday", type=int, choices=range(7))
            p.add_argument("--max-rounds", type=int, default=5)
        return p

    command("info", "what the feed holds")
    stops = command("stops", "places by name")
    stops.add_argument("--search", required=True)
    stops.add_argument("--limit", type=int, default=25)
    route = command("plan", "journeys between two places", day=True)
    route.add_argument("--from", dest="origin", required=True)
    route.add_argument("--to", dest="target", required=True)
    route.add_argument("--json", action="store_true")
    bench = command("benchmark", "many random pairs at once", day=True)
    bench.add_argument("--queries", type=int, default=100)
    bench.add_argument("--seed", type=int, default=42)
    return top


def _day(feed: Feed, args: argparse.Namespace) -> dt.date | None:
    """The service day asked for; without one, today or the feed's first day."""
    if "date" not in args or args.weekday is not None:
        return None
    window = None if args.date else service_window(feed).first()
    return query_date(args.date, *(window or ()))


def _timetable(feed: Feed, args: argparse.Namespace) -> Timetable:
    weekday, date = getattr(args, "weekday", None), _day(feed, args)
    return build_timetable(running_trips(feed.with_calls(), on_date=date, weekday=weekday), feed.stop_times, footpaths(feed.stops, feed.transfers, args.max_walk))


def _one_query(spark: SparkSession, depart: int) -> DataFrame:
    return spark.range(1).select(F.lit(0).alias("query_id"), F.lit(depart).alias("depart"))


def info(spark: SparkSession, args: argparse.Namespace) -> int:
    feed = load_feed(spark, args.feed).snapshot()
    routing = timetable_counts(_timetable(feed, args)).withColumn("metric", F.concat(F.lit("routing "), "metric"))
    for r in feed_counts(feed).unionByName(routing).unionByName(place_counts(build_places(feed.stops))).collect():
        print(f"{r.metric:<24}{r.value:>12,}")
    window = service_window(feed).select("*", covers(F.col("first_day"), F.col("last_day"), F.current_date()).alias("now")).first()
    print(f"valid                 {window.first_day or '?'} to {window.last_day or '?'}{'' if window.now else '  (not today)'}")
    return 0


def stops(spark: SparkSession, args: argparse.Namespace) -> int:
    places = build_places(load_feed(spark, args.feed).stops)
    asked = spark.range(1).select(F.lit(args.search).alias("query"))
    found = search_places(places, asked, args.limit + 1).join(places.select("place_id", F.size("stop_ids").alias("n"), "lat", "lon"), "place_id").orderBy("rank").collect()
    for r in found[: args.limit]:
        print(f"{r.place_id[:15]:<16}{r.name[:41]:<42}{r.n:>6}  {r.lat:.5f}, {r.lon:.5f}")
    print("no matches" if not found else "… and more" * (len(found) > args.limit))
    return 0 if found else 1


def route(spark: SparkSession, args: argparse.Namespace) -> int:
    feed = load_feed(spark, args.feed).snapshot()
    places = build_places(feed.stops).cache()
    asked = spark.range(1).select(F.explode(F.array(F.lit(args.origin), F.lit(args.target))).alias("query")).distinct()
    meant = {r["query"]: r for r in resolve_places(places, feed.stops, asked).collect()}
    for text in (args.origin, args.target):
        if text not in meant:
            near = search_places(places, asked.filter(F.col("query") == text), 8).orderBy("rank").collect()
            print(f"{text!r} " + ("matches " + ", ".join(f"{r.name} ({r.place_id})" for r in near) if near else "matches no stop"), file=sys.stderr)
            return 1
    if meant[args.origin].place_id == meant[args.target].place_id:
        print("origin and destination are the same place", file=sys.stderr)
        return 1
    timetable, queries = _timetable(feed, args), _one_query(spark, query_time(args.at))
    ends = [spark.range(1).select(F.lit(0).alias("query_id"), F.lit(side).alias("side"), F.explode(F.array(*map(F.lit, meant[t].stop_ids))).alias("stop_id"), F.lit(0).alias("walk")) for side, t in (("origin", args.origin), ("target", args.target))]
    legs = journey_legs(plan(timetable, queries, ends[0].unionByName(ends[1]), args.max_rounds), timetable)
    found = journeys(legs, queries).cache()
    if found.isEmpty():
        window = service_window(feed).first()
        day = _day(feed, args)
        outside = day and (window.first_day and day < window.first_day or window.last_day and day > window.last_day)
        print(f"no service on {day}; the feed covers {window.first_day} to {window.last_day}" if outside else "no trips run that day" if timetable.patterns.isEmpty() else "no journey found; the places may not be connected, or the last vehicle has gone")
        return 1
    named = named_legs(legs, feed)
    if args.json:
        print(as_json(found, with_points(named, feed)).first().payload)
        return 0
    lines = {r.journey: [] for r in found.collect()}
    for r in describe(named).orderBy("journey", "leg_no").collect():
        lines[r.journey].append(r.line)
    for r in summary(found).join(tags(found).select("query_id", "journey", "tag"), ["query_id", "journey"]).orderBy("journey").collect():
        print(f"[{r.tag}] {r.line}")
        print("\n".join(f"    {x}" for line in lines[r.journey] for x in line.split("\n")))
    return 0


def benchmark(spark: SparkSession, args: argparse.Namespace) -> int:
    feed = load_feed(spark, args.feed).snapshot()
    timetable = _timetable(feed, args)
    drawn = random_pairs(timetable.pattern_stops, args.queries, args.seed).cache()
    ends = drawn.select("query_id", F.explode(F.array(*[F.struct(F.lit(side).alias("side"), F.col(side).alias("stop_id")) for side in ("origin", "target")])).alias("e")).select("query_id", "e.*", F.lit(0).alias("walk"))
    queries = drawn.select("query_id", F.lit(query_time(args.at)).alias("depart"))
    r = benchmark_stats(journeys(journey_legs(plan(timetable, queries, ends, args.max_rounds), timetable), queries), queries).first()
    print(f"{r.n} queries, {r.solved} solved; door to door in seconds: mean {r.mean}, median {r.median}, p95 {r.p95}, slowest {r.slowest}")
    return 0


def main(argv: list[str] | None = None) -> int:
    args = parser().parse_args(argv)
    run = {"info": info, "stops": stops, "plan": route, "benchmark": benchmark}[args.command]
    logging.basicConfig(level=logging.ERROR if args.quiet else logging.INFO, format="%(message)s", stream=sys.stderr)
    logging.getLogger("py4j").setLevel(logging.ERROR)
    try:
        return run(session("headway"), args)
    except (FeedError, ValueError) as e:
        print(e, file=sys.stderr)
        return 2


if __name__ == "__main__":
    sys.exit(main())
