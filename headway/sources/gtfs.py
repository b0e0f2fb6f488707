"""GTFS feeds as typed DataFrames."""

from __future__ import annotations

import logging
from collections.abc import Callable
from dataclasses import dataclass, fields
from functools import cached_property, reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import hex_colour
from ..functions.time import NO_TIME, parse_date, strip, stripped_time
from ..storage import Scratch, shared_folder
from .csv import read_csv

log = logging.getLogger(__name__)

REQUIRED = ("stops", "routes", "trips", "stop_times")
OPTIONAL = ("calendar", "calendar_dates", "transfers")
DAYS = ("monday", "tuesday", "wednesday", "thursday", "friday", "saturday", "sunday")
#: Fixed values of GTFS: a calendar exception that removes, and a transfer that is impossible.
REMOVED, NO_TRANSFER = "2", "3"


class FeedError(ValueError):
    """The feed can't be read."""


@dataclass(frozen=True)
class Feed:
    """A feed's tables.

    stops(stop_ord, stop_id, name, lat, lon, parent, location_type)
    routes(route_ord, route_id, short_name, long_name, route_type, color, text_color)
    trips(trip_ord, trip_id, route_id, service_id, headsign), and their calls(stop_id, arr, dep) in order if the feed has a trip's in one row
    stop_times(trip_id, pos, stop_id, arr, dep), pos from 0
    services(service_id, weekdays, start, end), weekdays from 0 for Monday
    exceptions(service_id, day, added)
    transfers(from_stop, to_stop, seconds)
    Ordinals follow the files' order; times are seconds of the service day.
    """

    stops: DataFrame
    routes: DataFrame
    trips: DataFrame
    stop_times: DataFrame
    services: DataFrame
    exceptions: DataFrame
    transfers: DataFrame

    def with_calls(self) -> Feed:
        """This feed, whose trips hold their calls if it has them in one row."""
        return self

    def snapshot(self) -> Feed:
        """The same feed, read from written tables instead of its files."""
        scratch = Scratch(self.stops.sparkSession, "feed")
        return Feed(**{f.name: scratch.write(getattr(self, f.name)) for f in fields(Feed)})


def _hadoop_path(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark._jsc.hadoopConfiguration())


def _open(spark: SparkSession, path: str) -> dict[str, str]:
    """Paths of the feed's files by name.  A zip, which Spark can't split, is first unpacked into the shared folder."""
    p, fs = _hadoop_path(spark, path)
    if not fs.exists(p):
        raise FeedError(f"no such feed: {path}")
    if fs.getFileStatus(p).isDirectory():
        return {s.getPath().getName(): s.getPath().toString() for s in fs.listStatus(p)}
    scratch = Scratch(spark, "feed-zip")
    out, blocks = {}, spark._jvm.org.apache.hadoop.io.IOUtils
    entries = spark._jvm.java.util.zip.ZipInputStream(fs.open(p))
    try:
        while (entry := entries.getNextEntry()) is not None:
            name = entry.getName().rsplit("/", 1)[-1]
            if name.removesuffix(".txt") in (*REQUIRED, *OPTIONAL) and name.endswith(".txt"):
                target, into = _hadoop_path(spark, f"{scratch.root}/{name}")
                stream = into.create(target, True)
                blocks.copyBytes(entries, stream, 1 << 20, False)
                stream.close()
                out[name] = target.toString()
    finally:
        entries.close()
    if not out:
        raise FeedError(f"not a zip file with a feed: {path}")
    return out


def _text(df: DataFrame, name: str, required: bool = False) -> Column:
    if name in df.columns:
        return F.coalesce(F.col(f"`{name}`"), F.lit(""))
    if required:
        raise FeedError(f"a file has no column {name}")
    return F.lit("")


def _integer(df: DataFrame, name: str, default: int) -> Column:
    """An integer; empty is the default; anything else stops the job."""
    text = _text(df, name)
    return F.when(text == "", default).otherwise(F.coalesce(strip(text).try_cast("int"), F.raise_error(F.concat(F.lit(f"{name} is not a number: "), text)).cast("int")))


def _coordinate(df: DataFrame, name: str) -> Column:
    """Empty is NaN, which stays; text that is no number is null, whose row goes."""
    text = _text(df, name)
    return F.when(text == "", float("nan")).otherwise(strip(text).try_cast("double"))


def _last_wins(df: DataFrame, *key: str) -> DataFrame:
    """Of rows with one key, the values of the last at the place of the first.  Keys hardly repeat, so rows are dealt before they are sorted, and not sorted in both places."""
    values = [c for c in df.columns if c not in key and c != "_ord"]
    return df.repartition(*key).groupBy(*key).agg(F.max(F.struct("_ord", *values)).alias("v"), F.min("_ord").alias("_ord")).select("_ord", *key, *[F.col(f"v.{c}").alias(c) for c in values])


class FeedFiles(Feed):
    """A feed that is read file by file, as its tables are asked for.

    raw gives the rows of a file by its name, None if the feed has no such
    file.
    """

    def __init__(self, spark: SparkSession, raw: Callable[[str], DataFrame | None]):
        vars(self).update(_spark=spark, _raw=raw)

    @cached_property
    def stops(self) -> DataFrame:
        s = self._raw("stops")
        stop_id = strip(_text(s, "stop_id", True))
        kind = F.coalesce(strip(_text(s, "location_type")).try_cast("int"), F.lit(0))
        stops = s.select("_ord", stop_id.alias("stop_id"), F.when(_text(s, "stop_name") == "", stop_id).otherwise(strip(_text(s, "stop_name"))).alias("name"), _coordinate(s, "stop_lat").alias("lat"), _coordinate(s, "stop_lon").alias("lon"), strip(_text(s, "parent_station")).alias("parent"), kind.alias("location_type"))
        # Written, so that Spark knows whether their ids are few enough to send them to the stop times.
        return Scratch(self._spark, "stops").write(_last_wins(stops.filter("lat is not null and lon is not null"), "stop_id").withColumnRenamed("_ord", "stop_ord"))

    @cached_property
    def routes(self) -> DataFrame:
        r = self._raw("routes")
        routes = r.select("_ord", strip(_text(r, "route_id", True)).alias("route_id"), strip(_text(r, "route_short_name")).alias("short_name"), strip(_text(r, "route_long_name")).alias("long_name"), _integer(r, "route_type", 3).alias("route_type"), hex_colour(_text(r, "route_color")).alias("color"), hex_colour(_text(r, "route_text_color")).alias("text_color"))
        return _last_wins(routes, "route_id").withColumnRenamed("_ord", "route_ord")

    @cached_property
    def _trips(self) -> DataFrame:
        t = self._raw("trips")
        trips = t.select("_ord", strip(_text(t, "trip_id", True)).alias("trip_id"), strip(_text(t, "route_id")).alias("route_id"), strip(_text(t, "service_id")).alias("service_id"), strip(_text(t, "trip_headsign")).alias("headsign"))
        return _last_wins(trips, "trip_id").withColumnRenamed("_ord", "trip_ord")

    @cached_property
    def _runs(self) -> DataFrame:
        """Trips that have calls, with them.  Written, as both trips and stop times come from it."""
        x = self._raw("stop_times")
        # By generators, so that texts are stripped and times read once, though what follows filters and mends them.
        texts = x.select(F.inline(F.array(F.struct(F.col("_ord").alias("st_ord"), strip(_text(x, "trip_id", True)).alias("trip_id"), strip(_text(x, "stop_id", True)).alias("stop_id"), strip(_text(x, "arrival_time")).alias("arr"), strip(_text(x, "departure_time")).alias("dep"), _integer(x, "stop_sequence", 0).alias("seq")))))
        times = texts.select(F.inline(F.array(F.struct("st_ord", "trip_id", "stop_id", stripped_time(F.col("arr")).alias("arr"), stripped_time(F.col("dep")).alias("dep"), "seq"))))
        return Scratch(self._spark, "runs").write(_calls_of(times, self.stops).join(self._trips, "trip_id"))

    @cached_property
    def trips(self) -> DataFrame:
        return self._runs.select("trip_ord", "trip_id", "route_id", "service_id", "headsign")

    @cached_property
    def stop_times(self) -> DataFrame:
        return stop_times_of(self._runs)

    def with_calls(self) -> Feed:
        out, trips = FeedFiles(self._spark, self._raw), self._runs.select(*self.trips.columns, "calls")
        vars(out).update(vars(self), trips=trips)
        return out

    @cached_property
    def exceptions(self) -> DataFrame:
        e = self._raw("calendar_dates")
        return _empty(self._spark, "service_id string, day date, added boolean") if e is None else e.select(
            strip(_text(e, "service_id", True)).alias("service_id"), parse_date(_text(e, "date")).alias("day"), (strip(_text(e, "exception_type")) != REMOVED).alias("added")
        ).filter("day is not null").distinct()

    @cached_property
    def services(self) -> DataFrame:
        c = self._raw("calendar")
        services = _empty(self._spark, "service_id string, weekdays array<int>, start date, end date") if c is None else _last_wins(
            c.select(
                "_ord", strip(_text(c, "service_id", True)).alias("service_id"), F.filter(F.array(*[F.when(strip(_text(c, d)) == "1", i) for i, d in enumerate(DAYS)]), lambda d: d.isNotNull()).alias("weekdays"),
                parse_date(_text(c, "start_date")).alias("start"), parse_date(_text(c, "end_date")).alias("end"),
            ), "service_id",
        ).drop("_ord")
        # A service that only exceptions mention runs on what they add.
        only = self.exceptions.select("service_id").distinct().join(services, "service_id", "left_anti")
        return services.unionByName(only.select("service_id", F.expr("cast(array() as array<int>)").alias("weekdays"), F.lit(None).cast("date").alias("start"), F.lit(None).cast("date").alias("end")))

    @cached_property
    def transfers(self) -> DataFrame:
        f = self._raw("transfers")
        if f is None:
            return _empty(self._spark, "from_stop string, to_stop string, seconds int")
        known = self.stops.select("stop_id")
        transfers = f.select("_ord", strip(_text(f, "from_stop_id")).alias("from_stop"), strip(_text(f, "to_stop_id")).alias("to_stop"), _integer(f, "min_transfer_time", 0).alias("seconds"), strip(_text(f, "transfer_type")).alias("kind"))
        transfers = transfers.filter(F.col("kind") != NO_TRANSFER).drop("kind")
        for side in ("from_stop", "to_stop"):
            transfers = transfers.join(known.withColumnRenamed("stop_id", side), side, "left_semi")
        return _last_wins(transfers, "from_stop", "to_stop").select("from_stop", "to_stop", "seconds")


def load_feed(spark: SparkSession, path: str) -> Feed:
    """The cleaned feed at ``path``, a folder or a zip file, each file of which is read when a table first needs it.

    Rows that can't be used go: stops with unreadable coordinates; stop times
    without any time, of unknown trips or at unknown stops, and trips that
    keep fewer than two; impossible transfers and those of unknown stops;
    exceptions without a date.  Files are read by many tasks, whatever they
    hold (read_csv).
    """
    files = _open(spark, path)
    missing = [f"{n}.txt" for n in REQUIRED if f"{n}.txt" not in files]
    if missing:
        raise FeedError(f"feed is missing required files: {', '.join(missing)}")
    log.info("reading feed %s", path)
    return FeedFiles(spark, lambda n: read_csv(spark, files[f"{n}.txt"]) if f"{n}.txt" in files else None)


def clean_stop_times(times: DataFrame, trips: DataFrame, stops: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(trips, stop_times) of times (st_ord, trip_id, stop_id, arr, dep, seq) that can be used.

    A missing arrival or departure takes the other's value.  Positions count
    from 0 in the order of (seq, st_ord).
    """
    calls = usable_calls(times, trips, stops)
    return trips_of(calls, trips), stop_times_of(calls)


def usable_calls(times: DataFrame, trips: DataFrame, stops: DataFrame) -> DataFrame:
    """(trip_id, calls) of clean_stop_times: a trip in one row, its calls in order."""
    return _calls_of(times, stops).join(trips.select("trip_id"), "trip_id", "left_semi")


def _calls_of(times: DataFrame, stops: DataFrame) -> DataFrame:
    """The same of all trips, known or not: a trip's times mostly come together, so that one row of each is shuffled, and not its times."""
    usable = times.filter((F.col("arr") != NO_TIME) | (F.col("dep") != NO_TIME)).withColumn("arr", F.when(F.col("arr") == NO_TIME, F.col("dep")).otherwise(F.col("arr"))).withColumn("dep", F.when(F.col("dep") == NO_TIME, F.col("arr")).otherwise(F.col("dep")))
    usable = usable.join(stops.select("stop_id"), "stop_id", "left_semi")
    return usable.groupBy("trip_id").agg(F.array_sort(F.collect_list(F.struct("seq", "st_ord", "stop_id", "arr", "dep"))).alias("calls")).filter(F.size("calls") >= 2)


def stop_times_of(calls: DataFrame) -> DataFrame:
    return calls.select("trip_id", F.posexplode("calls").alias("pos", "c")).select("trip_id", "pos", "c.stop_id", "c.arr", "c.dep")


def trips_of(calls: DataFrame, trips: DataFrame) -> DataFrame:
    return trips.join(calls.select("trip_id"), "trip_id", "left_semi").select(*trips.columns)


def _empty(spark: SparkSession, schema: str) -> DataFrame:
    return spark.range(0).select(*[F.lit(None).cast(kind).alias(name) for name, kind in (c.split(" ", 1) for c in schema.split(", "))])


def feed_counts(feed: Feed) -> DataFrame:
    """(metric, value): how many rows each table has."""
    counts = [getattr(feed, f.name).agg(F.count(F.lit(1)).alias("value")).select(F.lit(f.name).alias("metric"), "value") for f in fields(Feed)]
    return reduce(DataFrame.unionByName, counts)


__all__ = ["Feed", "FeedError", "clean_stop_times", "feed_counts", "load_feed", "shared_folder"]
