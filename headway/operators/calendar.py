"""Which services and trips run on a day."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.gtfs import Feed


def runs_on(services: DataFrame, exceptions: DataFrame, days: list[dt.date]) -> DataFrame:
    """(day, service_id, runs) of each service on each of some days.

    A removed date beats an added one, and either beats the service's first
    and last date and its weekdays.
    """
    by_day = exceptions.filter(F.col("day").isin(days)).groupBy("service_id", "day").agg(F.max(~F.col("added")).alias("removed"), F.max("added").alias("added"))
    each = services.select("*", F.explode(F.array(*map(F.lit, days))).alias("day"))
    known = each.join(by_day, ["service_id", "day"], "left")
    regular = (
        F.array_contains("weekdays", F.weekday("day"))
        & F.coalesce(F.col("day") >= F.col("start"), F.lit(True)) & F.coalesce(F.col("day") <= F.col("end"), F.lit(True))
    )
    return known.select("day", "service_id", F.when(F.coalesce("removed", F.lit(False)), False).when(F.coalesce("added", F.lit(False)), True).otherwise(regular).alias("runs"))


def running_trips(feed: Feed, on_date: dt.date | None = None, weekday: int | None = None) -> DataFrame:
    """The feed's trips on a date, or on a weekday (0 is Monday) whatever the date, or all.

    A date beats a weekday.  Trips of unknown services run, and so do all if
    the feed knows no service at all, or neither day is given.
    """
    if on_date is None and weekday is None:
        return feed.trips
    if on_date is not None:
        idle = runs_on(feed.services, feed.exceptions, [on_date]).filter("not runs")
    else:
        idle = feed.services.filter(~F.array_contains("weekdays", F.lit(weekday)))
    # Sent to the trips: dealt by service, all trips would come to as many tasks as there are services.
    return feed.trips.join(F.broadcast(idle.select("service_id")), "service_id", "left_anti").select(*feed.trips.columns)


def service_window(feed: Feed) -> DataFrame:
    """One row (first_day, last_day): of all services' dates and added dates; null without any."""
    added = feed.exceptions.filter("added").select(F.col("day").alias("start"), F.col("day").alias("end"))
    return feed.services.select("start", "end").unionByName(added).agg(F.min("start").alias("first_day"), F.max("end").alias("last_day"))


def covers(first_day: Column, last_day: Column, day: Column) -> Column:
    """Whether day is inside the window; a missing end is open."""
    return F.coalesce(day >= first_day, F.lit(True)) & F.coalesce(day <= last_day, F.lit(True))
