"""Times of day in seconds, which may pass 24 hours, and dates."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column
from pyspark.sql import functions as F

#: "No time given".
NO_TIME = -1


def strip(text: Column) -> Column:
    """text without white space of any script at its ends.  Text of one byte a letter has no other white space than ASCII's, which needs no pattern."""
    anywhere = F.regexp_replace(F.regexp_replace(text, r"(?U)^\s+", ""), r"(?U)\s+$", "")
    return F.when(F.octet_length(text) == F.length(text), F.trim(text, F.lit("\t\n\x0b\x0c\r "))).otherwise(anywhere)


def parse_time(text: Column) -> Column:
    """Seconds since midnight of H:MM or H:MM:SS, of any number of hours; blank or null is NO_TIME; anything else stops the job."""
    return stripped_time(strip(F.coalesce(text, F.lit(""))))


def stripped_time(text: Column) -> Column:
    """The same of text without white space at its ends, which is best a column, as it is taken several times.

    H:MM:SS is cut at its colons from the end; what that can't read is split.
    """
    number = lambda t: t.try_cast("int")
    n, at = F.length(text), lambda k, size: F.substr(text, k, F.lit(size))
    cut = number(F.substr(text, F.lit(1), n - 6)) * 3600 + number(at(n - 4, 2)) * 60 + number(at(n - 1, 2))
    parts = F.split(text, ":")
    total = number(F.get(parts, F.lit(0))) * 3600 + number(F.get(parts, F.lit(1))) * 60 + F.when(F.size(parts) > 2, number(F.get(parts, F.lit(2)))).otherwise(0)
    plain = F.when((n > 6) & (at(n - 5, 1) == ":") & (at(n - 2, 1) == ":"), cut)
    return F.when(text == "", NO_TIME).otherwise(F.coalesce(plain, total, F.raise_error(F.concat(F.lit("not a time: "), text)).cast("int")))


def format_time(seconds: Column) -> Column:
    """HH:MM:SS with hours as they are; --:-- before midnight of the service day."""
    part = lambda x, n: F.lpad((F.floor(seconds / n) if x is None else F.floor(seconds / n) % x).cast("string"), 2, "0")
    hours = F.floor(seconds / 3600).cast("string")
    return F.when(seconds < 0, "--:--").otherwise(F.concat_ws(":", F.when(F.length(hours) < 2, F.lpad(hours, 2, "0")).otherwise(hours), part(60, 60), part(60, 1)))


def clock(seconds: Column) -> Column:
    """The first five characters of format_time."""
    return F.substring(format_time(seconds), 1, 5)


def wall_clock(seconds: Column, twelve: bool = False) -> Column:
    """Rounded to minutes, hours wrapped at midnight; with ``twelve`` as h:mm am/pm."""
    minutes = F.floor((seconds + 30) / 60)
    hour, minute = F.floor(minutes / 60) % 24, F.lpad((minutes % 60).cast("string"), 2, "0")
    if not twelve:
        return F.concat(F.lpad(hour.cast("string"), 2, "0"), F.lit(":"), minute)
    return F.concat((F.when(hour % 12 == 0, 12).otherwise(hour % 12)).cast("string"), F.lit(":"), minute, F.when(hour < 12, " am").otherwise(" pm"))


def parse_date(text: Column) -> Column:
    """The date of YYYYMMDD; null for anything else and for dates that don't exist."""
    clean = strip(text)
    return F.when(clean.rlike("^[0-9]{8}$"), F.try_to_timestamp(clean, F.lit("yyyyMMdd")).cast("date"))


def query_date(text: str | None, first_day: dt.date | None = None, last_day: dt.date | None = None) -> dt.date:
    """A date as a user writes it, with or without dashes.

    If none, today, or the first day of the window of dates that today is not in.
    """
    if not text:
        today = dt.date.today()
        inside = (first_day is None or first_day <= today) and (last_day is None or today <= last_day)
        return today if inside or first_day is None else first_day
    try:
        return dt.datetime.strptime(text.replace("-", ""), "%Y%m%d").date()
    except ValueError:
        raise ValueError(f"not a date: {text!r}; write YYYY-MM-DD") from None


def query_time(text: str) -> int:
    """Seconds of a time as a user writes it."""
    parts = text.strip().split(":")
    if len(parts) < 2 or not all(p.isdigit() for p in parts[:3]):
        raise ValueError(f"not a time: {text!r}; write HH:MM")
    h, m, s = (*map(int, parts[:3]), 0)[:3]
    return h * 3600 + m * 60 + s


def window_label(start: Column, end: Column) -> Column:
    """"4 Sep – 5 Oct 2026", with both years where they differ; empty if either is missing."""
    same = F.date_format(start, "d MMM")
    first = F.when(F.year(start) == F.year(end), same).otherwise(F.date_format(start, "d MMM yyyy"))
    return F.when(start.isNull() | end.isNull(), "").otherwise(F.concat(first, F.lit(" – "), F.date_format(end, "d MMM yyyy")))
