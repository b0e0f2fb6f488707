"""Names of stops, places and routes."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .time import strip

#: What marks a platform at the end of a stop's name, and how long the rest must be.
PLATFORM = r"(?i)\s+(?:[A-Z]|(?:PLATFORM|PLATFORME|BAY|QUAI|STAND)\s*[0-9]{1,2})$"
NUMBER = r"\s+[0-9]{1,2}$"
SHORTEST_STEM, SHORTEST_NUMBERED_STEM = 4, 10
#: Modes of GTFS route types.
MODES = {0: "tram", 1: "metro", 2: "rail", 3: "bus", 4: "ferry", 5: "tram", 6: "gondola", 7: "funicular"}


def name_stem(name: Column) -> Column:
    """The lower-case name without a platform mark at its end.

    A letter or a labelled platform goes if at least SHORTEST_STEM characters
    stay; a bare number only off several words of SHORTEST_NUMBERED_STEM.
    """
    clean = strip(name)
    marked, numbered = F.regexp_replace(clean, PLATFORM, ""), F.regexp_replace(clean, NUMBER, "")
    return F.lower(
        F.when((marked != clean) & (F.length(marked) >= SHORTEST_STEM), marked)
        .when((numbered != clean) & (F.length(numbered) >= SHORTEST_NUMBERED_STEM) & strip(numbered).contains(" "), numbered)
        .otherwise(clean)
    )


def fold_text(text: str) -> str:
    """What someone would type for a name: plain lower-case letters and digits, one space between words, apostrophes gone."""
    plain = unicodedata.normalize("NFKD", text.lower())
    kept = [c for c in plain if not unicodedata.combining(c) and c not in "'’ʼ"]
    return " ".join("".join(c if c.isascii() and c.isalnum() else " " for c in kept).split())


@F.pandas_udf(T.StringType())
def fold(names: pd.Series) -> pd.Series:
    """fold_text of each name.  Spark has no Unicode decomposition of its own; names are few beside trips."""
    distinct = {n: None if n is None else fold_text(n) for n in names.unique()}
    return names.map(distinct)


@F.pandas_udf(T.StringType())
def title_case(names: pd.Series) -> pd.Series:
    """Each letter run capitalised, after apostrophes and dashes too, which initcap leaves alone."""
    return names.str.title()


def is_upper(text: Column) -> Column:
    return (F.upper(text) == text) & (F.lower(text) != text)


def hex_colour(text: Column) -> Column:
    """#rrggbb in lower case; empty if text is not six hexadecimal digits after any #."""
    digits = F.lower(F.regexp_replace(strip(F.coalesce(text, F.lit(""))), "^#+", ""))
    return F.when(digits.rlike("^[0-9a-f]{6}$"), F.concat(F.lit("#"), digits)).otherwise("")


def route_label(short_name: Column, long_name: Column, route_id: Column) -> Column:
    return F.coalesce(F.nullif(short_name, F.lit("")), F.nullif(long_name, F.lit("")), route_id)


def route_mode(route_type: Column) -> Column:
    modes = F.create_map(*[F.lit(x) for pair in MODES.items() for x in pair])
    return F.coalesce(F.try_element_at(modes, route_type), F.lit("bus"))


def short_address(name: Column) -> Column:
    """The first two parts that commas separate; the whole if there are none."""
    parts = F.filter(F.transform(F.split(name, ","), lambda p: F.trim(p)), lambda p: p != "")
    return F.when(F.size(parts) > 0, F.array_join(F.slice(parts, 1, 2), ", ")).otherwise(name)


def lookup_key(text: Column) -> Column:
    return F.regexp_replace(F.lower(strip(text)), r"(?U)\s+", " ")


def feed_name(path: Column) -> Column:
    return F.element_at(F.split(path, r"[/\\]"), -1)
