"""Places: stops that a traveller thinks of as one, and finding them by name."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geo import cell, cells_around, grid_sizes, haversine, metres_between
from ..functions.text import fold, is_upper, name_stem, title_case
from ..graph import components
from ..storage import Scratch
from .ranking import ranked
from .transfers import furthest_lat, placed

#: Stops of one name further apart than this are different places.
SAME_NAME_M = 250.0
SEARCH_LIMIT = 25
#: Stops of one name that one task puts into places at once.
AT_ONCE = 100_000
#: Queries that are broadcast at most; more meet places by an index of their letters.
SMALL_BATCH = 1000


def _near_pairs(here: DataFrame, sizes: tuple[float, float]) -> DataFrame:
    """(early, late) by stop_ord: all pairs of stops (stop_ord, stem, lat, lon) of one name within SAME_NAME_M of each other."""
    near = here.select(F.col("stop_ord").alias("early"), "stem", F.col("lat").alias("lat2"), F.col("lon").alias("lon2"), cell(F.col("lat"), F.col("lon"), sizes).alias("cell"))
    late = here.select(F.col("stop_ord").alias("late"), "stem", "lat", "lon", F.explode(cells_around(F.col("lat"), F.col("lon"), sizes)).alias("cell"))
    return late.join(near, ["stem", "cell"]).filter((F.col("early") < F.col("late")) & (haversine(F.col("lat2"), F.col("lon2"), F.col("lat"), F.col("lon")) <= SAME_NAME_M)).select("early", "late")


def _first_come(pairs: DataFrame, scratch: Scratch) -> DataFrame:
    """(late, seed) of pairs (early, late): the stops that an earlier one takes in, and the earliest that does, decided in rounds.

    A round decides all stops that have no undecided earlier neighbour; rounds
    grow with the longest chain of neighbours, each earlier than the next.
    """
    pairs = scratch.write(pairs)
    left, taken = pairs, pairs.select("late").limit(0)
    while not left.isEmpty():
        seeds = left.select("early").distinct().join(left.select(F.col("late").alias("early")), "early", "left_anti")
        now = scratch.write(left.join(seeds, "early", "left_semi").select("late").distinct())
        taken = taken.unionByName(now)
        left = scratch.write(left.join(now, "late", "left_anti").join(now.withColumnRenamed("late", "early"), "early", "left_anti"))
    seeds = pairs.join(taken.withColumnRenamed("late", "early"), "early", "left_anti")
    return seeds.groupBy("late").agg(F.min("early").alias("seed"))


def _taken_in(rows: pd.DataFrame, sizes: tuple[float, float]) -> pd.DataFrame:
    """(late, seed) of the stops (stop_ord, lat, lon) of one group: in their order, each is taken in by the earliest seed within reach, or is one."""
    seeds: dict[tuple[int, int], list[tuple[int, float, float]]] = {}
    out = []
    for k, lat, lon in rows.sort_values("stop_ord")[["stop_ord", "lat", "lon"]].itertuples(index=False):
        a, b = math.floor(lat / sizes[0]), math.floor(lon / sizes[1])
        near = [s for da in (-1, 0, 1) for db in (-1, 0, 1) for s in seeds.get((a + da, b + db), ()) if metres_between(s[1], s[2], lat, lon) <= SAME_NAME_M]
        if near:
            out.append((k, min(near)[0]))
        else:
            seeds.setdefault((a, b), []).append((k, lat, lon))
    return pd.DataFrame(out, columns=["late", "seed"]).astype("int64")


def _clusters(single: DataFrame, scratch: Scratch, most: int) -> DataFrame:
    """(late, seed) of stops (stop_ord, stem, lat, lon), as if all of one stem came in order, each a seed unless an earlier seed is within SAME_NAME_M.

    What is decided in one task is a stem of at most ``most`` stops, or of a
    larger one a component of its graph of near pairs, if that has no more;
    components beyond that are decided in rounds of joins.
    """
    here = placed(single).select("stop_ord", "stem", "lat", "lon")
    sizes = grid_sizes(SAME_NAME_M, furthest_lat(single))
    decide = lambda rows: _taken_in(rows, sizes)
    counts = here.groupBy("stem").agg(F.count(F.lit(1)).alias("n"))
    if (counts.agg(F.max("n")).first()[0] or 0) <= most:
        return here.groupBy("stem").applyInPandas(decide, "late long, seed long")
    stems = scratch.write(counts.filter(F.col("n") > most).select("stem"))
    small = here.join(stems, "stem", "left_anti").groupBy("stem").applyInPandas(decide, "late long, seed long")
    large = scratch.write(here.join(stems, "stem", "left_semi"))
    pairs = scratch.write(_near_pairs(large, sizes))
    named = scratch.write(components(pairs.select(F.col("early").alias("a"), F.col("late").alias("b")), scratch))
    beyond = scratch.write(named.groupBy("component").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > most).select("component"))
    each = large.join(named.withColumnRenamed("node", "stop_ord"), "stop_ord")
    whole = each.join(beyond, "component", "left_anti").groupBy("component").applyInPandas(decide, "late long, seed long")
    rest = pairs.join(named.join(beyond, "component", "left_semi").select(F.col("node").alias("late")), "late", "left_semi")
    return small.unionByName(whole).unionByName(_first_come(rest.select("early", "late"), scratch))


def build_places(stops: DataFrame, most: int = AT_ONCE) -> DataFrame:
    """(place_id, place_ord, name, search_key, stop_ids, lat, lon) of all boardable stops.

    Stops of a known station are its place, under its name and id.  The others
    form a place where they share a name without platform marks and are near
    the first of them; its id is that stop's, or, for further places of a name,
    the stem and a number.  The places are written and read again.
    """
    scratch = Scratch(stops.sparkSession, "places")
    board = stops.filter("location_type = 0")
    stations = stops.select(F.col("stop_id").alias("parent"), F.col("name").alias("station"), F.col("location_type").alias("station_type"))
    with_parent = board.filter("parent <> ''").join(stations, "parent")
    grouped = with_parent.select(F.col("parent").alias("place_id"), "stop_id")
    single = board.join(with_parent.select("stop_id"), "stop_id", "left_anti").withColumn("stem", name_stem(F.col("name")))
    single = scratch.write(single.select("stop_ord", "stop_id", "stem", "lat", "lon"))
    taken_in = scratch.write(_clusters(single, scratch, most)).withColumnRenamed("late", "stop_ord")
    clustered = single.join(taken_in, "stop_ord", "left").withColumn("seed", F.coalesce("seed", "stop_ord"))
    seeds = ranked(clustered.filter("seed = stop_ord").select("seed", "stem", F.col("stop_id").alias("seed_id")), ["stem"], ["seed"], "number", scratch)
    numbered = F.concat_ws("#", "stem", F.col("number").cast("string"))
    seeds = seeds.withColumn("own", F.when(F.col("number") == 0, F.col("seed_id")).otherwise(numbered))
    # The id of a place that a station names, and a numbered one that a stop has, is made unique by the seed.
    taken = grouped.select(F.col("place_id").alias("own"), F.lit(0).alias("above")).unionByName(stops.select(F.col("stop_id").alias("own"), F.lit(1).alias("above"))).groupBy("own").agg(F.min("above").alias("above"))
    seeds = seeds.join(taken, "own", "left").withColumn("used", F.coalesce(F.col("number") >= F.col("above"), F.lit(False)))
    seeds = seeds.select("seed", F.when(F.col("used"), F.concat(numbered, F.lit("@"), F.col("seed_id"))).otherwise(F.col("own")).alias("place_id"))
    named = clustered.join(seeds, "seed").select("place_id", "stop_id")
    members = grouped.unionByName(named).join(board.select("stop_id", "stop_ord", "name", "lat", "lon"), "stop_id")
    places = members.groupBy("place_id").agg(
        F.min("stop_ord").alias("place_ord"), F.min_by("name", "stop_ord").alias("first_name"), F.size(F.collect_set("name")).alias("n_names"),
        F.array_sort(F.collect_list("stop_id")).alias("stop_ids"), F.avg("lat").alias("lat"), F.avg("lon").alias("lon"),
    )
    places = places.join(stations.filter("station_type <> 0").withColumnRenamed("parent", "place_id"), "place_id", "left")
    stem = name_stem(F.col("first_name"))
    name = F.coalesce("station", F.when(F.col("n_names") == 1, F.col("first_name")).when(is_upper(F.col("first_name")), F.upper(stem)).otherwise(title_case(stem)))
    return scratch.write(places.withColumn("name", name).select("place_id", "place_ord", "name", fold("name").alias("search_key"), "stop_ids", "lat", "lon"))


def place_counts(places: DataFrame) -> DataFrame:
    """(metric, value): all places, and those of more than one stop."""
    counts = places.agg(F.count(F.lit(1)).alias("places"), F.count_if(F.size("stop_ids") > 1).alias("places of several stops"))
    return counts.unpivot([], ["places", "places of several stops"], "metric", "value")


def _grams(words: Column) -> Column:
    """Runs of three letters of words, and whole words that are shorter."""
    runs = F.transform(words, lambda w: F.when(F.length(w) < 3, F.array(w)).otherwise(F.transform(F.sequence(F.lit(1), F.greatest(F.length(w) - 2, F.lit(1))), lambda i: F.substring(w, i, F.lit(3)))))
    return F.array_distinct(F.flatten(runs))


def _by_letters(places: DataFrame, wanted: DataFrame) -> DataFrame:
    """places and wanted (query, needle) that share the needle's rarest run of letters.

    A place that a needle finds holds all its words, so all their runs; places
    are listed under their runs of one, two and three letters.
    """
    key = F.col("search_key")
    runs = F.flatten(F.transform(F.array(F.lit(1), F.lit(2), F.lit(3)), lambda n: F.transform(F.sequence(F.lit(1), F.greatest(F.length(key) - n + 1, F.lit(1))), lambda i: F.substring(key, i, n))))
    listed = places.select("place_id", F.explode(F.array_distinct(runs)).alias("gram"))
    asked = wanted.select("query", "needle", F.explode(_grams(F.split("needle", " "))).alias("gram"))
    sizes = listed.join(asked.select("gram").distinct(), "gram", "left_semi").groupBy("gram").agg(F.count(F.lit(1)).alias("n"))
    rarest = asked.join(sizes, "gram", "left").groupBy("query", "needle").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "gram")).alias("rarest"))
    return rarest.select("query", "needle", "rarest.gram").join(listed, "gram").drop("gram").join(places, "place_id")


def search_places(places: DataFrame, queries: DataFrame, limit: int = SEARCH_LIMIT) -> DataFrame:
    """(query, rank, place_id, name, tier) of the places that each query (query) finds, best first.

    Tiers: 0 the whole name, 1 its beginning, 2 any part of it, 3 all of
    several words anywhere.  Exact ones keep the feed's order, others come by
    length of name, then name.  A blank query finds nothing.
    """
    wanted = queries.select("query", fold(F.coalesce("query", F.lit(""))).alias("needle")).filter("needle <> ''").distinct()
    words = F.split("needle", " ")
    all_words = (F.size(words) > 1) & F.forall(words, lambda w: F.contains(F.col("search_key"), w))
    if wanted.limit(SMALL_BATCH + 1).count() <= SMALL_BATCH:
        met = places.join(F.broadcast(wanted))
    else:
        met = _by_letters(places, wanted)
    met = met.filter(F.contains(F.col("search_key"), F.col("needle")) | all_words)
    key, needle = F.col("search_key"), F.col("needle")
    tier = F.when(key == needle, 0).when(F.startswith(key, needle), 1).when(F.contains(key, needle), 2).otherwise(3)
    order = Window.partitionBy("query").orderBy("tier", F.when(F.col("tier") > 0, F.length("name")), F.when(F.col("tier") > 0, F.col("name")), "place_ord", "place_id")
    ranked = met.withColumn("tier", tier).withColumn("rank", F.row_number().over(order))
    return ranked.filter(F.col("rank") <= limit).select("query", "rank", "place_id", "name", "tier")


def resolve_places(places: DataFrame, stops: DataFrame, queries: DataFrame) -> DataFrame:
    """(query, place_id, name, stop_ids, how) of the queries that mean one place.

    In turn: a place's id; a stop's id, for the place that holds it or else the
    stop alone; the only place found; the only place of that whole name among
    those found.
    """
    wanted = queries.select("query").distinct().withColumn("token", F.trim("query"))
    by_id = wanted.join(places, F.col("token") == F.col("place_id")).select("query", F.lit(0).alias("how"), "place_id", "name", "stop_ids")
    holder = places.select("place_id", "place_ord", F.explode("stop_ids").alias("stop_id")).groupBy("stop_id").agg(F.min_by("place_id", "place_ord").alias("place_id"))
    stop = wanted.join(stops.select("stop_id", F.col("name").alias("stop_name")), F.col("token") == F.col("stop_id")).join(holder, "stop_id", "left")
    stop = stop.join(places.select("place_id", "name", "stop_ids"), "place_id", "left")
    by_stop = stop.select("query", F.lit(1).alias("how"), F.coalesce("place_id", "stop_id").alias("place_id"), F.coalesce("name", "stop_name").alias("name"), F.coalesce("stop_ids", F.array("stop_id")).alias("stop_ids"))
    found = search_places(places, queries)
    counted = found.groupBy("query").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("tier") == 0).alias("n_exact"), F.min_by("place_id", "rank").alias("place_id"))
    # Exact ones come first, so the first one found is the one meant either way.
    by_name = counted.filter("n = 1 or n_exact = 1").select("query", F.when(F.col("n") == 1, 2).otherwise(3).alias("how"), "place_id").join(places.select("place_id", "name", "stop_ids"), "place_id")
    every = by_id.unionByName(by_stop).unionByName(by_name.select("query", "how", "place_id", "name", "stop_ids"))
    first = Window.partitionBy("query").orderBy("how")
    return every.withColumn("_n", F.row_number().over(first)).filter("_n = 1").select("query", "place_id", "name", "stop_ids", "how")
