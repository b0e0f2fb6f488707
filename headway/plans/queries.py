"""The library's operators as queries over the driver's tables, and the same in SQL."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import hex_colour, name_stem, route_label, route_mode
from ..functions.time import clock, format_time, parse_date, parse_time, wall_clock, window_label
from ..operators.calendar import covers, running_trips, runs_on, service_window
from ..operators.itinerary import as_json, benchmark_stats, describe, journeys, merge_walks, named_legs, summary, tags, with_doors, with_points
from ..operators.pairs import random_pairs
from ..operators.patterns import build_timetable, earliest_trips, overtaking, timetable_counts, trip_patterns
from ..operators.places import place_counts, resolve_places, search_places
from ..operators.requests import Answers, answer
from ..operators.router import boardings, first_frontier, pareto, route_scan, stops_reached
from ..operators.transfers import bounds, footpaths, generated_footpaths, walkable_from
from ..sources.gtfs import clean_stop_times as usable_stop_times
from ..sources.gtfs import feed_counts
from .network import BUSY_VIEWS, DAYS, LEGS, SOUTH, VIEWS, WEST, Batch, busy_network, doors_sql, network, places, queries_sql, query_batch, rounds_sql, solved, table, timetable
from .registry import query

#: As many as the published single-thread benchmark solves.
BENCHMARK_QUERIES = 200


# Trips from line items, which come in no order, repeat positions and miss times.
_ITEMS = """
WITH x AS (SELECT l_orderkey AS trip_id, l_suppkey AS stop_id, l_linenumber AS seq, l_partkey * 1000000 + l_suppkey AS st_ord,
  CASE WHEN l_discount = 0 THEN -1 ELSE 18000 + l_linenumber * 300 END AS a, CASE WHEN l_tax = 0 THEN -1 ELSE 18060 + l_linenumber * 300 END AS d FROM lineitem),
y AS (SELECT trip_id, stop_id, seq, st_ord, CASE WHEN a = -1 THEN d ELSE a END AS arr, CASE WHEN d = -1 THEN a ELSE d END AS dep FROM x WHERE (a <> -1 OR d <> -1)
  AND trip_id IN (SELECT o_orderkey FROM orders WHERE o_orderstatus <> 'P') AND stop_id IN (SELECT s_suppkey FROM supplier WHERE s_acctbal > 0)),
calls AS (SELECT trip_id, (row_number() OVER (PARTITION BY trip_id ORDER BY seq, st_ord, stop_id, arr, dep) - 1)::INTEGER AS pos, stop_id, arr, dep, count(*) OVER (PARTITION BY trip_id) AS n FROM y)"""


def _items(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    times = table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("trip_id"), F.col("l_suppkey").alias("stop_id"), F.col("l_linenumber").alias("seq"), (F.col("l_partkey") * 1_000_000 + F.col("l_suppkey")).alias("st_ord"),
        F.when(F.col("l_discount") == 0, -1).otherwise(18000 + F.col("l_linenumber") * 300).alias("arr"), F.when(F.col("l_tax") == 0, -1).otherwise(18060 + F.col("l_linenumber") * 300).alias("dep"),
    )
    trips = table(spark, sf_dir, "orders").filter("o_orderstatus <> 'P'").select(F.col("o_orderkey").alias("trip_id"), F.col("o_orderkey").alias("trip_ord"), (F.col("o_custkey") % 20).alias("route_id"))
    stops = table(spark, sf_dir, "supplier").filter("s_acctbal > 0").select(F.col("s_suppkey").alias("stop_id"))
    return usable_stop_times(times, trips, stops)


@query(f"{_ITEMS} SELECT trip_id, pos, stop_id, arr, dep FROM calls WHERE n >= 2")
def clean_stop_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _items(spark, sf_dir)[1]


def _pattern_rows(each: DataFrame) -> DataFrame:
    return each.groupBy("pattern_id", "route_id", "stops").agg(F.count(F.lit(1)).alias("n_trips"), F.min("first_dep").alias("first_dep"), F.max("first_dep").alias("last_dep")).withColumn("stop_seq", F.array_join(F.col("stops").cast("array<string>"), ",")).drop("stops")


@query(f"""{_ITEMS}, s AS (SELECT trip_id, string_agg(stop_id::VARCHAR, ',' ORDER BY pos) AS stop_seq, any_value(dep) FILTER (pos = 0) AS first_dep FROM calls WHERE n >= 2 GROUP BY trip_id)
SELECT min(trip_id) AS pattern_id, o_custkey % 20 AS route_id, stop_seq, count(*) AS n_trips, min(first_dep) AS first_dep, max(first_dep) AS last_dep FROM s JOIN orders ON o_orderkey = trip_id GROUP BY o_custkey % 20, stop_seq""")
def trip_patterns_messy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pattern_rows(trip_patterns(*_items(spark, sf_dir)))


@query(f"{VIEWS} SELECT pattern_id, route_id, stops AS stop_seq, count(*) AS n_trips, min(first_dep) AS first_dep, max(first_dep) AS last_dep FROM tp GROUP BY ALL")
def trip_patterns_network(spark: SparkSession, sf_dir: str) -> DataFrame:
    feed = network(spark, sf_dir)
    return _pattern_rows(trip_patterns(running_trips(feed, on_date=DAYS[4]), feed.stop_times))


@query(f"{VIEWS} SELECT pattern_id, pos, stop_id FROM ps")
def pattern_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return timetable(network(spark, sf_dir)).pattern_stops.select("pattern_id", "pos", "stop_id")


@query(f"{VIEWS} SELECT * FROM ranked")
def pattern_trip_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    return timetable(network(spark, sf_dir)).pattern_trips


@query(f"{VIEWS}, late AS (SELECT pattern_id, trip_rank, pos, dep + trip_id % 7 * 90 * pos AS dep FROM ev), o AS (SELECT *, lag(dep) OVER (PARTITION BY pattern_id, pos ORDER BY trip_rank) AS b FROM late) SELECT pattern_id, pos, count(*) AS n_bad FROM o WHERE b > dep GROUP BY ALL")
def fifo_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = timetable(network(spark, sf_dir))
    return overtaking(t.pattern_events.join(t.pattern_trips, ["pattern_id", "trip_rank"]).withColumn("dep", F.col("dep") + F.col("trip_id") % 7 * 90 * F.col("pos")))


@query(f"{VIEWS} SELECT day::VARCHAR AS day, service_id, runs, count(trip_id) AS n_trips FROM service_days LEFT JOIN trips USING (service_id) GROUP BY ALL")
def service_on_date(spark: SparkSession, sf_dir: str) -> DataFrame:
    feed = network(spark, sf_dir)
    n = feed.trips.groupBy("service_id").agg(F.count(F.lit(1)).alias("n_trips"))
    return runs_on(feed.services, feed.exceptions, DAYS).join(n, "service_id", "left").select(F.col("day").cast("string").alias("day"), "service_id", "runs", F.coalesce("n_trips", F.lit(0)).alias("n_trips"))


@query(f"{VIEWS}, w(weekday) AS (SELECT unnest(range(7))::INTEGER) SELECT weekday, service_id, count(*) AS n_trips FROM w, trips LEFT JOIN services USING (service_id) WHERE weekdays IS NULL OR list_contains(weekdays, weekday) GROUP BY ALL")
def service_on_weekday(spark: SparkSession, sf_dir: str) -> DataFrame:
    feed = network(spark, sf_dir)
    days = [running_trips(feed, weekday=d).groupBy("service_id").agg(F.count(F.lit(1)).alias("n_trips")).withColumn("weekday", F.lit(d)) for d in range(7)]
    out = days[0]
    for d in days[1:]:
        out = out.unionByName(d)
    return out


@query(f"{VIEWS}, w AS (SELECT min(a) AS first_day, max(b) AS last_day FROM (SELECT first_day AS a, last_day AS b FROM services UNION ALL SELECT day, day FROM exceptions WHERE added)) SELECT first_day::VARCHAR AS first_day, last_day::VARCHAR AS last_day, DATE '{DAYS[4]}' BETWEEN first_day AND last_day AS covers_day, strftime(first_day, '%-d %b %Y') || ' – ' || strftime(last_day, '%-d %b %Y') AS label FROM w")
def feed_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = service_window(network(spark, sf_dir))
    a, b = F.col("first_day"), F.col("last_day")
    return w.select(a.cast("string").alias("first_day"), b.cast("string").alias("last_day"), covers(a, b, F.lit(DAYS[4])).alias("covers_day"), window_label(a, b).alias("label"))


@query(f"""{VIEWS} SELECT 'stops' AS metric, count(*) AS value FROM stops UNION ALL SELECT 'routes', count(DISTINCT route_id) FROM trips UNION ALL SELECT 'trips', count(*) FROM trips UNION ALL SELECT 'stop_times', count(*) FROM stop_times
UNION ALL SELECT 'services', count(*) FROM services UNION ALL SELECT 'exceptions', count(*) FROM exceptions UNION ALL SELECT 'transfers', count(*) FROM stops WHERE stop_ord % 7 = 0""")
def feed_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return feed_counts(network(spark, sf_dir))


@query(f"""{VIEWS}, t AS (SELECT DISTINCT arr * 3 - 60000 AS seconds FROM stop_times), p AS (SELECT seconds, seconds // 3600 AS h, (seconds // 60) % 60 AS m, seconds % 60 AS s, ((seconds + 30) // 60) AS w FROM t WHERE seconds >= 0)
SELECT seconds, hhmmss, left(hhmmss, 5) AS hhmm, hhmm_wrapped FROM (SELECT seconds, CASE WHEN h < 10 THEN '0' ELSE '' END || h || ':' || lpad(m::VARCHAR, 2, '0') || ':' || lpad(s::VARCHAR, 2, '0') AS hhmmss, lpad((w // 60 % 24)::VARCHAR, 2, '0') || ':' || lpad((w % 60)::VARCHAR, 2, '0') AS hhmm_wrapped FROM p)
UNION ALL SELECT seconds, '--:--', '--:--', NULL FROM t WHERE seconds < 0""")
def format_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = network(spark, sf_dir).stop_times.select((F.col("arr") * 3 - 60000).alias("seconds")).distinct()
    s = F.col("seconds")
    return t.select("seconds", format_time(s).alias("hhmmss"), clock(s).alias("hhmm"), F.when(s >= 0, wall_clock(s)).alias("hhmm_wrapped"))


@query("""SELECT DISTINCT t AS text, h * 3600 + m * 60 + s AS seconds FROM (SELECT l_partkey % 120 AS h, l_suppkey % 60 AS m, l_linenumber % 60 AS s, ' ' || h || ':' || lpad(m::VARCHAR, 2, '0') || ':' || lpad(s::VARCHAR, 2, '0') AS t FROM lineitem)
UNION ALL SELECT DISTINCT t, h * 3600 + m * 60 FROM (SELECT l_partkey % 30 AS h, l_suppkey % 60 AS m, h || ':' || m AS t FROM lineitem) UNION ALL SELECT '  ', -1""")
def parse_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = table(spark, sf_dir, "lineitem")
    two = lambda c: F.lpad(c.cast("string"), 2, "0")
    full = items.select(F.concat(F.lit(" "), (F.col("l_partkey") % 120).cast("string"), F.lit(":"), two(F.col("l_suppkey") % 60), F.lit(":"), two(F.col("l_linenumber") % 60)).alias("text"))
    short = items.select(F.concat_ws(":", (F.col("l_partkey") % 30).cast("string"), (F.col("l_suppkey") % 60).cast("string")).alias("text"))
    texts = full.distinct().unionByName(short.distinct()).unionByName(spark.range(1).select(F.lit("  ").alias("text")))
    return texts.select("text", parse_time(F.col("text")).cast("long").alias("seconds"))


@query("SELECT DISTINCT strftime(o_orderdate, '%Y%m%d') AS text, o_orderdate::DATE::VARCHAR AS day FROM orders UNION ALL SELECT DISTINCT strftime(o_orderdate, '%Y-%m-%d'), NULL FROM orders UNION ALL VALUES ('20240230', NULL)")
def parse_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    day = table(spark, sf_dir, "orders").select(F.col("o_orderdate").cast("date").alias("d"))
    texts = day.select(F.date_format("d", "yyyyMMdd").alias("text")).distinct().unionByName(day.select(F.date_format("d", "yyyy-MM-dd").alias("text")).distinct()).unionByName(spark.range(1).select(F.lit("20240230").alias("text")))
    return texts.select("text", parse_date(F.col("text")).cast("string").alias("day"))


@query("SELECT DISTINCT p_brand AS brand, '#' || lower(right(md5(p_brand), 6)) AS color, '' AS bad FROM part")
def hex_colours(spark: SparkSession, sf_dir: str) -> DataFrame:
    brands = table(spark, sf_dir, "part").select(F.col("p_brand").alias("brand")).distinct()
    return brands.select("brand", hex_colour(F.concat(F.lit(" #"), F.upper(F.right(F.md5(F.col("brand").cast("binary")), F.lit(6))))).alias("color"), hex_colour(F.col("brand")).alias("bad"))


@query("""SELECT r AS route_id, CASE WHEN r % 3 <> 0 THEN 'R' || r WHEN r % 2 <> 0 THEN 'Route ' || r ELSE r::VARCHAR END AS label,
CASE r % 10 WHEN 0 THEN 'tram' WHEN 1 THEN 'metro' WHEN 2 THEN 'rail' WHEN 4 THEN 'ferry' WHEN 5 THEN 'tram' WHEN 6 THEN 'gondola' WHEN 7 THEN 'funicular' ELSE 'bus' END AS mode FROM (SELECT DISTINCT o_custkey % 20 AS r FROM orders)""")
def route_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return network(spark, sf_dir).routes.select("route_id", route_label(F.col("short_name"), F.col("long_name"), F.col("route_id").cast("string")).alias("label"), route_mode(F.col("route_type")).alias("mode"))


@query(f"{VIEWS} SELECT * FROM generated")
def walking_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return generated_footpaths(network(spark, sf_dir).stops)


@query(f"{VIEWS} SELECT * FROM footpaths")
def footpaths_override(spark: SparkSession, sf_dir: str) -> DataFrame:
    feed = network(spark, sf_dir)
    return footpaths(feed.stops, feed.transfers)


_POINTS = f"p AS (SELECT c_custkey AS point_id, {SOUTH}::DOUBLE + (c_custkey % 97) * 0.0004::DOUBLE AS lat, {WEST}::DOUBLE + (c_custkey % 89) * 0.0005::DOUBLE AS lon FROM customer)"
_NEAR = "2 * 6371000.0::DOUBLE * asin(sqrt(least(1.0, pow(sin(radians(s.lat - p.lat) / 2), 2) + cos(radians(p.lat)) * cos(radians(s.lat)) * pow(sin(radians(s.lon - p.lon) / 2), 2))))"


@query(f"""{VIEWS}, {_POINTS}, m AS (SELECT point_id, stop_id, {_NEAR} AS metres FROM p JOIN stops s ON location_type = 0 AND {_NEAR} <= 800),
r AS (SELECT *, row_number() OVER (PARTITION BY point_id ORDER BY metres, stop_id)::INTEGER AS rank FROM m) SELECT point_id, stop_id, rank, greatest(60, trunc(metres * 1.3 / 1.33)::INTEGER) AS seconds FROM r WHERE rank <= 8""")
def walkable_stops(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    points = table(spark, sf_dir, "customer").select(k.alias("point_id"), (F.lit(SOUTH) + (k % 97) * 0.0004).alias("lat"), (F.lit(WEST) + (k % 89) * 0.0005).alias("lon"))
    return walkable_from(points, network(spark, sf_dir).stops)


@query(f"{VIEWS} SELECT round(min(lat) - 0.15, 6) AS south, round(min(lon) - 0.15, 6) AS west, round(max(lat) + 0.15, 6) AS north, round(max(lon) + 0.15, 6) AS east FROM stops")
def feed_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bounds(network(spark, sf_dir).stops).select(*[F.round(c, 6).alias(c) for c in ("south", "west", "north", "east")])


_PART_NAMES = "SELECT DISTINCT p_name || CASE p_size % 6 WHEN 0 THEN ' B' WHEN 1 THEN ' platform 3' WHEN 2 THEN ' 12' WHEN 3 THEN ' Quai  7' WHEN 4 THEN ' / X' ELSE '' END AS name FROM part"


@query(rf"""WITH x AS ({_PART_NAMES} UNION ALL VALUES ('Perron 4'), ('OST'), ('Halt 31'), ('MILLER''S FIELD 3')),
y AS (SELECT name, regexp_replace(name, '(?i)\s+(?:[A-Z]|(?:PLATFORM|PLATFORME|BAY|QUAI|STAND)\s*[0-9]{{1,2}})$', '') AS a, regexp_replace(name, '\s+[0-9]{{1,2}}$', '') AS b FROM x)
SELECT name, lower(CASE WHEN a <> name AND length(a) >= 4 THEN a WHEN b <> name AND length(b) >= 10 AND contains(trim(b), ' ') THEN b ELSE name END) AS stem FROM y""")
def normalised_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    size = F.col("p_size") % 6
    tail = F.when(size == 0, " B").when(size == 1, " platform 3").when(size == 2, " 12").when(size == 3, " Quai  7").when(size == 4, " / X").otherwise("")
    names = table(spark, sf_dir, "part").select(F.concat("p_name", tail).alias("name")).distinct()
    more = spark.range(1).select(F.explode(F.array(*map(F.lit, ["Perron 4", "OST", "Halt 31", "MILLER'S FIELD 3"]))).alias("name"))
    return names.unionByName(more).select("name", name_stem(F.col("name")).alias("stem"))


# Up to 55.8 degrees (31,000 suppliers) no two stops of the lattice are within 250 m, so the clusters of a name are its stops.
# Beyond, neighbours are; this SQL still takes each for itself, so there it differs from build_places.
_PLACES = r""",
board AS (SELECT * FROM stops WHERE location_type = 0),
child AS (SELECT b.stop_id, s.stop_id AS place_id, CASE WHEN s.location_type <> 0 THEN s.name END AS station FROM board b JOIN stops s ON b.parent = s.stop_id),
alone AS (SELECT stop_id, stop_ord, regexp_replace(lower(name), '\s[a-e]$', '') AS stem, row_number() OVER (PARTITION BY regexp_replace(lower(name), '\s[a-e]$', '') ORDER BY stop_ord) - 1 AS number FROM board WHERE stop_id NOT IN (SELECT stop_id FROM child)),
member AS (SELECT stop_id, place_id, station FROM child UNION ALL SELECT stop_id, CASE WHEN number = 0 THEN stop_id ELSE stem || '#' || number END, NULL FROM alone),
places AS (SELECT place_id, min(stop_ord) AS place_ord, coalesce(any_value(station), CASE WHEN count(DISTINCT name) = 1 THEN any_value(name) ELSE upper(regexp_replace(arg_min(name, stop_ord), '\s[A-E]$', '')) END) AS name,
  string_agg(stop_id, ',' ORDER BY stop_id) AS stop_ids, round(avg(lat), 6) AS lat, round(avg(lon), 6) AS lon FROM member JOIN stops USING (stop_id) GROUP BY place_id),
keyed AS (SELECT *, trim(regexp_replace(lower(name), '[^0-9a-z]+', ' ', 'g')) AS search_key FROM places)"""


@query(f"{VIEWS}{_PLACES} SELECT place_id, name, search_key, stop_ids, lat, lon FROM keyed")
def place_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = places(network(spark, sf_dir))
    return found.select("place_id", "name", "search_key", F.array_join("stop_ids", ",").alias("stop_ids"), F.round("lat", 6).alias("lat"), F.round("lon", 6).alias("lon"))


def _search_sql(asked: str) -> str:
    return f""",
asked AS ({asked}),
needles AS (SELECT query, trim(regexp_replace(lower(query), '[^0-9a-z]+', ' ', 'g')) AS needle FROM asked),
tiers AS (SELECT query, place_id, place_ord, name, CASE WHEN search_key = needle THEN 0 WHEN starts_with(search_key, needle) THEN 1 WHEN contains(search_key, needle) THEN 2
  WHEN contains(needle, ' ') AND len(list_filter(string_split(needle, ' '), lambda w: NOT contains(search_key, w))) = 0 THEN 3 END AS tier FROM needles, keyed WHERE needle <> ''),
found AS MATERIALIZED (SELECT * FROM (SELECT query, row_number() OVER (PARTITION BY query ORDER BY tier, CASE WHEN tier > 0 THEN length(name) END, CASE WHEN tier > 0 THEN name END, place_ord, place_id)::INTEGER AS rank, place_id, name, tier FROM tiers WHERE tier IS NOT NULL) WHERE rank <= 25),
ways AS (SELECT query, 0 AS how, place_id FROM asked JOIN places ON trim(query) = place_id
  UNION ALL SELECT query, 1, coalesce(m.place_id, s.stop_id) FROM asked JOIN stops s ON trim(query) = s.stop_id LEFT JOIN member m ON m.stop_id = s.stop_id
  UNION ALL SELECT query, CASE WHEN count(*) = 1 THEN 2 ELSE 3 END, arg_min(place_id, rank) FROM found GROUP BY query HAVING count(*) = 1 OR count(*) FILTER (tier = 0) = 1),
meant AS MATERIALIZED (SELECT query, place_id, how, coalesce(p.name, s.name) AS name, coalesce(p.stop_ids, s.stop_id) AS stop_ids FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY how) AS i FROM ways) LEFT JOIN places p USING (place_id) LEFT JOIN stops s ON s.stop_id = place_id WHERE i = 1)"""


_ASKED = ["NATION_1", "nation 1 a", "Nation-2", "a nation", "5", "17", "ation 3 c", "zzz", " ", "NATION_4 D", "nation"]
_SEARCH = _search_sql("SELECT * FROM (VALUES " + ", ".join(f"('{a}')" for a in _ASKED) + ") v(query)")


def _asked(spark: SparkSession) -> DataFrame:
    return spark.range(1).select(F.explode(F.array(*map(F.lit, _ASKED))).alias("query"))


@query(f"{VIEWS}{_PLACES}{_SEARCH} SELECT * FROM found")
def place_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search_places(places(network(spark, sf_dir)), _asked(spark))


@query(f"{VIEWS}{_PLACES}{_SEARCH} SELECT query, place_id, how, name FROM meant")
def place_resolve(spark: SparkSession, sf_dir: str) -> DataFrame:
    feed = network(spark, sf_dir)
    return resolve_places(places(feed), feed.stops, _asked(spark)).select("query", "place_id", "how", "name")


@query(f"{VIEWS}, w AS (SELECT pattern_id, pos, stop_id, 18000 + i * 4000 AS ready FROM ps, range(20) t(i)) SELECT w.pattern_id, w.pos, ready, min(trip_rank) AS trip_rank FROM w JOIN ev ON ev.pattern_id = w.pattern_id AND ev.pos = w.pos AND dep >= ready GROUP BY ALL")
def earliest_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = timetable(network(spark, sf_dir))
    wanted = t.pattern_stops.select("pattern_id", "pos", F.explode(F.sequence(F.lit(18000).cast("long"), F.lit(94000).cast("long"), F.lit(4000).cast("long"))).alias("ready"))
    return earliest_trips(wanted, t.departures).select("pattern_id", "pos", "ready", "trip_rank")


@query(f"{VIEWS}{queries_sql()}{rounds_sql(1)} SELECT query_id, pattern_id, pos, trip_rank, board_pos FROM sc1")
def first_route_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    feed = network(spark, sf_dir)
    t = timetable(feed)
    queries, ends = query_batch(spark, feed)
    return route_scan(boardings(first_frontier(t, queries, ends), t))


def _arrivals(batch: Batch) -> DataFrame:
    return batch.plan.labels


@query(f"{VIEWS}{queries_sql()}{rounds_sql(1)} SELECT query_id, round, stop_id, min(arrival) AS arrival FROM labels GROUP BY ALL")
def raptor_round1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _arrivals(solved(spark, sf_dir, rounds=1))


@query(f"{VIEWS}{queries_sql()}{rounds_sql()} SELECT query_id, round, stop_id, min(arrival) AS arrival FROM labels GROUP BY ALL")
def raptor_arrivals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _arrivals(solved(spark, sf_dir))


@query(f"{VIEWS}{queries_sql()}{rounds_sql()} SELECT query_id, count(DISTINCT stop_id) AS n_stops, max(round) AS rounds FROM labels GROUP BY query_id")
def search_reach(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stops_reached(solved(spark, sf_dir).plan)


@query(f"""{VIEWS}{_PLACES} SELECT 'patterns' AS metric, count(DISTINCT pattern_id) AS value FROM ranked UNION ALL SELECT 'trips', count(*) FROM ranked UNION ALL SELECT 'footpaths', count(*) FROM footpaths UNION ALL SELECT 'served_stops', count(DISTINCT stop_id) FROM ps
UNION ALL SELECT 'places', count(*) FROM places UNION ALL SELECT 'places of several stops', count(*) FROM places WHERE contains(stop_ids, ',')""")
def network_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    feed = network(spark, sf_dir)
    return timetable_counts(timetable(feed)).unionByName(place_counts(places(feed)))


@query(f"{VIEWS} SELECT 'patterns' AS metric, count(DISTINCT pattern_id) AS value FROM ranked UNION ALL SELECT 'trips', count(*) FROM ranked UNION ALL SELECT 'footpaths', count(*) FROM footpaths UNION ALL SELECT 'served_stops', count(DISTINCT stop_id) FROM ps")
def timetable_build(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A timetable made anew each time, where the others take the one that the session has."""
    feed = network(spark, sf_dir)
    return timetable_counts(build_timetable(running_trips(feed, on_date=DAYS[4]), feed.stop_times, footpaths(feed.stops, feed.transfers)))


@query(f"{VIEWS}{queries_sql()}{rounds_sql()} SELECT query_id, journey, round AS vehicles, arrival FROM journeys")
def journeys_pareto(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pareto(solved(spark, sf_dir).plan.options).select("query_id", F.col("rank").alias("journey"), F.col("round").alias("vehicles"), "arrival")


@query(f"{VIEWS}{queries_sql()}{rounds_sql()}{LEGS} SELECT query_id, journey, leg_no, kind, from_stop, to_stop, depart, arrive, n_hops FROM legs")
def journey_leg_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return solved(spark, sf_dir).legs().select("query_id", "journey", "leg_no", "kind", "from_stop", "to_stop", "depart", "arrive", "n_hops")


_METRICS = """,
metrics AS (SELECT l.query_id, l.journey, arg_min(l.depart, leg_no) AS depart, arg_max(arrive, leg_no) AS arrive, greatest(0, count(*) FILTER (kind = 'ride') - 1)::INTEGER AS transfers, coalesce(sum(arrive - l.depart) FILTER (kind = 'walk'), 0)::BIGINT AS walking_s, any_value(q.depart) AS asked
  FROM legs l JOIN q USING (query_id) GROUP BY ALL),
done AS (SELECT query_id, journey, depart, arrive, transfers, walking_s, greatest(0, depart - asked) AS wait_s, greatest(0, arrive - asked) AS door_to_door_s FROM metrics)"""


@query(f"{VIEWS}{queries_sql()}{rounds_sql()}{LEGS}{_METRICS} SELECT *, CASE WHEN journey = 0 THEN 'fastest' ELSE 'fewer changes' END AS tag, CASE WHEN max(journey) OVER (PARTITION BY query_id) = 0 THEN '' WHEN journey = 0 THEN 'fastest' WHEN journey = max(journey) OVER (PARTITION BY query_id) THEN 'fewest changes' ELSE '' END AS badge FROM done")
def journey_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    batch = solved(spark, sf_dir)
    return tags(journeys(batch.legs(), batch.queries))


@query(f"{VIEWS}{queries_sql(BENCHMARK_QUERIES)}{rounds_sql()}{LEGS}{_METRICS} SELECT (SELECT count(*) FROM q) AS n, count(*) AS solved, avg(door_to_door_s) AS mean, median(door_to_door_s) AS median, list_sort(list(door_to_door_s))[(count(*) * 0.95)::INTEGER - CASE WHEN (count(*) * 0.95)::INTEGER > count(*) * 0.95 THEN 1 ELSE 0 END + 1] AS p95, max(door_to_door_s) AS slowest FROM done WHERE journey = 0")
def search_benchmark(spark: SparkSession, sf_dir: str) -> DataFrame:
    batch = solved(spark, sf_dir, BENCHMARK_QUERIES)
    return benchmark_stats(journeys(batch.legs(), batch.queries), batch.queries)


def _clock_sql(c: str) -> str:
    return f"lpad(({c} // 3600)::VARCHAR, 2, '0') || ':' || lpad(({c} // 60 % 60)::VARCHAR, 2, '0') || ':' || lpad(({c} % 60)::VARCHAR, 2, '0')"


def _text_sql() -> str:
    t = _clock_sql
    return f"""SELECT query_id, journey, {t("depart")} || ' → ' || {t("arrive")} || '  (' || door_to_door_s // 60 || ' min total' || CASE WHEN wait_s >= 60 THEN ', ' || wait_s // 60 || ' min wait' ELSE '' END
    || ', ' || transfers || ' transfer' || CASE WHEN transfers = 1 THEN '' ELSE 's' END || ', ' || walking_s // 60 || ' min walking)' AS line FROM done"""


@query(f"{VIEWS}{queries_sql()}{rounds_sql()}{LEGS}{_METRICS} {_text_sql()}")
def journey_summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    batch = solved(spark, sf_dir)
    return summary(journeys(batch.legs(), batch.queries))


@query(f"""{VIEWS}{queries_sql()}{rounds_sql()}{LEGS} SELECT query_id, journey, leg_no, CASE WHEN kind = 'walk' THEN {_clock_sql("depart")} || '  walk ' || (arrive - depart) // 60 || ' min to ' || b.name
  ELSE {_clock_sql("depart")} || '  route ' || CASE WHEN route_id % 3 <> 0 THEN 'R' || route_id WHEN route_id % 2 <> 0 THEN 'Route ' || route_id ELSE route_id::VARCHAR END || ' from ' || a.name || CASE WHEN n_hops > 0 THEN ' (' || n_hops || ' stops)' ELSE '' END
    || chr(10) || {_clock_sql("arrive")} || '  arrive ' || b.name END AS line
FROM legs JOIN stops a ON a.stop_id = from_stop JOIN stops b ON b.stop_id = to_stop LEFT JOIN trips ON trip_id = pattern_id""")
def journey_descriptions(spark: SparkSession, sf_dir: str) -> DataFrame:
    feed = network(spark, sf_dir)
    return describe(named_legs(solved(spark, sf_dir).legs(), feed))


_DOORS = """,
ends AS (SELECT query_id, journey, min(leg_no) AS a, max(leg_no) AS b FROM legs GROUP BY ALL),
doors AS (SELECT query_id, journey, leg_no, kind, from_stop, to_stop, depart, arrive FROM legs
  UNION ALL SELECT query_id, journey, -1, 'walk', '', from_stop, l.depart - access, l.depart FROM legs l JOIN ends e USING (query_id, journey) JOIN q USING (query_id) WHERE leg_no = a AND from_stop = origin
  UNION ALL SELECT query_id, journey, b + 1, 'walk', to_stop, '', arrive, arrive + egress FROM legs l JOIN ends e USING (query_id, journey) JOIN q USING (query_id) WHERE leg_no = b AND to_stop = target),
numbered AS (SELECT query_id, journey, (row_number() OVER (PARTITION BY query_id, journey ORDER BY leg_no) - 1)::INTEGER AS leg_no, kind, from_stop, to_stop, depart, arrive FROM doors)"""


@query(f"{VIEWS}{queries_sql(access=True)}{rounds_sql()}{LEGS}{_DOORS} SELECT * FROM numbered")
def access_egress_legs(spark: SparkSession, sf_dir: str) -> DataFrame:
    batch = solved(spark, sf_dir, access=True)
    return with_doors(batch.legs(), batch.endpoints)


_WALKS = """,
ends_of AS (SELECT query_id, journey, min(leg_no) AS a, max(leg_no) AS b FROM legs GROUP BY ALL),
doors AS (SELECT query_id, journey, leg_no, kind, from_stop, to_stop, depart, arrive FROM legs
  UNION ALL SELECT l.query_id, journey, -1, 'walk', '', from_stop, l.depart - walk, l.depart FROM legs l JOIN ends_of e USING (query_id, journey) JOIN origins o ON o.query_id = l.query_id AND o.stop_id = from_stop WHERE leg_no = a
  UNION ALL SELECT l.query_id, journey, b + 1, 'walk', to_stop, '', arrive, arrive + walk FROM legs l JOIN ends_of e USING (query_id, journey) JOIN targets t ON t.query_id = l.query_id AND t.stop_id = to_stop WHERE leg_no = b),
runs AS (SELECT *, CASE WHEN kind = 'walk' AND lag(kind) OVER w = 'walk' AND lag(arrive) OVER w = depart THEN 0 ELSE 1 END AS starts FROM doors WINDOW w AS (PARTITION BY query_id, journey ORDER BY leg_no)),
islands AS (SELECT *, sum(starts) OVER (PARTITION BY query_id, journey ORDER BY leg_no) AS island FROM runs),
merged AS (SELECT query_id, journey, min(leg_no) AS first_no, any_value(kind) AS kind, arg_min(from_stop, leg_no) AS from_stop, arg_max(to_stop, leg_no) AS to_stop, min(depart)::INTEGER AS depart, max(arrive)::INTEGER AS arrive FROM islands GROUP BY query_id, journey, island)"""


@query(f"{VIEWS}{doors_sql()}{rounds_sql()}{LEGS}{_WALKS} SELECT query_id, journey, (row_number() OVER (PARTITION BY query_id, journey ORDER BY first_no) - 1)::INTEGER AS leg_no, kind, from_stop, to_stop, depart, arrive FROM merged")
def door_to_door(spark: SparkSession, sf_dir: str) -> DataFrame:
    batch = solved(spark, sf_dir, doors=True)
    return merge_walks(with_doors(batch.legs(), batch.endpoints))


@query("""WITH l AS (SELECT user_id AS query_id, 0 AS journey, (row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1)::INTEGER AS leg_no, CASE WHEN event_type IN ('view', 'click', 'error') THEN 'walk' ELSE 'ride' END AS kind,
  event_id::VARCHAR AS from_stop, (event_id + 1)::VARCHAR AS to_stop, event_id FROM events),
t AS (SELECT *, leg_no * 600 AS depart, leg_no * 600 + CASE WHEN event_id % 4 = 0 THEN 540 ELSE 600 END AS arrive FROM l),
o AS (SELECT *, CASE WHEN kind = 'walk' AND lag(kind) OVER w = 'walk' AND lag(arrive) OVER w = depart THEN 0 ELSE 1 END AS starts FROM t WINDOW w AS (PARTITION BY query_id ORDER BY leg_no)),
i AS (SELECT *, sum(starts) OVER (PARTITION BY query_id ORDER BY leg_no) AS island FROM o),
m AS (SELECT query_id, journey, island, min(leg_no) AS first_no, any_value(kind) AS kind, arg_min(from_stop, leg_no) AS from_stop, arg_max(to_stop, leg_no) AS to_stop, min(depart)::INTEGER AS depart, max(arrive)::INTEGER AS arrive FROM i GROUP BY ALL)
SELECT query_id, journey, (row_number() OVER (PARTITION BY query_id ORDER BY first_no) - 1)::INTEGER AS leg_no, kind, from_stop, to_stop, depart, arrive FROM m""")
def merged_walks(spark: SparkSession, sf_dir: str) -> DataFrame:
    number = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")) - 1
    legs = table(spark, sf_dir, "events").select(
        F.col("user_id").alias("query_id"), F.lit(0).alias("journey"), number.alias("leg_no"), F.when(F.col("event_type").isin("view", "click", "error"), "walk").otherwise("ride").alias("kind"),
        F.col("event_id").cast("string").alias("from_stop"), (F.col("event_id") + 1).cast("string").alias("to_stop"), "event_id",
    )
    legs = legs.withColumn("depart", F.col("leg_no") * 600).withColumn("arrive", F.col("depart") + F.when(F.col("event_id") % 4 == 0, 540).otherwise(600))
    return merge_walks(legs.drop("event_id"))


# Searches of a network with thousands of patterns, loops and overtaking.


@query(f"{BUSY_VIEWS} SELECT pattern_id, route_id, stops AS stop_seq, count(*) AS n_trips, min(first_dep) AS first_dep, max(first_dep) AS last_dep FROM tp GROUP BY ALL")
def busy_patterns(spark: SparkSession, sf_dir: str) -> DataFrame:
    feed = busy_network(spark, sf_dir)
    return _pattern_rows(trip_patterns(running_trips(feed, on_date=DAYS[4]), feed.stop_times))


@query(f"{BUSY_VIEWS}, o AS (SELECT *, lag(dep) OVER (PARTITION BY pattern_id, pos ORDER BY trip_rank) AS b FROM ev) SELECT pattern_id, pos, count(*) AS n_bad FROM o WHERE b > dep GROUP BY ALL")
def busy_overtaking(spark: SparkSession, sf_dir: str) -> DataFrame:
    return overtaking(timetable(busy_network(spark, sf_dir)).pattern_events)


@query(f"{BUSY_VIEWS}, w AS (SELECT pattern_id, pos, stop_id, 18000 + i * 7000 AS ready FROM ps, range(10) t(i)) SELECT w.pattern_id, w.pos, ready, min(trip_rank) AS trip_rank FROM w JOIN ev ON ev.pattern_id = w.pattern_id AND ev.pos = w.pos AND dep >= ready GROUP BY ALL")
def busy_earliest_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = timetable(busy_network(spark, sf_dir))
    wanted = t.pattern_stops.select("pattern_id", "pos", F.explode(F.sequence(F.lit(18000).cast("long"), F.lit(81000).cast("long"), F.lit(7000).cast("long"))).alias("ready"))
    return earliest_trips(wanted, t.departures).select("pattern_id", "pos", "ready", "trip_rank")


@query(f"{BUSY_VIEWS}{queries_sql()}{rounds_sql()} SELECT query_id, round, stop_id, min(arrival) AS arrival FROM labels GROUP BY ALL")
def busy_arrivals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _arrivals(solved(spark, sf_dir, busy=True))


@query(f"{BUSY_VIEWS}{queries_sql()}{rounds_sql()}{LEGS} SELECT query_id, journey, leg_no, kind, from_stop, to_stop, depart, arrive, n_hops FROM legs")
def busy_leg_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return solved(spark, sf_dir, busy=True).legs().select("query_id", "journey", "leg_no", "kind", "from_stop", "to_stop", "depart", "arrive", "n_hops")


@query(f"{BUSY_VIEWS}{queries_sql()}{rounds_sql()}{LEGS}{_METRICS} SELECT *, CASE WHEN journey = 0 THEN 'fastest' ELSE 'fewer changes' END AS tag, CASE WHEN max(journey) OVER (PARTITION BY query_id) = 0 THEN '' WHEN journey = 0 THEN 'fastest' WHEN journey = max(journey) OVER (PARTITION BY query_id) THEN 'fewest changes' ELSE '' END AS badge FROM done")
def busy_journeys(spark: SparkSession, sf_dir: str) -> DataFrame:
    batch = solved(spark, sf_dir, busy=True)
    return tags(journeys(batch.legs(), batch.queries))


# The payload of a page: journeys with the points of their legs.
_PAYLOAD_SCHEMA = "struct<journeys:array<struct<journey:int,badge:string,depart:string,legs:array<struct<leg_no:int,kind:string,`from`:string,`to`:string,minutes:int,points:array<struct<id:string,name:string,lat:double,lon:double>>>>>>>"


@query(f"""{VIEWS}{queries_sql()}{rounds_sql()}{LEGS}{_METRICS},
named AS (SELECT l.*, a.name AS from_name, b.name AS to_name FROM legs l JOIN stops a ON a.stop_id = from_stop JOIN stops b ON b.stop_id = to_stop),
passed AS (SELECT query_id, journey, leg_no, pos AS place, stop_id FROM legs JOIN ps ON ps.pattern_id = legs.pattern_id JOIN (SELECT DISTINCT query_id, journey, leg_no, board, alight FROM (
    SELECT query_id, journey, (row_number() OVER (PARTITION BY query_id, journey ORDER BY back DESC) - 1)::INTEGER AS leg_no, board_pos AS board, alight_pos AS alight FROM chain WHERE back > 0)) USING (query_id, journey, leg_no) WHERE pos BETWEEN board AND alight
  UNION ALL SELECT query_id, journey, leg_no, 0, from_stop FROM legs WHERE kind = 'walk' UNION ALL SELECT query_id, journey, leg_no, 1, to_stop FROM legs WHERE kind = 'walk')
SELECT query_id, journey, leg_no, kind, any_value(from_name) AS from_name, any_value(to_name) AS to_name, any_value(greatest(1, (n.arrive - n.depart) // 60))::INTEGER AS minutes, string_agg(s.stop_id || ' ' || s.name, ',' ORDER BY place) AS points, round(sum(lat), 6) AS lat_sum, round(sum(lon), 6) AS lon_sum
FROM named n JOIN passed USING (query_id, journey, leg_no) JOIN stops s USING (stop_id) GROUP BY query_id, journey, leg_no, kind""")
def journey_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    feed, batch = network(spark, sf_dir), solved(spark, sf_dir)
    legs = batch.legs()
    payloads = as_json(journeys(legs, batch.queries), with_points(named_legs(legs, feed), feed))
    # The texts, read again.
    each = payloads.select("query_id", F.from_json("payload", _PAYLOAD_SCHEMA).alias("p")).select("query_id", F.explode("p.journeys").alias("j")).select("query_id", "j.journey", F.explode("j.legs").alias("l"))
    total = lambda axis: F.round(F.aggregate("l.points", F.lit(0.0), lambda a, p: a + p[axis]), 6).alias(f"{axis}_sum")
    return each.select("query_id", "journey", "l.leg_no", "l.kind", F.col("l.from").alias("from_name"), F.col("l.to").alias("to_name"), "l.minutes", F.array_join(F.transform("l.points", lambda p: F.concat(p["id"], F.lit(" "), p["name"])), ",").alias("points"), total("lat"), total("lon"))


@query(f"{VIEWS} SELECT from_stop, string_agg(to_stop || ':' || seconds, ',' ORDER BY seconds, to_stop) AS near FROM footpaths GROUP BY from_stop")
def footpath_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    near = timetable(network(spark, sf_dir)).neighbours
    return near.select("from_stop", F.array_join(F.transform("near", lambda w: F.concat(w["to_stop"], F.lit(":"), w["seconds"].cast("string"))), ",").alias("near"))


_SEED = 42


@query(f"""{VIEWS}, served AS (SELECT stop_id, row_number() OVER (ORDER BY stop_id) - 1 AS k, count(*) OVER () AS n FROM (SELECT DISTINCT stop_id FROM ps)),
drawn AS (SELECT i AS query_id, ('0x' || left(md5('{_SEED}:origin:' || i), 15))::BIGINT % size AS a, ('0x' || left(md5('{_SEED}:target:' || i), 15))::BIGINT % (size - 1) AS b FROM (SELECT max(n) AS size FROM served), range(3 * (SELECT max(n) FROM served)) t(i))
SELECT query_id, o.stop_id AS origin, t.stop_id AS target FROM drawn JOIN served o ON o.k = a JOIN served t ON t.k = b + CASE WHEN b >= a THEN 1 ELSE 0 END""")
def benchmark_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    served = timetable(network(spark, sf_dir)).pattern_stops.select("stop_id").distinct()
    return random_pairs(served, 3 * served.count(), _SEED)


# What customers type: names, ids, addresses, and nothing that helps.
_TYPED = f"""
req AS (SELECT c_custkey AS request_id, CASE c % 8 WHEN 0 THEN lower('NATION_' || c % 25 || ' ' || chr((65 + c % 5)::INTEGER)) WHEN 1 THEN (c % n)::VARCHAR WHEN 2 THEN c_name WHEN 3 THEN 'NATION_' || c % 25 WHEN 4 THEN ' ' WHEN 5 THEN 'zzz ' || c
    WHEN 6 THEN '  ' || upper(c_name) || ' ' ELSE ((c * 3 + 1) % n)::VARCHAR END AS origin, CASE WHEN c % 9 = 8 THEN 'zzz' WHEN c % 11 = 10 THEN c_name ELSE ((c * 3 + 1) % n)::VARCHAR END AS target, CASE WHEN c % 6 = 0 THEN DATE '2005-01-01' ELSE DATE '{DAYS[4]}' END AS day
  FROM (SELECT *, c_custkey AS c FROM customer), n),
gaz AS (SELECT c_custkey AS rank, c_name || ', ' || (c_custkey % 7) || ' Hill Road, , Town' AS name, lower(c_name) AS key, c_name || ', ' || (c_custkey % 7) || ' Hill Road' AS shown,
  {SOUTH}::DOUBLE + (c_custkey % 97) * 0.0004::DOUBLE + CASE WHEN c_custkey % 10 = 9 THEN 5 ELSE 0 END AS lat, {WEST}::DOUBLE + (c_custkey % 89) * 0.0005::DOUBLE AS lon FROM customer)"""


@query(f"""{VIEWS}{_PLACES},{_TYPED}{_search_sql("SELECT DISTINCT query FROM (SELECT trim(origin) AS query FROM req UNION ALL SELECT trim(target) FROM req) WHERE query <> ''")},
box AS (SELECT min(lat) - 0.15 AS south, max(lat) + 0.15 AS north, min(lon) - 0.15 AS west, max(lon) + 0.15 AS east FROM stops),
hit AS (SELECT query, arg_min(shown, rank) AS name, arg_min(lat, rank) AS lat, arg_min(lon, rank) AS lon FROM asked JOIN gaz ON lower(query) = key, box WHERE lat BETWEEN south AND north AND lon BETWEEN west AND east
  AND query NOT IN (SELECT query FROM meant) AND query NOT IN (SELECT query FROM found) GROUP BY query),
reach AS (SELECT p.query, p.name, s.stop_id, {_NEAR} AS metres FROM hit p JOIN stops s ON location_type = 0 AND {_NEAR} <= 800),
known AS (SELECT query, name, stop_ids AS stops FROM meant UNION ALL SELECT query, name, string_agg(stop_id, ',' ORDER BY stop_id) FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY metres, stop_id) AS i FROM reach) WHERE i <= 8 GROUP BY query, name),
state AS MATERIALIZED (SELECT query, name, stops, CASE WHEN stops IS NOT NULL THEN 'known' WHEN query IN (SELECT query FROM found) THEN 'ambiguous' ELSE 'missing' END AS state FROM asked LEFT JOIN known USING (query)),
w AS (SELECT min(a) AS first_day, max(b) AS last_day FROM (SELECT first_day AS a, last_day AS b FROM services UNION ALL SELECT day, day FROM exceptions WHERE added))
SELECT request_id, CASE WHEN trim(origin) = '' OR trim(target) = '' THEN 'blank' WHEN o.state <> 'known' THEN o.state WHEN t.state <> 'known' THEN t.state WHEN o.stops = t.stops THEN 'same' WHEN NOT day BETWEEN first_day AND last_day THEN 'outside window' ELSE 'ready' END AS status,
  o.name AS origin_name, t.name AS target_name, CASE WHEN o.stops IS NULL THEN 0 ELSE len(string_split(o.stops, ','))::INTEGER END AS origin_stops, CASE WHEN t.stops IS NULL THEN 0 ELSE len(string_split(t.stops, ','))::INTEGER END AS target_stops
FROM req LEFT JOIN state o ON o.query = trim(origin) LEFT JOIN state t ON t.query = trim(target), w""")
def request_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _answered(spark, sf_dir).answers


def _answered(spark: SparkSession, sf_dir: str) -> Answers:
    feed, customer, c = network(spark, sf_dir), table(spark, sf_dir, "customer"), F.col("c_custkey")
    n, text = feed.stops.count(), lambda x: x.cast("string")
    named = F.concat(F.lit("NATION_"), text(c % 25))
    other = text((c * 3 + 1) % n)
    origins = (F.lower(F.concat(named, F.lit(" "), F.char((65 + c % 5).cast("long")))), text(c % n), F.col("c_name"), named, F.lit(" "), F.concat(F.lit("zzz "), text(c)), F.concat(F.lit("  "), F.upper("c_name"), F.lit(" ")), other)
    origin = F.get(F.array(*origins), (c % 8).cast("int"))
    target = F.when(c % 9 == 8, "zzz").when(c % 11 == 10, F.col("c_name")).otherwise(other)
    requests = customer.select(c.alias("request_id"), origin.alias("origin"), target.alias("target"), F.when(c % 6 == 0, F.lit(dt.date(2005, 1, 1))).otherwise(F.lit(DAYS[4])).alias("day"))
    gazetteer = customer.select(
        c.alias("rank"), F.concat(F.col("c_name"), F.lit(", "), text(c % 7), F.lit(" Hill Road, , Town")).alias("name"),
        (F.lit(SOUTH) + (c % 97) * 0.0004 + F.when(c % 10 == 9, 5).otherwise(0)).alias("lat"), (F.lit(WEST) + (c % 89) * 0.0005).alias("lon"),
    )
    return answer(requests, places(feed), feed.stops, gazetteer, service_window(feed))
