"""A transit network as views over the order tables, for running the operators on any scale of them.

Suppliers are stops on a lattice, orders are trips of twenty routes with six
calls each, priorities are services, nations exceptions.  SQL holds the same
views for DuckDB.
"""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass, replace
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.calendar import running_trips
from ..operators.patterns import Timetable, build_timetable
from ..operators.places import build_places
from ..operators.router import Plan, journey_legs, plan
from ..operators.transfers import footpaths, walkable_from
from ..sources.gtfs import Feed, stop_times_of
from ..storage import file_state, is_written

ROUTES, CALLS, N_QUERIES, ROUNDS = 20, 6, 24, 5
#: The lattice's corner.
SOUTH, WEST = 46.5, 7.5
#: A Monday: priorities 3 and 5 do not run, 4 is unknown to the calendar and does.
SERVICE_DAY = dt.date(1998, 7, 6)
DAYS = [dt.date(1998, 7, d) for d in (1, 2, 4, 5, 6)] + [dt.date(1994, 12, 31)]
#: The weekdays of services by the digit they begin with, and the services and days of exceptions.
WEEKDAYS = {"1": [0, 1, 2, 3, 4, 5, 6], "2": [0, 1, 2, 3, 4], "3": [5, 6]}
PRIORITIES, FIRST_EXCEPTION = ("1-URGENT", "2-HIGH", "3-MEDIUM", "5-LOW"), dt.date(1998, 7, 1)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def network(spark: SparkSession, sf_dir: str) -> Feed:
    supplier, nation, orders = (table(spark, sf_dir, t) for t in ("supplier", "nation", "orders"))
    n = supplier.count()
    k = F.col("s_suppkey")
    stops = supplier.join(nation, F.col("s_nationkey") == F.col("n_nationkey")).select(
        k.alias("stop_ord"), k.cast("string").alias("stop_id"), F.concat("n_name", F.lit(" "), F.char((F.lit(65) + k % 5).cast("long"))).alias("name"),
        (F.lit(SOUTH) + F.floor(k / 10) * 0.003).alias("lat"), (F.lit(WEST) + (k % 10) * 0.004).alias("lon"),
        F.when(k % 25 < 2, (k - k % 25 + 24).cast("string")).otherwise("").alias("parent"), F.when(k % 25 == 24, 1).otherwise(0).alias("location_type"),
    )
    trips = orders.select(F.col("o_orderkey").alias("trip_ord"), F.col("o_orderkey").alias("trip_id"), (F.col("o_custkey") % ROUTES).alias("route_id"), F.col("o_orderpriority").alias("service_id"), F.lit("").alias("headsign"))

    def call(pos: Column) -> Column:
        at = (F.lit(18000) + (F.col("trip_id") % 1200) * 60 + pos * (240 + 60 * (F.col("route_id") % 3))).cast("int")
        stop = (F.col("route_id") * 7 + pos * (1 + F.col("route_id") % 3)) % F.lit(n)
        return F.struct(stop.cast("string").alias("stop_id"), at.alias("arr"), at.alias("dep"))

    trips = trips.withColumn("calls", F.array(*[call(F.lit(pos)) for pos in range(CALLS)]))
    r = F.col("id")
    routes = orders.select((F.col("o_custkey") % ROUTES).alias("id")).distinct().select(
        r.alias("route_ord"), r.alias("route_id"), F.when(r % 3 == 0, "").otherwise(F.concat(F.lit("R"), r.cast("string"))).alias("short_name"), F.when(r % 2 == 0, "").otherwise(F.concat(F.lit("Route "), r.cast("string"))).alias("long_name"),
        (r % 10).cast("int").alias("route_type"), F.lit("").alias("color"), F.lit("").alias("text_color"),
    )
    priority, ordered = F.col("o_orderpriority"), F.col("o_orderdate").cast("date")
    weekdays = F.expr("cast(array() as array<int>)")
    for digit, days in WEEKDAYS.items():
        weekdays = F.when(F.startswith(F.col("service_id"), F.lit(digit)), F.array(*map(F.lit, days))).otherwise(weekdays)
    services = orders.filter(~F.startswith(priority, F.lit("4"))).groupBy(priority.alias("service_id")).agg(F.min(ordered).alias("start"), F.max(ordered).alias("end"))
    services = services.select("service_id", weekdays.alias("weekdays"), "start", "end")
    d = F.col("n_nationkey")
    exceptions = nation.select(F.get(F.array(*map(F.lit, PRIORITIES)), (d % len(PRIORITIES)).cast("int")).alias("service_id"), F.date_add(F.lit(FIRST_EXCEPTION), (d * 3 % 8).cast("int")).alias("day"), (d % 3 != 0).alias("added"))
    declared = stops.filter(k % 7 == 0).select(F.col("stop_id").alias("from_stop"), ((F.col("stop_ord") + 1) % F.lit(n)).cast("string").alias("to_stop"), ((F.col("stop_ord") * 13) % 400).cast("int").alias("seconds"))
    return Feed(stops, routes, trips, stop_times_of(trips), services, exceptions, declared)


#: Variants of each route of the busy network.
VARIANTS = 50


def busy_network(spark: SparkSession, sf_dir: str) -> Feed:
    """The same network with a trip as long as its order has items, of several variants of each route: thousands of patterns, which pass stops again, and on which faster trips overtake slower ones."""
    feed = network(spark, sf_dir)
    lengths = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("trip_id")).agg(F.count(F.lit(1)).cast("int").alias("n_calls")).filter("n_calls > 1")
    n, t, variant, turn = feed.stops.count(), F.col("trip_id"), F.col("trip_id") % VARIANTS, F.floor(F.col("trip_id") / VARIANTS)

    def call(pos: Column) -> Column:
        stop = (F.col("route_id") * 7 + (variant + pos) % 5 * 3 + variant % 3) % F.lit(n)
        arr = (F.lit(18000) + t % 600 * 90 + pos * (120 + 60 * (turn % 5))).cast("int")
        return F.struct(stop.cast("string").alias("stop_id"), arr.alias("arr"), (arr + (turn % 2 * 30).cast("int")).alias("dep"))

    trips = feed.trips.drop("calls").join(lengths, "trip_id", "left").withColumn("calls", F.transform(F.sequence(F.lit(0), F.col("n_calls") - 1), call))
    return replace(feed, trips=trips, stop_times=stop_times_of(trips))


#: What this session has written, by application, kind and the state of the files it came from.
_WRITTEN: dict[tuple, Timetable | DataFrame] = {}


def timetable(feed: Feed) -> Timetable:
    """The timetable of the service day, whose tables a session writes once for each state of the feed's files, as long as they are there."""
    key = (feed.stops.sparkSession.sparkContext.applicationId, "timetable", file_state(feed.stops, feed.trips, feed.stop_times))
    if key not in _WRITTEN or not _WRITTEN[key].is_there():
        _WRITTEN[key] = build_timetable(running_trips(feed.with_calls(), on_date=SERVICE_DAY), feed.stop_times, footpaths(feed.stops, feed.transfers))
    return _WRITTEN[key]


def places(feed: Feed) -> DataFrame:
    """The feed's places, written once in the same way."""
    key = (feed.stops.sparkSession.sparkContext.applicationId, "places", file_state(feed.stops))
    if key not in _WRITTEN or not is_written(_WRITTEN[key]):
        _WRITTEN[key] = build_places(feed.stops)
    return _WRITTEN[key]


@dataclass(frozen=True)
class Batch:
    timetable: Timetable
    queries: DataFrame
    endpoints: DataFrame
    plan: Plan

    def legs(self) -> DataFrame:
        return journey_legs(self.plan, self.timetable)


def query_batch(spark: SparkSession, feed: Feed, n_queries: int = N_QUERIES, access: bool = False) -> tuple[DataFrame, DataFrame]:
    """(queries, endpoints): pairs of stops at four times of the morning; with ``access`` a walk at either end."""
    n = feed.stops.count()
    q = spark.range(n_queries).select(F.col("id").cast("int").alias("query_id"), (F.lit(28800) + (F.col("id") % 4) * 1800).cast("int").alias("depart"))
    at = lambda a, b: ((F.col("query_id") * a + b) % F.lit(n)).cast("string")
    walk = lambda w: F.lit(w if access else 0)
    ends = q.select("query_id", F.lit("origin").alias("side"), at(7, 0).alias("stop_id"), walk(120).alias("walk")).unionByName(q.select("query_id", F.lit("target").alias("side"), at(13, 5).alias("stop_id"), walk(180).alias("walk")))
    return q, ends


def door_batch(spark: SparkSession, feed: Feed, n_queries: int = N_QUERIES) -> tuple[DataFrame, DataFrame]:
    """(queries, endpoints) between points, whose endpoints are the stops in reach."""
    q = spark.range(n_queries).select(F.col("id").cast("int").alias("query_id"), (F.lit(28800) + (F.col("id") % 4) * 1800).cast("int").alias("depart"))
    side = lambda name, a, b: q.select(F.struct("query_id", F.lit(name).alias("side")).alias("point_id"), (F.lit(SOUTH) + F.col("query_id") * a % 97 * 0.0004).alias("lat"), (F.lit(WEST) + F.col("query_id") * b % 89 * 0.0005).alias("lon"))
    near = walkable_from(reduce(DataFrame.unionByName, [side(*p) for p in DOOR_POINTS]), feed.stops)
    return q, near.select("point_id.query_id", "point_id.side", "stop_id", F.col("seconds").alias("walk"))


def solved(spark: SparkSession, sf_dir: str, n_queries: int = N_QUERIES, rounds: int = ROUNDS, access: bool = False, doors: bool = False, busy: bool = False) -> Batch:
    feed = (busy_network if busy else network)(spark, sf_dir)
    table_ = timetable(feed)
    queries, ends = door_batch(spark, feed, n_queries) if doors else query_batch(spark, feed, n_queries, access)
    return Batch(table_, queries, ends, plan(table_, queries, ends, max_rounds=rounds))


_HAVERSINE = "2 * 6371000.0::DOUBLE * asin(sqrt(least(1.0, pow(sin(radians({b}.lat - {a}.lat) / 2), 2) + cos(radians({a}.lat)) * cos(radians({b}.lat)) * pow(sin(radians({b}.lon - {a}.lon) / 2), 2))))"
_STOP_TIMES = f"""SELECT trip_id, pos, ((route_id * 7 + pos * (1 + route_id % 3)) % n)::VARCHAR AS stop_id, (18000 + (trip_id % 1200) * 60 + pos * (240 + 60 * (route_id % 3)))::INTEGER AS arr, arr AS dep
  FROM trips, n, (SELECT unnest(range({CALLS}))::INTEGER AS pos) p"""
_BUSY_STOP_TIMES = f"""SELECT trip_id, pos, ((route_id * 7 + (trip_id % {VARIANTS} + pos) % 5 * 3 + trip_id % {VARIANTS} % 3) % n)::VARCHAR AS stop_id, (18000 + trip_id % 600 * 90 + pos * (120 + 60 * (trip_id // {VARIANTS} % 5)))::INTEGER AS arr, (arr + trip_id // {VARIANTS} % 2 * 30)::INTEGER AS dep
  FROM (SELECT trip_id, route_id, unnest(range(n_calls))::INTEGER AS pos FROM trips JOIN (SELECT l_orderkey AS trip_id, count(*) AS n_calls FROM lineitem GROUP BY l_orderkey HAVING count(*) > 1) USING (trip_id)), n"""
#: WITH clause of the views.
VIEWS = f"""
WITH RECURSIVE stops AS (SELECT s_suppkey AS stop_ord, s_suppkey::VARCHAR AS stop_id, n_name || ' ' || chr((65 + s_suppkey % 5)::INTEGER) AS name, {SOUTH}::DOUBLE + (s_suppkey // 10) * 0.003::DOUBLE AS lat,
  {WEST}::DOUBLE + (s_suppkey % 10) * 0.004::DOUBLE AS lon, CASE WHEN s_suppkey % 25 < 2 THEN (s_suppkey - s_suppkey % 25 + 24)::VARCHAR ELSE '' END AS parent, CASE WHEN s_suppkey % 25 = 24 THEN 1 ELSE 0 END AS location_type
  FROM supplier JOIN nation ON s_nationkey = n_nationkey),
n AS (SELECT count(*) AS n FROM supplier),
trips AS (SELECT o_orderkey AS trip_id, o_orderkey AS trip_ord, o_custkey % {ROUTES} AS route_id, o_orderpriority AS service_id FROM orders),
stop_times AS ({_STOP_TIMES}),
services AS (SELECT o_orderpriority AS service_id, CASE left(o_orderpriority, 1) {" ".join(f"WHEN '{d}' THEN {w}" for d, w in WEEKDAYS.items())} ELSE [] END::INTEGER[] AS weekdays, min(o_orderdate)::DATE AS first_day, max(o_orderdate)::DATE AS last_day
  FROM orders WHERE NOT starts_with(o_orderpriority, '4') GROUP BY o_orderpriority),
exceptions AS (SELECT {list(PRIORITIES)}[n_nationkey % {len(PRIORITIES)} + 1] AS service_id, DATE '{FIRST_EXCEPTION}' + (n_nationkey * 3 % 8)::INTEGER AS day, n_nationkey % 3 <> 0 AS added FROM nation),
days(day) AS (VALUES {", ".join(f"(DATE '{d}')" for d in DAYS)}),
service_days AS (SELECT day, service_id, CASE WHEN EXISTS (SELECT 1 FROM exceptions e WHERE e.service_id = s.service_id AND e.day = d.day AND NOT added) THEN false
  WHEN EXISTS (SELECT 1 FROM exceptions e WHERE e.service_id = s.service_id AND e.day = d.day AND added) THEN true
  ELSE list_contains(weekdays, (isodow(day) - 1)::INTEGER) AND coalesce(day >= first_day, true) AND coalesce(day <= last_day, true) END AS runs FROM services s, days d),
running AS (SELECT * FROM trips WHERE service_id NOT IN (SELECT service_id FROM service_days WHERE day = DATE '{SERVICE_DAY}' AND NOT runs)),
generated AS (SELECT a.stop_id AS from_stop, b.stop_id AS to_stop, greatest(60, trunc({_HAVERSINE.format(a="a", b="b")} * 1.3 / 1.33)::INTEGER) AS seconds
  FROM stops a JOIN stops b ON a.stop_id <> b.stop_id AND {_HAVERSINE.format(a="a", b="b")} <= 400),
declared AS (SELECT stop_id AS from_stop, ((stop_ord + 1) % n)::VARCHAR AS to_stop, greatest(60, stop_ord * 13 % 400)::INTEGER AS declared FROM stops, n WHERE stop_ord % 7 = 0),
footpaths AS MATERIALIZED (SELECT coalesce(d.from_stop, f.from_stop) AS from_stop, coalesce(d.to_stop, f.to_stop) AS to_stop, coalesce(declared, seconds) AS seconds
  FROM generated f FULL JOIN declared d ON d.from_stop = f.from_stop AND d.to_stop = f.to_stop),
tp AS (SELECT t.trip_id, trip_ord, route_id, stops, first_dep, last_dep, min(trip_ord) OVER (PARTITION BY route_id, stops) AS pattern_id
  FROM running t JOIN (SELECT trip_id, string_agg(stop_id, ',' ORDER BY pos) AS stops, min(dep) AS first_dep, max(dep) AS last_dep FROM stop_times GROUP BY trip_id) USING (trip_id)),
ranked AS (SELECT pattern_id, (row_number() OVER (PARTITION BY pattern_id ORDER BY first_dep, trip_ord) - 1)::INTEGER AS trip_rank, trip_id FROM tp),
ev AS MATERIALIZED (SELECT pattern_id, trip_rank, trip_id, pos, stop_id, arr, dep FROM ranked JOIN stop_times USING (trip_id)),
ps AS MATERIALIZED (SELECT DISTINCT pattern_id, pos, stop_id FROM ev)"""

#: The same of the busy network.
BUSY_VIEWS = VIEWS.replace(_STOP_TIMES, _BUSY_STOP_TIMES)


def queries_sql(n_queries: int = N_QUERIES, access: bool = False) -> str:
    walk = (120, 180) if access else (0, 0)
    return f""",
q AS (SELECT i::INTEGER AS query_id, (28800 + (i % 4) * 1800)::INTEGER AS depart, ((i * 7) % n)::VARCHAR AS origin, ((i * 13 + 5) % n)::VARCHAR AS target, {walk[0]} AS access, {walk[1]} AS egress FROM range({n_queries}) t(i), n),
ok AS (SELECT * FROM q WHERE origin <> target),
origins AS (SELECT query_id, origin AS stop_id, access AS walk, depart FROM ok), targets AS (SELECT query_id, target AS stop_id, egress AS walk FROM ok)"""


#: The same between points, each of which has several stops in reach: where they are, and CTEs q, ends, origins and targets.
DOOR_POINTS = (("origin", 7, 5), ("target", 31, 13))


def doors_sql(n_queries: int = N_QUERIES) -> str:
    near = _HAVERSINE.format(a="p", b="s")
    points = " UNION ALL ".join(f"SELECT query_id, '{side}' AS side, {SOUTH}::DOUBLE + (query_id * {a} % 97) * 0.0004::DOUBLE AS lat, {WEST}::DOUBLE + (query_id * {b} % 89) * 0.0005::DOUBLE AS lon FROM q" for side, a, b in DOOR_POINTS)
    return f""",
q AS (SELECT i::INTEGER AS query_id, (28800 + (i % 4) * 1800)::INTEGER AS depart FROM range({n_queries}) t(i)),
points AS ({points}),
near AS (SELECT query_id, side, stop_id, {near} AS metres FROM points p JOIN stops s ON location_type = 0 AND {near} <= 800),
ends AS (SELECT query_id, side, stop_id, greatest(60, trunc(metres * 1.3 / 1.33)::INTEGER) AS walk FROM (SELECT *, row_number() OVER (PARTITION BY query_id, side ORDER BY metres, stop_id) AS i FROM near) WHERE i <= 8),
ok AS (SELECT query_id, depart FROM q WHERE query_id IN (SELECT query_id FROM ends GROUP BY query_id HAVING count(DISTINCT side) = 2 AND count(DISTINCT stop_id) = count(*))),
origins AS (SELECT query_id, stop_id, walk, depart FROM ends JOIN ok USING (query_id) WHERE side = 'origin'), targets AS (SELECT query_id, stop_id, walk FROM ends JOIN ok USING (query_id) WHERE side = 'target')"""


def rounds_sql(rounds: int = ROUNDS) -> str:
    """CTEs r0, r1, ... (all labels of a round) and options of the search, one block for each round."""
    label = "query_id, round, stop_id, kind, arrival, from_stop, depart, pattern_id, trip_rank, board_pos, alight_pos"
    out = [f""",
s0 AS (SELECT query_id, 0 AS round, stop_id, 'seed' AS kind, (depart + walk)::INTEGER AS arrival, NULL::VARCHAR AS from_stop, NULL::INTEGER AS depart, NULL::BIGINT AS pattern_id, NULL::INTEGER AS trip_rank, NULL::INTEGER AS board_pos, NULL::INTEGER AS alight_pos FROM origins),
r0 AS MATERIALIZED (SELECT * FROM s0 UNION ALL SELECT query_id, 0, to_stop, 'walk', arrival + seconds, footpaths.from_stop, arrival, NULL, NULL, NULL, NULL FROM s0 JOIN footpaths ON s0.stop_id = footpaths.from_stop
  WHERE NOT EXISTS (SELECT 1 FROM s0 x WHERE x.query_id = s0.query_id AND x.stop_id = to_stop AND x.arrival <= s0.arrival + seconds)),
b0 AS MATERIALIZED (SELECT query_id, stop_id, min(arrival) AS best FROM r0 GROUP BY ALL)"""]
    for k in range(1, rounds + 1):
        p = k - 1
        out.append(f""",
bo{k} AS MATERIALIZED (SELECT query_id, f.pattern_id, f.pos, min(ev.trip_rank) AS trip_rank FROM (SELECT query_id, ready, pattern_id, pos FROM (SELECT query_id, stop_id, min(arrival) AS ready FROM r{p} GROUP BY ALL) JOIN ps USING (stop_id)) f
  JOIN ev ON ev.pattern_id = f.pattern_id AND ev.pos = f.pos AND ev.dep >= f.ready GROUP BY ALL),
sc{k} AS MATERIALIZED (SELECT query_id, pattern_id, pos, c // 1000 AS trip_rank, c % 1000 AS board_pos FROM (SELECT m.query_id, ps.pattern_id, ps.pos, min(b.trip_rank * 1000 + b.pos)
    OVER (PARTITION BY m.query_id, ps.pattern_id ORDER BY ps.pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS c
  FROM (SELECT query_id, pattern_id, min(pos) AS a FROM bo{k} GROUP BY ALL) m JOIN ps ON ps.pattern_id = m.pattern_id AND ps.pos >= m.a
  LEFT JOIN bo{k} b ON b.query_id = m.query_id AND b.pattern_id = ps.pattern_id AND b.pos = ps.pos) WHERE c IS NOT NULL),
ri{k} AS MATERIALIZED (SELECT query_id, {k} AS round, stop_id, 'ride' AS kind, arrival, NULL::VARCHAR AS from_stop, NULL::INTEGER AS depart, pattern_id, trip_rank, board_pos, alight_pos FROM (
  SELECT c.query_id, e.stop_id, e.arr AS arrival, c.pattern_id, c.trip_rank, c.board_pos, c.pos AS alight_pos, row_number() OVER (PARTITION BY c.query_id, e.stop_id ORDER BY e.arr, c.pattern_id, c.trip_rank, c.board_pos, c.pos) AS i
  FROM sc{k} c JOIN ev e ON e.pattern_id = c.pattern_id AND e.trip_rank = c.trip_rank AND e.pos = c.pos LEFT JOIN b{p} b ON b.query_id = c.query_id AND b.stop_id = e.stop_id
  LEFT JOIN (SELECT query_id, min(best + walk) AS bound FROM b{p} JOIN targets USING (query_id, stop_id) GROUP BY query_id) t ON t.query_id = c.query_id
  WHERE e.arr < least(coalesce(best, 2147483647), coalesce(bound, 2147483647))) WHERE i = 1),
wa{k} AS MATERIALIZED (SELECT query_id, {k} AS round, to_stop AS stop_id, 'walk' AS kind, arrival, from_stop, depart, NULL::BIGINT AS pattern_id, NULL::INTEGER AS trip_rank, NULL::INTEGER AS board_pos, NULL::INTEGER AS alight_pos FROM (
  SELECT r.query_id, f.to_stop, r.arrival + f.seconds AS arrival, f.from_stop, r.arrival AS depart, row_number() OVER (PARTITION BY r.query_id, f.to_stop ORDER BY r.arrival + f.seconds, f.from_stop, r.arrival) AS i
  FROM ri{k} r JOIN footpaths f ON f.from_stop = r.stop_id LEFT JOIN b{p} b ON b.query_id = r.query_id AND b.stop_id = f.to_stop LEFT JOIN ri{k} o ON o.query_id = r.query_id AND o.stop_id = f.to_stop
  WHERE r.arrival + f.seconds < least(coalesce(b.best, 2147483647), coalesce(o.arrival, 2147483647))) WHERE i = 1),
r{k} AS MATERIALIZED (SELECT {label} FROM ri{k} UNION ALL SELECT {label} FROM wa{k}),
b{k} AS MATERIALIZED (SELECT query_id, stop_id, min(best) AS best FROM (SELECT * FROM b{p} UNION ALL SELECT query_id, stop_id, arrival FROM r{k}) GROUP BY ALL)""")
    every = " UNION ALL ".join(f"SELECT {label} FROM r{k}" for k in range(rounds + 1))
    out.append(f""",
labels AS MATERIALIZED ({every}),
options AS (SELECT query_id, round, stop_id, arrival FROM (SELECT query_id, round, stop_id, min(arrival) AS arrival, row_number() OVER (PARTITION BY query_id, round ORDER BY min(arrival + walk), stop_id) AS i
  FROM labels JOIN targets USING (query_id, stop_id) WHERE round > 0 GROUP BY query_id, round, stop_id) WHERE i = 1),
journeys AS MATERIALIZED (SELECT query_id, (row_number() OVER (PARTITION BY query_id ORDER BY arrival, round) - 1)::INTEGER AS journey, round, stop_id, arrival FROM (
  SELECT *, min(round) OVER (PARTITION BY query_id ORDER BY arrival, round ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS fewest FROM options) WHERE fewest IS NULL OR round < fewest)""")
    return "".join(out)


#: CTE legs: labels followed back from each journey's end.
LEGS = """,
chain AS (
  SELECT query_id, journey, round, stop_id, false AS ride_only, 0 AS back, NULL::VARCHAR AS kind, NULL::INTEGER AS arrive, NULL::VARCHAR AS from_stop, NULL::INTEGER AS depart, NULL::BIGINT AS pattern_id, NULL::INTEGER AS trip_rank, NULL::INTEGER AS board_pos, NULL::INTEGER AS alight_pos, NULL::VARCHAR AS to_stop FROM journeys
  UNION ALL
  SELECT * FROM (SELECT c.query_id, c.journey, CASE l.kind WHEN 'ride' THEN l.round - 1 ELSE l.round END AS round, CASE l.kind WHEN 'ride' THEN s.stop_id ELSE l.from_stop END AS stop_id, l.kind = 'walk' AND l.round > 0 AS ride_only, c.back + 1 AS back,
      l.kind, l.arrival AS arrive, CASE l.kind WHEN 'ride' THEN s.stop_id ELSE l.from_stop END AS from_stop, CASE l.kind WHEN 'ride' THEN s.dep ELSE l.depart END AS depart, l.pattern_id, l.trip_rank, l.board_pos, l.alight_pos, c.stop_id AS to_stop
    FROM chain c JOIN (SELECT *, row_number() OVER (PARTITION BY query_id, round, stop_id ORDER BY arrival, kind, from_stop) AS i FROM labels) l
      ON l.query_id = c.query_id AND l.round = c.round AND l.stop_id = c.stop_id AND (l.i = 1 AND NOT c.ride_only OR l.kind = 'ride' AND c.ride_only)
    LEFT JOIN ev s ON s.pattern_id = l.pattern_id AND s.trip_rank = l.trip_rank AND s.pos = l.board_pos WHERE l.kind <> 'seed' AND (c.kind IS DISTINCT FROM 'walk' OR c.round > 0))),
legs AS MATERIALIZED (SELECT query_id, journey, (row_number() OVER (PARTITION BY query_id, journey ORDER BY back DESC) - 1)::INTEGER AS leg_no, kind, from_stop, to_stop, depart, arrive, coalesce(alight_pos - board_pos, 0) AS n_hops, pattern_id FROM chain WHERE back > 0)"""
