from __future__ import annotations

import datetime as dt
from dataclasses import replace

import pytest
from feeds import at, hms
from pyspark.sql import functions as F

from headway.operators.calendar import running_trips
from headway.operators.itinerary import journeys
from headway.operators.pairs import random_pairs
from headway.operators.patterns import Timetable, build_timetable, earliest_trips, overtaking
from headway.operators.ranking import ranked
from headway.operators.router import boardings, first_frontier, journey_legs, next_state, plan
from headway.operators.transfers import footpaths
from headway.storage import Scratch

MONDAY = dt.date(2026, 3, 9)


@pytest.fixture(scope="module")
def timetable(valley):
    return build_timetable(running_trips(valley, on_date=MONDAY), valley.stop_times, footpaths(valley.stops, valley.transfers))


def asked_and_ends(spark, queries):
    asked = spark.createDataFrame([(q, t) for q, _, _, t in queries], "query_id int, depart int")
    return asked, spark.createDataFrame([(q, side, s, 0) for q, a, b, _ in queries for side, s in (("origin", a), ("target", b))], "query_id int, side string, stop_id string, walk int")


def solve(spark, timetable, queries, **options):
    """{query: [(depart, arrive, transfers, kinds, wait, legs)]} of queries (id, origin, target, depart)."""
    asked, ends = asked_and_ends(spark, queries)
    found = plan(timetable, asked, ends, **options)
    legs = journey_legs(found, timetable)
    by_leg = {}
    for r in sorted(legs.collect(), key=lambda r: r.leg_no):
        by_leg.setdefault((r.query_id, r.journey), []).append(r)
    for chain in by_leg.values():
        for a, b in zip(chain, chain[1:]):
            assert a.to_stop == b.from_stop and a.arrive <= b.depart
        assert all(x.depart <= x.arrive for x in chain)
    out = {q: [] for q, *_ in queries}
    for r in sorted(journeys(legs, asked).collect(), key=lambda r: r.journey):
        chain = by_leg[r.query_id, r.journey]
        out[r.query_id].append((hms(r.depart), hms(r.arrive), r.transfers, [x.kind for x in chain], r.wait_s, chain))
    return out


def test_hand_solved_journeys(spark, timetable):
    found = solve(spark, timetable, [
        (1, "ash", "dogwood", at(7)), (2, "ash", "hazel", at(7)), (3, "birch", "ash", at(7, 5)), (4, "cedar", "elm", at(7, 5)), (5, "ash", "ivy", at(7)), (6, "ash", "dogwood", at(22)), (7, "ash", "ash", at(7)), (8, "", "ash", at(7)),
        (9, "hazel", "birch", at(8)), (10, "gorse", "hazel", at(7, 45)), (11, "elm", "hazel", at(7, 25)), (12, "elm", "hazel", at(7, 35)), (13, "dogwood", "birch", at(7, 15)),
    ])
    short = {q: [j[:4] for j in js] for q, js in found.items()}
    assert short[1] == [("07:00:00", "07:15:00", 0, ["ride"])] and found[1][0][5][0].stops == ["ash", "birch", "cedar", "dogwood"]
    # On foot from the loop to the railway, and from the first train on, not from the express behind it.
    assert short[2] == [("07:00:00", "07:55:00", 1, ["ride", "walk", "ride"])]
    # The loop comes back to its first stop.
    assert short[3] == [("07:05:00", "07:20:00", 0, ["ride"])]
    # Walks alone are no journey, nor are ends that nothing joins, no train, one stop, or none.
    assert short[4] == short[5] == short[6] == short[7] == short[8] == []
    # Once round the end of the loop by a second bus.
    assert short[9] == [("08:05:00", "09:05:00", 2, ["ride", "walk", "ride", "ride"])]
    assert [(hms(x.depart), hms(x.arrive)) for x in found[9][0][5]] == [("08:05:00", "08:30:00"), ("08:30:00", "08:31:26"), ("08:50:00", "09:00:00"), ("09:00:00", "09:05:00")]
    assert short[10] == [("07:50:00", "08:55:00", 1, ["ride", "ride"])]
    # Who comes later may be there earlier: the lowest rank is taken, though the express overtakes it.
    assert short[11] == [("07:30:00", "07:55:00", 0, ["ride"])] and short[12] == [("07:40:00", "07:51:00", 0, ["ride"])] and found[12][0][4] == 300
    # Two buses, or the one that goes round twice and so calls at the target twice.
    assert short[13] == [("07:15:00", "07:25:00", 1, ["ride", "ride"]), ("07:20:00", "07:30:00", 0, ["ride"])]
    assert (found[13][1][5][0].board_pos, found[13][1][5][0].alight_pos) == (3, 5)


def test_rounds_bound_the_vehicles(spark, timetable):
    one = [(1, "dogwood", "birch", at(7, 15))]
    found = solve(spark, timetable, one, max_rounds=1)
    assert [(j[1], j[2]) for j in found[1]] == [("07:30:00", 0)]
    # Fewer than one round, or more than MOST_ROUNDS, count as one and as MOST_ROUNDS.
    assert solve(spark, timetable, one, max_rounds=0)[1] == found[1]
    assert [j[1] for j in solve(spark, timetable, one, max_rounds=50)[1]] == ["07:25:00", "07:30:00"]


def test_patterns(timetable):
    patterns = {tuple(r.stops): r for r in timetable.patterns.collect()}
    assert {stops: r.n_trips for stops, r in patterns.items()} == {
        ("ash", "birch", "cedar", "dogwood", "ash"): 7, ("ash", "birch", "cedar", "dogwood", "ash", "birch"): 1, ("elm", "fir", "gorse"): 2, ("elm", "fir", "hazel"): 3, ("gorse", "fir", "elm"): 1, ("hazel", "fir", "elm"): 1,
    }
    rank = {r.trip_id: r.trip_rank for r in timetable.pattern_trips.collect()}
    assert [rank[f"r{k}"] for k in range(7)] == list(range(7)) and (rank["s0"], rank["x0"], rank["s1"]) == (0, 1, 2)
    assert [tuple(r) for r in overtaking(timetable.pattern_events).collect()] == [(patterns["elm", "fir", "hazel"].pattern_id, 2, 1)]
    assert {(r.from_stop, r.to_stop): r.seconds for r in timetable.footpaths.collect()} == {("cedar", "elm"): 86, ("elm", "cedar"): 86}


def test_trips_that_hold_their_calls(spark, valley, timetable):
    """They need no stop times, and are not dealt by service, of which there are few."""
    calls = valley.stop_times.groupBy("trip_id").agg(F.array_sort(F.collect_list(F.struct("pos", "stop_id", "arr", "dep"))).alias("calls"))
    feed = replace(valley, trips=valley.trips.join(calls, "trip_id", "left"))
    t = build_timetable(running_trips(feed, on_date=MONDAY), None, timetable.footpaths)
    for name in ("trip_calls", "departures", "pattern_stops"):
        assert sorted(map(repr, getattr(t, name).collect())) == sorted(map(repr, getattr(timetable, name).collect()))
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        lines = running_trips(feed, on_date=MONDAY)._jdf.queryExecution().executedPlan().toString().split("\n")
        assert any("BroadcastHashJoin" in line and "LeftAnti" in line for line in lines)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_only_patterns_of_several_trips_are_looked_up(spark):
    """Trips with a pattern each are boarded by their stops alone, unless they arrive nowhere before the query's bound; others are found among the departures."""
    k = F.col("id")
    trips = spark.range(100).select(k.alias("trip_id"), k.alias("trip_ord"), F.lit(1).alias("route_id"))
    there = F.when(k < 90, F.concat(F.lit("s"), k)).otherwise("s90")
    at = lambda t: (F.lit(t) + k * 10).cast("int")
    trips = trips.join(spark.range(100).select(k.alias("trip_id"), F.array(*[F.struct(stop.alias("stop_id"), at(t).alias("arr"), at(t).alias("dep")) for stop, t in ((F.lit("a"), 0), (there, 500), (F.lit("z"), 300))]).alias("calls")), "trip_id")
    walks = spark.createDataFrame([], "from_stop string, to_stop string, seconds int")
    t = build_timetable(trips, None, walks)
    assert {r.pattern_id for r in t.shared_departures.collect()} == {90} and t.departures.select("pattern_id").distinct().count() == 91
    reached = spark.createDataFrame([(1, "a", 205, 950), (2, "a", 205, 2**31 - 1)], "query_id int, stop_id string, ready int, bound int")
    found = {q: {(r.pattern_id, r.trip_rank) for r in boardings(reached, t).filter(F.col("query_id") == q).collect()} for q in (1, 2)}
    assert found == {1: {(p, 0) for p in range(21, 65)} | {(90, 0)}, 2: {(p, 0) for p in range(21, 91)}}
    assert found[2] == {(r.pattern_id, r.trip_rank) for r in boardings(reached.drop("bound"), t).filter("query_id = 2").collect()}
    # A group of trips too large for a task is ranked across tasks, in the same order.
    one, many = (sorted(map(repr, Timetable(trips, None, walks, most_ranked=n).pattern_trips.collect())) for n in (100, 2))
    assert one == many == sorted(map(repr, t.pattern_trips.collect()))


def test_departures_grow_with_the_clock(spark):
    """20,000 trips of one pattern depart in 50 different seconds; later ranks depart earlier further on."""
    k = F.col("id")
    first = (k / 400).cast("int")
    trips = spark.range(20_000).select(k.alias("trip_id"), k.alias("trip_ord"), F.lit(1).alias("route_id"))
    calls = spark.range(20_000).select(k.alias("trip_id"), F.posexplode(F.array(first, F.lit(900) - first, F.lit(5000))).alias("pos", "arr")).select("trip_id", "pos", F.col("pos").cast("string").alias("stop_id"), "arr", F.col("arr").alias("dep"))
    walks = spark.createDataFrame([], "from_stop string, to_stop string, seconds int")
    t = build_timetable(trips, calls, walks)
    spans = {(r.pos, r.bucket): [tuple(c) for c in r.calls] for r in t.departures.collect()}
    assert spans[0, 0] == [(s, 400 * s) for s in range(50)]  # the first of each second
    assert spans[1, 0] == [(900, 0)] and spans[2, 2] == [(5000, 0)]  # rank 0 departs last, so it is what all that wait get
    wanted = spark.createDataFrame([(0, 0, 0), (0, 0, 7), (0, 0, 49), (0, 0, 50), (0, 1, 860), (0, 1, 901)], "pattern_id long, pos int, ready int")
    assert sorted((r.pos, r.ready, r.trip_rank) for r in earliest_trips(wanted, t.departures).collect()) == [(0, 0, 0), (0, 7, 2800), (0, 49, 19600), (1, 860, 0)]


def test_ranks_of_a_large_group_lie_in_many_tasks(spark):
    k = F.col("id")
    rows = spark.range(40_000).select(F.when(k < 39_000, 0).otherwise(k % 5).alias("g"), F.pmod(F.hash("id"), F.lit(50)).alias("x"), k.alias("y"))
    settings = {"spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.files.maxPartitionBytes": "60000", "spark.sql.files.openCostInBytes": "60000"}
    before = {name: spark.conf.get(name) for name in settings}
    for name, value in settings.items():
        spark.conf.set(name, value)
    try:
        check_ranks(rows, ranked(rows, ["g"], ["x", "y"], "rank", Scratch(rows.sparkSession, "ranked")))
    finally:
        for name, value in before.items():
            spark.conf.set(name, value)


def check_ranks(rows, out):
    assert out.groupBy("g", F.spark_partition_id().alias("p")).count().agg(F.max("count")).first()[0] < 20_000
    order = sorted((r.g, r.x, r.y) for r in rows.collect())
    start = {}
    want = {(g, x, y): n - start.setdefault(g, n) for n, (g, x, y) in enumerate(order)}
    assert {(r.g, r.x, r.y): r["rank"] for r in out.collect()} == want


def test_a_round_shuffles_no_timetable(spark, valley):
    """Without broadcasts each of a round's joins has its table under it without an exchange."""
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        t = build_timetable(running_trips(valley, on_date=MONDAY), valley.stop_times, footpaths(valley.stops, valley.transfers))
        asked, ends = asked_and_ends(spark, [(1, "ash", "hazel", at(7))])
        state = first_frontier(t, asked, ends).select("query_id", "stop_id", F.col("ready").alias("best"), F.lit(None).cast("int").alias("egress"))
        label = F.struct(F.col("best").alias("arrival"), *[F.lit(None).cast(c).alias(n) for n, c in (("walk_from", "string"), ("walk_depart", "int"))], F.lit(None).cast("struct<arrival:int,pattern_id:bigint,trip_rank:int,board_pos:int,alight_pos:int,board_stop:string,alight_stop:string,depart:int>").alias("ride"))
        lines = next_state(state.withColumn("label", label).checkpoint(), t)._jdf.queryExecution().executedPlan().toString().split("\n")
        above, scans = [], 0
        for line in lines:
            depth = len(line) - len(line.lstrip(" :+-"))
            above = [x for x in above if x[0] < depth] + [(depth, line)]
            if "FileScan parquet" in line:
                scans += 1
                path = [text for _, text in above]
                last_join = max(n for n, text in enumerate(path) if "Join" in text)
                assert not any("Exchange" in text for text in path[last_join:]), path
                assert "Bucketed: true" in line
        assert scans == 4
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_a_round_boards_in_all_tasks(spark, valley):
    """A frontier that lies in one partition is dealt over as many as shuffles have."""
    t = build_timetable(running_trips(valley, on_date=MONDAY), valley.stop_times, footpaths(valley.stops, valley.transfers))
    asked, ends = asked_and_ends(spark, [(1, "ash", "hazel", at(7))])
    met = boardings(first_frontier(t, asked, ends).coalesce(1).localCheckpoint(), t)
    assert met.count() > 0 and met.rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))


def test_random_pairs(spark):
    stops = spark.createDataFrame([(f"s{k}",) for k in range(7)] * 2, "stop_id string")
    pairs = [(r.origin, r.target) for r in random_pairs(stops, 3000).orderBy("query_id").collect()]
    assert len(pairs) == 3000 and all(a != b for a, b in pairs) and len(set(pairs)) == 42
    assert [(r.origin, r.target) for r in random_pairs(stops, 10).orderBy("query_id").collect()] == pairs[:10] != [(r.origin, r.target) for r in random_pairs(stops, 10, seed=1).orderBy("query_id").collect()]
    assert random_pairs(stops.limit(1), 5).count() == 0


@pytest.mark.parametrize("options, n", [({"weekday": 1}, 15), ({"weekday": 5}, 1), ({"weekday": 6}, 0), ({"on_date": MONDAY}, 15), ({"on_date": dt.date(2027, 3, 1)}, 0), ({}, 16)])
def test_running_trips(valley, options, n):
    assert running_trips(valley, **options).count() == n
