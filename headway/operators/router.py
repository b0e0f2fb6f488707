"""Round-based earliest-arrival search for many queries at once.

Round k finds the earliest arrival at each stop with k vehicles: the stops
that round k - 1 improved meet the patterns that serve them, each pattern
carries the earliest trip caught so far along its positions, and footpaths
spread what the trips reach.  All queries go through a round in one job.

A round's state is one row of fixed width for each stop of a query.  What a
round improves points to where it came from; journeys are followed back along
these pointers at the end.  The timetable's tables are bucketed on the keys of
the joins here: where Spark broadcasts them, nothing is shuffled, as the state
is partitioned by query; where they are too large, the frontier is shuffled to
them, and they stay.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..storage import shared_folder
from .patterns import BUCKET, Timetable, trip_in_span

MAX_ROUNDS = 5
#: A search takes at least one round and at most these.
MOST_ROUNDS = 8
_NEVER = 2**31 - 1


@dataclass(frozen=True)
class Plan:
    """labels: (query_id, round, stop_id, arrival), what each round improved.
    options: (query_id, round, stop_id, arrival, egress), the best target of each round that improved one.
    pointers: by round, (query_id, stop_id, label); a label is the ride taken in that round, and the walk after it if there was one.
    """

    labels: DataFrame
    options: DataFrame
    pointers: list[DataFrame]


def _ride_type(stop: str) -> str:
    return f"struct<arrival:int,pattern_id:bigint,trip_rank:int,board_pos:int,alight_pos:int,board_stop:{stop},alight_stop:{stop},depart:int>"


def _label_type(stop: str) -> str:
    """Order matters: of equal arrivals, one without a walk comes first, then the walk from the smallest stop."""
    return f"struct<arrival:int,walk_from:{stop},walk_depart:int,ride:{_ride_type(stop)}>"


def _path_type(stop: str) -> str:
    return f"array<struct<kind:string,from_stop:{stop},to_stop:{stop},depart:int,arrive:int,pattern_id:bigint,trip_rank:int,board_pos:int,alight_pos:int>>"


def _first_state(timetable: Timetable, queries: DataFrame, endpoints: DataFrame, initial_walk: bool = True) -> DataFrame:
    """(query_id, stop_id, best, label, egress): a row for each stop of a query that is reached or a target; its best arrival so far, and what this round improved."""
    label = _label_type(dict(endpoints.dtypes)["stop_id"])
    ends = _usable_ends(queries, endpoints)
    seeds = ends.filter("origin is not null").select("query_id", "stop_id", F.expr(f"cast(named_struct('arrival', asked + origin, 'walk_from', null, 'walk_depart', null, 'ride', null) as {label})").alias("label"))
    if initial_walk:
        on = seeds.join(timetable.footpaths, seeds.stop_id == F.col("from_stop"))
        at = F.col("label.arrival")
        walked = F.struct((at + F.col("seconds")).alias("arrival"), F.col("from_stop").alias("walk_from"), at.alias("walk_depart"), F.lit(None).alias("ride")).cast(label)
        seeds = seeds.unionByName(on.select("query_id", F.col("to_stop").alias("stop_id"), walked.alias("label")))
    goals = ends.filter("egress is not null").select("query_id", "stop_id", F.lit(None).cast(label).alias("label"), "egress")
    state = seeds.withColumn("egress", F.lit(None).cast("int")).unionByName(goals).groupBy("query_id", "stop_id").agg(F.min("label").alias("label"), F.max("egress").alias("egress"))
    return state.select("query_id", "stop_id", F.col("label.arrival").alias("best"), "label", "egress")


def frontier(state: DataFrame) -> DataFrame:
    """(query_id, stop_id, ready): the stops that a state's round improved."""
    return state.filter("label is not null").select("query_id", "stop_id", F.col("label.arrival").alias("ready"))


def first_frontier(timetable: Timetable, queries: DataFrame, endpoints: DataFrame) -> DataFrame:
    """What the first round of a search starts from."""
    return frontier(_first_state(timetable, queries, endpoints))


def plan(timetable: Timetable, queries: DataFrame, endpoints: DataFrame, max_rounds: int = MAX_ROUNDS, initial_walk: bool = True, bucket: int = BUCKET) -> Plan:
    """Search for queries (query_id, depart) between endpoints (query_id, side, stop_id, walk).

    side is "origin" or "target"; walk is the seconds to or from the stop,
    negative ones counting as none.  A query whose ends share a stop, or lack
    one, has no result.  Journeys hold at least one ride; a walk into a target
    still bounds what rides can improve.  Footpaths are taken from the stops
    that rides reach, one at a time.  max_rounds counts vehicles, from 1 to
    MOST_ROUNDS.
    """
    state = _kept(_first_state(timetable, queries, endpoints, initial_walk))
    states = [state]
    for _ in range(max(1, min(max_rounds, MOST_ROUNDS))):
        state = _kept(next_state(state, timetable, bucket))
        if state.filter("label is not null").isEmpty():
            break
        states.append(state)
    improved = [s.filter("label is not null") for s in states]
    labels = reduce(DataFrame.unionByName, [s.select("query_id", F.lit(k).alias("round"), "stop_id", "label.arrival") for k, s in enumerate(improved)])
    options = [
        s.filter("egress is not null").groupBy("query_id").agg(F.min(F.struct((F.col("label.arrival") + F.col("egress")).alias("door"), "stop_id", "egress", "label.arrival")).alias("b"))
        .select("query_id", F.lit(k).alias("round"), "b.stop_id", "b.arrival", "b.egress")
        for k, s in enumerate(improved)
    ]
    return Plan(labels, reduce(DataFrame.unionByName, options).filter("round > 0"), [s.select("query_id", "stop_id", "label") for s in improved])


def stops_reached(found: Plan) -> DataFrame:
    """(query_id, n_stops, rounds): how many stops a search reached, and the last round that improved any."""
    return found.labels.groupBy("query_id").agg(F.countDistinct("stop_id").alias("n_stops"), F.max("round").alias("rounds"))


def _kept(state: DataFrame) -> DataFrame:
    """A round's state, written to the checkpoint folder, which cuts its lineage; it keeps its partitioning."""
    shared_folder(state.sparkSession)
    return state.checkpoint()


def _usable_ends(queries: DataFrame, endpoints: DataFrame) -> DataFrame:
    """(query_id, stop_id, asked, origin, egress) by query: seconds to walk to an origin, or from a target; none of queries that can't be answered."""
    named = F.col("stop_id").isNotNull() & (F.col("stop_id").cast("string") != "")
    walk = F.greatest("walk", F.lit(0)).cast("int")
    sides = endpoints.filter(named).select("query_id", "stop_id", F.when(F.col("side") == "origin", walk).alias("origin"), F.when(F.col("side") == "target", walk).alias("egress"))
    asked = queries.select("query_id", F.col("depart").cast("int").alias("asked"))
    each = sides.join(asked, "query_id").repartition("query_id").groupBy("query_id", "stop_id").agg(F.first("asked").alias("asked"), F.min("origin").alias("origin"), F.min("egress").alias("egress"))
    whole = Window.partitionBy("query_id")
    checked = each.withColumns({"_a": F.count("origin").over(whole), "_b": F.count("egress").over(whole), "_both": F.count_if(F.col("origin").isNotNull() & F.col("egress").isNotNull()).over(whole)})
    return checked.filter("_a > 0 and _b > 0 and _both = 0").drop("_a", "_b", "_both")


def next_state(state: DataFrame, timetable: Timetable, bucket: int = BUCKET) -> DataFrame:
    """The state after a round: best includes what the round before improved; label is what this one does."""
    stop = dict(state.dtypes)["stop_id"]
    ride_type, label_type = _ride_type(stop), _label_type(stop)
    bound = state.groupBy("query_id").agg(F.min(F.coalesce("best", F.lit(_NEVER)) + F.col("egress").cast("bigint")).alias("bound"))
    reached = frontier(state).join(bound, "query_id", "left").withColumn("bound", F.coalesce("bound", F.lit(_NEVER)))
    rides = _rides(boardings(reached, timetable, bucket), timetable, ride_type)
    known = state.select("query_id", "stop_id", "best", "egress", F.lit(None).cast(ride_type).alias("ride"))
    rode = rides.select("query_id", "stop_id", F.lit(None).cast("int").alias("best"), F.lit(None).cast("int").alias("egress"), "ride")
    both = known.unionByName(rode).groupBy("query_id", "stop_id").agg(F.min("best").alias("best"), F.max("egress").alias("egress"), F.min("ride").alias("ride"))
    limit = F.least(F.coalesce("best", F.lit(_NEVER)), F.coalesce("bound", F.lit(_NEVER)))
    both = both.join(bound, "query_id", "left").withColumn("ride", F.when(F.col("ride.arrival") < limit, F.col("ride"))).drop("bound")
    # A row goes on as itself and as one footpath to each neighbour of a stop that a ride reached.
    near = timetable.neighbours.withColumnRenamed("from_stop", "stop_id")
    at = F.col("ride.arrival")

    def walked(w: Column) -> Column:
        walk = F.struct((at + w["seconds"]).alias("arrival"), F.col("stop_id").alias("walk_from"), at.alias("walk_depart"), F.col("ride")).cast(label_type)
        return F.struct(w["to_stop"].alias("stop_id"), F.lit(None).cast("int").alias("best"), F.lit(None).cast("int").alias("egress"), F.lit(None).cast(ride_type).alias("ride"), walk.alias("walk"))

    own = F.struct("stop_id", "best", "egress", "ride", F.lit(None).cast(label_type).alias("walk"))
    all_ways = F.when(F.col("ride").isNotNull() & F.col("near").isNotNull(), F.concat(F.array(own), F.transform("near", walked))).otherwise(F.array(own))
    done = both.join(near, "stop_id", "left").select("query_id", F.inline(all_ways))
    done = done.groupBy("query_id", "stop_id").agg(F.min("best").alias("best"), F.max("egress").alias("egress"), F.min("ride").alias("ride"), F.min("walk").alias("walk"))
    before = F.least(F.coalesce("best", F.lit(_NEVER)), F.coalesce("ride.arrival", F.lit(_NEVER)))
    by_ride = F.struct(F.col("ride.arrival").alias("arrival"), F.lit(None).alias("walk_from"), F.lit(None).alias("walk_depart"), F.col("ride")).cast(label_type)
    label = F.when(F.col("walk.arrival") < before, F.col("walk")).when(F.col("ride").isNotNull(), by_ride)
    return done.withColumn("label", label).select("query_id", "stop_id", F.least("best", "label.arrival").alias("best"), "label", "egress")


def boardings(reached: DataFrame, timetable: Timetable, bucket: int = BUCKET) -> DataFrame:
    """(query_id, pattern_id, pos, n_stops, trip_rank): the earliest trip that each of stops reached (query_id, stop_id, ready) lets a query board.

    Stops may hold the ``bound`` of their query, which goes on: an arrival at
    which or later nothing is wanted.  A pattern's only trip is boarded or not
    by what its stops say of it, where it is left out if it arrives nowhere
    before the bound; so only patterns of several trips are looked up.
    """
    # Dealt over all tasks, as its few rows, which would come in one, meet many patterns each; by stop and number like the buckets they meet.
    n = int(reached.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    met = reached.repartition(n, "stop_id").join(timetable.pattern_stops, "stop_id").filter("dep is null or dep >= ready")
    bound = [c for c in ("bound",) if c in reached.columns]
    if bound:
        met = met.filter("dep is null or soonest < bound")
    met = met.withColumn("bucket", F.greatest(F.floor(F.col("ready") / bucket).cast("int"), "first_bucket")).join(timetable.shared_departures, ["pattern_id", "pos", "bucket"], "left")
    met = met.withColumn("trip_rank", F.when(F.col("dep").isNotNull(), 0).otherwise(trip_in_span(F.col("ready"))))
    return met.filter("trip_rank is not null").select("query_id", "pattern_id", "pos", "n_stops", "trip_rank", *bound)


def route_scan(boarded: DataFrame) -> DataFrame:
    """(query_id, pattern_id, pos, trip_rank, board_pos) of boardings, for each position that a boarded trip comes to.

    The trip is the earliest caught at any position before, boarded where that
    was first possible.
    """
    return _stretches(boarded).select("query_id", "pattern_id", F.explode(F.sequence("first", "last")).alias("pos"), "trip_rank", "board_pos")


def _stretches(boarded: DataFrame) -> DataFrame:
    """The same in stretches of positions, ``first`` to ``last``, that are ridden in one trip from one stop, with the ``bound`` if boardings have it."""
    bound = [c for c in ("bound",) if c in boarded.columns]
    boards = boarded.groupBy("query_id", "pattern_id").agg(F.collect_list(F.struct("trip_rank", F.col("pos").alias("board_pos"))).alias("boards"), F.first("n_stops").alias("n_stops"), *[F.first(c).alias(c) for c in bound])
    start, end = F.array_min(F.transform("boards", lambda b: b["board_pos"])) + 1, F.col("n_stops") - 1

    def ridden(board: Column, first: Column, last: Column) -> Column:
        return F.struct(board["trip_rank"].alias("trip_rank"), board["board_pos"].alias("board_pos"), first.alias("first"), last.alias("last"))

    each = F.transform(F.sequence(start, end), lambda pos: ridden(F.array_min(F.filter("boards", lambda b: b["board_pos"] < pos)), pos, pos))
    whole = F.array(ridden(F.get("boards", F.lit(0)), start, end))
    return boards.filter(start <= end).select("query_id", "pattern_id", *bound, F.inline(F.when(F.size("boards") == 1, whole).otherwise(each)))


def _rides(boarded: DataFrame, timetable: Timetable, ride_type: str) -> DataFrame:
    """(query_id, stop_id, ride): each ride, in the order in which equal arrivals are chosen."""
    met = _stretches(boarded).join(timetable.trip_calls.drop("trip_id"), ["pattern_id", "trip_rank"])
    met = met.select("*", F.explode(F.sequence("first", "last")).alias("pos")).filter(F.get("arrs", "pos") < F.col("bound"))
    to_stop = F.get("stops", "pos")
    ride = F.struct(F.get("arrs", "pos").alias("arrival"), "pattern_id", "trip_rank", "board_pos", F.col("pos").alias("alight_pos"), F.get("stops", "board_pos").alias("board_stop"), to_stop.alias("alight_stop"), F.get("deps", "board_pos").alias("depart"))
    return met.select("query_id", to_stop.alias("stop_id"), ride.cast(ride_type).alias("ride"))


def pareto(options: DataFrame) -> DataFrame:
    """options whose number of vehicles is lower than that of all that arrive no later, with ``rank`` from 0 by arrival; the first is the fastest."""
    order = Window.partitionBy("query_id").orderBy("arrival", "round")
    fewest = F.min("round").over(order.rowsBetween(Window.unboundedPreceding, -1))
    kept = options.withColumn("_fewest", fewest).filter("_fewest is null or round < _fewest").drop("_fewest")
    return kept.withColumn("rank", F.row_number().over(order) - 1)


def _paths(found: Plan, ends: DataFrame) -> DataFrame:
    """ends (query_id, journey, round, stop_id) with their path, the legs followed back from there: one join for each round, which all journeys that have come to it take."""
    stop = dict(ends.dtypes)["stop_id"]
    none = f"cast(array() as {_path_type(stop)})"
    at = None
    for k in range(len(found.pointers) - 1, -1, -1):
        start = ends.filter(F.col("round") == k).select("query_id", "journey", "stop_id", F.expr(none).alias("path"))
        at = start if at is None else at.unionByName(start)
        met = at.join(found.pointers[k], ["query_id", "stop_id"])
        ride, no = F.col("label.ride"), lambda kind: F.lit(None).cast(kind)
        rode = F.struct(F.lit("ride").alias("kind"), ride["board_stop"].alias("from_stop"), ride["alight_stop"].alias("to_stop"), ride["depart"].alias("depart"), ride["arrival"].alias("arrive"), *(ride[c].alias(c) for c in ("pattern_id", "trip_rank", "board_pos", "alight_pos")))
        walked = F.struct(
            F.lit("walk").alias("kind"), F.col("label.walk_from").alias("from_stop"), F.col("stop_id").alias("to_stop"), F.col("label.walk_depart").alias("depart"), F.col("label.arrival").alias("arrive"),
            no("bigint").alias("pattern_id"), no("int").alias("trip_rank"), no("int").alias("board_pos"), no("int").alias("alight_pos"),
        )
        step = F.filter(F.array(F.when(ride.isNotNull(), rode), F.when(F.col("label.walk_from").isNotNull(), walked)).cast(_path_type(stop)), lambda leg: leg.isNotNull())
        at = met.select("query_id", "journey", ride["board_stop"].alias("stop_id"), F.concat(step, "path").alias("path"))
    return at.select("query_id", "journey", "path")


def journey_legs(found: Plan, timetable: Timetable) -> DataFrame:
    """(query_id, journey, leg_no, kind, from_stop, to_stop, depart, arrive, pattern_id, trip_id, board_pos, alight_pos, stops, n_hops).

    One row for each leg of each Pareto-optimal journey; ``journey`` is its rank.
    """
    ends = _kept(pareto(found.options).select("query_id", F.col("rank").alias("journey"), "round", "stop_id"))
    legs = _paths(found, ends).select("query_id", "journey", F.posexplode("path").alias("leg_no", "l")).select("query_id", "journey", "leg_no", "l.*")
    trips = timetable.trip_calls.select("pattern_id", "trip_rank", "trip_id", "stops")
    hops = F.col("alight_pos") - F.col("board_pos")
    out = legs.join(trips, ["pattern_id", "trip_rank"], "left")
    return out.select("query_id", "journey", "leg_no", "kind", "from_stop", "to_stop", "depart", "arrive", "pattern_id", "trip_id", "board_pos", "alight_pos", F.slice("stops", F.col("board_pos") + 1, hops + 1).alias("stops"), F.coalesce(hops, F.lit(0)).alias("n_hops"))
