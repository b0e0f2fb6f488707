"""Ingest, places and itineraries on small feeds."""

from __future__ import annotations

import datetime as dt
import json
import random
import zipfile

import pytest
from feeds import at, hms, write_feed
from pyspark.sql import functions as F

from headway.functions.geo import metres_between
from headway.functions.text import feed_name, fold_text, hex_colour, lookup_key, name_stem, short_address
from headway.functions.time import clock, format_time, parse_time, query_date, query_time, wall_clock, window_label
from headway.operators.calendar import service_window
from headway.operators.itinerary import as_json, describe, journeys, merge_walks, named_legs, summary, tags, with_doors, with_points
from headway.operators.patterns import build_timetable
from headway.operators import places as place_search
from headway.operators.places import build_places, resolve_places, search_places
from headway.operators.router import journey_legs, plan
from headway.operators.requests import answer
from headway.operators.transfers import footpaths, generated_footpaths, walkable_from
from headway.plans.queries import place_groups
from headway.sources.csv import CsvError, read_csv
from headway.sources.gtfs import FeedError, feed_counts, load_feed
from headway.sources.generate import generate


def column(spark, values, kind, f):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r.out for r in df.select("i", f(F.col("v")).alias("out")).orderBy("i").collect()]


def test_times(spark):
    assert column(spark, ["00:00:01", "6:07:08", "23:00:00", "24:30:00", "31:00:09", "9:40", "", "  ", None, "120:00:00"], "string", parse_time) == [1, 22028, 82800, 88200, 111609, 34800, -1, -1, -1, 432000]
    assert column(spark, [-1, 0, 90600, 376080], "int", format_time) == ["--:--", "00:00:00", "25:10:00", "104:28:00"]
    assert column(spark, [90600, 29100], "int", clock) == ["25:10", "08:05"]
    assert column(spark, [90629, 90630, 43200], "int", wall_clock) == ["01:10", "01:11", "12:00"]
    assert column(spark, [0, 46800], "int", lambda c: wall_clock(c, twelve=True)) == ["12:00 am", "1:00 pm"]
    with pytest.raises(Exception, match="not a time"):
        column(spark, ["soon"], "string", parse_time)
    assert query_time("8:05") == 29100 and str(query_date("2026-07-06")) == "2026-07-06"
    assert str(query_date(None, dt.date(1999, 1, 2), dt.date(1999, 5, 1))) == "1999-01-02" and query_date("", dt.date(1999, 1, 2)) == query_date(None) == dt.date.today()
    days = spark.createDataFrame([("2026-09-04", "2026-10-05"), ("2026-12-01", "2027-01-02"), (None, "2027-01-02")], "a string, b string").select(window_label(F.to_date("a"), F.to_date("b")).alias("w"))
    assert [r.w for r in days.collect()] == ["4 Sep – 5 Oct 2026", "1 Dec 2026 – 2 Jan 2027", ""]


def test_times_of_any_shape(spark):
    assert column(spark, ["\t7:08:09 ", "1:2:3", "100:2:30", "7:08:09:10", "07:8:09", " 7: 8: 9"], "string", parse_time) == [25689, 3723, 360150, 25689, 25689, 25689]


def test_names(spark):
    names = ["KRONENPLATZ C", "Alte Weberei 14", "Nordtor Quai 7", "North Gate bay12", "Halt 7", "Ost B", "Am See", "Linden / Allee"]
    assert column(spark, names, "string", name_stem) == ["kronenplatz", "alte weberei", "nordtor", "north gate", "halt 7", "ost b", "am see", "linden / allee"]
    assert [fold_text(x) for x in ("Rue de l’Évêché", "Groß-Gerau", "  São  Bento / Sé ", "ÎLE D'OR")] == ["rue de leveche", "gro gerau", "sao bento se", "ile dor"]
    assert column(spark, ["#12AB9F", "fff", "12ab9g", None, "##0a0B0c"], "string", hex_colour) == ["#12ab9f", "", "", "", "#0a0b0c"]
    assert column(spark, ["3 Pier Road, , Port, Country", ",,", "pier"], "string", short_address) == ["3 Pier Road, Port", ",,", "pier"]
    assert column(spark, ["  Pier \t Road ", ""], "string", lookup_key) == ["pier road", ""]
    assert column(spark, ["/data/feeds/valley.zip", "C:\\feeds\\town", "x"], "string", feed_name) == ["valley.zip", "town", "x"]


def test_zipped_feed_in_a_folder(spark, tmp_path):
    folder = write_feed(tmp_path / "feed")
    with zipfile.ZipFile(tmp_path / "feed.zip", "w") as z:
        for p in sorted((tmp_path / "feed").iterdir()):
            z.write(p, f"wrapped/{p.name}")
    for path in (folder, str(tmp_path / "feed.zip")):
        counts = {r.metric: r.value for r in feed_counts(load_feed(spark, path)).collect()}
        assert counts == {"stops": 9, "routes": 2, "trips": 16, "stop_times": 67, "services": 2, "exceptions": 0, "transfers": 0}


def test_feeds_that_cannot_be_read(spark, tmp_path):
    with pytest.raises(FeedError, match="no such feed"):
        load_feed(spark, str(tmp_path / "none"))
    (tmp_path / "empty").mkdir()
    with pytest.raises(FeedError, match="stops.txt, routes.txt, trips.txt, stop_times.txt"):
        load_feed(spark, str(tmp_path / "empty"))


def test_unusable_rows_go(spark, tmp_path):
    extra = {
        "stop_times": ["r2,,,elm,70", "r3,08:00:00,08:00:00,nowhere,60", "unknown,07:00:00,07:00:00,ash,0", "n1,,09:15:00,ivy,80", "solo,07:00:00,07:00:00,ash,0"],
        "trips": ["solo,LOOP,WEEKDAYS,Alone"],
        "stops": ["bad,Bad Halt,abc,9.2", "blank,,,", "ash,New Ash,47.1,9.1"],
        "calendar_dates": ["service_id,date,exception_type", "WEEKDAYS,20260310,2", "SATURDAYS,2026-03-11,1", "FAIR,20260314,1"],
        "transfers": ["from_stop_id,to_stop_id,transfer_type,min_transfer_time", "ash,fir,2,45", "fir,ash,3,45", "ash,nowhere,2,45", "elm,cedar,2,150"],
    }
    feed = load_feed(spark, write_feed(tmp_path / "feed", extra))
    assert {r.metric: r.value for r in feed_counts(feed).collect()} == {"stops": 10, "routes": 2, "trips": 16, "stop_times": 68, "services": 3, "exceptions": 2, "transfers": 2}
    named = {r.stop_id: r for r in feed.stops.collect()}
    assert named["blank"].name == "blank" and named["blank"].lat != named["blank"].lat
    assert named["ash"].name == "New Ash" and named["ash"].stop_ord == min(r.stop_ord for r in named.values())
    late = [(r.arr, r.dep) for r in feed.stop_times.filter("trip_id = 'n1'").orderBy("pos").collect()][-1]
    assert late == (at(9, 15), at(9, 15))
    # Stops without coordinates walk nowhere; a declared transfer takes at least a minute.
    assert {(r.from_stop, r.to_stop): r.seconds for r in footpaths(feed.stops, feed.transfers).collect()} == {("elm", "cedar"): 150, ("cedar", "elm"): 86, ("ash", "fir"): 60}


def test_quoted_newlines(spark, tmp_path):
    feed = load_feed(spark, write_feed(tmp_path / "feed", {"trips": ['q,LOOP,WEEKDAYS,"Round\nby night"'], "stop_times": ["q,20:00:00,20:00:00,ash,1", "q,20:05:00,20:05:00,birch,2"]}))
    assert feed.trips.filter("trip_id = 'q'").first().headsign == "Round\nby night"
    assert feed.trips.count() == 17


@pytest.mark.parametrize(("letters", "longest", "quoted"), [('xy,"\n é', 12, True), ('xy" ', 12, False), ('x,"\n\n\n\n', 90, True)])
def test_csv_in_splits(spark, tmp_path, letters, longest, quoted):
    """Splits of 160 bytes: records that begin in one and end in the next but one, splits without any beginning, and quotes that are letters."""
    rng, rows, text = random.Random(longest), [], "\ufeffa, b,c\r\n"
    for k in range(100):
        values = ["".join(rng.choice(letters) for _ in range(rng.randint(0, longest))) for _ in range(3)]
        if not "".join(values).strip():
            continue
        rows.append([v or None for v in values])
        text += ",".join('"' + v.replace('"', '""') + '"' if quoted or v.startswith('"') else v for v in values) + rng.choice(["\n", "\r\n"]) + "\n" * (k % 20 == 0)
    (tmp_path / "x.csv").write_bytes(text.encode())
    settings = {"spark.sql.files.maxPartitionBytes": "160", "spark.sql.files.openCostInBytes": "1"}
    before = {k: spark.conf.get(k) for k in settings}
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        read = read_csv(spark, str(tmp_path / "x.csv"))
        assert read.columns == ["_ord", "a", "b", "c"] and spark.read.text(str(tmp_path / "x.csv")).rdd.getNumPartitions() > 8
        assert [[r.a, r.b, r.c] for r in read.orderBy("_ord").collect()] == rows
        (tmp_path / "x.csv").write_text(text + 'x,"y')
        with pytest.raises(CsvError, match="never closed"):
            read_csv(spark, str(tmp_path / "x.csv"))
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_parts_of_a_file_come_in_the_order_of_their_names(spark, tmp_path):
    (tmp_path / "x").mkdir()
    for name, n in (("part-2", 900), ("part-0", 3), ("part-1", 40)):
        (tmp_path / "x" / name).write_text("a,b\n" + "".join(f"{name},{k}\n" for k in range(n)))
    got = [(r.a, int(r.b)) for r in read_csv(spark, str(tmp_path / "x")).orderBy("_ord").collect()]
    assert got == [(name, k) for name, n in (("part-0", 3), ("part-1", 40), ("part-2", 900)) for k in range(n)]
    (tmp_path / "empty").write_text("")
    assert read_csv(spark, str(tmp_path / "empty")).columns == ["_ord"]


def test_files_give_trips_with_calls(spark, tmp_path):
    """A feed's trips hold their calls as they were read, so that a timetable does not collect them again."""
    feed = load_feed(spark, write_feed(tmp_path / "feed", {"trips": ["solo,LOOP,WEEKDAYS,Alone"], "stop_times": ["solo,07:00:00,07:00:00,ash,0", "n1,,9:15:0,ivy,80"]}))
    calls = feed.with_calls().trips.select("trip_id", F.posexplode("calls").alias("pos", "c")).select("trip_id", "pos", "c.stop_id", "c.arr", "c.dep")
    assert sorted(calls.collect()) == sorted(feed.stop_times.collect()) and feed.trips.columns == feed.with_calls().trips.columns[:-1]
    assert build_timetable(feed.with_calls().trips, None, feed.transfers).pattern_trips.count() == feed.trips.count() == 16


def test_stop_order_is_by_sequence(spark, tmp_path):
    feed = load_feed(spark, write_feed(tmp_path / "feed", {"trips": ["late,RAIL,WEEKDAYS,x"], "stop_times": ["late,21:20:00,21:20:00,gorse,9", "late,21:00:00,21:00:00,elm,2", "late,21:08:00,21:08:00,fir,4"]}))
    assert [r.stop_id for r in feed.stop_times.filter("trip_id = 'late'").orderBy("pos").collect()] == ["elm", "fir", "gorse"]


HEAD = "stop_id,stop_name,stop_lat,stop_lon,location_type,parent_station"


def places_of(spark, tmp_path, lines):
    extra = {"stops": [HEAD, *lines]}
    folder = write_feed(tmp_path / "feed", stops=extra["stops"])
    return load_feed(spark, folder).stops


def test_places(spark, tmp_path):
    stops = places_of(spark, tmp_path, [
        "STA,Central Station,51.50,4.20,1,", "p1,Central Track 1,51.50,4.20,0,STA", "p2,Central Track 2,51.50,4.20,0,STA", "c1,CHURCH SQUARE A,51.53,4.26,0,", "c2,CHURCH SQUARE B,51.5301,4.26,0,GONE", "c3,CHURCH SQUARE C,51.57,4.26,0,",
        "m1,Moat,51.49,4.17,0,", "m2,Moat,51.4901,4.17,0,", "x1,Moat / Alder,51.51,4.17,0,", "e1,RUE D'ÉTÉ NORD 1,51.48,4.14,0,", "e2,Rue d'Été nord 2,51.48,4.14,0,", "nan,Moat,,,0,",
    ])
    found = {r.place_id: (r.name, r.stop_ids) for r in build_places(stops).collect()}
    assert found == {
        "STA": ("Central Station", ["p1", "p2"]), "c1": ("CHURCH SQUARE", ["c1", "c2"]), "church square#1": ("CHURCH SQUARE C", ["c3"]), "m1": ("Moat", ["m1", "m2"]), "x1": ("Moat / Alder", ["x1"]),
        "e1": ("RUE D'ÉTÉ NORD", ["e1", "e2"]), "moat#1": ("Moat", ["nan"]),
    }
    places = build_places(stops)
    asked = spark.createDataFrame([(q,) for q in ("moat / alder", "alder moat", "rue dete", "p2", "church", "STA", "", "zz")], "query string")
    listed = {}
    for r in search_places(places, asked).orderBy("query", "rank").collect():
        listed.setdefault(r["query"], []).append((r.place_id, r.tier))
    assert listed == {"moat / alder": [("x1", 0)], "alder moat": [("x1", 3)], "rue dete": [("e1", 1)], "church": [("c1", 1), ("church square#1", 1)], "STA": [("STA", 2)]}
    meant = {r["query"]: r.place_id for r in resolve_places(places, stops, asked).collect()}
    assert meant == {"moat / alder": "x1", "alder moat": "x1", "rue dete": "e1", "p2": "STA", "STA": "STA"}


@pytest.mark.parametrize("most", [1000, 20, 1])
def test_first_come_clusters(spark, most):
    """A chain of stops 200 m apart, in an odd order, and the ids that clusters get beside a stop of the same id: in one task, by components, and in rounds."""
    rng = random.Random(6)
    rows = [(k, f"s{k}", f"Long Street {'ABCDEFGHJK'[k % 10]}", 51.0 + 0.0018 * rng.randrange(60), 4.0, "", 0) for k in range(60)] + [(60, "long street#1", "Elsewhere", 52.0, 4.0, "", 0)]
    stops = spark.createDataFrame(rows, STOP)
    seeds, want = [], {}
    for k, stop_id, _, lat, *_ in rows[:60]:
        near = [s for s in seeds if abs(s[1] - lat) < 0.00224]
        if not near:
            seeds.append((k, lat, stop_id if not seeds else f"long street#{len(seeds)}" if len(seeds) > 1 else f"long street#1@{stop_id}"))
        want.setdefault((near or seeds[-1:])[0][2], []).append(stop_id)
    assert {r.place_id: r.stop_ids for r in build_places(stops, most).collect()} == {k: sorted(v) for k, v in want.items()} | {"long street#1": ["long street#1"]}


STOP = "stop_ord long, stop_id string, name string, lat double, lon double, parent string, location_type int"


def test_a_long_chain_takes_few_jobs(spark):
    """2000 stops along a street, each 200 m from the next: every other one is a place."""
    stops = spark.range(2000).select(F.col("id").alias("stop_ord"), F.concat(F.lit("s"), F.col("id")).alias("stop_id"), F.lit("Long Street").alias("name"), (F.col("id") * 0.0018).alias("lat"), F.lit(4.0).alias("lon"), F.lit("").alias("parent"), F.lit(0).alias("location_type"))
    spark.sparkContext.setJobGroup("chain", "chain")
    try:
        found = build_places(stops)
        jobs = len(spark.sparkContext.statusTracker().getJobIdsForGroup("chain"))
    finally:
        spark.sparkContext._jsc.clearJobGroup()
    assert found.count() == 1000 and jobs < 30


def test_lattice_stops_of_one_name(spark, tmp_path):
    """From 55.8 degrees on neighbours of the lattice are within 250 m: those of one name are one place, which the SQL of the query leaves out."""
    ks = range(30_900, 31_100)
    rows = {"supplier": ([(k, k // 4 % 2) for k in ks], "s_suppkey long, s_nationkey int"), "nation": ([(0, "NATION_0"), (1, "NATION_1")], "n_nationkey int, n_name string"), "orders": ([], "o_orderkey long, o_custkey long, o_orderpriority string, o_orderdate timestamp")}
    for name, (each, schema) in rows.items():
        spark.createDataFrame(each, schema).write.parquet(str(tmp_path / f"{name}.parquet"))
    where = lambda k: (46.5 + k // 10 * 0.003, 7.5 + k % 10 * 0.004)
    want = [(k, k + 1) for k in ks if k % 25 == 0]
    for nation in (0, 1):
        left = [k for k in ks if 2 <= k % 25 < 24 and k // 4 % 2 == nation]
        while left:
            want.append(tuple(k for k in left if metres_between(*where(left[0]), *where(k)) <= 250))
            left = [k for k in left if k not in want[-1]]
    several = [w for w in want if len(w) > 1 and w[0] % 25]
    assert several and min(several)[0] >= 31_000
    assert sorted(r.stop_ids for r in place_groups(spark, str(tmp_path)).collect()) == sorted(",".join(map(str, w)) for w in want)


def test_crowded_cells_are_cut_up(spark):
    """Pairs within a radius are the same however many stops a cell may hold."""
    rng = random.Random(4)
    rows = [(k, f"s{k}", "x", 47.0 + rng.random() * (0.004 if k % 3 else 0.02), 9.0 + rng.random() * 0.006, "", 0) for k in range(300)] + [(k, f"s{k}", "x", 47.001, 9.001, "", 0) for k in range(300, 330)]
    stops = spark.createDataFrame(rows, STOP)
    want = sorted(map(tuple, generated_footpaths(stops).collect()))
    assert len(want) == sum(metres_between(a[3], a[4], b[3], b[4]) <= 400 for a in rows for b in rows if a is not b)
    assert sorted(map(tuple, generated_footpaths(stops, crowded=5).collect())) == want
    points = spark.createDataFrame([(k, 47.0 + rng.random() * 0.004, 9.0 + rng.random() * 0.006) for k in range(40)], "point_id int, lat double, lon double")
    assert sorted(map(tuple, walkable_from(points, stops, crowded=5).collect())) == sorted(map(tuple, walkable_from(points, stops).collect()))


def test_large_batches_are_searched_by_letters(spark, valley, monkeypatch):
    places = build_places(valley.stops)
    asked = spark.createDataFrame([(q,) for q in ("h", "ha", "halt", "elm halt", "halt el", "a h", "azel", "zz", "q ha", "", None)], "query string")
    rows = lambda: sorted(map(tuple, search_places(places, asked).collect()))
    few = rows()
    monkeypatch.setattr(place_search, "SMALL_BATCH", 0)
    assert rows() == few and len({r[0] for r in few}) == 7


def test_door_to_door(spark, valley):
    near = walkable_from(spark.createDataFrame([(1, 47.1003, 9.1), (2, 40.0, 4.0)], "point_id int, lat double, lon double"), valley.stops)
    assert [(r.point_id, r.stop_id, r["rank"], r.seconds) for r in near.collect()] == [(1, "ash", 1, 60)]
    timetable = build_timetable(valley.trips, valley.stop_times, footpaths(valley.stops, valley.transfers))
    asked = spark.createDataFrame([(1, at(6, 59))], "query_id int, depart int")
    ends = spark.createDataFrame([(1, "origin", "ash", 60), (1, "target", "elm", 120)], "query_id int, side string, stop_id string, walk int")
    legs = journey_legs(plan(timetable, asked, ends), timetable)
    whole = merge_walks(with_doors(legs, ends)).orderBy("leg_no").collect()
    assert [(r.kind, hms(r.depart), hms(r.arrive)) for r in whole] == [("walk", "06:59:00", "07:00:00"), ("ride", "07:00:00", "07:10:00"), ("walk", "07:10:00", "07:13:26")]
    found, named = journeys(legs, asked), named_legs(legs, valley)
    assert [r.line for r in summary(found).collect()] == ["07:00:00 → 07:11:26  (12 min total, 1 min wait, 0 transfers, 1 min walking)"]
    assert [r.line for r in describe(named).orderBy("leg_no").collect()] == ["07:00:00  route L to Round from Ash Halt (2 stops)\n07:10:00  arrive Cedar Halt", "07:10:00  walk 1 min to Elm Halt"]
    assert [(r.badge, r.tag) for r in tags(found).collect()] == [("", "fastest")]
    payload = json.loads(as_json(found, with_points(named, valley)).first().payload)
    ride, walk = payload["journeys"][0]["legs"]
    assert [p["name"] for p in ride["points"]] == ["Ash Halt", "Birch Halt", "Cedar Halt"] and walk["points"] == [{"id": "cedar", "name": "Cedar Halt", "lat": 47.12, "lon": 9.14}, {"id": "elm", "name": "Elm Halt", "lat": 47.1208, "lon": 9.14}]


def test_requests_are_answered_in_turn(spark, valley):
    places, day, other = build_places(valley.stops), dt.date(2026, 3, 9), dt.date(2027, 3, 9)
    requests = spark.createDataFrame([
        (1, "Ash Halt", "fir", day), (2, "halt", "fir", day), (3, "fir", "nowhere", day), (4, "  ", "fir", day), (5, "fir", " fir", day), (6, "fir", "ash", other), (7, "7  MILL lane", "fir", day), (8, "Far Lane", "fir", day), (9, "high pass", "fir", day), (10, None, None, None), (11, "fir", "ash", None),
    ], "request_id int, origin string, target string, day date")
    gazetteer = spark.createDataFrame([(1, "7 Mill Lane, Lower Town, , Valley", 47.1001, 9.1001), (2, "7 mill lane", 47.15, 9.18), (3, "Far Lane", 12.0, 9.0), (4, "High Pass", 47.25, 9.3)], "rank int, name string, lat double, lon double")
    found = answer(requests, places, valley.stops, gazetteer, service_window(valley))
    got = {r.request_id: r for r in found.answers.collect()}
    assert {k: r.status for k, r in got.items()} == {1: "ready", 2: "ambiguous", 3: "missing", 4: "blank", 5: "same", 6: "outside window", 7: "ready", 8: "missing", 9: "missing", 10: "blank", 11: "ready"}
    assert (got[7].origin_name, got[7].origin_stops, got[1].origin_name) == ("7 Mill Lane, Lower Town", 1, "Ash Halt")
    assert {(r.request_id, r.side, r.stop_id, r.walk) for r in found.endpoints.collect() if r.request_id in (1, 7)} == {(1, "origin", "ash", 0), (1, "target", "fir", 0), (7, "origin", "ash", 60), (7, "target", "fir", 0)}
    assert [r.place_id for r in found.suggestions.filter("token = 'halt'").orderBy("rank").collect()] == ["ash", "elm", "fir", "ivy", "birch", "cedar"]


def test_generated_city(spark, tmp_path):
    generate(spark, str(tmp_path / "city"), n_stops=100, n_routes=4, trips_per_route=6)
    feed = load_feed(spark, str(tmp_path / "city"))
    counts = {r.metric: r.value for r in feed_counts(feed).collect()}
    assert counts["stops"] == 100 and counts["routes"] == 4 and counts["trips"] == 24 and counts["stop_times"] >= 24 * 5


def test_command_line(spark, tmp_path, capsys):
    from headway.cli import main

    feed = write_feed(tmp_path / "feed")
    assert main(["info", feed]) == 0 and "routing patterns" in capsys.readouterr().out
    assert main(["stops", feed, "--search", "halt"]) == 0 and "Elm Halt" in capsys.readouterr().out
    assert main(["stops", feed, "--search", "nothing such"]) == 1
    assert main(["plan", feed, "--from", "Dogwood Halt", "--to", "birch", "--at", "07:15", "--date", "2026-03-09"]) == 0
    out = capsys.readouterr().out
    assert "[fastest] 07:15:00 → 07:25:00" in out and "[fewer changes] 07:20:00 → 07:30:00" in out
    assert main(["plan", feed, "--from", "ash", "--to", "elm", "--date", "2027-03-01"]) == 1 and "no service" in capsys.readouterr().out
    assert main(["plan", feed, "--from", "ash", "--to", "ash"]) == 1 and main(["info", str(tmp_path / "none")]) == 2
    assert main(["benchmark", feed, "--queries", "30", "--weekday", "0"]) == 0 and capsys.readouterr().out.startswith("30 queries")


def test_files_are_read_when_their_tables_are_asked_for(spark, tmp_path, monkeypatch):
    """A file that is no CSV stops only the tables that need it; lines whose quotes all close are records without any windows."""
    feed = load_feed(spark, write_feed(tmp_path / "feed", {"stop_times": ['"open,20:00:00,20:00:00,ash,1']}))
    assert feed.services.count() == 2 and feed.stops.count() == 9
    with pytest.raises(CsvError, match="never closed"):
        feed.stop_times.count()
    (tmp_path / "quoted.csv").write_text('"a","b"\n"1","x ""y"", z"\n"2",""\n')
    monkeypatch.setattr("headway.sources.csv._records", lambda *_: pytest.fail("no record has several lines"))
    assert [(r.a, r.b) for r in read_csv(spark, str(tmp_path / "quoted.csv")).orderBy("_ord").collect()] == [("1", 'x "y", z'), ("2", None)]


def test_points_under_their_cells_are_not_broadcast(spark, valley):
    """Points at one place are answered alike, and what is listed under nine cells is merged, however small Spark takes it for."""
    near = walkable_from(spark.createDataFrame([(k, 47.1003, 9.1) for k in range(40)], "point_id int, lat double, lon double"), valley.stops)
    assert "Broadcast" not in near._jdf.queryExecution().executedPlan().toString()
    each = {}
    for r in near.collect():
        each.setdefault(r.point_id, set()).add((r.stop_id, r.rank, r.seconds))
    assert len(each) == 40 and len(set(map(frozenset, each.values()))) == 1
