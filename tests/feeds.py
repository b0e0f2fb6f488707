"""A small feed for the tests."""

from __future__ import annotations

#: A loop around a town, a railway that begins 89 metres from it and parts behind its first halt, and a halt that nothing serves.
STOPS = {
    "ash": (47.1000, 9.1000), "birch": (47.1100, 9.1200), "cedar": (47.1200, 9.1400), "dogwood": (47.1000, 9.1400), "elm": (47.1208, 9.1400),
    "fir": (47.1500, 9.1800), "gorse": (47.1800, 9.2000), "hazel": (47.1500, 9.2200), "ivy": (47.3000, 9.4000),
}
#: Minutes from the first departure at each stop.
LAP, TWO_LAPS = (("ash", 0), ("birch", 5), ("cedar", 10), ("dogwood", 15), ("ash", 20)), (("ash", 0), ("birch", 5), ("cedar", 10), ("dogwood", 15), ("ash", 20), ("birch", 25))
NORTH, SOUTH, EXPRESS = (("elm", 0), ("fir", 12), ("gorse", 20)), (("elm", 0), ("fir", 12), ("hazel", 25)), (("elm", 0), ("fir", 6), ("hazel", 11))
FROM_NORTH, FROM_SOUTH = (("gorse", 0), ("fir", 8), ("elm", 20)), (("hazel", 0), ("fir", 13), ("elm", 25))


def hms(seconds: int) -> str:
    return f"{seconds // 3600:02d}:{seconds // 60 % 60:02d}:{seconds % 60:02d}"


def at(hour: int, minute: int = 0) -> int:
    return 3600 * hour + 60 * minute


def write_feed(folder, extra: dict[str, list[str]] | None = None, stops: list[str] | None = None):
    """On weekdays seven laps from 07:00, every 20 minutes, and at 07:05 one trip of two laps; trains to either end of the railway, one of them an express that overtakes; one back from each.  On Saturdays one lap."""
    runs = [(f"r{k}", "LOOP", "WEEKDAYS", "Round", LAP, at(7, 20 * k)) for k in range(7)] + [("twice", "LOOP", "WEEKDAYS", "Twice", TWO_LAPS, at(7, 5)), ("market", "LOOP", "SATURDAYS", "Market", LAP, at(10))]
    runs += [("n0", "RAIL", "WEEKDAYS", "Gorse", NORTH, at(7, 15)), ("n1", "RAIL", "WEEKDAYS", "Gorse", NORTH, at(8, 15)), ("s0", "RAIL", "WEEKDAYS", "Hazel", SOUTH, at(7, 30)), ("s1", "RAIL", "WEEKDAYS", "Hazel", SOUTH, at(8, 30))]
    runs += [("x0", "RAIL", "WEEKDAYS", "Hazel", EXPRESS, at(7, 40)), ("g0", "RAIL", "WEEKDAYS", "Elm", FROM_NORTH, at(7, 50)), ("h0", "RAIL", "WEEKDAYS", "Elm", FROM_SOUTH, at(8, 5))]
    files = {
        "stops": stops or ["stop_id,stop_name,stop_lat,stop_lon", *(f"{s},{s.title()} Halt,{a},{b}" for s, (a, b) in STOPS.items())],
        "routes": ["route_id,route_short_name,route_long_name,route_type", "LOOP,L,Town loop,3", "RAIL,,Branch railway,2"],
        "trips": ["trip_id,route_id,service_id,trip_headsign", *(f"{t},{r},{s},{head}" for t, r, s, head, _, _ in runs)],
        "stop_times": ["trip_id,arrival_time,departure_time,stop_id,stop_sequence", *(f"{t},{hms(start + 60 * m)},{hms(start + 60 * m)},{stop},{3 * k + 1}" for t, _, _, _, calls, start in runs for k, (stop, m) in enumerate(calls))],
        "calendar": ["service_id,monday,tuesday,wednesday,thursday,friday,saturday,sunday,start_date,end_date", "WEEKDAYS,1,1,1,1,1,0,0,20250901,20261231", "SATURDAYS,0,0,0,0,0,1,0,20250901,20261231"],
    }
    for name, rows in (extra or {}).items():
        files[name] = files.get(name, []) + rows
    folder.mkdir(parents=True, exist_ok=True)
    for name, rows in files.items():
        (folder / f"{name}.txt").write_text("\n".join(rows) + "\n", encoding="utf-8-sig" if name == "stops" else "utf-8")
    return str(folder)
