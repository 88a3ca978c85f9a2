"""Schedule, network and demand operators on small tables, and the readers."""

import math
import random

import pytest
from pyspark.sql import functions as F

from routelab.operators import demand, graph, gtfs, network
from routelab.sources import tables

STOPS = "stop_id string, stop_name string, parent_station string, stop_lat double, stop_lon double"
EDGES = "from_stop string, to_stop string, route_id string, duration double, link_type string"
STATIONS = "station_id string, station_name string, stop_lat double, stop_lon double"


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_collapse(spark):
    stops = spark.createDataFrame([("A", "Station A", None, 1.0, 1.0), ("A_PF1", "Station A, Platform 1", "A", 1.0, 1.0), ("A_PF2", "Station A, Platform 2", "A", 1.0, 1.0), ("B", "Station B", None, 2.0, 2.0)], STOPS)
    stations, lookup = gtfs.collapse_platforms(stops)
    assert rows(stations.select("station_id", "station_name")) == [("A", "Station A"), ("B", "Station B")]
    assert dict(map(tuple, lookup.collect())) == {"A": "A", "A_PF1": "A", "A_PF2": "A", "B": "B"}


def test_collapse_prefers_the_station(spark):
    stops = spark.createDataFrame([("S1", "Parramatta Station, Stand A1", "PRRA", 2.0, 3.0, 3.0), ("ZZ", "Parramatta Station", "PRRA", 1.0, 3.0, 3.0)], "stop_id string, stop_name string, parent_station string, location_type double, stop_lat double, stop_lon double")
    assert gtfs.collapse_platforms(stops)[0].first()["station_name"] == "Parramatta Station"


def feed(spark):
    trips = spark.createDataFrame([("t1", "R1", "wk", "City"), ("t2", "R1", "wk", "City"), ("t3", "R1", "wk", "City"), ("t4", "R1", "we", "City"), ("t5", "R1", "wk", "Out")], "trip_id string, route_id string, service_id string, trip_headsign string")
    calls = []
    for t, (stops, start) in {"t1": ("ABC", 0), "t2": ("ABC", 600), "t3": ("ABCDE", 1500), "t4": ("AC", 0), "t5": ("CBA", 0)}.items():
        calls += [(t, s, k + 1, f"{8 + (start + 100 * k) // 3600:02d}:{(start + 100 * k) % 3600 // 60:02d}:{(start + 100 * k) % 60:02d}") for k, s in enumerate(stops)]
    calls = spark.createDataFrame([(*c, c[3]) for c in calls], "trip_id string, stop_id string, stop_sequence int, arrival_time string, departure_time string")
    return trips, calls


def test_canonical_and_headway(spark):
    trips, calls = feed(spark)
    routes = spark.createDataFrame([("R1", "City", "wk")], "route_id string, headsign string, service_id string")
    ids, patterns = gtfs.canonical_trips(trips, calls, routes)
    assert rows(ids.select("trip_id")) == [("t1",), ("t2",)]
    assert patterns.first()["signature"] == ["A", "B", "C"] and patterns.first()["n_candidate"] == 3
    ids, _ = gtfs.canonical_trips(trips, calls, routes, longest=["R1"])
    assert rows(ids.select("trip_id")) == [("t3",)]
    assert gtfs.reference_stops(trips, calls, routes).first()["stop_id"] == "A"
    assert gtfs.route_headways(trips, calls, routes).first()["headway_min"] == pytest.approx((600 + 900) / 2 / 60)
    unnamed = spark.createDataFrame([("R1", None, None), ("R9", None, None)], "route_id string, headsign string, service_id string")
    table = gtfs.headway_table(unnamed, gtfs.route_headways(trips, calls, unnamed))
    assert rows(table) == [("R1", 10.0), ("R9", 10.0)]


def test_services(spark):
    calendar = spark.createDataFrame([("wk", 1, 1, 1, 1, 1, 0, 0), ("we", 0, 0, 0, 0, 0, 1, 1)], "service_id string, monday int, tuesday int, wednesday int, thursday int, friday int, saturday int, sunday int")
    assert rows(gtfs.weekday_services(calendar, feed(spark)[0])) == [("R1", "wk")]


def test_walking_transfers(spark):
    stations = spark.createDataFrame([("A", "A", 1.0, 1.0), ("B", "B", 1.0001, 1.0001)], STATIONS)
    linked = spark.createDataFrame([("A", "B", "R1", 60.0, "transit")], EDGES)
    assert network.walking_transfers(stations, linked).count() == 0
    found = network.walking_transfers(stations, linked.limit(0)).collect()
    assert len(found) == 2 and {r["link_type"] for r in found} == {"transfer"}


def test_near_pairs_matches_all_pairs(spark):
    points = spark.range(300).select(F.col("id").cast("string").alias("id"), (F.rand(1) * 0.03 - 60).alias("lat"), (F.rand(2) * 0.06 + 179.97 - 0.06).alias("lon"))
    points = spark.createDataFrame(points.collect(), points.schema)
    from routelab.functions.scalar import haversine_m

    a, b = points.toDF("a", "x", "y"), points.toDF("b", "u", "v")
    want = a.crossJoin(b).filter((F.col("a") < F.col("b")) & (haversine_m(F.col("x"), F.col("y"), F.col("u"), F.col("v")) <= 400)).select("a", "b")
    got = network.near_pairs(points, points, 400, same=True).select("a", "b")
    assert rows(got) == rows(want) and got.count() > 50


def test_collapse_edges_and_mirror(spark):
    edges = spark.createDataFrame([("A", "B", "R1", 100.0, "transit"), ("A", "B", "R2", 90.0, "transit"), ("B", "C", "R1", 100.0, "transit"), ("C", "D", "R1", None, "transit")], EDGES)
    one = network.graph_edges(network.mirrored(edges))
    assert rows(one.select("from_stop", "to_stop", "route_id")) == [("A", "B", "R2"), ("B", "A", "R2"), ("B", "C", "R1"), ("C", "B", "R1")]
    reached = {r["dest"]: r["seconds"] for r in graph.all_pairs(one).filter("origin = 'C'").collect()}
    assert reached == {"C": 0.0, "B": 100.0, "A": 190.0}


def test_bus_part(spark):
    pattern = spark.createDataFrame([(s, k) for k, s in enumerate("PQRST")], "stop_id string, at int")
    tags = spark.createDataFrame([("Q", ["one"]), ("S", ["two"]), ("T", ["one", "two"])], "stop_id string, anchors array<string>")
    part = lambda *a: [r["stop_id"] for r in network.anchor_segments(pattern, tags, *a).orderBy("at").collect()]
    assert part("one", "two") == ["Q", "R", "S"] == part("two", "one")
    assert part("one", "two", "R") == ["Q", "R"] and part("one", "two", "P") == ["P", "Q"]
    assert part("one", "three") == []
    times = spark.createDataFrame([("Q", "R", 60.0), ("R", "S", None)], "from_stop string, to_stop string, duration double")
    cut = network.anchor_segments(pattern, tags, "one", "two")
    assert rows(network.bus_edges(cut, times, "9").select("from_stop", "to_stop", "route_id")) == [("BUS_Q", "BUS_R", "BUS_9"), ("BUS_R", "BUS_Q", "BUS_9")]


def test_supernetwork_order(spark):
    stations = spark.createDataFrame([("A", "A", 1.0, 1.0), ("B", "B", 1.001, 1.0), ("C", "C", 1.002, 1.0)], STATIONS)
    metro = network.mirrored(spark.createDataFrame([("A", "B", "R1", 60.0, "transit")], EDGES))
    _, plain = network.build_supernetwork(stations, metro)
    assert {(r["from_stop"], r["to_stop"]) for r in plain.collect()} == {("A", "B"), ("B", "A"), ("B", "C"), ("C", "B"), ("A", "C"), ("C", "A")}
    kept, edges = network.build_supernetwork(stations, metro, trim=lambda s, e: (s.filter("station_id <> 'C'"), e.filter("from_stop <> 'C' and to_stop <> 'C'")))
    assert kept.count() == 2 and edges.count() == 2


def test_demand_and_gravity(spark):
    stations = spark.createDataFrame([("1", "A"), ("2", "B"), ("3", "C")], "station_id string, station_name string")
    entries = spark.createDataFrame([("A", 10.0), ("B", 20.0)], "station_name string, trips double")
    exits = spark.createDataFrame([("B", 15.0), ("C", 15.0)], "station_name string, trips double")
    got = {r["station_name"]: (r["total_entries"], r["total_exits"]) for r in demand.ridership_demand(entries, exits, stations).collect()}
    assert got == {"A": (10.0, 0.0), "B": (20.0, 15.0), "C": (0.0, 15.0)}
    totals = spark.createDataFrame([("1", 100.0, 90.0), ("2", 80.0, 70.0), ("3", 60.0, 80.0)], "station_id string, total_entries double, total_exits double")
    times = spark.createDataFrame([(a, b, 0.0 if a == b else 600.0) for a in "123" for b in "123"], "origin string, dest string, seconds double")
    od = demand.gravity_od(totals, times, target=240.0, iterations=40).collect()
    by_dest = {d: sum(r["total_trips"] for r in od if r["dest_station_id"] == d) for d in "123"}
    assert by_dest == pytest.approx({"1": 90.0, "2": 70.0, "3": 80.0}, rel=1e-6)
    with pytest.raises(ValueError):
        demand.gravity_od(totals.limit(1), times)
    with pytest.raises(ValueError):
        demand.load_demand("other", stations)


def test_readers(spark, tmp_path):
    (tmp_path / "stops.txt").write_text("﻿stop_id,stop_name,parent_station,location_type,stop_lat,stop_lon\nA,Station A,,1,1.5,2.5\nB,B,A,x,1,2\n", encoding="utf-8")
    (tmp_path / "trips.txt").write_text("route_id,service_id,trip_id\nR,S,T\n")
    (tmp_path / "routes.txt").write_text("route_id\n7\n")
    (tmp_path / "stop_times.txt").write_text("trip_id,arrival_time,departure_time,stop_id,stop_sequence,extra\nT,25:00:00,25:00:10,A,1,z\n")
    feed = tables.read_gtfs(spark, str(tmp_path))
    assert [r["location_type"] for r in feed["stops"].orderBy("stop_id").collect()] == [1.0, None]
    assert feed["routes"].first()["route_id"] == "7" and feed["stop_times"].columns == ["trip_id", "stop_id", "stop_sequence", "arrival_time", "departure_time"]
    assert tables.read_calendar(spark, str(tmp_path)) is None
    (tmp_path / "calendar.txt").write_text("﻿service_id, monday,tuesday,wednesday,thursday,friday,saturday,sunday\nS,1,1,1,1,1,0,0\n", encoding="utf-8")
    assert tables.read_calendar(spark, str(tmp_path)).first()["monday"] == 1
    (tmp_path / "stop_times.txt").write_text("trip_id,stop_id\nT,A\n")
    with pytest.raises(ValueError):
        tables.read_gtfs(spark, str(tmp_path))
    (tmp_path / "pairs.csv").write_text("Origin Station;Destination Station;Ridership\nA;B;5\n")
    assert tuple(tables.read_station_pairs(spark, str(tmp_path / "pairs.csv")).first()) == ("A", "B", 5.0)
    (tmp_path / "opal.csv").write_text('Station,Entry_Exit,Trip\n A  x ,Entry,"1,000"\n')
    assert tuple(tables.read_entry_exit(spark, str(tmp_path / "opal.csv")).first()) == ("A x", "Entry", 1000.0)
    assert tables.read_headways(spark, str(tmp_path / "none.csv")).count() == 0
    tables.write_table(spark.range(3), str(tmp_path / "out"))
    tables.write_fit(spark, {"a": 1.5, "b": object}, str(tmp_path / "fit"))
    assert spark.read.parquet(str(tmp_path / "out")).count() == 3


def test_near_pairs_across_the_meridian_and_at_the_poles(spark):
    rng = random.Random(12)
    points = [(f"m{k}", rng.uniform(-60, 60), 180 - abs(rng.gauss(0, 0.01)) if k % 2 else -180 + abs(rng.gauss(0, 0.01))) for k in range(60)]
    points += [(f"m{60 + k}", points[k][1] + rng.uniform(-0.01, 0.01), -points[k][2]) for k in range(60)]
    points += [(f"p{k}", side * (90 - abs(rng.gauss(0, 0.02))), rng.uniform(-180, 180)) for k in range(40) for side in (1, -1)] + [("same1", 10.0, 20.0), ("same2", 10.0, 20.0), ("none", None, 1.0)]

    def metres(p, q):
        a, b = (math.radians(x) for x in (p[1], q[1]))
        h = math.sin((b - a) / 2) ** 2 + math.cos(a) * math.cos(b) * math.sin(math.radians(q[2] - p[2]) / 2) ** 2
        return 2 * 6_371_000 * math.atan2(math.sqrt(h), math.sqrt(1 - h))

    df = spark.createDataFrame([(f"{k}{p[0]}", *p[1:]) for k, p in enumerate(points)], "id string, lat double, lon double")
    for radius in (0.0, 900.0, 2500.0):
        known = [(f"{k}{p[0]}", *p[1:]) for k, p in enumerate(points) if p[1] is not None]
        want = {tuple(sorted((p[0], q[0]))) for i, p in enumerate(known) for q in known[:i] if metres(p, q) <= radius}
        got = [(r["a"], r["b"]) for r in network.near_pairs(df, df, radius, same=True).collect()]
        assert len(got) == len(set(got)) and set(got) == want
        assert any("m" in a and "m" in b for a, b in want) or radius == 0.0
        both = [(r["a"], r["b"]) for r in network.near_pairs(df, df, radius).collect()]
        assert len(both) == 2 * len(want) + len(known)
