"""A whole run over a small made-up feed with a bus line, and the experiment after it."""

import pytest

from routelab import city, config
from routelab.__main__ import main, parser
from routelab.operators import metrics, network


def seconds(s):
    return f"{s // 3600:02d}:{s % 3600 // 60:02d}:{s % 60:02d}"


@pytest.fixture(scope="module")
def raw(tmp_path_factory):
    root = tmp_path_factory.mktemp("raw")
    folder = root / "toy"
    (folder / "bmtc").mkdir(parents=True)
    stops = {"A": (0.0, 0.0), "B": (0.02, 0.0), "C": (0.04, 0.0), "D": (0.02, 0.02), "E": (0.06, 0.0)}
    (folder / "stops.txt").write_text("stop_id,stop_name,parent_station,stop_lat,stop_lon\n" + "".join(f"{s},{s} town,,{y},{x}\n" for s, (y, x) in stops.items()))
    (folder / "routes.txt").write_text("route_id,route_short_name\nR,R\nS,S\n")
    trips, calls = [], []
    for r, line in (("R", "ABCE"), ("S", "ADC")):
        for k in range(5):
            trips.append(f"{r},wk,{r}{k},Out\n")
            calls += [f"{r}{k},{seconds(28800 + 600 * k + 240 * n)},{seconds(28800 + 600 * k + 240 * n)},{s},{n + 1}\n" for n, s in enumerate(line)]
    (folder / "trips.txt").write_text("route_id,service_id,trip_id,trip_headsign\n" + "".join(trips))
    (folder / "stop_times.txt").write_text("trip_id,arrival_time,departure_time,stop_id,stop_sequence\n" + "".join(calls))
    bus = {"x": (0.001, 0.001), "y": (0.02, 0.03), "z": (0.041, 0.001), "w": (0.3, 0.3)}
    (folder / "bmtc/stops.txt").write_text("stop_id,stop_name,stop_lat,stop_lon\n" + "".join(f"{s},bus {s},{y},{x}\n" for s, (y, x) in bus.items()))
    (folder / "bmtc/routes.txt").write_text("route_id\n9\n")
    (folder / "bmtc/trips.txt").write_text("route_id,service_id,trip_id\n" + "".join(f"9,wk,b{k}\n" for k in range(3)))
    (folder / "bmtc/stop_times.txt").write_text("trip_id,arrival_time,departure_time,stop_id,stop_sequence\n" + "".join(f"b{k},{seconds(28800 + 3000 * k + 300 * n)},{seconds(28800 + 3000 * k + 300 * n)},{s},{n + 1}\n" for k in range(3) for n, s in enumerate("wxyz")))
    (folder / "entry_exit.csv").write_text("Station,Entry_Exit,Trip\n" + "".join(f'{s} town,{k},"{1000 + 100 * ord(s)}"\n' for s in stops for k in ("Entry", "Exit")))
    return str(root)


@pytest.fixture()
def toy(monkeypatch):
    own = config.City({"R": "Out", "S": "Out"}, "entry_exit", service_filter="wk", branch_boundaries=("A town", "C town", "D town"), bus_routes=(config.BusRoute("9", "9", ("A town", "C town")),))
    monkeypatch.setitem(config.CITIES, "toy", own)


def test_network(spark, raw, toy):
    stations, edges, headways = city.build_network(spark, "toy", raw)
    assert {r["station_id"] for r in stations.collect()} == {"A", "B", "C", "D", "BUS_x", "BUS_y", "BUS_z"}  # E lies beyond the boundary
    links = {(r["from_stop"], r["to_stop"]): (r["route_id"], r["duration"]) for r in edges.collect()}
    assert links["A", "B"] == ("R", 240.0) and links["BUS_x", "BUS_y"] == ("BUS_9", 300.0) == links["BUS_y", "BUS_x"]
    assert links["A", "BUS_x"][0] == "walk" and ("C", "E") not in links
    assert {r["route_id"]: r["headway_min"] for r in headways.collect()} == {"R": 10.0, "S": 10.0, "BUS_9": 50.0}


def test_run_and_diagnose(spark, raw, toy, tmp_path):
    table = {r["metric"]: r for r in city.run_city(spark, "toy", raw, str(tmp_path), draws=5).collect()}
    assert table["ivt"]["true"] == 0.025 and table["n_obs"]["nrl"] > 100
    trips = spark.read.parquet(f"{tmp_path}/toy/synthetic_trips")
    assert trips.count() == spark.read.parquet(f"{tmp_path}/toy/synthetic_trips_train").count() + spark.read.parquet(f"{tmp_path}/toy/synthetic_trips_test").count()
    assert abs(trips.count() - 1800) < 40
    found = city.diagnose_city(spark, "toy", str(tmp_path), "A", "C", n_observations=60, draws=5, skip_sweep=True, nrl_sample=20)
    runtimes = {r["model"]: r for r in found["runtimes"].collect()}
    assert set(runtimes) == {"eps", "nrl"} and all(r["city"] == "toy" and r["total_s"] == r["train_s"] + r["test_s"] > 0 for r in runtimes.values())
    assert {r["name"] for r in found["attributes"].collect()} == {"ivt_min", "wait_min", "walk_min", "n_transfers", "path_size"}
    assert {"se", "z", "pval", "pct_bias"} <= set(found["eps_recovery"].columns) and found["eps_recovery"].count() == 5
    skipped = metrics.runtimes(spark, [("other", "eps", 2.0, 1.0), ("other", "nrl", None, None)])
    total = city.compare_runtimes({"toy": found["runtimes"], "other": skipped}, str(tmp_path)).filter("city = 'all'").first()
    assert total["total_s"] == pytest.approx(3 + sum(r["total_s"] for r in runtimes.values()))
    assert found["choice_set"].first()["universal"] >= found["choice_set"].first()["chosen"] > 0


def test_buses_keep_their_order(spark):
    rows = [("A", "B", r, float(k), "transit") for k, r in enumerate(["BUS_25-A", "BUS_252-F", "GREEN", "BUS_314-D"])] + [("B", "A", r, 1.0, "transit") for r in ("BUS_25-A", "BUS_252-F", "PURPLE")]
    edges = spark.createDataFrame(rows, "from_stop string, to_stop string, route_id string, duration double, link_type string")
    kept = {r["from_stop"]: r["route_id"] for r in network.graph_edges(edges, city.bus_precedence(config.CITIES["bengaluru"])).collect()}
    assert kept == {"A": "BUS_314-D", "B": "BUS_25-A"}


def test_diagnose_sweep_and_held_out(spark, raw, toy, tmp_path):
    _, edges, headways = city.build_network(spark, "toy", raw)
    edges.write.parquet(f"{tmp_path}/toy/supernetwork_edges")
    headways.write.parquet(f"{tmp_path}/toy/route_headways")
    found = city.diagnose_city(spark, "toy", str(tmp_path), "A", "C", n_observations=20, draws=5, nrl_sample=10)
    held = {r["model"]: r["log_likelihood"] for r in found["held_out"].collect()}
    assert set(held) == {"eps", "nrl"} and all(x < 0 for x in held.values())
    sweep = found["sweep"]
    assert [r["draws"] for r in sweep.collect()] == [10, 20, 40, 80] and sweep.filter("n_obs > 0 and test_log_likelihood < 0").count() == 4
    both = city.compare_sweeps({"toy": sweep, "other": sweep}, str(tmp_path))
    assert both.columns == ["city", *sweep.columns] and both.count() == 8 == spark.read.csv(f"{tmp_path}/eps_draw_sweeps", header=True).count()
    with pytest.raises(ValueError, match="columns differ"):
        city.compare_sweeps({"toy": sweep, "other": sweep.drop("z_ivt")}, str(tmp_path))


def test_command_line():
    assert parser().parse_args(["run", "--city", "sydney", "--model", "eps"]).eps_draws == 20
    with pytest.raises(SystemExit):
        main(["diagnose", "--origin", "a", "--dest", "b"])
