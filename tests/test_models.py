"""Paths, choice models and optimisers on toy networks and against brute force."""

import itertools
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from routelab.config import Betas
from routelab.operators import eps, graph, metrics, nrl, optim, paths, simulate, viz

EDGES = "from_stop string, to_stop string, route_id string, duration double, link_type string"


@pytest.fixture(scope="module")
def toy(spark):
    edges = spark.createDataFrame([("A", "B", "R1", 300.0, "transit"), ("B", "D", "R1", 300.0, "transit"), ("A", "C", "R2", 300.0, "transit"), ("C", "D", "R2", 300.0, "transit")], EDGES)
    return edges, spark.createDataFrame([("R1", 10.0), ("R2", 10.0)], "route_id string, headway_min double")


def components(spark, links, headways):
    nodes = ["n0"] + [f"n{k + 1}" for k in range(len(links))]
    edges = spark.createDataFrame([(nodes[k], nodes[k + 1], r, float(d), "transfer" if r == "walk" else "transit") for k, (r, d) in enumerate(links)], EDGES)
    df = spark.createDataFrame([("s", nodes)], "set string, path array<string>")
    return paths.path_components(df, edges, spark.createDataFrame(list(headways.items()), "route_id string, headway_min double"), ["set"]).first()


def test_components(spark):
    r = components(spark, [("R1", 300), ("R1", 300)], {"R1": 10.0})
    assert (r["n_transfers"], r["wait_min"], r["ivt_min"]) == (0, 5.0, 10.0)
    r = components(spark, [("R1", 300), ("R2", 300)], {"R1": 10.0, "R2": 8.0})
    assert (r["n_transfers"], r["wait_min"]) == (1, 9.0)
    r = components(spark, [("R1", 300), ("walk", 120), ("R1", 300)], {"R1": 10.0})
    assert (r["n_transfers"], r["walk_min"]) == (1, 2.0)
    r = components(spark, [("walk", 120), ("R1", 300)], {})
    assert (r["n_transfers"], r["wait_min"]) == (0, 5.0)


def test_path_size(spark):
    edges = spark.createDataFrame([("A", "B", "R", 100.0, "transit"), ("B", "C", "R", 100.0, "transit"), ("A", "D", "R", 100.0, "transit"), ("D", "C", "R", 100.0, "transit"), ("B", "E", "R", 100.0, "transit"), ("E", "C", "R", 100.0, "transit")], EDGES)
    df = spark.createDataFrame([("s", ["A", "B", "C"]), ("t", ["A", "B", "C"]), ("t", ["A", "B", "E", "C"])], "set string, path array<string>")
    got = {(r["set"], r["path_text"]): r["path_size"] for r in paths.path_sizes(df, edges, ["set"]).collect()}
    assert got == pytest.approx({("s", "A|B|C"): 1.0, ("t", "A|B|C"): 0.75, ("t", "A|B|E|C"): 5 / 6})


def brute_paths(adj, o, d):
    out, stack = [], [(0.0, (o,))]
    while stack:
        s, p = stack.pop()
        for v, c in adj.get(p[-1], ()):
            if v == d:
                out.append((s + c, (*p, v)))
            elif v not in p:
                stack.append((s + c, (*p, v)))
    return sorted(out)


@pytest.mark.parametrize("seed", range(6))
def test_yen_and_dijkstra(seed):
    rng = random.Random(seed)
    nodes = "abcdef"
    adj = {a: [(b, float(rng.randint(1, 9))) for b in nodes if b != a and rng.random() < 0.5] for a in nodes}
    for o, d in itertools.permutations(nodes, 2):
        want = brute_paths(adj, o, d)
        got = graph.yen(adj, o, d, 7)
        assert [s for s, _ in got] == [s for s, _ in want[:7]]
        assert len({p for _, p in got}) == len(got)
        assert (d in graph.dijkstra(adj, o)) == bool(want)
        if want:
            assert graph.dijkstra(adj, o)[d][0] == want[0][0]


def test_simple_paths_bound(spark, toy):
    assert graph.simple_paths(toy[0]).count() == 6
    pair = spark.createDataFrame([("A", "D")], "origin string, dest string")
    assert graph.simple_paths(toy[0], pair, max_paths=2).count() == 2
    with pytest.raises(Exception, match="more than 1 simple paths"):
        graph.simple_paths(toy[0], pair, max_paths=1).collect()
    assert tuple(graph.richest_pair(graph.path_counts(toy[0])).first()) == ("A", "D", 2, 2)
    assert {r["n_paths"] for r in graph.path_counts(toy[0], max_paths=1).collect()} == {1, 2}


@pytest.mark.parametrize("seed", range(5))
def test_walks_are_all_simple_paths(seed):
    rng = random.Random(seed)
    nodes = "abcdefg"
    adj = {a: [(b, float(rng.randint(1, 9))) for b in nodes if b != a and rng.random() < 0.4] for a in nodes}
    back = graph.reversed_graph(adj)
    for o, d in itertools.permutations(nodes, 2):
        want = brute_paths(adj, o, d)
        assert sorted(graph.walks(adj, back, o, d)) == want
        for most in (1, 3):
            assert sorted(graph.walks(adj, back, o, d, most)) == [x for x in want if len(x[1]) <= most + 1]


def lattice(spark, rows, columns, extra=()):
    """Both directions of a grid's links, and of more."""
    links = [((r, c), (r + dr, c + dc)) for r in range(rows) for c in range(columns) for dr, dc in ((0, 1), (1, 0)) if r + dr < rows and c + dc < columns]
    links = [(f"{a}", f"{b}") for a, b in links] + list(extra)
    return spark.createDataFrame([(a, b, "R", 60.0 + k % 7, "transit") for k, link in enumerate(links) for a, b in (link, link[::-1])], EDGES)


def test_enumeration_ends_at_the_destination(spark):
    """One path only, whatever lies behind its end; and a pair of far too many paths is given up after as many as asked for."""
    edges = lattice(spark, 5, 6, [("A", "B"), ("B", "(0, 0)")])
    pair = spark.createDataFrame([("A", "B")], "origin string, dest string")
    assert [r["path"] for r in graph.simple_paths(edges, pair, max_paths=500).collect()] == [["A", "B"]]
    far = spark.createDataFrame([("A", "(4, 5)")], "origin string, dest string")
    assert tuple(graph.path_counts(edges, far, 500).first()) == ("A", "(4, 5)", 501, 11)
    with pytest.raises(Exception, match="more than 500 simple paths"):
        graph.simple_paths(edges, far, max_paths=500).collect()
    best = graph.richest_pair(graph.path_counts(lattice(spark, 2, 20), max_paths=40), 2, 40).first()  # all pairs of forty nodes
    assert 2 <= best["n_paths"] <= 40


def test_min_plus_settles_on_a_long_line(spark):
    edges = spark.createDataFrame([(str(k), str(k + 1), "R", 1.0 + k * 1e-9, "transit") for k in range(150)], EDGES)
    got = {(r["origin"], r["dest"]): r["seconds"] for r in graph.min_plus_times(edges).collect()}
    assert len(got) == 151 * 152 // 2 and got["0", "150"] == pytest.approx(sum(1.0 + k * 1e-9 for k in range(150)), abs=1e-9)


def test_log_q_sums_to_one(spark, toy):
    edges, _ = toy
    times = graph.all_pairs(edges).select("origin", "dest", "seconds")
    weights = eps.link_weights(edges, times)
    df = spark.createDataFrame([("A", "D", ["A", "B", "D"]), ("A", "D", ["A", "C", "D"]), ("A", "D", ["A", "D"])], "origin string, dest string, path array<string>")
    got = {r["path_text"]: r["log_q"] for r in eps.path_log_q(df, weights, ["origin", "dest"]).collect()}
    assert got["A|B|D"] == pytest.approx(math.log(0.5)) and got["A|C|D"] == pytest.approx(math.log(0.5)) and got["A|D"] is None


def test_sampling(spark, toy):
    edges, headways = toy
    times = graph.all_pairs(edges).select("origin", "dest", "seconds")
    obs = spark.createDataFrame([(k, "A", "D", ["A", "C", "D"]) for k in range(8)], "obs_id bigint, origin string, dest string, path array<string>")
    sets = eps.sampled_sets(obs, edges, draws=30)
    again = eps.sampled_sets(obs.repartition(3), edges, draws=30)
    key = lambda df: sorted((r["obs_id"], "|".join(r["path"]), r["n_sampled"]) for r in df.collect())
    assert key(sets) == key(again)
    assert all(r["path"][0] == "A" and r["path"][-1] == "D" for r in sets.collect())
    assert sets.agg(F.sum("n_sampled")).first()[0] == 240
    assert eps.sampled_sets(obs, edges, draws=5, max_steps=2).count() == 0  # two steps end before arrival is tested
    weights = eps.link_weights(edges, times)
    full = eps.with_observed(sets.filter("array_contains(path, 'B')"), obs, weights)
    forced = full.filter("array_contains(path, 'C')").collect()
    assert len(forced) == 8 and {r["n_sampled"] for r in forced} == {1}
    table = eps.estimation_table(full, obs, edges, headways, 30).collect()
    assert all(r["expanded_path_size"] > 0 and math.isfinite(r["sampling_correction"]) for r in table)


def test_values_and_probabilities(spark, toy):
    edges, headways = toy
    lines = nrl.line_graph(edges, headways)
    p = nrl.Parameters()
    values = nrl.value_table(lines, edges, spark.createDataFrame([("D",)], "dest string"), p)
    got = {(r["u"], r["v"]): r["value"] for r in values.collect()}
    assert got["B", "D"] == 0 and got["C", "D"] == 0 and values.first()["converged"]
    df = spark.createDataFrame([(["A", "B", "D"],), (["A", "C", "D"],)], "path array<string>")
    probs = [math.exp(r["log_p"]) for r in nrl.path_log_probability(df, nrl.transitions(lines, p), values, []).collect()]
    assert probs == pytest.approx([0.5, 0.5], abs=1e-3)
    trips = spark.createDataFrame([(["A", "B", "D"],)] * 5 + [(["A", "C", "D"],)] * 5, "path array<string>")
    fit = nrl.fit(trips, edges, headways, errors=True)
    assert fit["log_likelihood"] == pytest.approx(10 * math.log(0.5), abs=1e-2) and fit["n_obs"] == 10
    assert set(nrl.fit(trips, edges, headways, variant="v0")["betas"]) == {*nrl.NAMES, "scale_regular"}


def test_recovery_of_a_logit(spark):
    rng = np.random.default_rng(3)
    true, rows = Betas(0.3, 0.2, 0.25, 0.8, 0.6), []
    for obs in range(1500):
        x = np.column_stack([rng.uniform(0, 20, 4), rng.uniform(0, 10, 4), rng.uniform(0, 8, 4), rng.integers(0, 3, 4), rng.uniform(0.2, 1, 4)])
        u = -(x[:, :4] @ [true.ivt, true.wait, true.walk, true.transfer]) + true.pathsize * np.log(x[:, 4]) + rng.gumbel(size=4)
        rows += [(obs, str(k), bool(k == u.argmax()), *map(float, x[k, :3]), int(x[k, 3]), float(x[k, 4]), 0.0) for k in range(4)]
    table = spark.createDataFrame(rows, "obs_id bigint, path_text string, chosen boolean, ivt_min double, wait_min double, walk_min double, n_transfers bigint, expanded_path_size double, sampling_correction double")
    fit = eps.fit(table, Betas(0.0, 0.0, 0.0, 0.0, 0.0), errors=True)
    for name in eps.NAMES:
        assert abs(fit["betas"][name] - getattr(true, name)) < 4 * fit["se"][name]
    nm = eps.fit(table, method="nelder-mead")
    assert nm["log_likelihood"] == pytest.approx(fit["log_likelihood"], abs=1e-2)
    ll = eps.log_likelihood(table, Betas(**fit["betas"])).first()["log_likelihood"]
    assert ll == pytest.approx(fit["log_likelihood"], abs=1e-6)
    assert 0.3 < eps.hit_rate(table, true).first()[0] <= 1


def test_a_likelihood_on_executors_is_the_drivers(spark, toy):
    rng = np.random.default_rng(0)
    rows = [(obs, str(k), k == obs % 3, *map(float, rng.uniform(1, 9, 3)), int(rng.integers(0, 3)), float(rng.uniform(0.2, 1)), 0.1) for obs in range(30) for k in range(3)]
    schema = "obs_id bigint, path_text string, chosen boolean, ivt_min double, wait_min double, walk_min double, n_transfers bigint, expanded_path_size double, sampling_correction double"
    table = spark.createDataFrame(rows, schema)
    with pytest.raises(ValueError, match="no observation"):
        eps.fit(table.limit(0))
    with pytest.raises(ValueError, match="no observation"):
        eps.fit(table.filter("path_text = '0'"))
    edges, headways = toy
    counted = spark.createDataFrame([(["A", "B", "D"], 3), (["A", "C", "D"], 2), (["A", "B"], 4)], "path array<string>, n bigint")
    lines = nrl.line_graph(edges, headways)
    own, p = nrl.Likelihood(lines, edges, counted), nrl.Parameters(0.3, 0.2, 0.4, 0.5, 0.3)
    ends = spark.createDataFrame([("D",), ("B",)], "dest string")
    probs = nrl.path_log_probability(counted, nrl.transitions(lines, p), nrl.value_table(lines, edges, ends, p, tol=1e-7), ["n"]).collect()
    assert own.n == 9 and own(np.array([0.3, 0.2, 0.4, 0.5, 0.3])) == pytest.approx(sum(r["n"] * r["log_p"] for r in probs), rel=1e-7)
    with pytest.raises(Exception, match="lacks"):
        nrl.Likelihood(lines, edges, spark.createDataFrame([(["A", "D"], 1)], "path array<string>, n bigint"))(np.ones(5))
    with pytest.raises(ValueError, match="no trips"):
        nrl.fit(counted.select("path").limit(0), edges, headways)
    assert nrl.held_out_log_likelihood(counted.select("path").limit(0), edges, headways, nrl.Parameters().__dict__) is None


def test_the_warm_sample_ignores_partitions(spark, toy, monkeypatch):
    edges, headways = toy
    trips = spark.createDataFrame([(["A", "B", "D"],)] * 45 + [(["A", "C", "D"],)] * 35, "path array<string>")
    seen = []
    monkeypatch.setattr(nrl, "Likelihood", type("Kept", (), {"__init__": lambda self, lines, edges, counted, variant: seen.append(sorted(map(str, counted.collect()))), "at": lambda self, xs: [(-(x[0] ** 2), np.eye(5)[0] * -2 * x[0]) for x in xs], "n": 80}))
    for n in (1, 5):
        nrl.fit(trips.repartition(n), edges, headways)
    assert len(seen) == 4 and seen[:2] == seen[2:]


def test_bias_of_negative_values(spark):
    table = lambda rows: spark.createDataFrame(rows, "name string, value double")
    r = metrics.parameter_bias(table([("a", -0.4), ("b", 1.0)]), table([("a", -0.5), ("b", 0.0)])).orderBy("name").collect()
    assert r[0]["bias"] == pytest.approx(0.1) and r[0]["pct_bias"] == pytest.approx(-20) and r[1]["pct_bias"] is None


def test_hit_rate_ties_take_the_first_path(spark):
    rows = [(obs, path, path == own, 1.0, 1.0, 1.0, 0, 1.0, 0.0) for obs, own in ((0, "A|B"), (1, "A|C|B")) for path in ("A|C|B", "A|B")]
    schema = "obs_id bigint, path_text string, chosen boolean, ivt_min double, wait_min double, walk_min double, n_transfers bigint, expanded_path_size double, sampling_correction double"
    assert eps.hit_rate(spark.createDataFrame(rows, schema), Betas()).first()[0] == 0.5


def test_optimisers():
    f = lambda x: (x[0] - 3) ** 2 + 10 * (x[1] + 1) ** 2 + x[0] * x[1]
    want = np.linalg.solve([[2, 1], [1, 20]], [6, -20])
    for method in ("bfgs", "nelder-mead"):
        assert optim.minimise(f, [0, 0], [(-5, 5)] * 2, method).x == pytest.approx(want, abs=1e-3)
    assert optim.minimise(f, [0, 0], [(-5, 1), (-5, 5)]).x[0] == pytest.approx(1)
    assert optim.hessian(f, np.array([1.0, 2.0])) == pytest.approx(np.array([[2, 1], [1, 20]]), abs=1e-4)
    assert optim.standard_errors(lambda x: x[0] ** 2, np.array([1.0, 1.0]), ["a", "b"])["se"]["a"] == pytest.approx(math.sqrt(0.5), rel=1e-3)


def test_split_and_metrics(spark):
    trips = spark.createDataFrame([(k, "x" if k < 10 else "y" if k < 12 else "z") for k in range(13)], "id bigint, od string")
    got = simulate.train_test_split(trips, ["od"], "id", 0.2)
    assert {r["od"]: r["n"] for r in got.groupBy("od").agg(F.sum(F.col("is_test").cast("int")).alias("n")).collect()} == {"x": 2, "y": 1, "z": 0}
    assert metrics.rho_squared(-5, -10) == 0.5
    t = metrics.Timer()
    t.run("a", lambda: 1)
    t.skip("b")
    assert t.table(spark).count() == 2


def test_features(spark, toy):
    stations = spark.createDataFrame([(s, s, 1.0, 2.0) for s in "ABCD"], "station_id string, station_name string, stop_lat double, stop_lon double")
    assert viz.features(toy[0], stations).count() == 8
    assert viz.map_centre(stations).first()["lat"] == 1.0


def _random_edges(spark, rng, n_nodes, n_edges):
    rows = {(f"n{rng.integers(n_nodes)}", f"n{rng.integers(n_nodes)}") for _ in range(n_edges)}
    return spark.createDataFrame([(a, b, "r", float(rng.integers(1, 9)) * 60, "transit") for a, b in sorted(rows) if a != b], "from_stop string, to_stop string, route_id string, duration double, link_type string")


def test_frontier_search_is_all_pairs(spark, monkeypatch):
    rng = np.random.default_rng(5)
    edges = _random_edges(spark, rng, 14, 36)
    want = sorted(map(repr, graph.all_pairs(edges).collect()))
    origins = spark.createDataFrame([("n1",), ("n3",), ("n3",), ("nowhere",)], "origin string")
    some = sorted(map(repr, graph.shortest_paths(edges, origins).collect()))
    monkeypatch.setattr(graph, "MAX_BROADCAST_EDGES", 10)
    assert sorted(map(repr, graph.all_pairs(edges).collect())) == want
    assert sorted(map(repr, graph.shortest_paths(edges, origins).collect())) == some
    assert sorted(map(repr, graph.frontier_paths(edges, origins, delta=60.0).collect())) == some
    back = {(r["dest"], r["origin"]): (r["seconds"], r["path"]) for r in graph.frontier_paths(edges, origins, to_origin=True).collect()}
    times = {(r["origin"], r["dest"]): r["seconds"] for r in graph.min_plus_times(edges).collect()}
    assert {k: v[0] for k, v in back.items()} == {k: v for k, v in times.items() if k[1] in ("n1", "n3")}
    assert all(p[0] == a and p[-1] == b for (a, b), (_, p) in back.items())
    assert graph.frontier_paths(edges.limit(0), origins).count() == 0
    plain = graph.frontier_paths(edges, origins, with_path=False)
    assert plain.columns == ["origin", "dest", "seconds"] and plain.count() == len(some)


def test_rounds_of_the_frontier_search_neither_shuffle_links_nor_sort_messages(spark, monkeypatch):
    edges = _random_edges(spark, np.random.default_rng(6), 30, 120)
    plans, staged, tables = [], graph.Scratch.__call__, len(spark.catalog.listTables())
    monkeypatch.setattr(graph.Scratch, "__call__", lambda self, df, name: plans.append((name, df._jdf.queryExecution().executedPlan().toString())) or staged(self, df, name))
    found = graph.frontier_paths(edges, edges.select(F.col("from_stop").alias("origin")).union(edges.select("to_stop")), with_path=False)
    rounds = [text for name, text in plans if name == "frontier"][1:]
    assert rounds and all("Bucketed: true" in text and "SortAggregate" not in text for text in rounds)
    assert {(r["origin"], r["dest"], r["seconds"]) for r in found.collect()} == {(r["origin"], r["dest"], r["seconds"]) for r in graph.all_pairs(edges).collect()}
    assert len(spark.catalog.listTables()) == tables


def test_partitioned_values_are_the_kernels(spark, toy, monkeypatch):
    rng = np.random.default_rng(8)
    ring = [(f"n{k}", f"n{(k + 1) % 7}", f"R{k % 3}", 60.0 * (2 + k % 4), "transit") for k in range(7)]
    ring += [(b, a, r, d, t) for a, b, r, d, t in ring] + [("n0", "n3", "walk", 300.0, "transfer"), ("n3", "n0", "walk", 300.0, "transfer")]
    edges = spark.createDataFrame(ring, "from_stop string, to_stop string, route_id string, duration double, link_type string")
    headways = spark.createDataFrame([("R0", 6.0), ("R1", 9.0)], "route_id string, headway_min double")
    lines, dests = nrl.line_graph(edges, headways), spark.createDataFrame([("n2",), ("n5",), ("n2",)], "dest string")
    p = nrl.Parameters(0.2, 0.3, 0.25, 0.6, float(rng.uniform(-1, 1)), 0.4)

    def rows(df):
        return {(r["dest"], r["u"], r["v"]): r for r in df.collect()}

    for how in ({}, {"max_iter": 4}):
        monkeypatch.setattr(nrl, "MAX_TRANSITIONS", 20_000_000)
        want = rows(nrl.value_table(lines, edges, dests, p, **how))
        monkeypatch.setattr(nrl, "MAX_TRANSITIONS", 10)
        got = rows(nrl.value_table(lines, edges, dests, p, **how))
        assert got.keys() == want.keys()
        for k, r in want.items():
            assert got[k]["value"] == pytest.approx(r["value"], abs=1e-9) and (got[k]["converged"], got[k]["iterations"]) == (r["converged"], r["iterations"])


def test_recursive_likelihood_gradient_is_differences(spark):
    ring = [(f"n{k}", f"n{(k + 1) % 6}", f"R{k % 2}", 60.0 * (4 + k % 3), "transit") for k in range(6)]
    ring += [(b, a, r, d, t) for a, b, r, d, t in ring] + [("n0", "n3", "walk", 500.0, "transfer"), ("n3", "n0", "walk", 500.0, "transfer")]
    edges = spark.createDataFrame(ring, "from_stop string, to_stop string, route_id string, duration double, link_type string")
    lines = nrl.line_graph(edges, spark.createDataFrame([("R0", 6.0)], "route_id string, headway_min double"))
    counted = spark.createDataFrame([(["n0", "n1", "n2"], 5), (["n5", "n0", "n3", "n2"], 2), (["n4", "n3", "n0"], 3), (["n1", "n0"], 1), (["n1", "n2", "n3", "n0"], 2)], "path array<string>, n bigint")
    for variant, x in (("current", [0.4, 0.3, 0.5, 0.7, -0.4]), ("v0", [0.4, 0.3, 0.5, 0.7, -0.4, 0.8])):
        own, x = nrl.Likelihood(lines, edges, counted, variant, tol=1e-11), np.array(x)
        h, n = 1e-5, len(x)
        found = own.at([x, *(x + s * h * np.eye(n)[k] for k in range(n) for s in (1, -1))])
        assert own.jobs == 1
        slopes = [(found[1 + 2 * k][0] - found[2 + 2 * k][0]) / (2 * h) for k in range(n)]
        assert found[0][1] == pytest.approx(slopes, rel=1e-4, abs=1e-5)
    assert own(np.full(6, 1e-5)) == nrl.UNSETTLED


def test_a_path_with_a_lost_link_raises(spark, toy):
    edges, headways = toy
    df = spark.createDataFrame([("A", "D", ["A", "B", "D"]), ("A", "D", ["A", "D"])], "origin string, dest string, path array<string>")
    assert paths.path_components(df.limit(1), edges, headways, ["origin", "dest"]).count() == 1
    for table in (paths.path_components(df, edges, headways, ["origin", "dest"]), paths.path_sizes(df, edges, ["origin", "dest"])):
        with pytest.raises(Exception, match="lacks"):
            table.collect()
