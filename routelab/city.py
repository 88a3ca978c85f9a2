"""A city's whole run, from feeds to fitted models, and the experiment on one pair with its universal choice set.

Inputs below ``raw/<city>``: stops, trips, routes, stop_times and optionally calendar (.txt), ``bmtc/`` for bus feeds, and the demand
files. Tables go to ``out/<city>`` as Parquet, reports as CSV, fits as JSON lines; either folder may be on any file system of Spark.
"""

from __future__ import annotations

import math
from dataclasses import asdict

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from routelab.config import CITIES, SETTINGS, TRUE_BETAS, Betas, City
from routelab.functions.scalar import TRANSFER, gtfs_seconds, path_nodes
from routelab.operators import demand, eps, graph, gtfs, metrics, network, nrl, paths, simulate, viz
from routelab.sources import tables
from routelab.staging import staged

PAIR = ["origin", "dest"]


def route_table(spark: SparkSession, city: City, services: dict[str, str] | None = None) -> DataFrame:
    rows = [(r, h, (services or {}).get(r)) for r, h in city.headsigns.items()]
    return spark.createDataFrame(rows, "route_id string, headsign string, service_id string")


def _services(spark: SparkSession, city: City, feed: dict[str, DataFrame], calendar: DataFrame | None) -> DataFrame:
    """route_id and its service: of the calendar, else set by hand, else the city's filter."""
    routes = route_table(spark, city)
    manual = spark.createDataFrame(list(city.headway_services.items()), "route_id string, service_id string")
    weekday = gtfs.weekday_services(calendar, feed["trips"]) if calendar is not None else manual.limit(0)
    return gtfs.resolved_services(routes, weekday, manual, city.service_filter)


def metro(spark: SparkSession, city: City, feed: dict[str, DataFrame], calendar: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Stations and transit edges of the canonical trips."""
    stations, lookup = gtfs.collapse_platforms(feed["stops"])
    routes = route_table(spark, city).drop("service_id").join(_services(spark, city, feed, calendar), "route_id")
    matching, _ = gtfs.canonical_trips(feed["trips"], feed["stop_times"], routes, None, list(city.longest))
    matching = staged(matching, "canonical")
    if matching.isEmpty():
        raise ValueError("no canonical trips: check routes, headsigns and services")
    calls = feed["stop_times"].join(matching, "trip_id").join(lookup, "stop_id")
    calls = calls.select("trip_id", "route_id", F.col("station_id").alias("stop_id"), "stop_sequence", gtfs_seconds("arrival_time").alias("arrival"), gtfs_seconds("departure_time").alias("departure"))
    edges = staged(network.transit_edges(calls, ["stop_sequence"]), "metro")
    return network.used_stations(stations, edges), edges


def build_network(spark: SparkSession, name: str, raw: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Stations, edges and headways of a city; bus stops count as stations, routes without a headway have the default."""
    city, folder = CITIES[name], f"{raw}/{name}"
    feed, calendar = tables.read_gtfs(spark, folder), tables.read_calendar(spark, folder)
    stations, edges = metro(spark, city, feed, calendar)

    def trim(s: DataFrame, e: DataFrame) -> tuple[DataFrame, DataFrame]:
        if not city.branch_boundaries:
            return s, e
        e = staged(e, "untrimmed")
        ends = spark.createDataFrame([(b,) for b in city.branch_boundaries], "station_name string")
        return network.trim_branches(s, e, ends, graph.all_pairs(network.graph_edges(e)))

    buses = []
    if city.bus_routes:
        bus = tables.read_gtfs(spark, f"{folder}/bmtc")
        buses = [network.parallel_bus_route(stations, bus, r, SETTINGS.bus_max_gap_sec) for r in city.bus_routes]
    merged = [_union(parts) for parts in zip(*buses)] if buses else [None, None, None]
    all_stations, all_edges = network.build_supernetwork(stations, edges, SETTINGS.max_walk_m, SETTINGS.walk_speed_mps, trim, merged[0], merged[1])
    all_edges = staged(all_edges, "edges")

    routes = route_table(spark, city).drop("service_id").join(_services(spark, city, feed, calendar), "route_id")
    known = gtfs.route_headways(feed["trips"], feed["stop_times"], routes, SETTINGS.metro_max_gap_sec)
    known = known.unionByName(merged[2]) if buses else known
    transit = all_edges.filter(F.col("link_type") != TRANSFER).select("route_id")
    return staged(all_stations, "stations"), all_edges, staged(gtfs.headway_table(transit, known, SETTINGS.default_headway_min), "headways")


def _union(parts) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def load_demand(spark: SparkSession, name: str, raw: str, stations: DataFrame, times: DataFrame) -> tuple[DataFrame, DataFrame]:
    city, folder = CITIES[name], f"{raw}/{name}"
    if city.demand == "entry_exit":
        return demand.load_demand("entry_exit", stations, entry_exit=tables.read_entry_exit(spark, f"{folder}/entry_exit.csv"), times=times)
    files = f"{folder}/bmrcl-ridership-hourly"
    return demand.load_demand(
        "ridership", stations, entries=tables.read_ridership(spark, f"{files}/station-hourly.csv"), exits=tables.read_ridership(spark, f"{files}/station-hourly-exits.csv"),
        pairs=tables.read_station_pairs(spark, f"{files}/stationpair-hourly.csv") if city.has_od else None, times=times,
    )


def _bias(spark: SparkSession, fit: dict) -> DataFrame:
    values = lambda d: spark.createDataFrame([(k, float(v)) for k, v in d.items()], "name string, value double")
    return metrics.parameter_bias(values(fit["betas"]), values(asdict(TRUE_BETAS)))


def recovery(spark: SparkSession, fit: dict) -> DataFrame:
    """The bias table with se, z and pval of each parameter, null where the fit has none."""
    rows = [(name, *(x if x is not None and math.isfinite(x) else None for x in (fit.get(k, {}).get(name) for k in ("se", "z", "pval")))) for name in fit["betas"]]
    return _bias(spark, fit).join(spark.createDataFrame(rows, "name string, se double, z double, pval double"), "name")


def bus_precedence(city: City) -> Column:
    """Of parallel edges those of a bus route go before others, and of bus routes the one configured last."""
    order = F.lit(0)
    for at, route in enumerate(city.bus_routes, 1):
        order = F.when(F.col("route_id") == f"BUS_{route.name}", at).otherwise(order)
    return order


def observations(trips: DataFrame) -> DataFrame:
    """Trips as the models take them: obs_id, origin, dest and path."""
    return trips.select(F.xxhash64("trip_id").alias("obs_id"), *PAIR, path_nodes("chosen_path").alias("path"))


def fit_models(spark: SparkSession, name: str, out: str, train: DataFrame, test: DataFrame, edges: DataFrame, headways: DataFrame, model: str = "both", draws: int = 20) -> DataFrame:
    """Fit the models, write bias tables and fits, and return (and write) the comparison."""
    rows = [(k, "true", float(v)) for k, v in asdict(TRUE_BETAS).items()]
    if model in ("eps", "both"):
        fit = eps.fit(staged(eps.estimation_data(train, edges, headways, draws), "estimation"))
        held = eps.log_likelihood(staged(eps.estimation_data(test, edges, headways, draws), "estimation"), Betas(**fit["betas"])).first()["log_likelihood"]
        tables.write_table(_bias(spark, fit), f"{out}/{name}_eps_parameter_bias", "csv")
        tables.write_fit(spark, fit | {"test_log_likelihood": held}, f"{out}/{name}_eps_params")
        rows += [(k, "eps", float(v)) for k, v in fit["betas"].items()] + [("log_likelihood", "eps", fit["log_likelihood"]), ("n_obs", "eps", float(fit["n_obs"]))]
    if model in ("nrl", "both"):
        fit = nrl.fit(train, edges, headways)
        held = nrl.held_out_log_likelihood(test, edges, headways, fit["betas"])
        tables.write_table(_bias(spark, fit), f"{out}/{name}_nrl_parameter_bias", "csv")
        tables.write_fit(spark, fit | {"test_log_likelihood": held}, f"{out}/{name}_nrl_params")
        rows += [(k, "nrl", float(v)) for k, v in fit["betas"].items()] + [("log_likelihood", "nrl", fit["log_likelihood"]), ("n_obs", "nrl", float(fit["n_obs"]))]
    table = metrics.comparison(spark.createDataFrame(rows, "metric string, model string, value double"))
    tables.write_table(table, f"{out}/{name}_eps_vs_nrl", "csv")
    return table


def run_city(spark: SparkSession, name: str, raw: str, out: str, skip_models: bool = False, model: str = "both", draws: int = 20) -> DataFrame | None:
    """Network, demand, headways, simulated trips, map features and, unless skipped, both models; the comparison."""
    out = f"{out}/{name}"
    stations, edges, headways = build_network(spark, name, raw)
    one = staged(network.graph_edges(edges, bus_precedence(CITIES[name])), "graph")
    times = staged(graph.all_pairs(one), "times")
    with_demand, od = load_demand(spark, name, raw, stations, times)
    od = staged(od, "od")
    pairs = od.select(F.col("origin_station_id").alias("origin"), F.col("dest_station_id").alias("dest"), "total_trips")
    choices = paths.choice_table(graph.k_shortest(one, pairs, SETTINGS.k_paths).select(*PAIR, "path"), one, headways, PAIR, TRUE_BETAS)
    total = pairs.agg(F.sum("total_trips")).first()[0]
    trips = staged(simulate.synthetic_trips(choices, pairs, SETTINGS.target_trips / total, SETTINGS.min_trips_per_od, SETTINGS.seed), "trips")
    split = simulate.train_test_split(trips, PAIR, "trip_id", SETTINGS.test_fraction, SETTINGS.seed)
    for df, table in (
        (stations, "stations"), (edges, "supernetwork_edges"), (with_demand, "stations_with_demand"), (od, "od_matrix"), (headways, "route_headways"), (trips, "synthetic_trips"),
        (split.filter("is_test"), "synthetic_trips_test"), (split.filter("not is_test"), "synthetic_trips_train"), (viz.features(edges, stations), "map_features"), (viz.network_stats(edges, stations), "network_stats"),
    ):
        tables.write_table(df, f"{out}/{table}")
    if skip_models:
        return None
    part = lambda test: staged(observations(spark.read.parquet(f"{out}/synthetic_trips_{test}")), "observations")
    return fit_models(spark, name, out, part("train"), part("test"), one, headways, model, draws)


def diagnose_city(
    spark: SparkSession, name: str, out: str, origin: str | None = None, dest: str | None = None, n_observations: int = 3000, max_paths: int = 500,
    skip_sweep: bool = False, skip_nrl: bool = False, nrl_sample: int = 60, nrl_se: bool = False, draws: int = 50,
) -> dict[str, DataFrame]:
    """Both models on one pair's universal choice set, over the tables of an earlier run: attributes, recovery, sweep, held-out fit and runtimes.

    Attributes are those of the paths that were chosen at least once, path size among them.
    """
    folder, timer, found = f"{out}/{name}", metrics.Timer(), {}
    edges, headways = staged(network.graph_edges(spark.read.parquet(f"{folder}/supernetwork_edges"), bus_precedence(CITIES[name])), "graph"), spark.read.parquet(f"{folder}/route_headways")
    if origin is None or dest is None:
        best = graph.richest_pair(graph.path_counts(edges, None, max_paths), 2, max_paths).first()
        if best is None:
            raise ValueError(f"no pair has 2 to {max_paths} paths")
        origin, dest = best["origin"], best["dest"]
    pair = spark.createDataFrame([(str(origin), str(dest))], "origin string, dest string")
    choices = staged(paths.choice_table(graph.simple_paths(edges, pair, max_paths=max_paths), edges, headways, PAIR, TRUE_BETAS), "choices")
    trips = staged(simulate.universal_trips(choices, n_observations, SETTINGS.seed), "trips")
    chosen = choices.join(trips.select(F.col("chosen_path").alias("path_text")).distinct(), "path_text", "left_semi")
    columns = ["ivt_min", "wait_min", "walk_min", "n_transfers", "path_size"]
    found["choice_set"] = choices.agg(F.count("*").alias("universal")).crossJoin(chosen.agg(F.count("*").alias("chosen")))  # a row and a row
    found |= {"attributes": metrics.describe(chosen, columns), "correlations": metrics.correlations(chosen, columns), "transfers": metrics.value_counts(chosen, "n_transfers")}

    split = simulate.train_test_split(trips, PAIR, "obs_id", SETTINGS.test_fraction, SETTINGS.seed)
    rows = split.select("obs_id", *PAIR, path_nodes("chosen_path").alias("path"), "choice_set_size", "is_test")
    train, test = staged(rows.filter("not is_test"), "train"), staged(rows.filter("is_test"), "test")
    fit = timer.run("eps train", lambda: eps.fit(staged(eps.estimation_data(train, edges, headways, draws), "estimation"), errors=True))
    held_out = [("eps", timer.run("eps test", lambda: eps.log_likelihood(eps.estimation_data(test, edges, headways, draws), Betas(**fit["betas"])).first())["log_likelihood"])]
    found["eps_recovery"] = recovery(spark, fit)
    if not skip_sweep:
        found["sweep"] = eps.draw_sweep(train, test, edges, headways, timer=timer)
    if skip_nrl:
        timer.skip("nrl train")
        timer.skip("nrl test")
    else:
        sample = lambda df: staged(df.orderBy(F.md5(F.col("obs_id").cast("string").cast("binary"))).limit(nrl_sample), "sample")
        small, held = sample(train), sample(test)
        own = timer.run("nrl train", lambda: nrl.fit(small, edges, headways, errors=nrl_se))
        held_out.append(("nrl", timer.run("nrl test", lambda: nrl.held_out_log_likelihood(held, edges, headways, own["betas"]))))
        found["nrl_recovery"] = recovery(spark, own)
    found["held_out"] = spark.createDataFrame(held_out, "model string, log_likelihood double")
    found["runtimes"] = metrics.runtimes(spark, [(name, model, timer.seconds[f"{model} train"], timer.seconds[f"{model} test"]) for model in ("eps", "nrl")])
    for key, df in found.items():
        tables.write_table(df, f"{folder}/diagnostic_{key}", "csv")
    return found


def compare_runtimes(runtimes: dict[str, DataFrame], out: str) -> DataFrame:
    """The cities' runtimes as one table, which is written too, with a last row of their grand total; what was skipped has none."""
    rows = staged(_union(list(runtimes.values())), "runtimes")
    total = rows.agg(F.lit("all").alias("city"), F.lit("all").alias("model"), *[F.sum(c).alias(c) for c in ("train_s", "test_s", "total_s")])
    table = rows.unionByName(total)
    tables.write_table(table, f"{out}/runtime_summary", "csv")
    return table


def compare_sweeps(sweeps: dict[str, DataFrame], out: str) -> DataFrame:
    """The cities' sweeps as one table (city and a sweep's columns), which is written too; their columns must agree."""
    columns = {name: df.dtypes for name, df in sweeps.items()}
    if any(c != next(iter(columns.values())) for c in columns.values()):
        raise ValueError(f"the sweeps' columns differ: {columns}")
    table = _union([df.select(F.lit(name).alias("city"), "*") for name, df in sweeps.items()])
    tables.write_table(table, f"{out}/eps_draw_sweeps", "csv")
    return table
