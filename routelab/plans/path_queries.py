"""Queries on paths, choice sets, simulation and summaries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from routelab.functions.scalar import generalized_time as generalized
from routelab.functions.scalar import path_text
from routelab.operators import graph, metrics, paths, simulate
from routelab.plans import adapters as a

PAIR = ["origin", "dest"]
SCALE = 0.01
OBSERVATIONS = 20
MAX_PATHS = 500
ATTRIBUTES = ["ivt_min", "wait_min", "walk_min", "n_transfers", "path_size"]


def _edges_paths(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    edges = a.grid_edges(spark, sf_dir)
    return edges, a.grid_paths(edges)


def _choices(spark: SparkSession, sf_dir: str) -> DataFrame:
    return a.grid_choices(*_edges_paths(spark, sf_dir))


def simple_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = graph.simple_paths(a.grid_edges(spark, sf_dir), max_paths=MAX_PATHS)
    return found.select(*PAIR, path_text("path").alias("path"), F.round("seconds", 6).alias("seconds"))


def k_shortest(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = graph.k_shortest(a.grid_edges(spark, sf_dir), None, 10)
    return found.select(*PAIR, path_text("path").alias("path"), F.round("seconds", 6).alias("seconds"), F.col("rank").cast("bigint").alias("rank"))


def richest_od(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.richest_pair(graph.path_counts(a.grid_edges(spark, sf_dir), max_paths=MAX_PATHS), 2, MAX_PATHS)


def path_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counted up to 10: one more means too many."""
    return graph.path_counts(a.grid_edges(spark, sf_dir), max_paths=10)


def path_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges, found = _edges_paths(spark, sf_dir)
    rows = paths.path_components(found, edges, a.grid_headways(edges), PAIR)
    return rows.select(*PAIR, "path_text", *[F.round(c, 6).alias(c) for c in ("ivt_min", "wait_min", "walk_min")], "n_transfers")


def path_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges, found = _edges_paths(spark, sf_dir)
    return paths.path_sizes(found, edges, PAIR).withColumn("path_size", F.round("path_size", 6))


def path_utility(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _choices(spark, sf_dir).select(*PAIR, "path_text", F.round("utility", 6).alias("utility"))


def choice_probabilities(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _choices(spark, sf_dir).select(*PAIR, "path_text", F.round("probability", 6).alias("probability"))


def generalized_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges, found = _edges_paths(spark, sf_dir)
    rows = paths.path_components(found, edges, a.grid_headways(edges), PAIR)
    return rows.select(*PAIR, "path_text", F.round(generalized(F.col("ivt_min"), F.col("wait_min"), F.col("walk_min")), 6).alias("generalized_min"))


def _od(spark: SparkSession, sf_dir: str) -> DataFrame:
    trips = a.nation_trips(spark, sf_dir).select(*[F.col(c).cast("string").alias(c) for c in PAIR])
    return trips.groupBy(*PAIR).agg(F.count("*").cast("double").alias("total_trips"))


def simulated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trips over the ten shortest paths of each pair of grid stations."""
    edges, found = _edges_paths(spark, sf_dir)
    choices = a.grid_choices(edges, graph.shortest_of(found, 10).drop("rank", "seconds"))
    return simulate.synthetic_trips(choices, _od(spark, sf_dir), SCALE)


def synthetic_trips(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simulated(spark, sf_dir).select("trip_id", *PAIR, "chosen_path", "n_stops", "n_transfers", "choice_set_size", "od_total_trips")


def gumbel_choice(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simulate.universal_trips(_choices(spark, sf_dir), OBSERVATIONS).select(*PAIR, "obs_id", "chosen_path", "choice_set_size")


def train_test_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = a.table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    return simulate.train_test_split(orders, ["o_custkey"], "o_orderkey")


def null_ll(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.null_log_likelihood(simulated(spark, sf_dir)).withColumn("null_log_likelihood", F.round("null_log_likelihood", 4))


def rho_squared(spark: SparkSession, sf_dir: str) -> DataFrame:
    """1 - LL / LL0 of the true utilities over simulated trips."""
    edges, found = _edges_paths(spark, sf_dir)
    choices = a.grid_choices(edges, graph.shortest_of(found, 10).drop("rank", "seconds"))
    trips = simulate.synthetic_trips(choices, _od(spark, sf_dir), SCALE)
    rows = trips.join(choices.select(*PAIR, F.col("path_text").alias("chosen_path"), "probability"), [*PAIR, "chosen_path"])
    return rows.agg(F.round(1 - F.sum(F.ln("probability")) / F.sum(-F.ln(F.col("choice_set_size").cast("double"))), 6).alias("rho_squared"))


def attribute_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = metrics.describe(_choices(spark, sf_dir), ATTRIBUTES)
    return rows.select("name", "n", *[F.round(c, 6).alias(c) for c in ("mean", "std", "min", "q25", "q50", "q75", "max")])


def attribute_corr(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.correlations(_choices(spark, sf_dir), ATTRIBUTES).withColumn("r", F.round("r", 6))


def transfer_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.value_counts(_choices(spark, sf_dir), "n_transfers")


def order_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Least seconds from the ten busiest parts to all parts, over the network of orders: a frontier search."""
    edges = a.part_edges(spark, sf_dir)
    busiest = a.table(spark, sf_dir, "lineitem").groupBy(F.col("l_partkey").alias("p")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "p").limit(10)
    found = graph.frontier_paths(edges, busiest.select(F.col("p").cast("string").alias("origin")), with_path=False)
    return found.select("origin", "dest", F.round("seconds", 4).alias("seconds"))


def parameter_bias(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How far the mean (centred) discount of returned lines is off that of all lines, by line number."""
    lines = a.table(spark, sf_dir, "lineitem").select(F.concat(F.lit("line"), F.col("l_linenumber").cast("string")).alias("name"), (F.col("l_discount") - 0.05).alias("x"), "l_returnflag")
    mean = lambda df: df.groupBy("name").agg(F.avg("x").alias("value"))
    out = metrics.parameter_bias(mean(lines.filter("l_returnflag = 'R'")), mean(lines))
    return out.select("name", F.round("true", 8).alias("true"), F.round("fitted", 8).alias("fitted"), F.round("bias", 8).alias("bias"), F.round("pct_bias", 4).alias("pct_bias"))


QUERIES = {
    "simple_paths": simple_paths, "path_counts": path_counts, "k_shortest": k_shortest, "richest_od": richest_od, "path_components": path_components, "path_size": path_size,
    "path_utility": path_utility, "choice_probabilities": choice_probabilities, "generalized_time": generalized_time, "synthetic_trips": synthetic_trips,
    "gumbel_choice": gumbel_choice, "train_test_split": train_test_split, "null_ll": null_ll, "rho_squared": rho_squared, "attribute_summary": attribute_summary,
    "attribute_corr": attribute_corr, "transfer_distribution": transfer_distribution, "parameter_bias": parameter_bias, "order_times": order_times,
}

_WALKED = a.with_(a.GRID, a.WALKS)
_PARTS = a.with_(a.GRID, a.WALKS, a.LINKS, a.COMPONENTS)
_CHOSEN = a.with_(a.GRID, a.WALKS, a.LINKS, a.COMPONENTS, a.SIZES, a.CHOICES)
_SHORT = a.WALKS.replace("paths AS (SELECT origin, dest, path, seconds, array_to_string(path, '|') AS path_text FROM walk)", "paths AS (SELECT origin, dest, path, seconds, array_to_string(path, '|') AS path_text FROM walk QUALIFY ROW_NUMBER() OVER (PARTITION BY origin, dest ORDER BY seconds, array_to_string(path, '|')) <= 10)")
_TRIPS = f"""{a.OD},
ranked AS (SELECT *, SUM(probability) OVER w AS upto, ROW_NUMBER() OVER w AS r, COUNT(*) OVER (PARTITION BY origin, dest) AS choice_set_size FROM choices WINDOW w AS (PARTITION BY origin, dest ORDER BY seconds, path_text)),
bands AS (SELECT *, COALESCE(LAG(upto) OVER (PARTITION BY origin, dest ORDER BY r), -1) AS low, CASE WHEN r = choice_set_size THEN 2 ELSE upto END AS high FROM ranked),
numbered AS (SELECT origin, dest, total_trips, UNNEST(range(0, GREATEST(2, round_even(total_trips * {SCALE}::DOUBLE, 0)::BIGINT))) AS draw FROM od WHERE origin <> dest),
drawn AS (SELECT *, {a.uniform("origin", "dest", "draw", "42")} AS u FROM numbered),
trips AS (SELECT drawn.*, path_text, bands.n_stops, n_transfers, choice_set_size, probability FROM drawn JOIN bands USING (origin, dest) WHERE u > low AND u <= high)"""
_SIMULATED = a.with_(a.GRID, _SHORT, a.LINKS, a.COMPONENTS, a.SIZES, a.CHOICES, _TRIPS)
_Q = lambda c: f"SELECT '{c}' AS name, COUNT({c}) AS n, ROUND(AVG({c}), 6) AS mean, ROUND(STDDEV_SAMP({c}), 6) AS std, ROUND(MIN({c}), 6)::DOUBLE AS min, ROUND(QUANTILE_CONT({c}::DOUBLE, 0.25), 6) AS q25, ROUND(QUANTILE_CONT({c}::DOUBLE, 0.5), 6) AS q50, ROUND(QUANTILE_CONT({c}::DOUBLE, 0.75), 6) AS q75, ROUND(MAX({c}), 6)::DOUBLE AS max FROM choices"

ORACLE_SQL = {
    "simple_paths": _WALKED + "SELECT origin, dest, path_text AS path, ROUND(seconds, 6) AS seconds FROM paths",
    "k_shortest": _WALKED + "SELECT origin, dest, path_text AS path, ROUND(seconds, 6) AS seconds, ROW_NUMBER() OVER (PARTITION BY origin, dest ORDER BY seconds, path_text) AS rank FROM paths QUALIFY rank <= 10",
    "richest_od": _WALKED + "SELECT origin, dest, COUNT(*) AS n_paths, MIN(len(path)) - 1 AS hops FROM paths GROUP BY ALL HAVING COUNT(*) BETWEEN 2 AND 500 ORDER BY n_paths DESC, origin, dest LIMIT 1",
    "path_counts": _WALKED + "SELECT origin, dest, LEAST(COUNT(*), 11) AS n_paths, MIN(len(path)) - 1 AS hops FROM paths GROUP BY ALL",
    "path_components": _PARTS + "SELECT origin, dest, path_text, ROUND(ivt_min, 6) AS ivt_min, ROUND(wait_min, 6) AS wait_min, ROUND(walk_min, 6) AS walk_min, n_transfers FROM parts",
    "path_size": a.with_(a.GRID, a.WALKS, a.LINKS, a.SIZES) + "SELECT origin, dest, path_text, ROUND(path_size, 6) AS path_size FROM sizes",
    "path_utility": _CHOSEN + "SELECT origin, dest, path_text, ROUND(utility, 6) AS utility FROM choices",
    "choice_probabilities": _CHOSEN + "SELECT origin, dest, path_text, ROUND(probability, 6) AS probability FROM choices",
    "generalized_time": _PARTS + "SELECT origin, dest, path_text, ROUND(ivt_min + 2 * wait_min + 2 * walk_min, 6) AS generalized_min FROM parts",
    "synthetic_trips": _SIMULATED + "SELECT CONCAT_WS('_', origin, dest, draw) AS trip_id, origin, dest, path_text AS chosen_path, n_stops, n_transfers, choice_set_size, total_trips AS od_total_trips FROM trips",
    "gumbel_choice": _CHOSEN + f""", shocked AS (SELECT origin, dest, obs_id, path_text, utility - LN(-LN({a.uniform("obs_id", "path_text", "42")})) AS total
  FROM choices, range(0, {OBSERVATIONS}) t(obs_id))
SELECT origin, dest, obs_id, ARG_MAX(path_text, total) AS chosen_path, COUNT(*) AS choice_set_size FROM shocked GROUP BY ALL""",
    "train_test_split": f"""WITH r AS (SELECT o_orderkey, o_custkey, COUNT(*) OVER (PARTITION BY o_custkey) AS n, ROW_NUMBER() OVER (PARTITION BY o_custkey ORDER BY {a.uniform("o_orderkey", "42")}, o_orderkey) AS at_ FROM orders)
SELECT o_orderkey, o_custkey, at_ <= CASE WHEN n >= 2 THEN GREATEST(1, round_even(n * 0.2::DOUBLE, 0)) ELSE 0 END AS is_test FROM r""",
    "null_ll": _SIMULATED + "SELECT ROUND(SUM(-LN(choice_set_size)), 4) AS null_log_likelihood FROM trips",
    "rho_squared": _SIMULATED + "SELECT ROUND(1 - SUM(LN(probability)) / SUM(-LN(choice_set_size)), 6) AS rho_squared FROM trips",
    "attribute_summary": _CHOSEN + " UNION ALL ".join(map(_Q, ATTRIBUTES)),
    "attribute_corr": _CHOSEN + " UNION ALL ".join(f"SELECT '{x}' AS a, '{y}' AS b, ROUND(CORR({x}, {y}), 6) AS r FROM choices" for x in ATTRIBUTES for y in ATTRIBUTES),
    "transfer_distribution": _CHOSEN + "SELECT n_transfers, COUNT(*) AS n FROM choices GROUP BY ALL",
    "order_times": """WITH RECURSIVE leg AS (SELECT l_partkey AS a, LEAD(l_partkey) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey) AS b, 60 + 10 * l_quantity AS d FROM lineitem),
link AS (SELECT a, b, AVG(d) AS c FROM leg WHERE b IS NOT NULL AND a <> b GROUP BY a, b),
busy AS (SELECT l_partkey AS p FROM lineitem GROUP BY l_partkey ORDER BY COUNT(*) DESC, l_partkey LIMIT 10),
met AS (SELECT 0 AS hops, p AS origin, p AS node, 0::DOUBLE AS s FROM busy
  UNION ALL SELECT hops + 1, origin, b, MIN(s + c) FROM met JOIN link ON node = a WHERE hops < 16 GROUP BY hops, origin, b)
SELECT CAST(origin AS VARCHAR) AS origin, CAST(node AS VARCHAR) AS dest, ROUND(MIN(s), 4) AS seconds FROM met GROUP BY origin, node""",
    "parameter_bias": """WITH line AS (SELECT 'line' || l_linenumber AS name, l_discount - 5e-2 AS x, l_returnflag FROM lineitem),
mean AS (SELECT name, AVG(x) AS t, AVG(x) FILTER (l_returnflag = 'R') AS f FROM line GROUP BY name)
SELECT name, ROUND(t, 8) AS "true", ROUND(f, 8) AS fitted, ROUND(f - t, 8) AS bias, CASE WHEN t <> 0 THEN ROUND(100 * (f - t) / t, 4) END AS pct_bias FROM mean WHERE f IS NOT NULL""",
}
ORACLE_SQL["gumbel_choice"] = ORACLE_SQL["gumbel_choice"].replace("\n, shocked", ",\nshocked")
