"""Queries on the two choice models over the grid network."""

from __future__ import annotations

from dataclasses import asdict

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from routelab.config import TRUE_BETAS, Betas
from routelab.functions.scalar import path_nodes
from routelab.operators import eps, graph, metrics, nrl, simulate
from routelab.plans import adapters as a
from routelab.staging import staged

PAIR = ["origin", "dest"]
DRAWS = 20
HIT_DRAWS = 30
#: Of each pair.
OBSERVATIONS = 2
ITERATIONS = 25
TRUE = nrl.Parameters()


def _times(edges: DataFrame) -> DataFrame:
    return staged(graph.all_pairs(edges).select("origin", "dest", "seconds"), "times")


def link_probs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Probability of each link of a walk that has visited nothing."""
    edges = a.grid_edges(spark, sf_dir)
    w = eps.link_weights(edges, _times(edges))
    return w.select("dest", "u", "v", F.round(F.col("weight") / F.sum("weight").over(Window.partitionBy("dest", "u")), 6).alias("probability"))


def _log_q(edges: DataFrame) -> DataFrame:
    paths = a.grid_paths(edges)
    found = eps.path_log_q(paths, eps.link_weights(edges, _times(edges)), PAIR)
    return paths.withColumn("path_text", F.array_join("path", "|")).join(found, [*PAIR, "path_text"])


def path_log_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _log_q(a.grid_edges(spark, sf_dir)).select(*PAIR, "path_text", F.round("log_q", 6).alias("log_q"))


def observed_trips(edges: DataFrame, n: int = OBSERVATIONS) -> DataFrame:
    """``n`` Gumbel choices among all paths of every pair: obs_id, origin, dest, path and choice_set_size."""
    chosen = simulate.universal_trips(a.grid_choices(edges, a.grid_paths(edges)), n)
    number = (F.col("origin").cast("bigint") * 1000 + F.col("dest").cast("bigint")) * n + F.col("obs_id")
    return chosen.select(number.alias("obs_id"), *PAIR, path_nodes("chosen_path").alias("path"), "choice_set_size")


def _estimation(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = a.grid_edges(spark, sf_dir)
    trips = staged(observed_trips(edges), "trips")
    sets = eps.with_observed(eps.hashed_sets(trips, _log_q(edges), DRAWS), trips, eps.link_weights(edges, _times(edges)))
    return eps.estimation_table(staged(sets, "sets"), trips, edges, a.grid_headways(edges), DRAWS)


def expanded_path_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _estimation(spark, sf_dir)
    return rows.select("obs_id", "path_text", "chosen", F.round("expanded_path_size", 6).alias("expanded_path_size"), F.round("sampling_correction", 6).alias("sampling_correction"))


def eps_nll(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Negative log-likelihood of the true parameters over observations with a real choice."""
    rows = eps.log_likelihood(eps.with_alternatives(_estimation(spark, sf_dir)), TRUE_BETAS)
    return rows.select(F.round(-F.col("log_likelihood"), 4).alias("nll"), "n_obs")


def line_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = a.grid_edges(spark, sf_dir)
    moves = nrl.transitions(nrl.line_graph(edges, a.grid_headways(edges)), TRUE)
    return moves.select("u", "v", "w", F.round("utility", 6).alias("utility"), "mu")


def _values(edges: DataFrame, **how) -> DataFrame:
    lines = nrl.line_graph(edges, a.grid_headways(edges))
    return nrl.value_table(lines, edges, edges.select(F.col("to_stop").alias("dest")), TRUE, **how)


def nrl_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    values = _values(a.grid_edges(spark, sf_dir), max_iter=ITERATIONS, tol=-1.0)
    return values.select("dest", "u", "v", F.round("value", 5).alias("value"))


def _log_p(edges: DataFrame, paths: DataFrame, keys: list[str]) -> DataFrame:
    moves = nrl.transitions(nrl.line_graph(edges, a.grid_headways(edges)), TRUE)
    return nrl.path_log_probability(paths, moves, staged(_values(edges, max_iter=ITERATIONS, tol=-1.0), "values"), keys)


def nrl_path_logprob(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = a.grid_edges(spark, sf_dir)
    return _log_p(edges, a.grid_paths(edges), PAIR).select(*PAIR, "path_text", F.round("log_p", 5).alias("log_p"))


def nrl_ll(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = a.grid_edges(spark, sf_dir)
    rows = _log_p(edges, staged(observed_trips(edges), "trips"), ["obs_id"])
    return rows.agg(F.round(F.sum("log_p"), 4).alias("log_likelihood"), F.count("*").alias("n_obs"))


def model_comparison(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both models' likelihoods of the observed trips at the true parameters, beside these."""
    parts = {"eps": eps_nll(spark, sf_dir).select((-F.col("nll")).alias("log_likelihood"), "n_obs"), "nrl": nrl_ll(spark, sf_dir)}
    rows = spark.createDataFrame([(k, "true", float(v)) for k, v in asdict(TRUE_BETAS).items()], "metric string, model string, value double")
    for model, fit in parts.items():
        long = F.explode(F.array(*[F.struct(F.lit(c).alias("metric"), F.col(c).cast("double").alias("value")) for c in ("log_likelihood", "n_obs")])).alias("m")
        rows = rows.unionByName(fit.select(long).select("m.metric", F.lit(model).alias("model"), "m.value"))
    return metrics.comparison(rows)


# --- checked by tests: random numbers, optimisers and clocks have no SQL form ----------------------------------------------------


def biased_walk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The paths that the walks of every observed trip took, how often, and their probability."""
    edges = a.grid_edges(spark, sf_dir)
    sets = eps.sampled_sets(staged(observed_trips(edges), "trips"), edges, DRAWS)
    return sets.select("obs_id", *PAIR, F.array_join("path", "|").alias("path_text"), "n_sampled", F.round("log_q", 6).alias("log_q"))


def _fit_rows(spark: SparkSession, fit: dict) -> DataFrame:
    rows = [(name, float(value), *(fit.get(k, {}).get(name) for k in ("se", "z", "pval"))) for name, value in fit["betas"].items()]
    rows += [("log_likelihood", float(fit["log_likelihood"]), None, None, None), ("n_obs", float(fit["n_obs"]), None, None, None)]
    return spark.createDataFrame(rows, "name string, value double, se double, z double, pval double")


def eps_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _fit_rows(spark, eps.fit(_estimation(spark, sf_dir), Betas(0.0, 0.0, 0.0, 0.0, 0.5)))


def nrl_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = a.grid_edges(spark, sf_dir)
    return _fit_rows(spark, nrl.fit(observed_trips(edges), edges, a.grid_headways(edges)))


def standard_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _fit_rows(spark, eps.fit(_estimation(spark, sf_dir), errors=True))


def hit_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hits in sets of their own, in which the observed path is only where it is drawn."""
    return eps.hit_rate(_hit_table(a.grid_edges(spark, sf_dir)), TRUE_BETAS)


def _hit_table(edges: DataFrame) -> DataFrame:
    trips = staged(observed_trips(edges), "trips")
    sets = eps.hashed_sets(trips, _log_q(edges), HIT_DRAWS)
    return eps.estimation_table(staged(sets, "sets"), trips, edges, a.grid_headways(edges), HIT_DRAWS)


def draw_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A fit for each of 10, 20, 40 and 80 draws, held-out trips included."""
    edges = a.grid_edges(spark, sf_dir)
    trips = staged(simulate.train_test_split(observed_trips(edges), PAIR, "obs_id"), "trips")
    return eps.draw_sweep(trips.filter("not is_test"), trips.filter("is_test"), edges, a.grid_headways(edges))


def runtime_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Seconds of a fit and its held-out likelihood; the model that was skipped has none."""
    timer, edges = metrics.Timer(), a.grid_edges(spark, sf_dir)
    table = staged(_estimation(spark, sf_dir), "estimation")
    own = timer.run("train", lambda: eps.fit(table))
    timer.run("test", lambda: eps.log_likelihood(table, Betas(**own["betas"])).first())
    return metrics.runtimes(spark, [(f"{edges.count()} edges", "eps", timer.seconds["train"], timer.seconds["test"]), (f"{edges.count()} edges", "nrl", None, None)])


QUERIES = {
    "link_probs": link_probs, "path_log_q": path_log_q, "expanded_path_size": expanded_path_size, "eps_nll": eps_nll, "line_graph": line_graph,
    "nrl_values": nrl_values, "nrl_path_logprob": nrl_path_logprob, "nrl_ll": nrl_ll, "model_comparison": model_comparison, "biased_walk": biased_walk, "eps_fit": eps_fit, "nrl_fit": nrl_fit,
    "standard_errors": standard_errors, "hit_rate": hit_rate, "draw_sweep": draw_sweep, "runtime_summary": runtime_summary,
}

WEIGHTS = """ratio AS (SELECT b.dest, e.from_stop AS u, e.to_stop AS v, CASE WHEN e.duration + r.seconds > 0 THEN GREATEST(0, LEAST(1, b.seconds / (e.duration + r.seconds))) ELSE 0 END AS x
  FROM edges e JOIN times b ON b.origin = e.from_stop AND b.seconds > 0 LEFT JOIN times r ON r.origin = e.to_stop AND r.dest = b.dest),
weights AS (SELECT dest, u, v, GREATEST(1e-12::DOUBLE, 1 - POW(1 - POW(COALESCE(x, 0), 2), 2)) AS weight FROM ratio)"""
LOG_Q = """steps AS (SELECT origin, dest, path_text, path, UNNEST(range(1, len(path))) AS step FROM paths),
open_ AS (SELECT s.origin, s.dest, path_text, step, weight, w.v = s.path[step + 1] AS took FROM steps s JOIN weights w ON w.dest = s.dest AND w.u = s.path[step]
  WHERE w.v = s.dest OR NOT list_contains(s.path[1:step], w.v)),
probs AS (SELECT origin, dest, path_text, step, SUM(weight) FILTER (took) / SUM(weight) AS p FROM open_ GROUP BY origin, dest, path_text, step),
logq AS (SELECT origin, dest, path_text, SUM(LN(p)) AS log_q FROM probs GROUP BY origin, dest, path_text)"""
OBSERVED = f"""shocked AS (SELECT origin, dest, n, path_text, utility - LN(-LN({a.uniform("n", "path_text", "42")})) AS total FROM choices, range(0, {OBSERVATIONS}) t(n)),
observed AS (SELECT (CAST(origin AS BIGINT) * 1000 + CAST(dest AS BIGINT)) * {OBSERVATIONS} + n AS obs_id, origin, dest, ARG_MAX(path_text, total) AS path_text FROM shocked GROUP BY origin, dest, n)"""


def sets_sql(draws: int, forced: bool) -> str:
    """Sampled sets of the observed trips, the observed path put in where ``forced``, up to the estimation table."""
    put_in = """
  UNION ALL SELECT obs_id, o.path_text, log_q, 1 FROM observed o JOIN logq ON logq.path_text = o.path_text
  WHERE NOT EXISTS (SELECT 1 FROM sampled s WHERE s.obs_id = o.obs_id AND s.path_text = o.path_text)""" if forced else ""
    return f"""bands AS (SELECT origin, dest, path_text, log_q, SUM(EXP(log_q)) OVER (PARTITION BY origin, dest ORDER BY path_text) AS high FROM logq),
low AS (SELECT *, COALESCE(LAG(high) OVER (PARTITION BY origin, dest ORDER BY path_text), -1) AS low FROM bands),
drawn AS (SELECT obs_id, origin, dest, {a.uniform("obs_id", "draw", "42")} AS u FROM observed, range(0, {draws}) d(draw)),
sampled AS (SELECT obs_id, path_text, log_q, COUNT(*) AS n FROM drawn JOIN low USING (origin, dest) WHERE u > low AND u <= high GROUP BY ALL),
sets AS (SELECT * FROM sampled{put_in}),
phied AS (SELECT *, n / ({draws}::DOUBLE * EXP(log_q)) AS phi, LN(n / ({draws}::DOUBLE * EXP(log_q))) AS sampling_correction FROM sets),
used AS (SELECT p.obs_id, p.path_text, sampling_correction, duration / SUM(duration) OVER (PARTITION BY p.obs_id, p.path_text) / SUM(phi) OVER (PARTITION BY p.obs_id, u, v) AS part
  FROM phied p JOIN links ON links.path_text = p.path_text),
expanded AS (SELECT obs_id, path_text, SUM(part) AS expanded_path_size, ANY_VALUE(sampling_correction) AS sampling_correction FROM used GROUP BY ALL),
estimation AS (SELECT e.*, e.path_text = o.path_text AS chosen, ivt_min, wait_min, walk_min, n_transfers FROM expanded e JOIN observed o USING (obs_id)
  JOIN parts ON parts.path_text = e.path_text)"""


WALKERS = f"""succ AS (SELECT dest, u, list({{'v': v, 'w': weight}} ORDER BY v) AS s FROM weights GROUP BY dest, u),
walker AS (SELECT obs_id, origin, dest, draw, [origin] AS path, 0::DOUBLE AS log_q, 0 AS k FROM observed, range(0, {DRAWS}) d(draw)
  UNION ALL SELECT obs_id, origin, dest, draw, list_append(path, ends[pick].v), log_q + LN(ends[pick].w / total), k + 1 FROM (
    SELECT *, list_filter(range(1, len(ends) + 1), lambda i: list_sum(list_transform(ends[1:i], lambda x: x.w)) >= goal * total)[1] AS pick FROM (
      SELECT *, list_sum(list_transform(ends, lambda x: x.w)) AS total, {a.uniform("obs_id", "draw", "k", "42")} AS goal FROM (
        SELECT walker.*, list_filter(s, lambda x: x.v = walker.dest OR NOT list_contains(path, x.v)) AS ends
        FROM walker JOIN succ ON succ.dest = walker.dest AND succ.u = path[-1] WHERE path[-1] <> walker.dest AND k < 24))
    WHERE len(ends) > 0))"""

MOVES = """prior AS (SELECT from_stop AS u, to_stop AS v, route_id, link_type FROM edges UNION ALL SELECT DISTINCT 'START', from_stop, NULL, 'start' FROM edges),
moves AS (SELECT p.u, p.v, e.to_stop AS w, CASE WHEN e.link_type = 'transfer' THEN -0.035::DOUBLE * e.duration / 60
    WHEN p.link_type IN ('start', 'transfer') OR p.route_id <> e.route_id THEN -0.025::DOUBLE * e.duration / 60 - 0.05::DOUBLE * headway_min / 2 - CASE WHEN p.link_type = 'start' THEN 0 ELSE 0.4::DOUBLE END
    ELSE -0.025::DOUBLE * e.duration / 60 END AS utility, CASE WHEN p.link_type = 'transfer' THEN 0.5::DOUBLE ELSE 1::DOUBLE END AS mu
  FROM prior p JOIN edges e ON e.from_stop = p.v LEFT JOIN headway ON headway.route_id = e.route_id)"""
VALUES = f"""val AS (SELECT 0 AS n, d.dest, p.u, p.v, CASE WHEN p.v = d.dest THEN 0::DOUBLE ELSE -10::DOUBLE END AS value FROM prior p, (SELECT DISTINCT to_stop AS dest FROM edges) d
  UNION ALL SELECT c.n + 1, c.dest, c.u, c.v, CASE WHEN c.v = c.dest THEN 0::DOUBLE ELSE ANY_VALUE(m.mu) * LN(SUM(EXP((m.utility + x.value) / m.mu))) END
  FROM val c JOIN moves m ON m.u = c.u AND m.v = c.v JOIN val x ON x.dest = c.dest AND x.u = m.v AND x.v = m.w WHERE c.n < {ITERATIONS} GROUP BY c.n, c.dest, c.u, c.v),
final AS (SELECT dest, u, v, value FROM val WHERE n = {ITERATIONS})"""
LOG_P = """hops AS (SELECT origin, dest, path_text, ['START'] || path AS stops, UNNEST(range(1, len(path))) AS step FROM paths),
logp AS (SELECT h.origin, h.dest, path_text, SUM((m.utility + b.value - f.value) / m.mu) AS log_p FROM hops h
  JOIN moves m ON m.u = stops[step] AND m.v = stops[step + 1] AND m.w = stops[step + 2]
  JOIN final f ON f.dest = h.dest AND f.u = m.u AND f.v = m.v JOIN final b ON b.dest = h.dest AND b.u = m.v AND b.v = m.w GROUP BY h.origin, h.dest, path_text)"""

_Q = a.with_(a.GRID, a.WALKS, a.TIMES, WEIGHTS, LOG_Q)
_SETS, _DRAWN = (a.with_(a.GRID, a.WALKS, a.TIMES, WEIGHTS, LOG_Q, a.LINKS, a.COMPONENTS, a.SIZES, a.CHOICES, OBSERVED, sets_sql(n, forced)) for n, forced in ((DRAWS, True), (HIT_DRAWS, False)))
_VALUED = """, valued_ AS (SELECT obs_id, path_text, chosen, COUNT(*) OVER (PARTITION BY obs_id) AS n, LN(GREATEST(expanded_path_size, 1e-9)) + sampling_correction
  - (0.025::DOUBLE * ivt_min + 0.05::DOUBLE * wait_min + 0.035::DOUBLE * walk_min + 0.4::DOUBLE * n_transfers) AS v FROM estimation)"""
_P = a.with_(a.GRID, a.WALKS, MOVES, VALUES, LOG_P)

ORACLE_SQL = {
    "link_probs": a.with_(a.GRID, a.WALKS, a.TIMES, WEIGHTS) + "SELECT dest, u, v, ROUND(weight / SUM(weight) OVER (PARTITION BY dest, u), 6) AS probability FROM weights",
    "path_log_q": _Q + "SELECT origin, dest, path_text, ROUND(log_q, 6) AS log_q FROM logq",
    "expanded_path_size": _SETS + "SELECT obs_id, path_text, chosen, ROUND(expanded_path_size, 6) AS expanded_path_size, ROUND(sampling_correction, 6) AS sampling_correction FROM estimation",
    "eps_nll": _SETS + _VALUED + """, p AS (SELECT obs_id, chosen, n, EXP(v) / SUM(EXP(v)) OVER (PARTITION BY obs_id) AS p FROM valued_)
SELECT ROUND(-SUM(LN(GREATEST(p, 1e-12))), 4) AS nll, COUNT(*) AS n_obs FROM p WHERE chosen AND n >= 2""",
    "hit_rate": _DRAWN + _VALUED + """, best AS (SELECT obs_id, chosen FROM valued_ QUALIFY ROW_NUMBER() OVER (PARTITION BY obs_id ORDER BY ROUND(v, 9) DESC, path_text) = 1)
SELECT AVG(CAST(chosen AS INT)) AS hit_rate FROM best""",
    "biased_walk": a.with_(a.GRID, a.WALKS, a.TIMES, WEIGHTS, a.LINKS, a.COMPONENTS, a.SIZES, a.CHOICES, OBSERVED, WALKERS)
    + """SELECT obs_id, origin, dest, array_to_string(path, '|') AS path_text, COUNT(*) AS n_sampled, ROUND(ANY_VALUE(log_q), 6) AS log_q
FROM walker WHERE path[-1] = dest GROUP BY obs_id, origin, dest, path""",
    "line_graph": a.with_(a.GRID, MOVES) + "SELECT u, v, w, ROUND(utility, 6) AS utility, mu FROM moves",
    "nrl_values": a.with_(a.GRID, MOVES, VALUES) + "SELECT dest, u, v, ROUND(value, 5) AS value FROM final",
    "nrl_path_logprob": _P + "SELECT origin, dest, path_text, ROUND(log_p, 5) AS log_p FROM logp",
    "nrl_ll": a.with_(a.GRID, a.WALKS, MOVES, VALUES, LOG_P, a.LINKS, a.COMPONENTS, a.SIZES, a.CHOICES, OBSERVED)
    + "SELECT ROUND(SUM(log_p), 4) AS log_likelihood, COUNT(*) AS n_obs FROM observed JOIN logp ON logp.path_text = observed.path_text",
}
for _name in ("eps_nll", "hit_rate"):
    ORACLE_SQL[_name] = ORACLE_SQL[_name].replace("\n, valued_ AS", ",\nvalued_ AS")
_TRUE = ", ".join(f"('{k}', NULL, NULL, {v}::DOUBLE)" for k, v in asdict(TRUE_BETAS).items())
ORACLE_SQL["model_comparison"] = f"""SELECT 'log_likelihood' AS metric, -nll AS eps, log_likelihood AS nrl, NULL AS "true" FROM ({ORACLE_SQL["eps_nll"]}) e, ({ORACLE_SQL["nrl_ll"]}) n
UNION ALL SELECT 'n_obs', CAST(e.n_obs AS DOUBLE), CAST(n.n_obs AS DOUBLE), NULL FROM ({ORACLE_SQL["eps_nll"]}) e, ({ORACLE_SQL["nrl_ll"]}) n
UNION ALL SELECT * FROM (VALUES {_TRUE}) t(metric, eps, nrl, "true")"""
