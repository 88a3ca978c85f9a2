"""Expanded Path Size logit: biased-walk sampling, exact path probabilities, corrections and estimation.

The sampled set of an observation weighs a path by n / (R q): n draws of R had probability q each. Draws that fail still count in R.
"""

from __future__ import annotations

import math
from dataclasses import asdict

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from routelab.config import TRUE_BETAS, Betas
from routelab.functions.scalar import hashed_uniform, kumaraswamy_weight
from routelab.operators.graph import shortest_paths
from routelab.operators.likelihood import ConditionalLogit, newton
from routelab.operators.metrics import Timer
from routelab.operators.optim import errors_of, minimise
from routelab.operators.paths import exploded_links, path_components, with_softmax
from routelab.staging import staged

FLOOR_Q = 1e-6
#: Nodes by destinations whose successors (a few ids and weights each) are broadcast to the walkers.
MAX_SUCCESSORS = 200_000
NAMES = ("ivt", "wait", "walk", "transfer", "pathsize")
DRAW_LEVELS = (10, 20, 40, 80)
SWEEP_SCHEMA = ", ".join(
    ["draws int, mean_choice_set_size double, mean_set_size double, n_obs bigint, log_likelihood double, test_log_likelihood double, seconds double, converged boolean"]
    + [f"{prefix}{n} double" for prefix in ("", "bias_", "z_") for n in NAMES]
)


def link_weights(edges: DataFrame, times: DataFrame, a: float = 2.0, b: float = 2.0) -> DataFrame:
    """dest, u, v and weight of leaving u by v towards dest, for every u that isn't dest and reaches it.

    The weight is Kumaraswamy's function of the shortest time from u over the time through v; a walk normalises it over the
    successors that it hasn't visited.
    """
    from_u = times.filter("seconds > 0").select(F.col("origin").alias("u"), "dest", F.col("seconds").alias("best"))
    from_v = times.select(F.col("origin").alias("v"), "dest", F.col("seconds").alias("rest"))
    rows = edges.select(F.col("from_stop").alias("u"), F.col("to_stop").alias("v"), "duration").join(from_u, "u").join(from_v, ["v", "dest"], "left")
    through = F.col("duration") + F.col("rest")
    x = F.when(through > 0, F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("best") / through))).otherwise(0.0)
    return rows.select("dest", "u", "v", kumaraswamy_weight(F.coalesce(x, F.lit(0.0)), a, b).alias("weight"))


def path_log_q(paths: DataFrame, weights: DataFrame, keys: list[str]) -> DataFrame:
    """keys, path_text and log_q of each path: the exact log probability that a walk takes it; null where none can."""
    own = paths.select(*keys, "path", F.array_join("path", "|").alias("path_text"), F.element_at("path", -1).alias("__end"))
    steps = own.select("*", F.posexplode(F.slice("path", 1, F.size("path") - 1)).alias("__at", "u")).withColumn("__took", F.get("path", F.col("__at") + 1))
    steps = steps.withColumn("__visited", F.slice("path", F.lit(1), F.col("__at") + 1))
    open_ = steps.join(weights.withColumnRenamed("dest", "__end"), ["__end", "u"], "left")
    open_ = open_.filter(F.col("v").isNull() | (F.col("v") == F.col("__end")) | ~F.array_contains("__visited", F.col("v")))
    each = open_.groupBy(*keys, "path_text", "__at").agg(F.sum("weight").alias("all"), F.sum(F.when(F.col("v") == F.col("__took"), F.col("weight"))).alias("one"))
    n_steps = F.count("*")
    total = each.groupBy(*keys, "path_text").agg(F.sum(F.ln(F.col("one") / F.col("all"))).alias("q"), F.count("one").alias("ok"), n_steps.alias("n"))
    return total.select(*keys, "path_text", F.when(F.col("ok") == F.col("n"), F.col("q")).alias("log_q"))


def weights_towards(edges: DataFrame, dests: DataFrame, a: float = 2.0, b: float = 2.0) -> DataFrame:
    """:func:`link_weights` towards the destinations (``dest``) alone: each is solved once, backwards; no table of all pairs."""
    back = edges.select(F.col("to_stop").alias("from_stop"), F.col("from_stop").alias("to_stop"), "duration")
    solved = shortest_paths(back, dests.select(F.col("dest").alias("origin")))
    times = solved.select(F.col("dest").alias("origin"), F.col("origin").alias("dest"), "seconds")
    return staged(link_weights(edges, staged(times, "times"), a, b), "weights")


def walks(observations: DataFrame, weights: DataFrame, draws: int = 20, max_steps: int = 25, seed: int = 42, rounds: int = 4) -> DataFrame:
    """``draws`` biased walks of each observation (obs_id, origin, dest): draw, path, log_q and whether the walk arrived.

    Walkers are rows, and all of them step together: a step joins each walker's node with the successors that lead towards its
    destination, leaves out what it has visited, and takes the first successor, in string order, whose cumulated weight reaches a uniform
    hashed from observation, draw, step and seed. Any task that repeats a step takes it again, and SQL can follow it. Tables are
    staged every ``rounds`` steps; walkers that arrived or have nowhere to go stay behind. A walk of ``max_steps`` tests arrival before
    each step: it has one link less at most.
    """
    successors = weights.groupBy("dest", "u").agg(F.array_sort(F.collect_list(F.struct("v", "weight"))).alias("ends"))
    successors = staged(successors, "successors")
    near = F.broadcast if successors.limit(MAX_SUCCESSORS + 1).count() <= MAX_SUCCESSORS else lambda df: df
    start = observations.select("obs_id", "origin", "dest", F.explode(F.sequence(F.lit(0), F.lit(draws - 1))).alias("draw"))
    live = start.select("*", F.array("origin").alias("path"), F.lit(0.0).alias("log_q"), F.lit(False).alias("stuck"))
    at_end, parts = F.element_at("path", -1) == F.col("dest"), []
    columns = ["obs_id", "origin", "dest", "draw", "path", "log_q", "stuck"]
    for first in range(0, max_steps - 1, rounds):
        for step in range(first, min(first + rounds, max_steps - 1)):
            live = _stepped(live, near(successors), step, seed)
        block = staged(live.select(columns), "walkers")
        parts.append(block.filter(at_end | F.col("stuck")))
        live = block.filter(~at_end & ~F.col("stuck"))
        if live.isEmpty():
            break
    else:
        parts.append(live if max_steps > 1 else live.select(columns))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out.select("obs_id", "origin", "dest", "draw", "path", "log_q", at_end.alias("arrived"))


def _stepped(live: DataFrame, successors: DataFrame, step: int, seed: int) -> DataFrame:
    """All walkers one step on; those that have arrived meet no successors and stay as they are."""
    onward = live.withColumn("u", F.element_at("path", -1)).join(successors, ["dest", "u"], "left")
    open_ = F.filter("ends", lambda s: (s["v"] == F.col("dest")) | ~F.array_contains("path", s["v"]))
    known = onward.withColumn("ends", F.when((F.col("u") != F.col("dest")) & ~F.col("stuck"), F.coalesce(open_, F.array().cast("array<struct<v:string,weight:double>>"))))
    known = known.withColumns({"all": F.aggregate("ends", F.lit(0.0), lambda total, s: total + s["weight"]), "goal": hashed_uniform("obs_id", "draw", F.lit(step), F.lit(seed))})
    zero = F.struct(F.lit(0.0).alias("upto"), F.lit(None).cast("string").alias("v"), F.lit(None).cast("double").alias("weight"))

    def scan(acc, s):
        upto = acc["upto"] + s["weight"]
        hit = upto >= F.col("goal") * F.col("all")
        return F.when(acc["v"].isNotNull(), acc).otherwise(F.struct(upto.alias("upto"), F.when(hit, s["v"]).alias("v"), F.when(hit, s["weight"]).alias("weight")))

    taken = known.withColumn("taken", F.aggregate("ends", zero, scan))
    moved = F.col("taken.v").isNotNull()
    return taken.select(
        "obs_id", "origin", "dest", "draw",
        F.when(moved, F.concat("path", F.array("taken.v"))).otherwise(F.col("path")).alias("path"),
        F.when(moved, F.col("log_q") + F.ln(F.col("taken.weight") / F.col("all"))).otherwise(F.col("log_q")).alias("log_q"),
        (F.col("stuck") | (F.size("ends") == 0)).alias("stuck"),
    )


def sets_of(walked: DataFrame, draws: int | None = None) -> DataFrame:
    """obs_id, origin, dest, path, n_sampled and log_q of the paths that arrived, of the first ``draws`` walks (unset: all)."""
    some = walked.filter("arrived") if draws is None else walked.filter(F.col("arrived") & (F.col("draw") < draws))
    return some.groupBy("obs_id", "origin", "dest", "path").agg(F.count("*").alias("n_sampled"), F.first("log_q").alias("log_q"))


def sampled_sets(observations: DataFrame, edges: DataFrame, draws: int = 20, max_steps: int = 25, seed: int = 42, a: float = 2.0, b: float = 2.0) -> DataFrame:
    """obs_id, origin, dest, path, n_sampled and log_q of the paths that ``draws`` biased walks of each observation (obs_id, origin, dest) take."""
    weights = weights_towards(edges, observations.select("dest"), a, b)
    return sets_of(walks(observations, weights, draws, max_steps, seed))


def hashed_sets(observations: DataFrame, paths: DataFrame, draws: int = 20, seed: int = 42) -> DataFrame:
    """obs_id, origin, dest, path, n_sampled and log_q of ``draws`` hashed draws among enumerated paths (origin, dest, path, log_q).

    A draw takes the first path, in string order, whose cumulated probability reaches its uniform; beyond the last it is a walk that
    fails, which counts in R only. Each pair's bounds are one array, which joins its observations once; draws search it.
    """
    order = Window.partitionBy("origin", "dest").orderBy("path_text")
    upto = paths.filter("log_q is not null").withColumn("path_text", F.array_join("path", "|")).withColumn("high", F.sum(F.exp("log_q")).over(order))
    bands = upto.groupBy("origin", "dest").agg(F.array_sort(F.collect_list(F.struct("path_text", "high", "path", "log_q"))).alias("bands"))
    number = F.lit(seed)
    # Uniforms are hashed once a draw, before the search, not once a band.
    uniforms = F.transform(F.sequence(F.lit(0), F.lit(draws - 1)), lambda draw: hashed_uniform("obs_id", draw, number))
    take = lambda u: F.get(F.filter("bands", lambda b: b["high"] >= u), F.lit(0))
    drawn = observations.select("obs_id", "origin", "dest").join(bands, ["origin", "dest"])
    hit = drawn.select("obs_id", "origin", "dest", F.explode(F.transform(uniforms, take)).alias("hit")).filter("hit is not null")
    return hit.groupBy("obs_id", "origin", "dest", "hit.path", "hit.log_q").agg(F.count("*").alias("n_sampled")).select("obs_id", "origin", "dest", "path", "n_sampled", "log_q")


def with_observed(sampled: DataFrame, observed: DataFrame, weights: DataFrame) -> DataFrame:
    """Sampled sets with each observation's own path (obs_id, origin, dest, path) put in once where it wasn't drawn.

    A path put in has n_sampled 1 and its exact log q, or ln FLOOR_Q where no walk can take it; drawn ones keep their count.
    """
    key = ["obs_id", "path_text"]
    named = lambda df: df.withColumn("path_text", F.array_join("path", "|"))
    missing = named(observed.select("obs_id", "origin", "dest", "path")).join(named(sampled).select(*key), key, "left_anti")
    exact = path_log_q(missing.drop("path_text"), weights, ["obs_id"])
    forced = missing.join(exact, key, "left").select("obs_id", "origin", "dest", "path", F.lit(1).cast("bigint").alias("n_sampled"), F.coalesce("log_q", F.ln(F.lit(FLOOR_Q))).alias("log_q"))
    return sampled.select("obs_id", "origin", "dest", "path", "n_sampled", "log_q").unionByName(forced)


def expanded_sizes(sets: DataFrame, edges: DataFrame, draws: int, keys: list[str]) -> DataFrame:
    """keys, path_text, expanded_path_size and sampling_correction of each path (n_sampled, log_q) of its set.

    A link's share of the length is divided by the summed weights n / (R q) of the set's paths that use it; links are told apart by
    their ends alone.
    """
    phi = F.col("n_sampled") / (F.lit(float(draws)) * F.exp("log_q"))
    correction = F.ln(F.greatest(F.col("n_sampled"), F.lit(1)) / (F.lit(float(draws)) * F.exp("log_q")))
    rows = exploded_links(sets.select(*keys, "path", F.array_join("path", "|").alias("path_text"), phi.alias("phi"), correction.alias("sampling_correction")), edges)
    sharing = F.sum("phi").over(Window.partitionBy(*keys, "u", "v"))
    length = F.sum("duration").over(Window.partitionBy(*keys, "path_text"))
    part = F.when(sharing > 0, F.col("duration") / F.when(length == 0, 1e-6).otherwise(length) / sharing).otherwise(0.0)
    parts = rows.select(*keys, "path_text", "sampling_correction", part.alias("part"))
    return parts.groupBy(*keys, "path_text").agg(F.sum("part").alias("expanded_path_size"), F.first("sampling_correction").alias("sampling_correction"))


def estimation_table(sets: DataFrame, observed: DataFrame, edges: DataFrame, headways: DataFrame, draws: int) -> DataFrame:
    """A row an alternative: obs_id, path_text, chosen, components, expanded_path_size and sampling_correction."""
    keys = ["obs_id"]
    parts = path_components(sets, edges, headways, keys).join(expanded_sizes(sets, edges, draws, keys), ["obs_id", "path_text"])
    chosen = observed.select("obs_id", F.array_join("path", "|").alias("observed"))
    return parts.join(chosen, "obs_id").select("obs_id", "path_text", (F.col("path_text") == F.col("observed")).alias("chosen"), "ivt_min", "wait_min", "walk_min", "n_transfers", "expanded_path_size", "sampling_correction")


def corrected_utility(betas: Betas):
    cost = F.lit(betas.ivt) * F.col("ivt_min") + F.lit(betas.wait) * F.col("wait_min") + F.lit(betas.walk) * F.col("walk_min") + F.lit(betas.transfer) * F.col("n_transfers")
    return F.lit(betas.pathsize) * F.ln(F.greatest(F.col("expanded_path_size"), F.lit(1e-9))) + F.col("sampling_correction") - cost


def with_probabilities(table: DataFrame, betas: Betas) -> DataFrame:
    return with_softmax(table.withColumn("utility", corrected_utility(betas)), "utility", ["obs_id"])


def with_alternatives(table: DataFrame, least: int = 2) -> DataFrame:
    """Observations of at least so many alternatives: for fits only."""
    return table.withColumn("__n", F.count("*").over(Window.partitionBy("obs_id"))).filter(F.col("__n") >= least).drop("__n")


def log_likelihood(table: DataFrame, betas: Betas) -> DataFrame:
    """One row: log_likelihood and the observations that have their chosen row; null over none."""
    chosen = with_probabilities(table, betas).filter("chosen")
    return chosen.agg(F.sum(F.ln(F.greatest(F.col("probability"), F.lit(1e-12)))).alias("log_likelihood"), F.count("*").alias("n_obs"))


COLUMNS = ("ivt_min", "wait_min", "walk_min", "n_transfers", "expanded_path_size")


def logit(table: DataFrame) -> ConditionalLogit:
    """The likelihood of an estimation table, evaluated where its rows are."""
    return ConditionalLogit(table, "obs_id", COLUMNS, "sampling_correction", [-1, -1, -1, -1, 1], logs=["expanded_path_size"])


def fit(table: DataFrame, start: Betas = TRUE_BETAS, least_alternatives: int = 2, bound: float = 5.0, method: str = "newton", errors: bool = False) -> dict:
    """Maximum likelihood over observations with a real choice; ``errors`` adds standard errors, which hold for the sampled sets.

    Raises where no observation has ``least_alternatives``: there is nothing to fit. Methods are newton (a job an iteration), bfgs
    with the same gradient and nelder-mead (a job an evaluation).
    """
    likelihood = logit(with_alternatives(table, least_alternatives))
    if not likelihood.n_obs:
        raise ValueError(f"no observation has {least_alternatives} alternatives")
    x, bounds = [getattr(start, n) for n in NAMES], [(-bound, bound)] * len(NAMES)
    one = lambda beta: likelihood.at([beta])[0]
    found = newton(likelihood, x, bounds) if method == "newton" else minimise(lambda beta: one(beta).value, x, bounds, method, lambda beta: one(beta).gradient)
    out = {"betas": dict(zip(NAMES, map(float, found.x))), "log_likelihood": -found.value, "n_obs": likelihood.n_obs, "converged": found.converged}
    return out | (errors_of(one(found.x).hessian, found.x, NAMES) if errors else {})


def estimation_data(trips: DataFrame, edges: DataFrame, headways: DataFrame, draws: int = 20, seed: int = 42) -> DataFrame:
    """Estimation table of trips (obs_id, origin, dest, path): sampling, forced observed paths and corrections."""
    weights = weights_towards(edges, trips.select("dest"))
    return _estimation(trips, walks(trips, weights, draws, seed=seed), weights, edges, headways, draws)


def _estimation(trips: DataFrame, walked: DataFrame, weights: DataFrame, edges: DataFrame, headways: DataFrame, draws: int) -> DataFrame:
    sets = staged(with_observed(sets_of(walked, draws), trips, weights), "sets")
    return estimation_table(sets, trips, edges, headways, draws)


def draw_sweep(train: DataFrame, test: DataFrame, edges: DataFrame, headways: DataFrame, levels: tuple[int, ...] = DRAW_LEVELS, timer: Timer | None = None) -> DataFrame:
    """A fit of ``train`` for each number of draws: set sizes, observations retained, log-likelihoods, seconds, estimates, biases and z.

    Trips have obs_id, origin, dest, path and choice_set_size; ids don't meet between ``train`` and ``test``. Walks are drawn once, as many
    as the greatest level asks for; a smaller level has the first of them, so levels differ by their number alone. Seconds are those of
    a level's sets and fit. The held-out log-likelihood is null over no trips, z where the curvature gives none.
    """
    timer, true, rows = timer or Timer(), asdict(TRUE_BETAS), []
    universal = train.agg(F.avg("choice_set_size")).first()[0]
    both = train.select("obs_id", "origin", "dest").unionByName(test.select("obs_id", "origin", "dest"))
    weights = weights_towards(edges, both.select("dest"))
    walked = staged(walks(both, weights, max(levels)), "walks")
    of = lambda trips: walked.join(trips.select("obs_id"), "obs_id", "left_semi")
    for draws in levels:
        step = f"eps draws {draws}"

        def sample_and_fit(draws: int = draws) -> tuple[DataFrame, dict]:
            table = staged(_estimation(train, of(train), weights, edges, headways, draws), "estimation")
            return table, fit(table, errors=True)

        table, own = timer.run(step, sample_and_fit)
        held = log_likelihood(_estimation(test, of(test), weights, edges, headways, draws), Betas(**own["betas"])).first()["log_likelihood"]
        size = table.groupBy("obs_id").count().agg(F.avg("count")).first()[0]
        biases = [own["betas"][n] - true[n] for n in NAMES]
        z = [own["z"][n] if math.isfinite(own["z"][n]) else None for n in NAMES]
        rows.append((draws, universal, size, own["n_obs"], float(own["log_likelihood"]), held, timer.seconds[step], own["converged"], *(own["betas"][n] for n in NAMES), *biases, *z))
    return edges.sparkSession.createDataFrame(rows, SWEEP_SCHEMA)


def hit_rate(table: DataFrame, betas: Betas) -> DataFrame:
    """One row: the share of observations whose most probable alternative is the observed path; of paths as good to nine
    places the first in string order."""
    best = with_probabilities(table, betas).groupBy("obs_id").agg(F.min_by("chosen", F.struct(-F.round("utility", 9), F.col("path_text"))).alias("hit"))
    return best.agg(F.avg(F.col("hit").cast("double")).alias("hit_rate"))
