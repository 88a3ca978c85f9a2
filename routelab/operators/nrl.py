"""Nested recursive logit over the line graph: links, transitions, values, path probabilities and estimation."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from routelab.functions.scalar import TRANSFER, nest_scale
from routelab.operators.likelihood import Local, newton
from routelab.operators.optim import Minimum, errors_of, minimise
from routelab.shipping import ship
from routelab.staging import Scratch, staged

START = "START"
MAX_TRANSITIONS = 20_000_000
UNSETTLED = -1e12
NAMES = ("ivt", "wait", "walk", "transfer", "scale_transfer")


@dataclass(frozen=True)
class Parameters:
    """Disutilities, stored positive, and the logits of the nests' scales (None: the scale is 1)."""

    ivt: float = 0.025
    wait: float = 0.05
    walk: float = 0.035
    transfer: float = 0.4
    scale_transfer: float = 0.0
    scale_regular: float | None = None


def line_graph(edges: DataFrame, headways: DataFrame, default: float = 10.0) -> DataFrame:
    """Transitions (u, v) -> (v, w) and (START, u) -> (u, w): kinds of the links and the minutes that the next one costs.

    A transit link is boarded after the start, after a walk and where the route changes. Every boarding but that of the start counts
    as a transfer, also the first one after a walk.
    """
    e = edges.select(F.col("from_stop").alias("v"), F.col("to_stop").alias("w"), F.col("route_id").alias("next_route"), F.col("link_type").alias("next_type"), F.col("duration").alias("seconds"))
    prior = edges.select(F.col("from_stop").alias("u"), F.col("to_stop").alias("v"), F.col("route_id").alias("prev_route"), F.col("link_type").alias("prev_type"))
    nodes = edges.select("from_stop").union(edges.select("to_stop")).distinct().select(F.lit(START).alias("u"), F.col("from_stop").alias("v"), F.lit(None).cast("string").alias("prev_route"), F.lit("start").alias("prev_type"))
    rows = prior.unionByName(nodes).join(e, "v").join(headways.select(F.col("route_id").alias("next_route"), "headway_min"), "next_route", "left")
    walks = F.col("next_type") == TRANSFER
    boards = ~walks & (F.col("prev_type").isin("start", TRANSFER) | (F.col("prev_route") != F.col("next_route")))
    return rows.select(
        "u", "v", "w", "prev_type", "next_type",
        F.when(walks, 0.0).otherwise(F.col("seconds") / 60.0).alias("ivt_min"),
        F.when(boards, F.coalesce("headway_min", F.lit(default)) / 2.0).otherwise(0.0).alias("wait_min"),
        F.when(walks, F.col("seconds") / 60.0).otherwise(0.0).alias("walk_min"),
        F.when(boards & (F.col("prev_type") != "start"), 1).otherwise(0).cast("bigint").alias("transfers"),
    )


def link_utility(p: Parameters) -> Column:
    return -(F.lit(p.ivt) * F.col("ivt_min") + F.lit(p.wait) * F.col("wait_min") + F.lit(p.walk) * F.col("walk_min") + F.lit(p.transfer) * F.col("transfers"))


def link_scale(p: Parameters) -> Column:
    regular = F.lit(1.0) if p.scale_regular is None else nest_scale(p.scale_regular)
    return F.when(F.col("prev_type") == "start", 1.0).when(F.col("prev_type") == TRANSFER, nest_scale(p.scale_transfer)).otherwise(regular)


def transitions(lines: DataFrame, p: Parameters) -> DataFrame:
    return lines.select("u", "v", "w", link_utility(p).alias("utility"), link_scale(p).alias("mu"))


class LineGraph:
    """The transitions as arrays: a row each, its two links, its attributes and its earlier link's kind."""

    def __init__(self, lines: pd.DataFrame, edges: list[tuple[str, str]]):
        links = sorted({*edges, *((u, v) for u, v in zip(lines["u"], lines["v"]))})
        self.links, self.index = links, {link: k for k, link in enumerate(links)}
        self.heads = np.array([v for _, v in links], object)
        order = np.argsort([self.index[u, v] for u, v in zip(lines["u"], lines["v"])], kind="stable")
        lines = lines.iloc[order]
        self.k = np.array([self.index[u, v] for u, v in zip(lines["u"], lines["v"])], np.int64)
        self.a = np.array([self.index[v, w] for v, w in zip(lines["v"], lines["w"])], np.int64)
        self.x = lines[["ivt_min", "wait_min", "walk_min", "transfers"]].to_numpy(float)
        self.kind = lines["prev_type"].to_numpy(object)
        self.live, self.starts = np.unique(self.k, return_index=True)
        self.moves = {(k, a): n for n, (k, a) in enumerate(zip(self.k.tolist(), self.a.tolist()))}

    def set(self, p: Parameters) -> tuple[np.ndarray, np.ndarray]:
        """Utility of each transition and the scale of its earlier link."""
        scale = lambda s: min(1.0, max(1e-4, 1 / (1 + np.exp(-s))))
        regular = 1.0 if p.scale_regular is None else scale(p.scale_regular)
        mu = np.where(self.kind == "start", 1.0, np.where(self.kind == TRANSFER, scale(p.scale_transfer), regular))
        return -(self.x @ np.array([p.ivt, p.wait, p.walk, p.transfer])), mu

    def values(self, dests: list[str], u: np.ndarray, mu: np.ndarray, max_iter: int = 300, tol: float = 1e-3) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """A row of values of all links for each destination, by synchronous iteration until its own row settles; whether it did, and the iterations."""
        end = self.heads[None, :] == np.array(dests, object)[:, None]
        out = np.where(end, 0.0, -10.0)
        settled, used = np.zeros(len(dests), bool), np.full(len(dests), max_iter)
        group, m = np.searchsorted(self.live, self.k), mu[self.starts] if len(self.starts) else mu
        open_ = np.arange(len(dests))
        for at in range(max_iter):
            v, ends = out[open_], end[open_]
            new = np.where(ends, 0.0, -1e6)
            if len(self.live):
                t = (u + v[:, self.a]) / mu
                top = np.maximum.reduceat(t, self.starts, axis=1)
                s = m * (top + np.log(np.add.reduceat(np.exp(t - top[:, group]), self.starts, axis=1)))
                new[:, self.live] = np.where(ends[:, self.live], 0.0, s)
            moved = np.abs(new - v).max(axis=1, initial=0.0, where=~ends)
            out[open_] = new
            done = moved < tol
            settled[open_[done]], used[open_[done]] = True, at + 1
            open_ = open_[~done]
            if not len(open_):
                break
        return out, settled, used

    def slopes(self, p: Parameters, n_free: int) -> tuple[np.ndarray, np.ndarray]:
        """Of each transition, by parameter: the derivatives of its utility and of its earlier link's scale."""
        du, dmu = np.zeros((n_free, len(self.k))), np.zeros((n_free, len(self.k)))
        du[:4] = -self.x.T
        slope = lambda s: (q := 1 / (1 + np.exp(-s))) * (1 - q) if 1e-4 < 1 / (1 + np.exp(-s)) < 1 else 0.0
        dmu[4] = np.where(self.kind == TRANSFER, slope(p.scale_transfer), 0.0)
        if n_free > 5:
            dmu[5] = np.where((self.kind != TRANSFER) & (self.kind != "start"), slope(p.scale_regular), 0.0)
        return du, dmu

    def tangents(self, dests: list[str], values: np.ndarray, u: np.ndarray, mu: np.ndarray, du: np.ndarray, dmu: np.ndarray, tol: float, max_iter: int = 3000) -> np.ndarray:
        """Derivatives of settled values: by parameter, destination and link.

        A link's are its successors' mean by choice probability plus what its own utilities and scale add: as the values, a fixed point.
        """
        end = self.heads[None, :] == np.array(dests, object)[:, None]
        out = np.zeros((len(du), *values.shape))
        if not len(self.live):
            return out
        group = np.searchsorted(self.live, self.k)
        t = (u + values[:, self.a]) / mu
        top = np.maximum.reduceat(t, self.starts, axis=1)
        e = np.exp(t - top[:, group])
        total = np.add.reduceat(e, self.starts, axis=1)
        p, level = e / total[:, group], top + np.log(total)
        entropy = level - np.add.reduceat(p * t, self.starts, axis=1)
        own = np.add.reduceat(p * du[:, None, :], self.starts, axis=2) + dmu[:, self.starts][:, None, :] * entropy
        for _ in range(max_iter):
            new = np.where(end[:, self.live], 0.0, own + np.add.reduceat(p * out[:, :, self.a], self.starts, axis=2))
            moved = np.abs(new - out[:, :, self.live]).max(initial=0.0)
            out[:, :, self.live] = new
            if moved < tol:
                break
        return out

    def taken(self, moves) -> tuple[np.ndarray, np.ndarray]:
        """Transitions of (u, v, w, n) rows, and how often each is taken."""
        try:
            at = [self.moves[self.index[m["u"], m["v"]], self.index[m["v"], m["w"]]] for m in moves]
        except KeyError as lost:
            raise ValueError(f"a path has a link that the network lacks: {lost}") from lost
        return np.array(at, np.int64), np.array([m["n"] for m in moves], float)

    def chunks(self, dests: list[str], cells: int = 4_000_000) -> list[list[str]]:
        """Destinations that are solved together: as many as keep a table of them by transitions below ``cells``."""
        n = max(1, cells // max(1, len(self.k)))
        return [dests[at : at + n] for at in range(0, len(dests), n)]


def _arrays(lines: DataFrame, edges: DataFrame) -> LineGraph:
    """The network's line graph: a row a pair of neighbouring links, which the network's size bounds, as checked here."""
    n = lines.count()
    if n > MAX_TRANSITIONS:
        raise ValueError(f"{n} transitions are more than the {MAX_TRANSITIONS} that a worker holds")
    return LineGraph(lines.toPandas(), [tuple(r) for r in edges.select("from_stop", "to_stop").distinct().collect()])


def value_table(lines: DataFrame, edges: DataFrame, dests: DataFrame, p: Parameters, max_iter: int = 300, tol: float = 1e-3) -> DataFrame:
    """dest, u, v, value, converged and iterations: each destination solved once, on the executor that has it.

    Up to MAX_TRANSITIONS transitions a worker holds the line graph; beyond, :func:`partitioned_values` gives the same.
    """
    spark = lines.sparkSession
    if lines.limit(MAX_TRANSITIONS + 1).count() > MAX_TRANSITIONS:
        return partitioned_values(lines, edges, dests, p, max_iter, tol)
    ship(spark)
    shared = spark.sparkContext.broadcast(_arrays(lines, edges))

    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        graph = shared.value
        utility, mu = graph.set(p)
        links = pd.DataFrame(graph.links, columns=["u", "v"])
        for batch in batches:
            for some in graph.chunks(batch["dest"].tolist()):
                for dest, v, ok, n in zip(some, *graph.values(some, utility, mu, max_iter, tol)):
                    yield links.assign(dest=dest, value=v, converged=ok, iterations=n)[["dest", "u", "v", "value", "converged", "iterations"]]

    return dests.select("dest").distinct().mapInPandas(run, "dest string, u string, v string, value double, converged boolean, iterations bigint")


def partitioned_values(lines: DataFrame, edges: DataFrame, dests: DataFrame, p: Parameters, max_iter: int = 300, tol: float = 1e-3) -> DataFrame:
    """:func:`value_table` for line graphs of any size: value iteration as joins over partitioned links.

    A state has a row for each asked destination and link. In a round every link tells its value to the links before it, and a link puts
    together what its successors say by a log-sum-exp of its own scale; nothing is collected but the number of open destinations. Only
    destinations whose values still move by ``tol`` or more go on to the next round; each round is staged.
    """
    with Scratch(lines.sparkSession) as scratch:
        moves = scratch(transitions(lines, p), "moves")
        ends = edges.select(F.col("from_stop").alias("u"), F.col("to_stop").alias("v")).union(lines.select("u", "v")).distinct()
        arrived = F.col("v") == F.col("dest")
        # A value for each asked destination and link is what is asked for: links are dealt to shares, each of which meets all destinations.
        shares = int(lines.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        asked = dests.select("dest").distinct().withColumn("share", F.explode(F.sequence(F.lit(0), F.lit(shares - 1))))
        dealt = ends.withColumn("share", F.pmod(F.xxhash64("u", "v"), F.lit(shares)).cast("int"))
        state = dealt.join(asked, "share").select("dest", "u", "v", F.when(arrived, 0.0).otherwise(-10.0).alias("value"))
        state, done = scratch(state, "values"), []
        shape = lambda df, ok, n: df.select("dest", "u", "v", "value", F.lit(ok).alias("converged"), F.lit(n).cast("bigint").alias("iterations"))
        for at in range(max_iter):
            told = state.select("dest", F.col("u").alias("v"), F.col("v").alias("w"), F.col("value").alias("next"))
            terms = moves.join(told, ["v", "w"]).groupBy("dest", "u", "v").agg(F.first("mu").alias("mu"), F.collect_list((F.col("utility") + F.col("next")) / F.col("mu")).alias("t"))
            top = F.array_max("t")
            summed = F.col("mu") * (top + F.ln(F.aggregate("t", F.lit(0.0), lambda total, t: total + F.exp(t - F.array_max("t")))))
            new = state.withColumnRenamed("value", "old").join(terms, ["dest", "u", "v"], "left")
            new = new.select("dest", "u", "v", "old", F.when(arrived, 0.0).otherwise(F.coalesce(summed, F.lit(-1e6))).alias("value"))
            new = scratch(new, "values")
            moved = scratch(new.groupBy("dest").agg(F.max(F.when(~arrived, F.abs(F.col("value") - F.col("old"))).otherwise(0.0)).alias("moved")), "moved")
            settled = moved.filter(F.col("moved") < tol).select("dest")
            done.append(shape(new.join(settled, "dest", "left_semi"), True, at + 1))
            state = new.drop("old").join(moved.filter(F.col("moved") >= tol).select("dest"), "dest", "left_semi")
            if moved.filter(F.col("moved") >= tol).isEmpty():
                break
        else:
            done.append(shape(state, False, max_iter))
        out = done[0]
        for part in done[1:]:
            out = out.unionByName(part)
        return staged(out, "values")


def path_log_probability(paths: DataFrame, moves: DataFrame, values: DataFrame, keys: list[str]) -> DataFrame:
    """keys, path_text and log_p: the sum of (utility + next value - value) / scale along each path's transitions."""
    own = paths.select(*keys, F.array_join("path", "|").alias("path_text"), F.element_at("path", -1).alias("__end"), F.concat(F.array(F.lit(START)), "path").alias("stops"))
    steps = own.select("*", F.explode(F.sequence(F.lit(0), F.size("stops") - 3)).alias("at")).select(*keys, "path_text", "__end", *[F.get("stops", F.col("at") + k).alias(c) for k, c in enumerate("uvw")])
    here = values.select(F.col("dest").alias("__end"), "u", "v", F.col("value").alias("now"))
    there = values.select(F.col("dest").alias("__end"), F.col("u").alias("v"), F.col("v").alias("w"), F.col("value").alias("next"))
    joined = steps.join(moves, ["u", "v", "w"]).join(here, ["__end", "u", "v"]).join(there, ["__end", "v", "w"])
    return joined.groupBy(*keys, "path_text").agg(F.sum((F.col("utility") + F.col("next") - F.col("now")) / F.col("mu")).alias("log_p"))


class Likelihood:
    """Log-likelihood and gradient of distinct paths (path, n: how often), one Spark job for any number of parameter sets.

    Paths are reduced once to how often each transition is taken towards each destination, a staged row a destination, whose size the
    network bounds. An evaluation is a map over those rows: a task solves its destinations' values and their derivatives for each
    parameter set and adds up; the driver gets one row of numbers a set. A path with a link that the network lacks raises.
    """

    def __init__(self, lines: DataFrame, edges: DataFrame, counted: DataFrame, variant: str = "current", tol: float = 1e-7):
        spark = lines.sparkSession
        ship(spark)
        self.variant, self.tol, self.jobs = variant, tol, 0
        self.shared = spark.sparkContext.broadcast(_arrays(lines, edges))
        self.n = counted.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
        stops = F.concat(F.array(F.lit(START)), "path")
        steps = counted.select("n", F.element_at("path", -1).alias("dest"), stops.alias("s")).filter(F.size("s") > 2)
        steps = steps.select("n", "dest", "s", F.explode(F.sequence(F.lit(0), F.size("s") - 3)).alias("at"))
        taken = steps.groupBy("dest", *[F.get("s", F.col("at") + k).alias(c) for k, c in enumerate("uvw")]).agg(F.sum("n").alias("n"))
        self.rows = staged(taken.groupBy("dest").agg(F.collect_list(F.struct("u", "v", "w", "n")).alias("moves")), "moves")

    def at(self, points: list[np.ndarray]) -> list[tuple[float, np.ndarray]]:
        """(log-likelihood, gradient) at each of the points."""
        shared, variant, tol, points = self.shared, self.variant, self.tol, [np.asarray(x, float) for x in points]
        width = 1 + len(points[0])
        names = [f"s{k}" for k in range(width)]

        def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            graph, total = shared.value, np.zeros((len(points), width))
            for batch in batches:
                by_dest = {dest: graph.taken(moves) for dest, moves in zip(batch["dest"], batch["moves"])}
                for k, x in enumerate(points):
                    total[k] += summed_log_probability(graph, by_dest, parameters_of(x, variant), width - 1, tol)
            yield pd.DataFrame({"point": range(len(points))} | dict(zip(names, total.T)))

        self.jobs += 1
        parts = self.rows.mapInPandas(run, "point int, " + ", ".join(f"{s} double" for s in names))
        found = {r["point"]: np.array(r[1:]) for r in parts.groupBy("point").agg(*[F.sum(s).alias(s) for s in names]).collect()}
        rows = [found.get(k, np.zeros(width)) for k in range(len(points))]
        return [(UNSETTLED, np.zeros(width - 1)) if r[0] <= UNSETTLED else (float(r[0]), r[1:]) for r in rows]

    def __call__(self, x: np.ndarray) -> float:
        return self.at([x])[0][0]


def summed_log_probability(graph: LineGraph, by_dest: dict[str, tuple[np.ndarray, np.ndarray]], p: Parameters, n_free: int, tol: float = 1e-7) -> np.ndarray:
    """Value and gradient summed over all transitions taken; UNSETTLED where a destination has no values, as costs are too small for
    the sum over all walks to settle."""
    utility, mu = graph.set(p)
    du, dmu = graph.slopes(p, n_free)
    out = np.zeros(1 + n_free)
    for some in graph.chunks(list(by_dest), 4_000_000 // (1 + n_free)):
        values, settled, _ = graph.values(some, utility, mu, tol=tol)
        if not settled.all():
            return np.array([UNSETTLED] + [0.0] * n_free)
        slopes = graph.tangents(some, values, utility, mu, du, dmu, tol)
        for row, dest in enumerate(some):
            moves, n = by_dest[dest]
            v, m = values[row], mu[moves]
            gain = utility[moves] + v[graph.a[moves]] - v[graph.k[moves]]
            out[0] += n @ (gain / m)
            dgain = du[:, moves] + slopes[:, row][:, graph.a[moves]] - slopes[:, row][:, graph.k[moves]]
            out[1:] += (dgain / m - gain * dmu[:, moves] / m**2) @ n
    return out


def parameters_of(x: np.ndarray, variant: str = "current") -> Parameters:
    """Five free parameters; variant ``v0`` frees the regular nest's scale as a sixth."""
    return Parameters(*map(float, x[:5]), float(x[5]) if variant == "v0" else None)


def fit(trips: DataFrame, edges: DataFrame, headways: DataFrame, start: list[float] | None = None, variant: str = "current", method: str = "newton", errors: bool = False, warm_rows: int = 50) -> dict:
    """Maximum likelihood of trips (path): first on a sample of max(``warm_rows``, a quarter), then, from there, on all.

    A step of newton is two jobs: the curvature, then some steps along it, tried together. Standard errors are of the Hessian that differences of the gradient give,
    all of them in one job.
    """
    names = NAMES if variant == "current" else (*NAMES, "scale_regular")
    bounds = [(1e-5, 5.0)] * 4 + [(-5.0, 5.0)] if variant == "current" else [(-5.0, 5.0)] * 6
    x = np.array(start if start is not None else [1.0, 1.0, 1.0, 1.0, 0.5, 0.5][: len(names)], float)
    lines = staged(line_graph(edges, headways), "lines")
    counted = staged(trips.groupBy("path").agg(F.count("*").alias("n")), "counted")
    n = counted.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    if not n:
        raise ValueError("no trips to fit")
    if n > warm_rows:
        # Trips of one path are alike: numbering them makes the hashed order the same however the rows lie.
        each = counted.select("path", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("n"))).alias("k"))
        order = F.md5(F.concat_ws(":", F.array_join("path", "|"), F.col("k").cast("string")).cast("binary"))
        warm = Likelihood(lines, edges, each.orderBy(order, "path", "k").limit(max(warm_rows, n // 4)).groupBy("path").agg(F.count("*").alias("n")), variant)
        x = _least(warm, x, bounds, method).x
    full = Likelihood(lines, edges, counted, variant)
    found = _least(full, x, bounds, method)
    out = {"betas": dict(zip(names, map(float, found.x))), "log_likelihood": -found.value, "n_obs": full.n, "converged": found.converged}
    return out | (errors_of(_Negative(full).curvature(found.x), found.x, names) if errors else {})


class _Negative:
    """A likelihood as something to minimise."""

    def __init__(self, likelihood: Likelihood):
        self.likelihood, self.last = likelihood, (b"", None)

    def at(self, points: list[np.ndarray]) -> list[Local]:
        return [Local(-value, -slope) for value, slope in self.likelihood.at(points)]

    def one(self, x: np.ndarray) -> Local:
        if self.last[0] != x.tobytes():
            self.last = x.tobytes(), self.at([x])[0]
        return self.last[1]

    def curvature(self, x: np.ndarray, step: float = 1e-4) -> np.ndarray:
        """The Hessian by central differences of the gradient: 2 n points, one job."""
        h = step * np.maximum(np.abs(x), 1.0)
        slopes = [local.gradient for local in self.at([x + sign * h[k] * np.eye(len(x))[k] for k in range(len(x)) for sign in (1, -1)])]
        rows = np.array([(slopes[2 * k] - slopes[2 * k + 1]) / (2 * h[k]) for k in range(len(x))])
        return (rows + rows.T) / 2


def _least(likelihood: Likelihood, x: np.ndarray, bounds: list[tuple[float, float]], method: str) -> Minimum:
    f = _Negative(likelihood)
    return newton(f, x, bounds) if method == "newton" else minimise(lambda b: f.one(b).value, x, bounds, method, lambda b: f.one(b).gradient)


def held_out_log_likelihood(trips: DataFrame, edges: DataFrame, headways: DataFrame, betas: dict[str, float]) -> float | None:
    """Of trips (path) under fitted parameters; null over none."""
    own = Likelihood(line_graph(edges, headways), edges, staged(trips.groupBy("path").agg(F.count("*").alias("n")), "counted"), "current" if len(betas) == len(NAMES) else "v0")
    return own(np.array(list(betas.values()))) if own.n else None
