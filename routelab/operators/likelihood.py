"""Likelihood, gradient and curvature of a conditional logit in one Spark job, for many parameter points at once.

Alternatives are packed once, a row an observation, and staged; they never leave the executors. An evaluation is a map over those rows,
without a shuffle of them: every task adds up, for each point asked for, the negative log-likelihood, its gradient and its Hessian over
its own observations, and one aggregate adds up the tasks' rows. What reaches the driver is one row of 1 + n + n (n + 1) / 2 numbers a
point, however many observations there are. A row's size is bounded by its set of alternatives: as many as were drawn, and the chosen one.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass
from typing import Protocol

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from routelab.operators.optim import Minimum
from routelab.shipping import ship
from routelab.staging import staged

#: A chosen alternative's probability counts as so much at least.
LEAST_P = 1e-12


@dataclass
class Local:
    """Value, gradient and, where it comes with them, Hessian of the negative log-likelihood at a point."""

    value: float
    gradient: np.ndarray
    hessian: np.ndarray | None = None


class Evaluator(Protocol):
    """What :func:`newton` goes by: many points at once, and the Hessian at one."""

    def at(self, points: Sequence[np.ndarray]) -> list[Local]: ...

    def curvature(self, x: np.ndarray) -> np.ndarray: ...


def packed(table: DataFrame, key: str, columns: Sequence[str], offset: str, chosen: str = "chosen") -> DataFrame:
    """A row an observation: a list for each attribute, one of offsets, and the place of the chosen alternative (null: none)."""
    fields = [F.col(c).cast("double").alias(c) for c in (*columns, offset)]
    rows = table.groupBy(key).agg(F.collect_list(F.struct(F.col(chosen).alias("__chosen"), *fields)).alias("alternatives"))
    place = F.array_position("alternatives.__chosen", True)
    lists = [F.col(f"alternatives.{c}").alias(f"x{k}") for k, c in enumerate((*columns, offset))]
    return rows.select(F.when(place > 0, (place - 1).cast("int")).alias("taken"), *lists)


def summed(x: np.ndarray, offset: np.ndarray, starts: np.ndarray, taken: np.ndarray, points: Sequence[np.ndarray]) -> np.ndarray:
    """A row a point: value, gradient and upper half of the Hessian, added up over the observations that begin at ``starts``.

    ``taken`` has the chosen row of each. Where its probability is below LEAST_P the observation's value is constant.
    """
    n = x.shape[1]
    upper = np.triu_indices(n)
    group = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, len(x))))
    out = np.zeros((len(points), 1 + n + len(upper[0])))
    for at, beta in enumerate(points):
        u = x @ beta + offset
        e = np.exp(u - np.maximum.reduceat(u, starts)[group])
        p = e / np.add.reduceat(e, starts)[group]
        own = p[taken]
        live = own >= LEAST_P
        weight = p * live[group]
        mean = np.add.reduceat(weight[:, None] * x, starts)
        out[at, 0] = -np.log(np.maximum(own, LEAST_P)).sum()
        out[at, 1 : 1 + n] = mean.sum(0) - x[taken[live]].sum(0)
        out[at, 1 + n :] = ((weight[:, None] * x).T @ x - mean.T @ mean)[upper]
    return out


class ConditionalLogit:
    """The staged observations of a table of alternatives; ``signs`` multiply the attributes, ``logs`` names those taken by logarithm."""

    def __init__(self, table: DataFrame, key: str, columns: Sequence[str], offset: str, signs: Sequence[float], logs: Sequence[str] = (), least: float = 1e-9):
        self.names, self.signs = list(columns), np.array(signs, float)
        taken = [F.ln(F.greatest(F.col(c), F.lit(least))).alias(c) if c in logs else F.col(c) for c in columns]
        ship(table.sparkSession)
        self.rows = staged(packed(table.select(key, "chosen", offset, *taken), key, columns, offset).filter("taken is not null"), "observations")
        self.n_obs, self.jobs = self.rows.count(), 0

    def at(self, points: Sequence[np.ndarray]) -> list[Local]:
        """The likelihood at each of the points: one job."""
        n, signs, points = len(self.names), self.signs, [np.asarray(p, float) for p in points]
        width = 1 + n + n * (n + 1) // 2
        names = [f"s{k}" for k in range(width)]

        def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros((len(points), width))
            for batch in batches:
                if batch.num_rows:
                    flat = [batch.column(1 + k).flatten().to_numpy(zero_copy_only=False) for k in range(n + 1)]
                    sizes = pc.list_value_length(batch.column(1)).to_numpy(zero_copy_only=False).astype(np.int64)
                    starts = np.cumsum(sizes) - sizes
                    total += summed(np.column_stack(flat[:n]) * signs, flat[n], starts, starts + batch.column(0).to_numpy(zero_copy_only=False), points)
            yield pa.RecordBatch.from_arrays([pa.array(range(len(points)), pa.int32()), *(pa.array(c) for c in total.T)], names=["point", *names])

        self.jobs += 1
        parts = self.rows.mapInArrow(run, "point int, " + ", ".join(f"{s} double" for s in names))
        found = {r["point"]: np.array(r[1:]) for r in parts.groupBy("point").agg(*[F.sum(s).alias(s) for s in names]).collect()}
        upper, out = np.triu_indices(n), []
        for k in range(len(points)):
            row = found.get(k, np.zeros(width))
            h = np.zeros((n, n))
            h[upper] = row[1 + n :]
            out.append(Local(float(row[0]), row[1 : 1 + n], h + np.triu(h, 1).T))
        return out

    def curvature(self, x: np.ndarray) -> np.ndarray:
        return self.at([x])[0].hessian


def newton(f: Evaluator, start: Sequence[float], bounds: Sequence[tuple[float, float]], max_iter: int = 60, tol: float = 1e-8) -> Minimum:
    """Newton's method within a box: each iteration tries the whole step and shorter ones together, in one job.

    Coordinates at a bound that the gradient pushes outwards rest. Directions without curvature take no step; where the curvature is
    negative its size counts, so that every step goes down.
    """
    low, high = (np.array(b, float) for b in zip(*bounds))
    x = np.clip(np.array(start, float), low, high)
    here = f.at([x])[0]
    for at in range(max_iter):
        g = here.gradient
        free = ~(((x <= low) & (g > 0)) | ((x >= high) & (g < 0)))
        if np.abs(np.where(free, g, 0)).max(initial=0.0) <= tol * max(1.0, abs(here.value)):
            return Minimum(x, here.value, True, at)
        step = np.zeros(len(x))
        size, axes = np.linalg.eigh((f.curvature(x) if here.hessian is None else here.hessian)[np.ix_(free, free)])
        size = np.abs(size)
        along = np.where(size > 1e-12 * size.max(initial=0.0), -(axes.T @ g[free]) / np.where(size > 0, size, 1.0), 0.0)
        step[free] = axes @ along
        if step @ g >= 0:
            step = np.where(free, -g / max(1.0, np.abs(g).max()), 0)
        trials = [np.clip(x + t * step, low, high) for t in (1.0, 0.5, 0.25, 0.05, 0.005)]
        found = f.at(trials)
        best = min(range(len(trials)), key=lambda k: found[k].value)
        if not found[best].value < here.value:
            # nothing is lower: where the step's promise is within rounding this is the minimum
            return Minimum(x, here.value, bool(-(step @ g) <= 1e-9 * max(1.0, abs(here.value))), at)
        x, here = trials[best], found[best]
    return Minimum(x, here.value, False, max_iter)
