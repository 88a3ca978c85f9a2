"""Fit measures, parameter recovery, summaries of attributes and timings."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from routelab.operators.ranks import exact_quantiles
from routelab.staging import staged

#: Values of a column up to which a task orders them all.
MANY_VALUES = 1_000_000


def rho_squared(log_likelihood: float, null: float) -> float:
    return 1 - log_likelihood / null


def null_log_likelihood(trips: DataFrame, size: str = "choice_set_size") -> DataFrame:
    """One row: the log-likelihood of equal shares."""
    return trips.agg(F.sum(-F.ln(F.greatest(F.col(size), F.lit(1)).cast("double"))).alias("null_log_likelihood"))


def parameter_bias(fitted: DataFrame, true: DataFrame) -> DataFrame:
    """name, true, fitted, bias and pct_bias (of the signed true value, null where it is 0) of the fitted names; tables have name and value."""
    rows = fitted.select("name", F.col("value").alias("fitted")).join(true.select("name", F.col("value").alias("true")), "name")
    bias = F.col("fitted") - F.col("true")
    return rows.select("name", "true", "fitted", bias.alias("bias"), F.when(F.col("true") != 0, 100 * bias / F.col("true")).alias("pct_bias"))


def comparison(values: DataFrame) -> DataFrame:
    """metric by model, from rows (metric, model, value): columns eps, nrl and true."""
    return values.groupBy("metric").pivot("model", ["eps", "nrl", "true"]).agg(F.max("value"))


def describe(df: DataFrame, columns: list[str]) -> DataFrame:
    """name, n, mean, std, least, quartiles and greatest of each column; quartiles are exact and interpolated.

    Up to MANY_VALUES rows a task orders a column's values; beyond, the quartiles are narrowed down, with the same result.
    """
    spread = F.explode(F.array(*[F.struct(F.lit(c).alias("name"), F.col(c).cast("double").alias("x")) for c in columns])).alias("s")
    rows = df.select(spread).select("s.name", "s.x")
    q = lambda p: F.expr(f"percentile(x, {p})")
    plain = [F.count("x").alias("n"), F.avg("x").alias("mean"), F.stddev_samp("x").alias("std"), F.min("x").alias("min"), F.max("x").alias("max")]
    shown = ["name", "n", "mean", "std", "min", "q25", "q50", "q75", "max"]
    if df.limit(MANY_VALUES + 1).count() <= MANY_VALUES:
        return rows.groupBy("name").agg(*plain, q(0.25).alias("q25"), q(0.5).alias("q50"), q(0.75).alias("q75")).select(shown)
    rows = staged(rows, "values")
    at = lambda p: F.max(F.when(F.col("p") == p, F.col("quantile")))
    quartiles = exact_quantiles(rows, ["name"], "x", [0.25, 0.5, 0.75]).groupBy("name").agg(at(0.25).alias("q25"), at(0.5).alias("q50"), at(0.75).alias("q75"))
    return rows.groupBy("name").agg(*plain).join(quartiles, "name", "left").select(shown)


def correlations(df: DataFrame, columns: list[str]) -> DataFrame:
    """a, b and Pearson's r of every ordered pair of columns, in one pass; null beside a constant column."""
    pairs = [(a, b) for a in columns for b in columns]

    def pearson(a: Column, b: Column) -> Column:
        return F.covar_pop(a, b) / F.nullif(F.stddev_pop(a) * F.stddev_pop(b), F.lit(0.0))

    row = df.agg(*[pearson(F.col(a).cast("double"), F.col(b).cast("double")).alias(f"r{k}") for k, (a, b) in enumerate(pairs)])
    return row.select(F.explode(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"r{k}").alias("r")) for k, (a, b) in enumerate(pairs)])).alias("p")).select("p.*")


def value_counts(df: DataFrame, column: str) -> DataFrame:
    return df.groupBy(column).agg(F.count("*").alias("n")).orderBy(F.desc("n"), column)


def runtimes(spark: SparkSession, rows: list[tuple[str, str, float | None, float | None]]) -> DataFrame:
    """city, model, train_s, test_s and total_s of (city, model, train, test); nulls where a model was skipped."""
    full = [(city, model, train, test, None if train is None and test is None else (train or 0.0) + (test or 0.0)) for city, model, train, test in rows]
    return spark.createDataFrame(full, "city string, model string, train_s double, test_s double, total_s double")


class Timer:
    """Wall-clock seconds of named steps; steps that were skipped have none."""

    def __init__(self) -> None:
        self.seconds: dict[str, float | None] = {}

    def run(self, name: str, step: Callable, *args, **kwargs):
        began = time.time()
        out = step(*args, **kwargs)
        self.seconds[name] = time.time() - began
        return out

    def skip(self, name: str) -> None:
        self.seconds[name] = None

    def table(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(list(self.seconds.items()), "step string, seconds double")
