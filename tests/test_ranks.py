"""Exact quantiles and ranks against numpy, hot groups and ties included."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from routelab.functions.scalar import hashed_uniform
from routelab.operators import gtfs, metrics, ranks, simulate


@pytest.fixture(scope="module")
def values(spark):
    rng = np.random.default_rng(2)
    groups = {"hot": rng.normal(size=30_000), "ties": rng.integers(0, 4, 5000).astype(float), "one": np.array([3.0]), "two": np.array([1.0, 2.0]), "same": np.full(900, 7.0), None: rng.uniform(size=11)}
    rows = [(k, float(x)) for k, v in groups.items() for x in v] + [("empty", None), ("two", None)]
    return groups, spark.createDataFrame(rows, "k string, x double").repartition(5).cache()


@pytest.mark.parametrize("accuracy", [100, 10_000])
def test_quantiles_are_numpys(values, accuracy):
    groups, df = values
    probabilities = [0.0, 0.25, 0.5, 0.9, 1.0]
    got = {(r["k"], r["p"]): r["quantile"] for r in ranks.exact_quantiles(df, ["k"], "x", probabilities, accuracy).collect()}
    assert got == {(k, p): pytest.approx(np.quantile(v, p), abs=1e-12) for k, v in groups.items() for p in probabilities}


def test_only_the_bracket_is_ordered(values):
    """What the window orders is the rows near the wanted rank, not the group."""
    groups, df = values
    plan = ranks.exact_quantiles(df.filter("k = 'hot'"), ["k"], "x", [0.5])
    rows = df.filter("k = 'hot'").agg(F.percentile_approx("x", 0.5 - 3 / 10_000, 10_000).alias("low"), F.percentile_approx("x", 0.5 + 3 / 10_000, 10_000).alias("high")).first()
    assert ((groups["hot"] >= rows["low"]) & (groups["hot"] <= rows["high"])).sum() <= 30_000 * 8 / 10_000 + 2
    assert plan.first()["quantile"] == pytest.approx(np.median(groups["hot"]), abs=1e-12)


def test_nothing(spark):
    df = spark.createDataFrame([], "k string, x double")
    assert ranks.exact_quantiles(df, ["k"], "x", [0.5]).count() == 0
    assert ranks.ranked(df, ["k"], F.rand(1), "x").count() == 0


def test_medians_and_quartiles_are_the_same_on_either_way(spark, monkeypatch):
    rng = np.random.default_rng(4)
    rows = [(f"r{k % 3}", float(t)) for k, t in enumerate(np.cumsum(rng.integers(1, 300, 900)))] + [("r9", 5.0), ("r9", None)]
    df = spark.createDataFrame(rows, "route_id string, second double")
    plain = sorted(map(repr, gtfs.median_gap_minutes(df, ["route_id"], "second", 700).collect()))
    table = df.withColumn("other", -F.col("second") / 7)
    summary = sorted(map(repr, metrics.describe(table, ["second", "other"]).collect()))
    monkeypatch.setattr(gtfs, "MANY_GAPS", 10)
    monkeypatch.setattr(metrics, "MANY_VALUES", 10)
    assert sorted(map(repr, gtfs.median_gap_minutes(df, ["route_id"], "second", 700).collect())) == plain
    assert [r[:40] for r in sorted(map(repr, metrics.describe(table, ["second", "other"]).collect()))] == [r[:40] for r in summary]
    both = [{r["name"]: [r["q25"], r["q50"], r["q75"]] for r in metrics.describe(table, ["second", "other"]).collect()}]
    want = {c: np.nanquantile(np.array([r[1] for r in rows if r[1] is not None]) * f, [0.25, 0.5, 0.75]) for c, f in (("second", 1), ("other", -1 / 7))}
    assert all(both[0][c] == pytest.approx(want[c]) for c in want)


def test_ranks_of_a_hot_stratum(spark):
    rows = [("hot" if k % 10 else f"s{k % 70}", k) for k in range(20_000)] + [(None, 1), (None, 2)]
    df = spark.createDataFrame(rows, "s string, id bigint").repartition(4)
    u = hashed_uniform("id", F.lit(42))
    got = ranks.ranked(df, ["s"], u, "id", buckets=16).withColumn("u", u).collect()
    assert len(got) == len(rows)
    for s in {r["s"] for r in got}:
        own = sorted((r for r in got if r["s"] == s), key=lambda r: (r["u"], r["id"]))
        assert [r["rank"] for r in own] == list(range(1, len(own) + 1)) and {r["size"] for r in own} == {len(own)}


def test_a_split_of_one_stratum(spark):
    trips = spark.range(0, 5001).select(F.col("id").alias("obs_id"), F.lit("a").alias("origin"), F.lit("b").alias("dest"))
    split = simulate.train_test_split(trips, ["origin", "dest"], "obs_id")
    assert split.columns == ["obs_id", "origin", "dest", "is_test"] and split.filter("is_test").count() == 1000
    again = simulate.train_test_split(trips.repartition(7), ["origin", "dest"], "obs_id")
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, split.collect()))
