"""Simulated trips, universal choice experiments and the train-test split, all driven by hashed uniforms."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from routelab.functions.scalar import gumbel, hashed_uniform, trips_to_draw
from routelab.operators.ranks import ranked

PAIR = ["origin", "dest"]


def synthetic_trips(choices: DataFrame, od: DataFrame, scale: float, least: int = 2, seed: int = 42) -> DataFrame:
    """Draw trips_to_draw paths for each pair of ``od`` (origin, dest, total_trips) from its choice table.

    Pairs without paths (unreachable, unknown, within a station) draw nothing. A draw takes the first path, by rank of length, whose
    cumulated probability reaches a uniform hashed from the pair, the draw's number and the seed.
    """
    shown = ["path_text", "path", "ivt_min", "wait_min", "walk_min", "n_transfers", "path_size", "utility"]
    order = Window.partitionBy(*PAIR).orderBy("seconds", "path_text")
    ranked = choices.select("*", F.sum("probability").over(order).alias("upto"), F.row_number().over(order).alias("rank"))
    sets = ranked.groupBy(*PAIR).agg(F.array_sort(F.collect_list(F.struct("rank", "upto", *shown))).alias("set"))
    draws = od.filter("origin <> dest").withColumn("n", trips_to_draw(F.col("total_trips"), scale, least)).select(*PAIR, "total_trips", F.explode(F.expr("sequence(0, cast(n as int) - 1)")).alias("draw"))
    # A pair's set is one row: draws search its bounds instead of meeting all of its paths.
    drawn = draws.withColumn("u", hashed_uniform(*PAIR, "draw", F.lit(seed))).join(sets, PAIR)
    first = F.get(F.filter("set", lambda c: c["upto"] >= F.col("u")), F.lit(0))
    taken = F.coalesce(first, F.element_at("set", -1)).alias("taken")
    chosen = drawn.select(*PAIR, "total_trips", "draw", F.size("set").cast("bigint").alias("choice_set_size"), taken).select("*", *[F.col(f"taken.{c}") for c in shown])
    return chosen.select(
        F.concat_ws("_", *PAIR, F.col("draw").cast("string")).alias("trip_id"), *PAIR, F.col("path_text").alias("chosen_path"), F.size("path").cast("bigint").alias("n_stops"),
        F.round("ivt_min", 2).alias("ivt_min"), F.round("wait_min", 2).alias("wait_min"), F.round("walk_min", 2).alias("walk_min"), "n_transfers",
        F.round("path_size", 4).alias("path_size"), F.round("utility", 4).alias("systematic_utility"), "choice_set_size", F.col("total_trips").alias("od_total_trips"),
    )


def universal_trips(choices: DataFrame, observations: int, seed: int = 42) -> DataFrame:
    """For each observation the path of greatest utility plus a hashed Gumbel shock, among all paths of each pair."""
    numbered = choices.select(*PAIR, "path_text", "utility", F.explode(F.sequence(F.lit(0), F.lit(observations - 1))).alias("obs_id"))
    shocked = numbered.withColumn("total", F.col("utility") + gumbel(hashed_uniform("obs_id", "path_text", F.lit(seed))))
    best = shocked.groupBy(*PAIR, "obs_id").agg(F.max_by(F.struct("path_text", "utility", "total"), F.struct("total", "path_text")).alias("b"), F.count("*").alias("choice_set_size"))
    return best.select(*PAIR, F.col("obs_id").cast("bigint").alias("obs_id"), F.col("b.path_text").alias("chosen_path"), F.col("b.utility").alias("systematic_utility"), "choice_set_size")


def train_test_split(trips: DataFrame, strata: list[str], key: str, fraction: float = 0.2, seed: int = 42) -> DataFrame:
    """``trips`` with ``is_test``: of a stratum of n >= 2 rows max(1, round-half-even(n f)), by hashed order of ``key``; of one row none.

    A stratum may hold all rows: no task orders more than a part of it.
    """
    known = ranked(trips, strata, hashed_uniform(key, F.lit(seed)), key, rank="__at", size="__n")
    tested = F.when(F.col("__n") >= 2, F.greatest(F.lit(1), F.rint(F.col("__n") * F.lit(fraction)).cast("int"))).otherwise(0)
    return known.withColumn("is_test", F.col("__at") <= tested).drop("__n", "__at")
