"""Demand operators: station totals, measured and balanced origin-destination tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from routelab.functions.scalar import impedance
from routelab.staging import staged

#: Stations whose factors (an id and a number each) are broadcast.
MAX_FACTORS = 200_000


def _with_totals(stations: DataFrame, totals: DataFrame) -> DataFrame:
    """Stations with total_entries, total_exits and total_demand; null where their name has none."""
    return stations.join(totals, "station_name", "left").withColumn("total_demand", F.col("total_entries") + F.col("total_exits"))


def entry_exit_demand(rows: DataFrame, stations: DataFrame) -> DataFrame:
    """Stations with totals of (station_name, kind Entry or Exit, trips); sums of nothing but nulls are 0."""
    own = rows.join(stations.select("station_name").distinct(), "station_name", "left_semi")
    pivot = own.groupBy("station_name").pivot("kind", ["Entry", "Exit"]).agg(F.coalesce(F.sum("trips"), F.lit(0.0)))
    return _with_totals(stations, pivot.select("station_name", F.coalesce("Entry", F.lit(0.0)).alias("total_entries"), F.coalesce("Exit", F.lit(0.0)).alias("total_exits")))


def stations_without_demand(rows: DataFrame, stations: DataFrame) -> DataFrame:
    return stations.join(rows.select("station_name").distinct(), "station_name", "left_anti")


def ridership_demand(entries: DataFrame, exits: DataFrame, stations: DataFrame) -> DataFrame:
    """Stations with totals of two (station_name, trips) tables; a name in one table only has 0 of the other."""
    a = entries.groupBy("station_name").agg(F.coalesce(F.sum("trips"), F.lit(0.0)).alias("total_entries"))
    b = exits.groupBy("station_name").agg(F.coalesce(F.sum("trips"), F.lit(0.0)).alias("total_exits"))
    return _with_totals(stations, a.join(b, "station_name", "full").na.fill(0.0, ["total_entries", "total_exits"]))


def measured_od(rows: DataFrame, stations: DataFrame) -> DataFrame:
    """Total trips of (origin, destination, trips) by names that are stations, most first; trips within a station stay."""
    names = stations.groupBy("station_name").agg(F.max("station_id").alias("station_id"))
    by = lambda kind, key: names.select(F.col("station_name").alias(key), F.col("station_id").alias(f"{kind}_station_id"))
    sums = rows.groupBy("origin", "destination").agg(F.coalesce(F.sum("trips"), F.lit(0.0)).alias("total_trips"))
    od = sums.join(by("origin", "origin"), "origin").join(by("dest", "destination"), "destination")
    return od.select("origin_station_id", "dest_station_id", "total_trips", F.col("origin").alias("origin_station_name"), F.col("destination").alias("dest_station_name")).orderBy(F.desc("total_trips"), "origin_station_id", "dest_station_id")


def gravity_od(stations: DataFrame, times: DataFrame, beta: float = 0.05, target: float = 18_000.0, iterations: int = 15, threshold: float = 0.5) -> DataFrame:
    """Doubly constrained gravity model in long form: seed by impedance, then rows and columns scaled in turn, then to the target.

    ``stations`` has station_id, total_entries and total_exits; ``times`` origin, dest and seconds. The cells, a row a pair, are
    staged once and never rewritten: what iterates are the two factors, a row a station, which are broadcast up to MAX_FACTORS
    stations and merged beyond. Ends balanced by column; pairs under the threshold and self-pairs go.
    """
    known = stations.filter("total_entries is not null and total_exits is not null")
    on_graph = staged(known.join(times.select(F.col("origin").alias("station_id")).distinct(), "station_id", "left_semi").select("station_id", "total_entries", "total_exits"), "totals")
    n, o, d = on_graph.agg(F.count("*"), F.sum("total_entries"), F.sum("total_exits")).first()
    if n < 2:
        raise ValueError("fewer than two stations with demand")
    if not o or not d:
        raise ValueError("no demand")
    origins = on_graph.select(F.col("station_id").alias("origin"), F.col("total_entries").cast("double").alias("o"))
    dests = on_graph.select(F.col("station_id").alias("dest"), F.col("total_exits").cast("double").alias("d"))
    # Pairs without a time have no trips in any iteration.
    pairs = times.select("origin", "dest", "seconds").join(origins, "origin").join(dests, "dest")
    seed = F.col("o") * F.col("d") * impedance(F.col("seconds") / 60.0, beta, F.col("origin") == F.col("dest"))
    cells = staged(pairs.select("origin", "dest", "o", "d", seed.alias("t")).filter("t <> 0"), "cells")
    if not cells.filter("t > 0").limit(1).count():
        raise ValueError("no pair can be reached")
    sided = F.broadcast if n <= MAX_FACTORS else lambda df: df.hint("merge")

    def factor(side: str, goal: str, other: DataFrame | None, by: str) -> DataFrame:
        """What scales each ``side``'s cells, already scaled by the ``other`` side's factor, to its goal."""
        rows = cells.select("*", F.lit(1.0).alias("f")) if other is None else cells.join(sided(other), by)
        total = F.sum(F.col("t") * F.col("f"))
        return rows.groupBy(side).agg((F.first(goal) / F.when(total == 0, 1.0).otherwise(total)).alias("f"))

    by_row, by_column = None, None
    for k in range(iterations):
        by_row = factor("origin", "o", by_column, "dest")
        by_column = factor("dest", "d", by_row, "origin")
        if k % 3 == 2 and k + 1 < iterations:
            by_column = staged(by_column, "factors")
    by_column = staged(by_column, "columns")
    by_row = staged(by_row, "rows")
    scaled = cells.join(sided(by_row.withColumnRenamed("f", "a")), "origin").join(sided(by_column.withColumnRenamed("f", "b")), "dest").select("origin", "dest", (F.col("t") * F.col("a") * F.col("b")).alias("t"))
    total = scaled.agg(F.sum("t")).first()[0]
    if not total:
        raise ValueError("the balanced table is empty")
    out = scaled.select("origin", "dest", (F.col("t") * F.lit(target) / F.lit(total)).alias("trips")).filter((F.col("trips") >= threshold) & (F.col("origin") != F.col("dest")))
    return out.select(F.col("origin").alias("origin_station_id"), F.col("dest").alias("dest_station_id"), F.col("trips").alias("total_trips"))


def load_demand(kind: str, stations: DataFrame, entry_exit: DataFrame | None = None, entries: DataFrame | None = None, exits: DataFrame | None = None, pairs: DataFrame | None = None, times: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Demand and OD table of a city of the given kind of files: measured pairs where there are some, else balanced ones."""
    if kind == "entry_exit":
        demand = entry_exit_demand(entry_exit, stations)
    elif kind == "ridership":
        demand = ridership_demand(entries, exits, stations)
    else:
        raise ValueError(f"unknown demand source {kind}")
    return demand, measured_od(pairs, stations) if pairs is not None else gravity_od(demand, times)
