"""Readers of schedule, ridership and processed tables with explicit schemas, and sinks."""

from __future__ import annotations

import json

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from routelab.functions.scalar import ridership_count, single_spaced

#: Column and kind; a trailing ? marks a column that may be missing.
GTFS = {
    "stops": "stop_id string, stop_name string, parent_station string?, location_type double?, stop_lat double, stop_lon double",
    "trips": "trip_id string, route_id string, service_id string, trip_headsign string?, direction_id tinyint?, shape_id string?, block_id string?",
    "routes": "route_id string, route_short_name string?, route_color string?",
    "stop_times": "trip_id string, stop_id string, stop_sequence int, arrival_time string, departure_time string",
}
DAYS = ("monday", "tuesday", "wednesday", "thursday", "friday", "saturday", "sunday")


def read_csv(spark: SparkSession, path: str, sep: str = ",") -> DataFrame:
    """All columns as strings, header names without byte-order marks and outer spaces."""
    raw = spark.read.csv(path, header=True, sep=sep, inferSchema=False, encoding="UTF-8")
    return raw.toDF(*[c.replace("﻿", "").strip() for c in raw.columns])


def typed(raw: DataFrame, schema: str, name: str) -> DataFrame:
    """Project and cast; a value that doesn't parse is null, a required column that is missing an error."""
    out, missing = [], []
    for part in schema.split(","):
        column, kind = part.split()
        if column in raw.columns:
            out.append(F.col(column).try_cast(kind.rstrip("?")).alias(column))
        elif not kind.endswith("?"):
            missing.append(column)
    if missing:
        raise ValueError(f"{name} lacks {', '.join(missing)}")
    return raw.select(*out)


def read_gtfs(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    return {name: typed(read_csv(spark, f"{folder}/{name}.txt"), schema, name) for name, schema in GTFS.items()}


def read_calendar(spark: SparkSession, folder: str) -> DataFrame | None:
    """The calendar, or None where the feed has none."""
    try:
        raw = read_csv(spark, f"{folder}/calendar.txt")
    except AnalysisException:
        return None
    return typed(raw, "service_id string, " + ", ".join(f"{d} int" for d in DAYS), "calendar")


def read_entry_exit(spark: SparkSession, path: str) -> DataFrame:
    raw = read_csv(spark, path)
    return raw.select(single_spaced("Station").alias("station_name"), F.col("Entry_Exit").alias("kind"), ridership_count("Trip").alias("trips"))


def read_ridership(spark: SparkSession, path: str) -> DataFrame:
    raw = read_csv(spark, path, ";")
    return raw.select(F.col("Station").alias("station_name"), F.col("Ridership").try_cast("double").alias("trips"))


def read_station_pairs(spark: SparkSession, path: str) -> DataFrame:
    raw = read_csv(spark, path, ";")
    return raw.select(F.col("Origin Station").alias("origin"), F.col("Destination Station").alias("destination"), F.col("Ridership").try_cast("double").alias("trips"))


def trip_stop_times(stop_times: DataFrame, trips: DataFrame) -> DataFrame:
    """Stop times of the given trips only: a semi-join, which the scan's splits share."""
    return stop_times.join(trips.select("trip_id").distinct(), "trip_id", "left_semi")


def read_headways(spark: SparkSession, path: str) -> DataFrame:
    """Processed headways, or an empty table where there is no file."""
    try:
        return typed(read_csv(spark, path), "route_id string, headway_min double", "headways")
    except AnalysisException:
        return spark.createDataFrame([], "route_id string, headway_min double")


def write_table(df: DataFrame, path: str, form: str = "parquet", sep: str = ",") -> None:
    writer = df.write.mode("overwrite")
    writer.csv(path, header=True, sep=sep) if form == "csv" else writer.format(form).save(path)


def write_fit(spark: SparkSession, fit: dict, path: str) -> None:
    """A fitted result as one JSON line; values that JSON lacks become text."""
    spark.createDataFrame([(json.dumps(fit, default=str),)], "value string").coalesce(1).write.mode("overwrite").text(path)
