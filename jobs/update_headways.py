"""Keeps the headways of every route and stop up to date while files of calls arrive.

    spark-submit jobs/update_headways.py --calls PATH --output PATH --checkpoint PATH [--config FILE]

A file stream takes the files of ``--calls`` that its checkpoint hasn't seen yet, and ends when there are no more. Each batch is written
to ``OUTPUT/calls`` under its own number; then the service dates that it touches, and only these, are computed anew from all calls of
the date and replace the date's partition of ``OUTPUT/headways``: calls that arrive late, between others, change the gaps around them.

Running again takes nothing twice. A batch that failed half way is repeated under its number and replaces what it left; a call that comes
in two files counts once, by its id, with the earliest time, least route and least stop of its rows. Calls without an id, time, route or
stop are left out. A folder whose files have no rows gives empty tables. On a cluster the session's spark.checkpoint.dir must name a folder
that driver and executors share: gaps are staged there, and deleted when the command ends. The config file names the columns, as SQL expressions over the files' columns.
"""

from __future__ import annotations

import argparse
import os
import sys

if __name__ == "__main__":
    sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from jobs.common import config, log, session, write_partitions
from routelab.operators.gtfs import median_gap_minutes
from routelab.staging import clear

CALLS = "call_id string, route_id string, stop_id string, second double, service_date date, batch bigint"
HEADWAYS = "route_id string, stop_id string, n_calls bigint, headway_min double, service_date date"


def as_calls(rows: DataFrame, settings: dict) -> DataFrame:
    """call_id, route_id, stop_id, second of the day and service_date of raw rows."""
    at = F.expr(settings["at"]).cast("timestamp_ntz")
    second = (F.unix_micros(at.cast("timestamp")) - F.unix_micros(F.to_date(at).cast("timestamp"))) / 1e6
    named = [F.expr(settings[k]).cast("string").alias(name) for k, name in (("call", "call_id"), ("route", "route_id"), ("stop", "stop_id"))]
    return rows.select(*named, second.alias("second"), F.to_date(at).alias("service_date")).na.drop()


def headways(calls: DataFrame, max_gap_sec: float) -> DataFrame:
    """Calls and median gap of every date, route and stop; null where no gap is within the limit."""
    keys = ["service_date", "route_id", "stop_id"]
    once = calls.groupBy("service_date", "call_id").agg(F.min(F.struct("second", "route_id", "stop_id")).alias("c")).select("service_date", "c.*")
    counts = once.groupBy(*keys).agg(F.count("*").alias("n_calls"))
    return counts.join(median_gap_minutes(once, keys, "second", max_gap_sec), keys, "left").select("route_id", "stop_id", "n_calls", "headway_min", "service_date")


def run(spark: SparkSession, calls_path: str, output: str, checkpoint: str, settings: dict | None = None) -> dict[str, int]:
    """Take what is new; returns the number of batches, of calls read and of rows written."""
    settings = settings or config("update_headways")
    done = {"batches": 0, "read": 0, "written": 0}
    kept, result = f"{output}/calls", f"{output}/headways"
    for path, schema, keys in ((kept, CALLS, ["batch", "service_date"]), (result, HEADWAYS, ["service_date"])):
        spark.createDataFrame([], schema).write.mode("append").partitionBy(*keys).parquet(path)

    def take(rows: DataFrame, number: int) -> None:
        own = rows.sparkSession
        read = write_partitions(as_calls(rows, settings).withColumn("batch", F.lit(number).cast("bigint")), kept, ["batch", "service_date"])
        calls = own.read.schema(CALLS).parquet(kept)
        dates = calls.filter(F.col("batch") == number).select("service_date").distinct()
        written = write_partitions(headways(calls.join(dates, "service_date", "left_semi"), settings["max_gap_sec"]), result, ["service_date"])
        log.info("batch %d: %d calls read from %s, %d rows written to %s", number, read, calls_path, written, result)
        done["batches"] += 1
        done["read"] += read
        done["written"] += written

    schema = spark.read.parquet(calls_path).schema
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", settings["files_per_batch"]).parquet(calls_path)
    query = stream.writeStream.foreachBatch(take).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    log.info("headways: %(batches)d batches, %(read)d calls read, %(written)d rows written", done)
    return done


def table(spark: SparkSession, output: str) -> DataFrame:
    return spark.read.schema(HEADWAYS).parquet(f"{output}/headways")


def main() -> None:
    parser = argparse.ArgumentParser(description=__doc__.splitlines()[0])
    for name in ("calls", "output", "checkpoint"):
        parser.add_argument(f"--{name}", required=True)
    parser.add_argument("--config")
    args = parser.parse_args()
    spark = session("update_headways")
    try:
        run(spark, args.calls, args.output, args.checkpoint, config("update_headways", args.config))
    finally:
        clear(spark)
        spark.stop()


if __name__ == "__main__":
    main()
