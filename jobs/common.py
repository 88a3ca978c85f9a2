"""What the jobs share: their config files, log and counted writes."""

from __future__ import annotations

import json
import logging
import os
from collections.abc import Iterator
from contextlib import contextmanager

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

log = logging.getLogger("routelab.jobs")


def config(name: str, path: str | None = None) -> dict:
    """The settings beside the job, with those of the file at ``path`` over them; an unknown one is an error."""
    with open(os.path.join(os.path.dirname(os.path.abspath(__file__)), f"{name}.json"), encoding="utf-8") as f:
        settings = json.load(f)
    if path:
        with open(path, encoding="utf-8") as f:
            own = json.load(f)
        if unknown := set(own) - set(settings):
            raise ValueError(f"unknown settings: {', '.join(sorted(unknown))}")
        settings |= own
    return settings


def rows_seen(seen: Observation) -> int:
    """The observed ``n``. Spark drops an observation together with a part of the plan that proves empty: then it is 0."""
    try:
        return seen.get.get("n", 0)
    except Py4JJavaError:
        return 0


def write_partitions(df: DataFrame, path: str, keys: list[str], dynamic: bool = True) -> int:
    """Write Parquet partitioned by ``keys`` and return the rows written.

    ``dynamic`` replaces the partitions that ``df`` has rows of and leaves the others; else the whole table is replaced.
    """
    seen = Observation()
    rows = df.observe(seen, F.count(F.lit(1)).alias("n"))
    mode = "dynamic" if dynamic else "static"
    rows.write.mode("overwrite").option("partitionOverwriteMode", mode).partitionBy(*keys).parquet(path)
    return rows_seen(seen)


@contextmanager
def setting(spark: SparkSession, key: str, value: str) -> Iterator[None]:
    """A setting of the session for the time of a block."""
    before = spark.conf.get(key, None)
    spark.conf.set(key, value)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(key)
        else:
            spark.conf.set(key, before)


def session(name: str) -> SparkSession:
    logging.basicConfig(level=logging.INFO, format="%(asctime)s %(name)s %(message)s")
    return SparkSession.builder.appName(name).getOrCreate()
