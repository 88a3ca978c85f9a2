"""Counts how many trips pass each link and each node of a network, from the texts of their paths.

    spark-submit jobs/link_flows.py --paths PATH --output PATH [--config FILE]

A path is a text of nodes in order: stations of observed trips, or the words of a document. The job cuts every text whole, pairs each
node with the next, and writes for each route ``OUTPUT/links`` (flow of a link and its share of what leaves the link's first node: the
choice probability that link-based models are compared with) and ``OUTPUT/nodes`` (trips that start, end and pass there), both
partitioned by route. A route with a link in the input replaces its partition, others stay: routes can be run one by one and again.

Texts are dealt over all tasks, as a file may hold them in one row group, and cut once (``OUTPUT/trips``). Nodes are counted first. Then
the few busy nodes' links are counted within tasks before sums are shuffled, and those of all others in rounds by a hash of their first
node: a round's shuffle holds a share of the steps, each node's steps meet in one task together with what leaves the node, and Spark
deletes the round's shuffle files at its end. Rounds collect in ``OUTPUT/flows``; links are replaced once all are there, and both folders
emptied. A null text, one without nodes and one of a single node pass no link; the latter still starts and ends at its node. Links below
``least_flow`` are left out of ``links``, not out of shares. The config file names route and path, as SQL expressions, and the pattern of
a node.
"""

from __future__ import annotations

import argparse
import os
import sys
from collections.abc import Iterator
from contextlib import ExitStack

if __name__ == "__main__":
    sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from jobs.common import config, log, rows_seen, session, setting, write_partitions

LINKS = "from_node string, to_node string, flow bigint, share double, route string"
NODES = "node string, starts bigint, ends bigint, passes bigint, route string"
TRIPS = "route string, nodes array<string>"
# Texts are dealt into so many pieces, of which Spark joins small ones up to this size: a task's counts then fit its memory.
PIECES, PIECE = 1024, "16m"
# A node with more than this share of all passes is busy. Others' steps are counted in rounds of at least so many, at most so many rounds.
BUSY, ROUND, ROUNDS = 256, 4_000_000, 4
SETTINGS = {
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": PIECE,
    "spark.sql.files.maxPartitionBytes": PIECE,
    "spark.sql.adaptive.coalescePartitions.initialPartitionNum": "512",
    "spark.sql.maxConcurrentOutputFileWriters": "16",  # a task that meets few routes needn't sort by them
    "spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true",
    "spark.sql.parquet.compression.codec": "zstd",
}


def trips(raw: DataFrame, settings: dict) -> DataFrame:
    """route and nodes, an array, of every row, dealt over all tasks: a file's row groups may be few and large."""
    rows = raw.select(F.expr(settings["route"]).cast("string").alias("route"), F.expr(settings["path"]).cast("string").alias("path"), F.monotonically_increasing_id().alias("row"))
    nodes = F.regexp_extract_all("path", F.lit(settings["node"]), F.lit(0))
    return rows.hint("rebalance", PIECES, "row").select("route", nodes.alias("nodes"))


def steps(paths: DataFrame) -> DataFrame:
    """Each node of each trip with its place and the one that follows it; none (null) follows the last."""
    # outer, as Spark else repeats the cut in a filter for arrays without nodes
    at = paths.select("route", "nodes", F.posexplode_outer("nodes").alias("k", "from_node")).filter("k is not null")
    return at.select("route", "from_node", F.get("nodes", F.col("k") + 1).alias("to_node"), "k")


def nodes(at: DataFrame) -> DataFrame:
    """Trips that start, end and pass at every node of a route, from steps; a trip passes as often as its path names the node."""
    counts = F.count_if(F.col("k") == 0).alias("starts"), F.count_if(F.col("to_node").isNull()).alias("ends"), F.count("*").alias("passes")
    return at.groupBy("route", F.col("from_node").alias("node")).agg(*counts).select("node", "starts", "ends", "passes", "route")


def leaving(at: DataFrame) -> DataFrame:
    """What passes at a node and doesn't end there."""
    return at.select("route", F.col("node").alias("from_node"), (F.col("passes") - F.col("ends")).alias("leaving"))


def flows(at: DataFrame) -> DataFrame:
    return at.groupBy("route", "from_node", "to_node").agg(F.count("*").alias("flow"))


def shares(counted: DataFrame, left: DataFrame) -> DataFrame:
    """Links with their share of the flow from their first node."""
    return counted.join(left, ["route", "from_node"]).select("from_node", "to_node", "flow", (F.col("flow") / F.col("leaving")).alias("share"), "route")


def rounds(at: DataFrame, known: DataFrame) -> Iterator[DataFrame]:
    """All links of the steps, in parts: those from busy nodes, which few rows name, then those from others by a hash of the node."""
    passes = known.agg(F.coalesce(F.sum("passes"), F.lit(0))).first()[0]
    moves, is_busy = at.filter("to_node is not null").drop("k"), F.col("passes") * BUSY > passes
    busy = F.broadcast(leaving(known.filter(is_busy)))
    yield shares(flows(moves.join(busy, ["route", "from_node"], "left_semi")), busy)
    n = min(ROUNDS, 1 + passes // ROUND)
    rest, others = moves.join(busy, ["route", "from_node"], "left_anti"), leaving(known.filter(~is_busy))
    for k in range(n):
        of = F.pmod(F.xxhash64("route", "from_node"), F.lit(n)) == k
        # both sides are dealt by route and node: neither counts nor shares shuffle the links again
        yield shares(flows(rest.filter(of).repartition("route", "from_node")), others.filter(of).hint("shuffle_hash"))


def emptied(spark: SparkSession, path: str, schema: str) -> None:
    spark.createDataFrame([], schema).write.mode("overwrite").parquet(path)


def run(spark: SparkSession, paths_path: str, output: str, settings: dict | None = None) -> dict[str, int]:
    """Write links and nodes; returns the number of paths read and of rows written."""
    settings = settings or config("link_flows")
    for name, schema in (("links", LINKS), ("nodes", NODES)):
        spark.createDataFrame([], schema).write.mode("append").partitionBy("route").parquet(f"{output}/{name}")
    with ExitStack() as held:
        for key, value in SETTINGS.items():
            held.enter_context(setting(spark, key, value))
        trips(spark.read.parquet(paths_path), settings).write.mode("overwrite").parquet(f"{output}/trips")
        at, read, linked = steps(spark.read.schema(TRIPS).parquet(f"{output}/trips")), Observation(), 0
        met = write_partitions(nodes(at).observe(read, F.coalesce(F.sum("starts"), F.lit(0)).alias("n")), f"{output}/nodes", ["route"])
        emptied(spark, f"{output}/flows", LINKS)
        for part in rounds(at, spark.read.schema(NODES).parquet(f"{output}/nodes")):
            seen = Observation()
            found = part.observe(seen, F.count(F.lit(1)).alias("n")).filter(F.col("flow") >= settings["least_flow"])
            found.sortWithinPartitions("route", "from_node").write.mode("append").parquet(f"{output}/flows")
            linked += rows_seen(seen)
        emptied(spark, f"{output}/trips", TRIPS)
        written = write_partitions(spark.read.schema(LINKS).parquet(f"{output}/flows"), f"{output}/links", ["route"])
        emptied(spark, f"{output}/flows", LINKS)
    done = {"read": rows_seen(read), "flows": linked, "links": written, "nodes": met}
    log.info("link flows: %d paths read from %s; %d links and %d nodes written to %s", done["read"], paths_path, written, met, output)
    return done


def table(spark: SparkSession, output: str) -> DataFrame:
    return spark.read.schema(LINKS).parquet(f"{output}/links")


def main() -> None:
    parser = argparse.ArgumentParser(description=__doc__.splitlines()[0])
    for name in ("paths", "output"):
        parser.add_argument(f"--{name}", required=True)
    parser.add_argument("--config")
    args = parser.parse_args()
    spark = session("link_flows")
    try:
        run(spark, args.paths, args.output, config("link_flows", args.config))
    finally:
        spark.stop()


if __name__ == "__main__":
    main()
