"""Path attributes, Path Size and utilities over tables of paths (set columns, path array of ids)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from routelab.config import Betas
from routelab.functions.scalar import TRANSFER

DEFAULT_HEADWAY = 10.0


def exploded_links(paths: DataFrame, edges: DataFrame) -> DataFrame:
    """A row a link: the paths' columns, at (from 0), u, v and the edge's route_id, duration and link_type.

    A path with a link that ``edges`` lacks raises: it would otherwise look shorter than it is.
    """
    spread = paths.filter(F.size("path") > 1).select("*", F.posexplode(F.slice("path", 1, F.size("path") - 1)).alias("at", "u")).withColumn("v", F.get("path", F.col("at") + 1))
    e = edges.select(F.col("from_stop").alias("u"), F.col("to_stop").alias("v"), "route_id", "duration", "link_type", F.lit(True).alias("__known"))
    lost = F.raise_error(F.concat(F.lit("a path has a link that the network lacks: "), F.col("u"), F.lit(" to "), F.col("v"))).cast("double")
    found = spread.join(e, ["u", "v"], "left")
    return found.withColumn("duration", F.when(F.col("__known"), F.col("duration")).otherwise(lost)).drop("__known")


def path_components(paths: DataFrame, edges: DataFrame, headways: DataFrame, keys: list[str], default: float = DEFAULT_HEADWAY) -> DataFrame:
    """ivt_min, wait_min, walk_min, n_transfers and seconds of each path.

    Half a headway is waited at each boarding: at the first transit link, after a walk, and where the route changes. Boardings after
    the first are transfers.
    """
    name = F.array_join("path", "|").alias("path_text")
    links = exploded_links(paths.select(*keys, "path", name), edges).join(headways.select("route_id", "headway_min"), "route_id", "left")
    w = Window.partitionBy(*keys, "path_text").orderBy("at")
    before = F.when(F.lag("link_type").over(w) != TRANSFER, F.lag("route_id").over(w))
    transit = F.col("link_type") != TRANSFER
    boards = transit & (before.isNull() | (before != F.col("route_id")))
    rows = links.withColumn("boards", F.coalesce(boards, F.lit(False)))
    total = rows.groupBy(*keys, "path_text").agg(
        F.first("path").alias("path"),
        (F.sum(F.when(transit, F.col("duration")).otherwise(0.0)) / 60.0).alias("ivt_min"),
        F.sum(F.when(F.col("boards"), F.coalesce("headway_min", F.lit(default)) / 2.0).otherwise(0.0)).alias("wait_min"),
        (F.sum(F.when(~transit, F.col("duration")).otherwise(0.0)) / 60.0).alias("walk_min"),
        F.greatest(F.lit(0), F.sum(F.col("boards").cast("int")) - 1).cast("bigint").alias("n_transfers"),
        F.sum("duration").alias("seconds"),
    )
    return total


def path_sizes(paths: DataFrame, edges: DataFrame, keys: list[str]) -> DataFrame:
    """Path Size of each path in its set (``keys``): each link's share of the length over the number of paths that have it."""
    links = exploded_links(paths.select(*keys, "path", F.array_join("path", "|").alias("path_text")), edges)
    sharing = F.count("*").over(Window.partitionBy(*keys, "u", "v", "duration"))
    length = F.sum("duration").over(Window.partitionBy(*keys, "path_text"))
    part = F.col("duration") / F.when(length == 0, 1e-6).otherwise(length) / sharing
    return links.select(*keys, "path_text", part.alias("part")).groupBy(*keys, "path_text").agg(F.sum("part").alias("path_size"))


def utility(betas: Betas, size: str = "path_size") -> Column:
    cost = F.lit(betas.ivt) * F.col("ivt_min") + F.lit(betas.wait) * F.col("wait_min") + F.lit(betas.walk) * F.col("walk_min") + F.lit(betas.transfer) * F.col("n_transfers")
    return F.lit(betas.pathsize) * F.ln(F.greatest(F.col(size), F.lit(1e-9))) - cost


def with_softmax(df: DataFrame, value: str, keys: list[str], name: str = "probability") -> DataFrame:
    """Choice probabilities within the sets of ``keys``, shifted by the greatest value."""
    w = Window.partitionBy(*keys)
    shifted = df.withColumn("__e", F.exp(F.col(value) - F.max(value).over(w)))
    return shifted.withColumn(name, F.col("__e") / F.sum("__e").over(w)).drop("__e")


def choice_table(paths: DataFrame, edges: DataFrame, headways: DataFrame, keys: list[str], betas: Betas) -> DataFrame:
    """Components, path_size, utility and probability of every path of each set."""
    rows = path_components(paths, edges, headways, keys).join(path_sizes(paths, edges, keys), [*keys, "path_text"]).withColumn("utility", utility(betas))
    return with_softmax(rows, "utility", keys)
