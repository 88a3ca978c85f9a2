"""Plot-ready tables: coloured edges, station flags, network statistics and map features."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from routelab.functions.scalar import TRANSFER

#: Colours that routes take in turn, in the order of their ids.
PALETTE = ("#1b9e77", "#d95f02", "#7570b3", "#e7298a", "#66a61e", "#e6ab02", "#a6761d", "#666666")


def route_colours(edges: DataFrame) -> DataFrame:
    """route_id and colour of each transit route; a table of the size of the route list."""
    routes = edges.filter(F.col("link_type") != TRANSFER).select("route_id").distinct()
    place = F.row_number().over(Window.orderBy("route_id")) - 1
    return routes.select("route_id", F.get(F.array(*map(F.lit, PALETTE)), place % len(PALETTE)).alias("colour"))


def plot_edges(edges: DataFrame, stations: DataFrame) -> DataFrame:
    """Each edge with the coordinates of its ends and its route's colour (null for walks)."""
    at = lambda end: stations.select(F.col("station_id").alias(f"{end}_stop"), F.col("stop_lat").alias(f"{end}_lat"), F.col("stop_lon").alias(f"{end}_lon"))
    return edges.join(at("from"), "from_stop").join(at("to"), "to_stop").join(route_colours(edges), "route_id", "left")


def station_flags(edges: DataFrame, stations: DataFrame) -> DataFrame:
    """Each station, the number of its transit routes, and whether it is an interchange (more than one) or has a walking link."""
    ends = edges.select(F.col("from_stop").alias("station_id"), "route_id", "link_type").unionAll(edges.select("to_stop", "route_id", "link_type"))
    flags = ends.groupBy("station_id").agg(
        F.count_distinct(F.when(F.col("link_type") != TRANSFER, F.col("route_id"))).alias("n_routes"), F.max(F.col("link_type") == TRANSFER).alias("has_transfer")
    )
    joined = stations.join(flags, "station_id", "left").withColumns({"n_routes": F.coalesce("n_routes", F.lit(0)), "has_transfer": F.coalesce("has_transfer", F.lit(False))})
    return joined.withColumn("is_interchange", F.col("n_routes") > 1)


def network_stats(edges: DataFrame, stations: DataFrame) -> DataFrame:
    """One row of counts: stations, transit and walking links (each direction), routes, interchanges."""
    e = edges.agg(
        F.count(F.when(F.col("link_type") != TRANSFER, 1)).alias("transit_links"), F.count(F.when(F.col("link_type") == TRANSFER, 1)).alias("walking_links"),
        F.count_distinct(F.when(F.col("link_type") != TRANSFER, F.col("route_id"))).alias("routes"),
    )
    s = station_flags(edges, stations).agg(F.count("*").alias("stations"), F.count(F.when(F.col("is_interchange"), 1)).alias("interchanges"))
    return e.join(s)


def features(edges: DataFrame, stations: DataFrame) -> DataFrame:
    """A GeoJSON feature a row, as text: stations as points and edges as lines."""
    lines = plot_edges(edges, stations).select(
        F.to_json(F.struct(F.lit("Feature").alias("type"), F.struct(F.lit("LineString").alias("type"), F.array(F.array("from_lon", "from_lat"), F.array("to_lon", "to_lat")).alias("coordinates")).alias("geometry"), F.struct("route_id", "link_type", "colour").alias("properties"))).alias("feature")
    )
    points = stations.select(F.to_json(F.struct(F.lit("Feature").alias("type"), F.struct(F.lit("Point").alias("type"), F.array("stop_lon", "stop_lat").alias("coordinates")).alias("geometry"), F.struct("station_id", "station_name").alias("properties"))).alias("feature"))
    return lines.unionByName(points)


def map_centre(stations: DataFrame) -> DataFrame:
    return stations.agg(F.avg("stop_lat").alias("lat"), F.avg("stop_lon").alias("lon"))
