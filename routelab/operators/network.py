"""Network operators: transit edges, walking transfers, collapse, trimming and parallel bus routes.

Edges have from_stop, to_stop, route_id, duration (seconds) and link_type (transit or transfer).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from routelab.config import BusRoute
from routelab.functions.scalar import EARTH_RADIUS_M, TRANSFER, TRANSIT, WALK, gtfs_seconds, haversine_m, pair_ends, prefixed, walk_seconds
from routelab.operators.gtfs import headway_table, median_gap_minutes, pattern_of_routes, signatures
from routelab.sources.tables import trip_stop_times

EDGE = ["from_stop", "to_stop", "route_id", "duration", "link_type"]


def legs(calls: DataFrame, order: list[str]) -> DataFrame:
    """trip_id, route_id, from_stop, to_stop and secs between neighbouring calls of a trip; ``calls`` has arrival and departure."""
    w = Window.partitionBy("trip_id").orderBy(*order)
    moved = calls.select("trip_id", "route_id", F.col("stop_id").alias("from_stop"), F.lead("stop_id").over(w).alias("to_stop"), (F.lead("arrival").over(w) - F.col("departure")).alias("secs"))
    return moved.filter("to_stop is not null and secs > 0")


def mirrored(edges: DataFrame) -> DataFrame:
    return edges.unionByName(edges.select(F.col("to_stop").alias("from_stop"), F.col("from_stop").alias("to_stop"), *[c for c in edges.columns if c not in ("from_stop", "to_stop")]))


def transit_edges(calls: DataFrame, order: list[str]) -> DataFrame:
    """Both directions of each link, at the mean of its directions' mean times."""
    directed = legs(calls, order).filter("from_stop <> to_stop").groupBy("from_stop", "to_stop", "route_id").agg(F.avg("secs").alias("secs"))
    a, b = pair_ends("from_stop", "to_stop")
    pairs = directed.groupBy(a.alias("a"), b.alias("b"), "route_id").agg(F.avg("secs").alias("duration"))
    return mirrored(pairs.select(F.col("a").alias("from_stop"), F.col("b").alias("to_stop"), "route_id", "duration", F.lit(TRANSIT).alias("link_type")))


def segment_times(calls: DataFrame, order: list[str]) -> DataFrame:
    """Mean seconds of each directed segment, links to itself included (bus feeds)."""
    return legs(calls, order).groupBy("from_stop", "to_stop").agg(F.avg("secs").alias("duration"))


def used_stations(stations: DataFrame, edges: DataFrame) -> DataFrame:
    ends = edges.select(F.col("from_stop").alias("station_id")).union(edges.select("to_stop")).distinct()
    return stations.join(ends, "station_id", "left_semi")


def near_pairs(left: DataFrame, right: DataFrame, radius_m: float, same: bool = False) -> DataFrame:
    """(a, b, metres) of points (id, lat, lon) within the radius; with ``same`` each unordered pair of one table once.

    An equi-join on cubes of space two radii wide, in which the sphere lies: one side in its own cube, the other in each cube that a ball of
    the radius around it meets, three or four of them on the whole. No straight line is longer than the way along the sphere, so no
    near pair is missed, at the 180th meridian and the poles neither.
    """
    reach = radius_m * (1 + 1e-9) + 1e-3
    axes = ["x", "y", "z"]

    def placed(df: DataFrame, side: str) -> DataFrame:
        lat, lon = F.radians("lat"), F.radians("lon")
        at = {"x": F.cos(lat) * F.cos(lon), "y": F.cos(lat) * F.sin(lon), "z": F.sin(lat)}
        return df.select(F.col("id").alias(side), F.col("lat").alias(f"lat_{side}"), F.col("lon").alias(f"lon_{side}"), *[(EARTH_RADIUS_M * at[c]).alias(c) for c in axes])

    cell = lambda c, off=0.0: F.floor((F.col(c) + off) / (2 * reach))
    a = placed(left, "a").withColumns({c: cell(c) for c in axes})
    b = placed(right, "b")
    for c in axes:
        b = b.withColumn(c, F.explode(F.array_distinct(F.array(cell(c, -reach), cell(c, reach)))))
    metres = haversine_m(F.col("lat_a"), F.col("lon_a"), F.col("lat_b"), F.col("lon_b"))
    pairs = a.join(b, axes).select("a", "b", metres.alias("metres")).filter(F.col("metres") <= radius_m)
    return pairs.filter("a < b") if same else pairs


def walking_transfers(stations: DataFrame, edges: DataFrame, max_m: float = 500.0, speed: float = 1.2) -> DataFrame:
    """Walking edges, both ways, between near stations that have no edge of any kind in either direction."""
    points = stations.select(F.col("station_id").alias("id"), F.col("stop_lat").alias("lat"), F.col("stop_lon").alias("lon"))
    a, b = pair_ends("from_stop", "to_stop")
    linked = edges.select(a.alias("a"), b.alias("b")).distinct()
    free = near_pairs(points, points, max_m, same=True).join(linked, ["a", "b"], "left_anti")
    return mirrored(free.select(F.col("a").alias("from_stop"), F.col("b").alias("to_stop"), F.lit(WALK).alias("route_id"), walk_seconds(F.col("metres"), speed).alias("duration"), F.lit(TRANSFER).alias("link_type")))


def anchor_tags(stops: DataFrame, anchors: DataFrame, radius_m: float = 500.0) -> DataFrame:
    """stop_id and the sorted anchors (id, lat, lon) within the radius of it."""
    return near_pairs(stops, anchors, radius_m).groupBy(F.col("a").alias("stop_id")).agg(F.array_sort(F.collect_set("b")).alias("anchors"))


def graph_edges(edges: DataFrame, precedence: Column | None = None) -> DataFrame:
    """One edge for each (from, to): of the greatest precedence, by default the greatest route id."""
    order = precedence if precedence is not None else F.col("route_id")
    best = F.max_by(F.struct("route_id", "duration", "link_type"), F.struct(order.alias("first"), "route_id", "duration"))
    return edges.filter("duration is not null").groupBy("from_stop", "to_stop").agg(best.alias("e")).select("from_stop", "to_stop", "e.route_id", "e.duration", "e.link_type")


def hub(edges: DataFrame) -> DataFrame:
    """The one station of most edges in and out; the least id of those."""
    ends = edges.select(F.col("from_stop").alias("station_id")).unionAll(edges.select("to_stop"))
    return ends.groupBy("station_id").agg(F.count("*").alias("degree")).orderBy(F.desc("degree"), "station_id").limit(1)


def trim_branches(stations: DataFrame, edges: DataFrame, boundaries: DataFrame, paths: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Stations and edges on the shortest paths from the hub to the boundary stations (names), and nothing else.

    ``paths`` has origin, dest and path (array of ids) of shortest paths. Unknown names are ignored.
    """
    ends = stations.join(boundaries, "station_name", "left_semi").select(F.col("station_id").alias("dest"))
    kept = paths.join(F.broadcast(hub(edges)), F.col("origin") == F.col("station_id")).join(ends, "dest", "left_semi").select(F.explode("path").alias("station_id")).distinct()
    inside = edges.join(kept.select(F.col("station_id").alias("from_stop")), "from_stop", "left_semi").join(kept.select(F.col("station_id").alias("to_stop")), "to_stop", "left_semi")
    return stations.join(kept, "station_id", "left_semi"), inside


def anchor_segments(pattern: DataFrame, tags: DataFrame, first: str, last: str, trim_at: str | None = None) -> DataFrame:
    """The stops (stop_id, at) of a pattern between its first stop near anchor ``first`` and its first near ``last``, or ``trim_at``.

    The part is the same whichever comes first; it is empty where an end isn't found.
    """
    rows = pattern.join(tags.select("stop_id", "anchors"), "stop_id", "left")
    place = lambda here: F.min(F.when(here, F.col("at")))
    end = F.col("stop_id") == F.lit(trim_at) if trim_at is not None else F.array_contains("anchors", F.lit(last))
    bounds = rows.agg(place(F.array_contains("anchors", F.lit(first))).alias("a"), place(end).alias("b"))
    return rows.join(F.broadcast(bounds), F.col("at").between(F.least("a", "b"), F.greatest("a", "b")) & F.col("a").isNotNull() & F.col("b").isNotNull()).select("stop_id", "at")


def bus_edges(pattern: DataFrame, times: DataFrame, route_id: str) -> DataFrame:
    """Both directions of a bus route's segments; stops and route take the prefix BUS_, segments without a time are dropped."""
    w = Window.partitionBy(F.lit(1)).orderBy("at")
    pairs = pattern.select(F.col("stop_id").alias("from_stop"), F.lead("stop_id").over(w).alias("to_stop")).filter("to_stop is not null")
    timed = pairs.join(times, ["from_stop", "to_stop"]).filter("duration is not null")
    bus = lambda c: prefixed("BUS_", c).alias(c)
    return mirrored(timed.select(bus("from_stop"), bus("to_stop"), F.lit(f"BUS_{route_id}").alias("route_id"), "duration", F.lit(TRANSIT).alias("link_type")))


def parallel_bus_route(stations: DataFrame, feed: dict[str, DataFrame], route: BusRoute, max_gap_sec: float = 7200.0, radius_m: float = 500.0, default: float = 10.0) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Stations, edges and headway (route_id, headway_min) of one bus route's part between its anchors.

    The pattern is the commonest of the route's trips, times are means over the trips that follow it, and the headway is that of all
    the route's trips at the first anchor's stop.
    """
    trips = feed["trips"].filter(F.col("route_id") == route.route_id).select("trip_id", "route_id")
    calls = trip_stop_times(feed["stop_times"], trips)
    best = pattern_of_routes(trips, calls)
    pattern = best.select(F.posexplode("signature").alias("at", "stop_id"))
    points = lambda df, key: df.select(F.col(key).alias("id"), F.col("stop_lat").alias("lat"), F.col("stop_lon").alias("lon"))
    tags = anchor_tags(points(feed["stops"], "stop_id"), points(stations.filter(F.col("station_name").isin(*route.anchors)), "station_name"), radius_m)
    part = anchor_segments(pattern, tags, *route.anchors, route.trim_at_stop_id)

    matching = signatures(calls).join(best.select("signature"), "signature", "left_semi").select("trip_id")
    timed = calls.join(matching, "trip_id", "left_semi").join(trips, "trip_id").select("trip_id", "route_id", "stop_id", "stop_sequence", gtfs_seconds("arrival_time").alias("arrival"), gtfs_seconds("departure_time").alias("departure"))
    edges = bus_edges(part, segment_times(timed, ["stop_sequence"]), route.name)
    places = feed["stops"].join(part.select("stop_id").distinct(), "stop_id", "left_semi")
    own = places.select(F.concat(F.lit("BUS_"), "stop_id").alias("station_id"), F.col("stop_name").alias("station_name"), "stop_lat", "stop_lon")

    start = pattern.join(tags.filter(F.array_contains("anchors", F.lit(route.anchors[0]))), "stop_id", "left_semi").orderBy("at").limit(1)
    leaving = calls.join(F.broadcast(start.select("stop_id")), "stop_id", "left_semi").select(F.lit(f"BUS_{route.name}").alias("route_id"), gtfs_seconds("departure_time").alias("second"))
    gaps = median_gap_minutes(leaving, ["route_id"], "second", max_gap_sec)
    named = feed["trips"].sparkSession.createDataFrame([(f"BUS_{route.name}",)], "route_id string")
    return own, edges, headway_table(named, gaps, default)


def build_supernetwork(stations: DataFrame, metro: DataFrame, max_m: float = 500.0, speed: float = 1.2, trim=None, bus_stations: DataFrame | None = None, bus: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Metro edges, then walking edges, then ``trim`` (stations, edges) -> both, then bus stations and edges with their walking edges."""
    edges = metro.select(EDGE).unionByName(walking_transfers(stations, metro, max_m, speed).select(EDGE))
    if trim:
        stations, edges = trim(stations, edges)
    if bus is not None:
        stations = stations.unionByName(bus_stations).dropDuplicates(["station_id"])
        edges = edges.unionByName(bus.select(EDGE))
        edges = edges.unionByName(walking_transfers(stations, edges, max_m, speed).select(EDGE))
    return stations.distinct(), edges.distinct()
