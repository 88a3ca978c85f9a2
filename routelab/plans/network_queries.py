"""Queries on schedules, stations and networks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from routelab.functions.scalar import gtfs_seconds
from routelab.operators import gtfs, network, viz
from routelab.operators.graph import all_pairs
from routelab.plans import adapters as a

STOPS = [
    ("A", "Station A", None, 0.0, 1.0, 1.0), ("A_PF1", "Station A, Platform 1", "A", 0.0, 1.0, 1.002), ("A_PF2", "Station A, Platform 2", "A", 0.0, 1.0, 1.004),
    ("B", "Station B", None, 0.0, 2.0, 2.0), ("P_STAND", "Parramatta Station, Stand A1", "PRRA", 2.0, 3.0, 3.0), ("P", "Parramatta Station", "PRRA", 1.0, 3.002, 3.002),
]
CALENDAR = [("S0", 1, 1, 1, 1, 1, 0, 0), ("S1", 0, 0, 0, 0, 0, 1, 1), ("S2", 1, 1, 1, 1, 1, 1, 0), ("S3", 0, 0, 0, 0, 1, 0, 0)]
CALENDAR_SCHEMA = "service_id string, monday int, tuesday int, wednesday int, thursday int, friday int, saturday int, sunday int"


def _values(rows: list[tuple]) -> str:
    return ", ".join("(" + ", ".join("NULL" if x is None else f"'{x}'" if isinstance(x, str) else repr(x) for x in row) + ")" for row in rows)


def _transit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return network.transit_edges(a.event_calls(spark, sf_dir), ["ts", "event_id"])


def transit_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _transit(spark, sf_dir).withColumn("duration", F.round("duration", 4))


def graph_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return network.graph_edges(_transit(spark, sf_dir)).withColumn("duration", F.round("duration", 4))


def bus_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Segment times of route R1's calls, self-links included."""
    calls = a.event_calls(spark, sf_dir).filter("route_id = 'R1'")
    return network.segment_times(calls, ["ts", "event_id"]).withColumn("duration", F.round("duration", 4))


def _headway(limit: float):
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        return gtfs.median_gap_minutes(a.event_calls(spark, sf_dir), ["stop_id"], "departure", limit).withColumn("headway_min", F.round("headway_min", 6))

    return query


def reference_stop(spark: SparkSession, sf_dir: str) -> DataFrame:
    calls = a.event_calls(spark, sf_dir)
    first = calls.groupBy("trip_id").agg(F.min_by(F.struct("route_id", "stop_id"), F.struct("ts", "event_id")).alias("f")).select("f.*")
    return gtfs.most_frequent(first, ["route_id"], "stop_id")


def _conversation_trips(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    rows = a.table(spark, sf_dir, "conversations")
    trips = rows.select(F.col("conv_id").cast("string").alias("trip_id"), F.concat(F.lit("C"), (F.col("conv_id") % 3).cast("string")).alias("route_id")).distinct()
    return trips, rows.select(F.col("conv_id").cast("string").alias("trip_id"), F.col("turn").cast("int").alias("stop_sequence"), F.col("role").alias("stop_id"))


def _pattern(longest: bool):
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        trips, calls = _conversation_trips(spark, sf_dir)
        found = gtfs.pattern_of_routes(trips, calls, F.lit(longest))
        return found.select("route_id", F.array_join("signature", "|").alias("signature"), F.col("n_stops").cast("bigint").alias("n_stops"), "n_matching", "n_candidate")

    return query


def _order_trips(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("o_orderkey")
    return a.table(spark, sf_dir, "orders").select(key.cast("string").alias("trip_id"), F.col("o_orderpriority").alias("route_id"), F.concat(F.lit("S"), (key % 4).cast("string")).alias("service_id"))


def weekday_service(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gtfs.weekday_services(spark.createDataFrame(CALENDAR, CALENDAR_SCHEMA), _order_trips(spark, sf_dir))


def resolved_service(spark: SparkSession, sf_dir: str) -> DataFrame:
    trips = _order_trips(spark, sf_dir)
    routes = trips.select("route_id").unionByName(spark.createDataFrame([("X1",), ("X2",)], "route_id string"))
    manual = spark.createDataFrame([("X1", "S9")], "route_id string, service_id string")
    weekday = gtfs.weekday_services(spark.createDataFrame(CALENDAR, CALENDAR_SCHEMA), trips)
    return gtfs.resolved_services(routes, weekday, manual, "weekday")


def gtfs_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Seconds of every event's time as feeds write it: beyond midnight, unpadded and spaced, too short, too long, or no time at all."""
    rest = F.date_format("ts", ":mm:ss")
    loose = F.concat(F.lit(" "), F.hour("ts").cast("string"), F.lit(":"), F.minute("ts").cast("string"), F.lit(":"), F.second("ts").cast("string"), F.lit(" "))
    ways = [F.concat((F.hour("ts") + 24).cast("string"), rest), loose, F.date_format("ts", "HH:mm"), F.concat(F.date_format("ts", "HH:mm:ss"), F.lit(":0")), F.concat(F.col("event_type"), rest)]
    text = F.date_format("ts", "HH:mm:ss")
    for k, way in enumerate(ways):
        text = F.when(F.col("event_id") % (len(ways) + 1) == k, way).otherwise(text)
    return a.table(spark, sf_dir, "events").select("event_id", text.alias("t")).select("event_id", "t", gtfs_seconds("t").alias("seconds"))


def station_collapse(spark: SparkSession, sf_dir: str) -> DataFrame:
    schema = "stop_id string, stop_name string, parent_station string, location_type double, stop_lat double, stop_lon double"
    nations = a.nation_stations(spark, sf_dir).join(a.table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("string").alias("station_id"), F.concat(F.lit("G"), F.col("n_regionkey").cast("string")).alias("parent")), "station_id")
    stops = spark.createDataFrame(STOPS, schema).unionByName(nations.select(F.col("station_id").alias("stop_id"), F.col("station_name").alias("stop_name"), F.col("parent").alias("parent_station"), F.lit(None).cast("double").alias("location_type"), "stop_lat", "stop_lon"))
    stations, _ = gtfs.collapse_platforms(stops)
    return stations.select("station_id", "station_name", F.round("stop_lat", 6).alias("stop_lat"), F.round("stop_lon", 6).alias("stop_lon"))


def walking_transfers(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = network.walking_transfers(a.nation_stations(spark, sf_dir), a.grid_edges(spark, sf_dir))
    return found.withColumn("duration", F.round("duration", 6))


def anchor_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = a.nation_stations(spark, sf_dir).select(F.col("station_id").alias("id"), F.col("stop_lat").alias("lat"), F.col("stop_lon").alias("lon"))
    tags = network.anchor_tags(points, points.filter(F.col("id").cast("int") % 7 == 0))
    return tags.select("stop_id", F.array_join("anchors", "|").alias("anchors"))


def branch_trim(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges, stations = a.grid_edges(spark, sf_dir), a.nation_stations(spark, sf_dir)
    ends = stations.filter("station_id in ('0', '18', '24')").select("station_name").unionByName(spark.createDataFrame([("NOWHERE",)], "station_name string"))
    _, kept = network.trim_branches(stations, edges, ends, all_pairs(edges))
    return kept.withColumn("duration", F.round("duration", 6))


def network_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return viz.network_stats(a.grid_edges(spark, sf_dir), a.nation_stations(spark, sf_dir))


def interchange_stations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return viz.station_flags(a.grid_edges(spark, sf_dir), a.nation_stations(spark, sf_dir)).select("station_id", "n_routes", "has_transfer", "is_interchange")


def plot_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = viz.plot_edges(a.grid_edges(spark, sf_dir), a.nation_stations(spark, sf_dir))
    return rows.select("from_stop", "to_stop", "route_id", "colour", *[F.round(c, 6).alias(c) for c in ("from_lat", "from_lon", "to_lat", "to_lon")])


QUERIES = {
    "transit_edges": transit_edges, "graph_edges": graph_edges, "bus_edges": bus_edges, "headway": _headway(3600.0), "bus_headway": _headway(7200.0),
    "reference_stop": reference_stop, "canonical_pattern": _pattern(False), "longest_pattern": _pattern(True), "weekday_service": weekday_service,
    "resolved_service": resolved_service, "gtfs_time": gtfs_time, "station_collapse": station_collapse, "walking_transfers": walking_transfers,
    "anchor_tags": anchor_tags, "branch_trim": branch_trim, "network_stats": network_stats, "interchange_stations": interchange_stations, "plot_edges": plot_edges,
}

CALLS = """calls AS (SELECT CAST(user_id AS VARCHAR) AS trip_id, event_type AS stop_id, 'R' || (CAST(json_extract_string(props, '$.k') AS INT) % 3) AS route_id,
  epoch_us(ts) / 1e6 AS sec, ts, event_id FROM events)"""
LEGS = "legs AS (SELECT route_id, stop_id AS from_stop, LEAD(stop_id) OVER w AS to_stop, LEAD(sec) OVER w - sec AS secs FROM {} WINDOW w AS (PARTITION BY trip_id ORDER BY ts, event_id))"
TRANSIT = f"""{CALLS}, {LEGS.format("calls")},
directed AS (SELECT from_stop, to_stop, route_id, AVG(secs) AS secs FROM legs WHERE to_stop IS NOT NULL AND to_stop <> from_stop AND secs > 0 GROUP BY ALL),
pairs AS (SELECT LEAST(from_stop, to_stop) AS a, GREATEST(from_stop, to_stop) AS b, route_id, AVG(secs) AS duration FROM directed GROUP BY ALL),
transit AS (SELECT a AS from_stop, b AS to_stop, route_id, duration, 'transit' AS link_type FROM pairs UNION ALL SELECT b, a, route_id, duration, 'transit' FROM pairs)"""


def _headway_sql(limit: int) -> str:
    return f"""WITH {CALLS}, gaps AS (SELECT stop_id, sec - LAG(sec) OVER (PARTITION BY stop_id ORDER BY sec) AS gap FROM calls)
SELECT stop_id, ROUND(MEDIAN(gap) / 60, 6) AS headway_min FROM gaps WHERE gap > 0 AND gap < {limit} GROUP BY stop_id"""


def _pattern_sql(order: str) -> str:
    return f"""WITH trips AS (SELECT conv_id, 'C' || (conv_id % 3) AS route_id, string_agg(role, '|' ORDER BY turn, role) AS signature, COUNT(role) AS n_stops FROM conversations GROUP BY conv_id),
counts AS (SELECT route_id, signature, n_stops, COUNT(*) AS n_matching FROM trips GROUP BY ALL),
ranked AS (SELECT *, SUM(n_matching) OVER (PARTITION BY route_id) AS n_candidate, ROW_NUMBER() OVER (PARTITION BY route_id ORDER BY {order}, signature) AS r FROM counts)
SELECT route_id, signature, CAST(n_stops AS BIGINT) AS n_stops, n_matching, CAST(n_candidate AS BIGINT) AS n_candidate FROM ranked WHERE r = 1"""


WEEKDAY = f"""cal(service_id, mo, tu, we, th, fr, sa, su) AS (VALUES {_values(CALENDAR)}),
trips AS (SELECT o_orderpriority AS route_id, 'S' || (o_orderkey % 4) AS service_id FROM orders),
used AS (SELECT route_id, service_id, COUNT(*) AS n FROM trips WHERE service_id IN (SELECT service_id FROM cal WHERE GREATEST(mo, tu, we, th, fr) = 1 AND sa = 0 AND su = 0) GROUP BY ALL),
weekday AS (SELECT route_id, service_id FROM used QUALIFY ROW_NUMBER() OVER (PARTITION BY route_id ORDER BY n DESC, service_id) = 1)"""

STATIONS = "stations AS (SELECT CAST(n_nationkey AS VARCHAR) AS id, n_name, n_nationkey AS k, -33.86::DOUBLE + 0.003::DOUBLE * (n_nationkey % 5) AS lat, 151.20::DOUBLE + 0.003::DOUBLE * (n_nationkey // 5) AS lon FROM nation)"
METRES = """2 * 6371000 * ATAN2(SQRT(hav), SQRT(1 - hav)) AS metres FROM (SELECT a.id AS a, b.id AS b, b.k AS bk,
  POW(SIN((RADIANS(b.lat) - RADIANS(a.lat)) / 2), 2) + COS(RADIANS(a.lat)) * COS(RADIANS(b.lat)) * POW(SIN(RADIANS(b.lon - a.lon) / 2), 2) AS hav FROM stations a, stations b)"""

FLAGS = """ends AS (SELECT from_stop AS id, route_id, link_type FROM edges UNION ALL SELECT to_stop, route_id, link_type FROM edges),
flags AS (SELECT id AS station_id, COUNT(DISTINCT CASE WHEN link_type <> 'transfer' THEN route_id END) AS n_routes, BOOL_OR(link_type = 'transfer') AS has_transfer FROM ends GROUP BY id)"""

ORACLE_SQL = {
    "transit_edges": f"WITH {TRANSIT} SELECT from_stop, to_stop, route_id, ROUND(duration, 4) AS duration, link_type FROM transit",
    "graph_edges": f"WITH {TRANSIT} SELECT from_stop, to_stop, MAX(route_id) AS route_id, ROUND(ARG_MAX(duration, route_id), 4) AS duration, 'transit' AS link_type FROM transit GROUP BY from_stop, to_stop",
    "bus_edges": f"WITH {CALLS}, {LEGS.format('(SELECT * FROM calls WHERE route_id = ' + chr(39) + 'R1' + chr(39) + ')')} SELECT from_stop, to_stop, ROUND(AVG(secs), 4) AS duration FROM legs WHERE to_stop IS NOT NULL AND secs > 0 GROUP BY ALL",
    "headway": _headway_sql(3600),
    "bus_headway": _headway_sql(7200),
    "reference_stop": f"""WITH {CALLS}, first AS (SELECT * FROM calls QUALIFY ROW_NUMBER() OVER (PARTITION BY trip_id ORDER BY ts, event_id) = 1),
counts AS (SELECT route_id, stop_id, COUNT(*) AS n FROM first GROUP BY ALL) SELECT route_id, stop_id FROM counts QUALIFY ROW_NUMBER() OVER (PARTITION BY route_id ORDER BY n DESC, stop_id) = 1""",
    "canonical_pattern": _pattern_sql("n_matching DESC, n_stops DESC"),
    "longest_pattern": _pattern_sql("n_stops DESC, n_matching DESC"),
    "weekday_service": f"WITH {WEEKDAY} SELECT route_id, service_id FROM weekday",
    "resolved_service": f"""WITH {WEEKDAY}, routes AS (SELECT route_id FROM trips UNION SELECT 'X1' UNION SELECT 'X2')
SELECT route_id, COALESCE(service_id, CASE WHEN route_id = 'X1' THEN 'S9' END, 'weekday') AS service_id FROM routes LEFT JOIN weekday USING (route_id)""",
    "gtfs_time": """WITH v AS (SELECT event_id, CASE event_id % 6 WHEN 0 THEN (hour(ts) + 24) || strftime(ts, ':%M:%S') WHEN 1 THEN ' ' || hour(ts) || ':' || minute(ts) || ':' || second(ts) || ' '
    WHEN 2 THEN strftime(ts, '%H:%M') WHEN 3 THEN strftime(ts, '%H:%M:%S') || ':0' WHEN 4 THEN event_type || strftime(ts, ':%M:%S') ELSE strftime(ts, '%H:%M:%S') END AS t FROM events),
p AS (SELECT event_id, t, string_split(TRIM(t), ':') AS x FROM v)
SELECT event_id, t, CASE WHEN len(x) = 3 THEN TRY_CAST(x[1] AS BIGINT) * 3600 + TRY_CAST(x[2] AS BIGINT) * 60 + TRY_CAST(x[3] AS BIGINT) END AS seconds FROM p""",
    "station_collapse": f"""WITH v(stop_id, stop_name, parent, kind, lat, lon) AS (VALUES {_values(STOPS)}), {STATIONS},
stops AS (SELECT * FROM v UNION ALL SELECT id, nation.n_name, 'G' || n_regionkey, NULL, lat, lon FROM stations JOIN nation ON k = n_nationkey),
keyed AS (SELECT COALESCE(parent, stop_id) AS station_id, TRIM(regexp_replace(stop_name, ',\\s*Platform\\s*\\d+$', '')) AS name, CASE WHEN kind = 1 THEN '0' ELSE '1' END || stop_id AS r, lat::DOUBLE AS lat, lon::DOUBLE AS lon FROM stops)
SELECT station_id, ARG_MIN(name, r) AS station_name, ROUND(AVG(lat), 6) AS stop_lat, ROUND(AVG(lon), 6) AS stop_lon FROM keyed GROUP BY station_id""",
    "walking_transfers": f"""WITH {a.GRID}, {STATIONS}, pairs AS (SELECT a, b, {METRES}),
free AS (SELECT a, b, metres / 1.2::DOUBLE AS duration FROM pairs WHERE a < b AND metres <= 500 AND NOT EXISTS (SELECT 1 FROM edges WHERE (from_stop = a AND to_stop = b) OR (from_stop = b AND to_stop = a)))
SELECT a AS from_stop, b AS to_stop, 'walk' AS route_id, ROUND(duration, 6) AS duration, 'transfer' AS link_type FROM free
UNION ALL SELECT b, a, 'walk', ROUND(duration, 6), 'transfer' FROM free""",
    "anchor_tags": f"WITH {STATIONS}, pairs AS (SELECT a, b, bk, {METRES}) SELECT a AS stop_id, string_agg(b, '|' ORDER BY b) AS anchors FROM pairs WHERE bk % 7 = 0 AND metres <= 500 GROUP BY a",
    "branch_trim": a.with_(a.GRID, a.WALKS) + """, ends AS (SELECT from_stop AS id FROM edges UNION ALL SELECT to_stop FROM edges),
hub AS (SELECT id FROM ends GROUP BY id ORDER BY COUNT(*) DESC, id LIMIT 1),
best AS (SELECT path FROM paths WHERE origin = (SELECT id FROM hub) AND dest IN ('0', '18', '24') QUALIFY ROW_NUMBER() OVER (PARTITION BY dest ORDER BY seconds, path_text) = 1),
kept AS (SELECT DISTINCT UNNEST(path) AS id FROM best UNION SELECT id FROM hub WHERE id IN ('0', '18', '24'))
SELECT from_stop, to_stop, route_id, ROUND(duration, 6) AS duration, link_type FROM edges WHERE from_stop IN (SELECT id FROM kept) AND to_stop IN (SELECT id FROM kept)""",
    "network_stats": f"""WITH {a.GRID}, {FLAGS} SELECT COUNT(*) FILTER (link_type <> 'transfer') AS transit_links, COUNT(*) FILTER (link_type = 'transfer') AS walking_links,
COUNT(DISTINCT CASE WHEN link_type <> 'transfer' THEN route_id END) AS routes, (SELECT COUNT(*) FROM nat) AS stations, (SELECT COUNT(*) FROM flags WHERE n_routes > 1) AS interchanges FROM edges""",
    "interchange_stations": f"WITH {a.GRID}, {FLAGS} SELECT station_id, n_routes, has_transfer, n_routes > 1 AS is_interchange FROM flags",
    "plot_edges": f"""WITH {a.GRID}, {STATIONS}, colours AS (SELECT route_id, [{", ".join(f"'{c}'" for c in viz.PALETTE)}][1 + ((ROW_NUMBER() OVER (ORDER BY route_id) - 1) % {len(viz.PALETTE)})::INT] AS colour
  FROM (SELECT DISTINCT route_id FROM edges WHERE link_type <> 'transfer'))
SELECT from_stop, to_stop, edges.route_id, colour, ROUND(f.lat, 6) AS from_lat, ROUND(f.lon, 6) AS from_lon, ROUND(t.lat, 6) AS to_lat, ROUND(t.lon, 6) AS to_lon
FROM edges JOIN stations f ON f.id = from_stop JOIN stations t ON t.id = to_stop LEFT JOIN colours ON colours.route_id = edges.route_id""",
}
ORACLE_SQL["branch_trim"] = ORACLE_SQL["branch_trim"].replace("\n, ends", ",\nends")
