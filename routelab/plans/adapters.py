"""Domain tables made from the driver's tables, in Spark and, for oracles, as DuckDB common table expressions.

The grid network has a station for each nation, five a row: a line along each row, two lines that join the rows' ends, and two walking
links. Durations are means over all line items between two nations. It is small by construction, as transit networks are, so its edges
are staged once for each query.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from routelab.config import TRUE_BETAS
from routelab.operators.graph import simple_paths
from routelab.operators.network import mirrored
from routelab.operators.paths import choice_table
from routelab.staging import staged


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def event_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as calls: trip (user), stop (type), route, arrival and departure seconds, and the order columns ts and event_id."""
    at = F.unix_micros(F.col("ts").cast("timestamp")) / 1e6
    route = F.concat(F.lit("R"), (F.get_json_object("props", "$.k").cast("int") % 3).cast("string"))
    return table(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("trip_id"), F.col("event_type").alias("stop_id"), route.alias("route_id"), at.alias("arrival"), at.alias("departure"), "ts", "event_id")


def nation_trips(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row a line item: origin (customer's nation), dest (supplier's nation) and quantity."""
    lines, orders = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey", "l_quantity"), table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    customers, suppliers = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey"), table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey")
    joined = lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).join(customers, F.col("o_custkey") == F.col("c_custkey")).join(suppliers, F.col("l_suppkey") == F.col("s_suppkey"))
    return joined.select(F.col("c_nationkey").alias("origin"), F.col("s_nationkey").alias("dest"), F.col("l_quantity").alias("quantity"))


def nation_stations(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("n_nationkey")
    return table(spark, sf_dir, "nation").select(k.cast("string").alias("station_id"), F.col("n_name").alias("station_name"), (F.lit(-33.86) + 0.003 * (k % 5)).alias("stop_lat"), (F.lit(151.20) + 0.003 * F.floor(k / 5)).alias("stop_lon"))


def grid_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("station_id").cast("int")
    nodes = nation_stations(spark, sf_dir).select(k.alias("k"), (k % 5).alias("x"), F.floor(k / 5).cast("int").alias("y"))
    a, b = nodes.toDF("a", "ax", "ay"), nodes.toDF("b", "bx", "by")
    near = ((F.col("ay") == F.col("by")) & (F.col("bx") - F.col("ax") == 1)) | ((F.col("ax") == F.col("bx")) & F.col("ax").isin(0, 4) & (F.col("by") - F.col("ay") == 1))
    mean = nation_trips(spark, sf_dir).groupBy(F.col("origin").alias("a"), F.col("dest").alias("b")).agg(F.avg("quantity").alias("q"))
    links = a.join(b, (F.col("a") < F.col("b")) & near).join(mean, ["a", "b"], "left")
    route = F.when(F.col("ay") == F.col("by"), F.concat(F.lit("H"), F.col("ay").cast("string"))).otherwise(F.concat(F.lit("V"), F.col("ax").cast("string")))
    duration = 120.0 * F.coalesce("q", F.lit(25.0)) + 240.0 * ((F.col("a") + F.col("b")) % 5)
    transit = links.select(F.col("a").cast("string").alias("from_stop"), F.col("b").cast("string").alias("to_stop"), route.alias("route_id"), duration.alias("duration"), F.lit("transit").alias("link_type"))
    walks = spark.createDataFrame([("0", "6", "walk", 1800.0, "transfer"), ("6", "12", "walk", 1800.0, "transfer")], transit.schema)
    return staged(mirrored(transit.unionByName(walks)).coalesce(1), "grid")


def part_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A network that grows with the tables: parts are stops, orders trips that call at their lines' parts in turn, times are means.

    Lines of an order that share number and part come in the table's order, however its files are split and shuffled.
    """
    order = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "_metadata.file_path", "_metadata.row_index")
    legs = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("a"), F.lead("l_partkey").over(order).alias("b"), (60.0 + 10.0 * F.col("l_quantity")).alias("d"))
    mean = legs.filter("b is not null and a <> b").groupBy("a", "b").agg(F.avg("d").alias("duration"))
    return staged(mean.select(F.col("a").cast("string").alias("from_stop"), F.col("b").cast("string").alias("to_stop"), "duration"), "parts")


def grid_headways(edges: DataFrame) -> DataFrame:
    return edges.filter("link_type <> 'transfer'").select("route_id", (6.0 + 2.0 * F.substring("route_id", 2, 1).cast("int")).alias("headway_min")).distinct()


def grid_paths(edges: DataFrame) -> DataFrame:
    return staged(simple_paths(edges), "paths")


def grid_choices(edges: DataFrame, paths: DataFrame) -> DataFrame:
    return choice_table(paths, edges, grid_headways(edges), ["origin", "dest"], TRUE_BETAS)


# --- DuckDB ----------------------------------------------------------------------------------------------------------------

GRID = """nat AS (SELECT n_nationkey AS k, n_nationkey % 5 AS x, n_nationkey // 5 AS y FROM nation),
legs_ AS (SELECT c_nationkey AS origin, s_nationkey AS dest, l_quantity AS quantity FROM lineitem JOIN orders ON l_orderkey = o_orderkey
  JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey),
mean_q AS (SELECT origin AS a, dest AS b, AVG(quantity) AS q FROM legs_ GROUP BY ALL),
oneway AS (SELECT CAST(m.k AS VARCHAR) AS from_stop, CAST(n.k AS VARCHAR) AS to_stop, CASE WHEN m.y = n.y THEN 'H' || m.y ELSE 'V' || m.x END AS route_id,
    120::DOUBLE * COALESCE(q, 25::DOUBLE) + 240::DOUBLE * ((m.k + n.k) % 5) AS duration, 'transit' AS link_type
  FROM nat m JOIN nat n ON m.k < n.k AND ((m.y = n.y AND n.x - m.x = 1) OR (m.x = n.x AND m.x IN (0, 4) AND n.y - m.y = 1)) LEFT JOIN mean_q ON mean_q.a = m.k AND mean_q.b = n.k
  UNION ALL SELECT '0', '6', 'walk', 1800::DOUBLE, 'transfer' UNION ALL SELECT '6', '12', 'walk', 1800::DOUBLE, 'transfer'),
edges AS (SELECT * FROM oneway UNION ALL SELECT to_stop, from_stop, route_id, duration, link_type FROM oneway),
headway AS (SELECT DISTINCT route_id, 6::DOUBLE + 2 * CAST(SUBSTR(route_id, 2, 1) AS INT) AS headway_min FROM edges WHERE link_type <> 'transfer')"""

WALKS = """walk AS (SELECT from_stop AS origin, to_stop AS dest, [from_stop, to_stop] AS path, duration AS seconds FROM edges
  UNION ALL SELECT walk.origin, e.to_stop, list_append(walk.path, e.to_stop), walk.seconds + e.duration FROM walk JOIN edges e ON walk.dest = e.from_stop
  WHERE NOT list_contains(walk.path, e.to_stop)),
paths AS (SELECT origin, dest, path, seconds, array_to_string(path, '|') AS path_text FROM walk)"""

LINKS = """spread AS (SELECT origin, dest, path_text, len(path) AS n, UNNEST(range(1, len(path))) AS step, path FROM paths),
links AS (SELECT s.origin, s.dest, s.path_text, s.step, s.path[s.step] AS u, s.path[s.step + 1] AS v, s.n, e.route_id, e.duration, e.link_type FROM spread s
  JOIN edges e ON e.from_stop = s.path[s.step] AND e.to_stop = s.path[s.step + 1])"""

COMPONENTS = """lagged AS (SELECT links.*, LAG(CASE WHEN link_type <> 'transfer' THEN route_id END) OVER (PARTITION BY origin, dest, path_text ORDER BY step) AS before FROM links),
boarded AS (SELECT lagged.*, link_type <> 'transfer' AND (before IS NULL OR before <> lagged.route_id) AS boards, COALESCE(headway_min, 10::DOUBLE) AS h
  FROM lagged LEFT JOIN headway ON lagged.route_id = headway.route_id),
parts AS (SELECT origin, dest, path_text, SUM(CASE WHEN link_type <> 'transfer' THEN duration ELSE 0 END) / 60 AS ivt_min,
  CAST(SUM(CASE WHEN boards THEN h / 2 ELSE 0 END) AS DOUBLE) AS wait_min, CAST(SUM(CASE WHEN link_type = 'transfer' THEN duration ELSE 0 END) / 60 AS DOUBLE) AS walk_min,
  CAST(GREATEST(0, SUM(CASE WHEN boards THEN 1 ELSE 0 END) - 1) AS BIGINT) AS n_transfers, SUM(duration) AS seconds, ANY_VALUE(n) AS n_stops FROM boarded GROUP BY ALL)"""

SIZES = """shared AS (SELECT origin, dest, path_text, duration / SUM(duration) OVER (PARTITION BY origin, dest, path_text) / COUNT(*) OVER (PARTITION BY origin, dest, u, v, duration) AS part FROM links),
sizes AS (SELECT origin, dest, path_text, SUM(part) AS path_size FROM shared GROUP BY ALL)"""

CHOICES = """valued AS (SELECT parts.*, path_size, LN(GREATEST(path_size, 1e-9)) - (0.025 * ivt_min + 0.05 * wait_min + 0.035 * walk_min + 0.4 * n_transfers) AS utility
  FROM parts JOIN sizes USING (origin, dest, path_text)),
exped AS (SELECT *, EXP(utility - MAX(utility) OVER (PARTITION BY origin, dest)) AS e FROM valued),
choices AS (SELECT *, e / SUM(e) OVER (PARTITION BY origin, dest) AS probability FROM exped)"""

TIMES = "times AS (SELECT origin, dest, MIN(seconds) AS seconds FROM paths GROUP BY ALL UNION ALL SELECT CAST(k AS VARCHAR), CAST(k AS VARCHAR), 0 FROM nat)"

OD = "od AS (SELECT CAST(origin AS VARCHAR) AS origin, CAST(dest AS VARCHAR) AS dest, CAST(COUNT(*) AS DOUBLE) AS total_trips FROM legs_ GROUP BY ALL)"


def uniform(*parts: str) -> str:
    """DuckDB SQL of functions.scalar.hashed_uniform."""
    return f"(('0x' || SUBSTR(MD5(CONCAT_WS(':', {', '.join(parts)})), 1, 8))::BIGINT + 0.5) / 4294967296::DOUBLE"


def with_(*tables: str) -> str:
    return "WITH RECURSIVE " + ",\n".join(tables) + "\n"
