"""Queries on demand, shortest times and origin-destination tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from routelab.functions.scalar import ridership_count, single_spaced
from routelab.operators import demand, graph
from routelab.plans import adapters as a

#: Station, kind and count as an entry-exit file has them.
ENTRY_EXIT = [
    ("ALGERIA", "Entry", "1,234"), ("ALGERIA", "Exit", "Less than 50"), ("  EGYPT ", "Entry", "77"), ("UNITED   KINGDOM", "Entry", "2,000,000"), ("UNITED KINGDOM", "Exit", "junk"),
    ("UNITED KINGDOM", "Entry", "5"), ("CHINA", "Exit", None), ("ATLANTIS", "Entry", "9"), ("NATION_1", "Entry", "1,001"), ("NATION_1", "Exit", "Less than 50"), ("NATION_2", "Entry", "12"),
]


def _stations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return a.nation_stations(spark, sf_dir).select("station_id", "station_name")


def _rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The literal rows, and one of each kind for every nation, named as the table names it."""
    raw = spark.createDataFrame(ENTRY_EXIT, "Station string, Entry_Exit string, Trip string")
    nations = a.table(spark, sf_dir, "nation").select(F.concat(F.lit(" "), "n_name", F.lit("  ")).alias("Station"), F.lit("Entry").alias("Entry_Exit"), F.concat((F.col("n_nationkey") + 1).cast("string"), F.lit(",000")).alias("Trip"))
    both = raw.unionByName(nations)
    return both.select(single_spaced("Station").alias("station_name"), F.col("Entry_Exit").alias("kind"), ridership_count("Trip").alias("trips"))


def demand_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    return demand.entry_exit_demand(_rows(spark, sf_dir), _stations(spark, sf_dir))


def demand_missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stations that the literal rows don't name."""
    raw = spark.createDataFrame(ENTRY_EXIT, "Station string, Entry_Exit string, Trip string").select(single_spaced("Station").alias("station_name"))
    return demand.stations_without_demand(raw, _stations(spark, sf_dir))


def counted_ends(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Orders by their customer's nation and line items by their supplier's: station_name and trips."""
    names = a.table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("k"), F.col("n_name").alias("station_name"))
    orders = a.table(spark, sf_dir, "orders").join(a.table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    lines = a.table(spark, sf_dir, "lineitem").join(a.table(spark, sf_dir, "supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
    entries = orders.groupBy("c_nationkey").agg(F.count("*").cast("double").alias("trips")).join(names, F.col("c_nationkey") == F.col("k"))
    exits = lines.groupBy("s_nationkey").agg(F.count("*").cast("double").alias("trips")).join(names, F.col("s_nationkey") == F.col("k"))
    return entries.select("station_name", "trips"), exits.select("station_name", "trips")


def demand_outer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each table has a name that the other lacks."""
    entries, exits = counted_ends(spark, sf_dir)
    one = lambda name, trips: spark.sql(f"SELECT '{name}' AS station_name, {trips}D AS trips")
    stations = _stations(spark, sf_dir).unionByName(spark.sql("SELECT * FROM VALUES ('x', 'ATLANTIS'), ('y', 'MU'), ('z', 'THULE') v(station_id, station_name)"))
    return demand.ridership_demand(entries.unionByName(one("ATLANTIS", 3)), exits.unionByName(one("MU", 4)), stations)


def named_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items by customer's and supplier's nation: origin, destination (names) and trips."""
    names = a.table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("k"), F.col("n_name"))
    trips = a.nation_trips(spark, sf_dir).groupBy("origin", "dest").agg(F.count("*").cast("double").alias("trips"))
    rows = trips.join(names.toDF("origin", "o_name"), "origin").join(names.toDF("dest", "d_name"), "dest")
    return rows.select(F.col("o_name").alias("origin"), F.col("d_name").alias("destination"), "trips")


def od_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return demand.measured_od(named_pairs(spark, sf_dir), _stations(spark, sf_dir))


def all_pairs_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = graph.all_pairs(a.grid_edges(spark, sf_dir))
    return found.select("origin", "dest", F.round("seconds", 6).alias("seconds"))


def min_plus_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.min_plus_times(a.grid_edges(spark, sf_dir)).select("origin", "dest", F.round("seconds", 6).alias("seconds"))


def gravity_od(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries are orders by customer's nation, exits line items by supplier's nation, times those of the grid."""
    times = graph.all_pairs(a.grid_edges(spark, sf_dir)).select("origin", "dest", "seconds")
    orders = a.table(spark, sf_dir, "orders").join(a.table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    lines = a.table(spark, sf_dir, "lineitem").join(a.table(spark, sf_dir, "supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
    entries = orders.groupBy(F.col("c_nationkey").cast("string").alias("station_id")).agg(F.count("*").cast("double").alias("total_entries"))
    exits = lines.groupBy(F.col("s_nationkey").cast("string").alias("station_id")).agg(F.count("*").cast("double").alias("total_exits"))
    od = demand.gravity_od(entries.join(exits, "station_id"), times)
    return od.withColumn("total_trips", F.round("total_trips", 6))


QUERIES = {
    "demand_pivot": demand_pivot, "demand_missing": demand_missing, "demand_outer": demand_outer, "od_matrix": od_matrix, "all_pairs_time": all_pairs_time,
    "min_plus_time": min_plus_time, "gravity_od": gravity_od,
}

_VALUES = ", ".join("(" + ", ".join("NULL" if x is None else f"'{x}'" for x in row) + ")" for row in ENTRY_EXIT)
_TOTALS = "SELECT CAST(n_nationkey AS VARCHAR) AS station_id, n_name AS station_name, total_entries, total_exits, total_entries + total_exits AS total_demand FROM nation LEFT JOIN totals ON n_name = name"
_GRAVITY = """o AS (SELECT CAST(c_nationkey AS VARCHAR) AS id, COUNT(*)::DOUBLE AS o FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY ALL),
d AS (SELECT CAST(s_nationkey AS VARCHAR) AS id, COUNT(*)::DOUBLE AS d FROM lineitem JOIN supplier ON l_suppkey = s_suppkey GROUP BY ALL),
known AS (SELECT id, o, d FROM o JOIN d USING (id) WHERE id IN (SELECT origin FROM times)),
seed AS (SELECT i.id AS i, j.id AS j, i.o, j.d, CASE WHEN i.id = j.id THEN 0 ELSE COALESCE(EXP(-0.05::DOUBLE * seconds / 60), 0) END * i.o * j.d AS t
  FROM known i, known j LEFT JOIN times ON origin = i.id AND dest = j.id),
ipf AS (SELECT 0 AS n, i, j, o, d, t::DOUBLE AS t FROM seed
  UNION ALL SELECT n + 1, i, j, o, d, r * d / COALESCE(NULLIF(SUM(r) OVER (PARTITION BY j), 0), 1)
  FROM (SELECT n, i, j, o, d, t * o / COALESCE(NULLIF(SUM(t) OVER (PARTITION BY i), 0), 1) AS r FROM ipf WHERE n < 15) x),
final AS (SELECT i, j, t * 18000 / SUM(t) OVER () AS trips FROM ipf WHERE n = 15)"""

ORACLE_SQL = {
    "demand_pivot": f"""WITH raw(station, kind, trip) AS (VALUES {_VALUES}), all_ AS (SELECT * FROM raw UNION ALL SELECT ' ' || n_name || '  ', 'Entry', (n_nationkey + 1) || ',000' FROM nation),
clean AS (SELECT TRIM(regexp_replace(station, '\\s+', ' ', 'g')) AS name, kind, CASE WHEN TRIM(trip) = 'Less than 50' THEN 25 ELSE TRY_CAST(REPLACE(TRIM(trip), ',', '') AS DOUBLE) END AS x FROM all_),
totals AS (SELECT name, COALESCE(SUM(x) FILTER (kind = 'Entry'), 0)::DOUBLE AS total_entries, COALESCE(SUM(x) FILTER (kind = 'Exit'), 0)::DOUBLE AS total_exits FROM clean GROUP BY name) {_TOTALS}""",
    "demand_missing": f"""WITH raw(station, kind, trip) AS (VALUES {_VALUES}) SELECT CAST(n_nationkey AS VARCHAR) AS station_id, n_name AS station_name FROM nation
WHERE n_name NOT IN (SELECT TRIM(regexp_replace(station, '\\s+', ' ', 'g')) FROM raw)""",
    "demand_outer": f"""WITH e AS (SELECT n_name AS name, COUNT(*)::DOUBLE AS x FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY ALL UNION ALL SELECT 'ATLANTIS', 3),
f AS (SELECT n_name AS name, COUNT(*)::DOUBLE AS y FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey GROUP BY ALL UNION ALL SELECT 'MU', 4),
totals AS (SELECT name, COALESCE(x, 0)::DOUBLE AS total_entries, COALESCE(y, 0)::DOUBLE AS total_exits FROM e FULL JOIN f USING (name))
SELECT id AS station_id, station AS station_name, total_entries, total_exits, total_entries + total_exits AS total_demand
FROM (SELECT CAST(n_nationkey AS VARCHAR) AS id, n_name AS station FROM nation UNION ALL VALUES ('x', 'ATLANTIS'), ('y', 'MU'), ('z', 'THULE')) LEFT JOIN totals ON station = name""",
    "od_matrix": f"""WITH {a.GRID} SELECT CAST(origin AS VARCHAR) AS origin_station_id, CAST(dest AS VARCHAR) AS dest_station_id, COUNT(*)::DOUBLE AS total_trips, o.n_name AS origin_station_name, d.n_name AS dest_station_name
FROM legs_ JOIN nation o ON o.n_nationkey = origin JOIN nation d ON d.n_nationkey = dest GROUP BY ALL""",
    "all_pairs_time": a.with_(a.GRID, a.WALKS, a.TIMES) + "SELECT origin, dest, ROUND(seconds, 6) AS seconds FROM times",
    "gravity_od": a.with_(a.GRID, a.WALKS, a.TIMES, _GRAVITY) + "SELECT i AS origin_station_id, j AS dest_station_id, ROUND(trips, 6) AS total_trips FROM final WHERE trips >= 0.5 AND i <> j",
}
ORACLE_SQL["min_plus_time"] = ORACLE_SQL["all_pairs_time"]
