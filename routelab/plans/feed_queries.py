"""Queries over schedule and ridership files: orders as a feed, written as its text files and read back through the readers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from routelab.functions.scalar import TRANSIT
from routelab.operators import demand, gtfs, network
from routelab.plans import adapters as a
from routelab.plans import demand_queries, network_queries
from routelab.sources import tables
from routelab.staging import fresh_uri

#: Route, headsign and service as a city's configuration has them; FILTER holds for routes without a service.
ROUTES = [("1-URGENT", "F", None), ("2-HIGH", "O", None), ("3-MEDIUM", None, "S1"), ("4-NOT SPECIFIED", None, None), ("5-LOW", "P", "S3")]
FILTER, LONGEST = "S2", ["4-NOT SPECIFIED"]


def _clock(second: Column) -> Column:
    return F.format_string("%02d:%02d:%02d", F.floor(second / 3600), F.floor(second / 60) % 60, second % 60)


def feed(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """Every order a trip, every line item a call at one of five stops: written as text files, read as a feed."""
    folder, key = fresh_uri(spark, "feed"), F.col("o_orderkey")
    trips = a.table(spark, sf_dir, "orders").select(key.alias("trip_id"), F.col("o_orderpriority").alias("route_id"), F.concat(F.lit("S"), (key % 4).cast("string")).alias("service_id"), F.col("o_orderstatus").alias("trip_headsign"))
    lines, suppliers = a.table(spark, sf_dir, "lineitem"), a.table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey")
    at = _clock(F.col("l_orderkey") * 37 % 100_000 + 300 * F.col("l_linenumber"))
    calls = lines.join(suppliers, F.col("l_suppkey") == F.col("s_suppkey")).select(F.col("l_orderkey").alias("trip_id"), (F.col("s_nationkey") % 5).alias("stop_id"), F.col("l_linenumber").alias("stop_sequence"), at.alias("arrival_time"), at.alias("departure_time"))
    stops = a.nation_stations(spark, sf_dir).select(F.col("station_id").alias("stop_id"), F.col("station_name").alias("stop_name"), "stop_lat", "stop_lon")
    for name, df in (("trips", trips), ("stop_times", calls), ("stops", stops), ("routes", trips.select("route_id").distinct())):
        tables.write_table(df, f"{folder}/{name}.txt", "csv")
    return tables.read_gtfs(spark, folder)


def _routes(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(ROUTES, "route_id string, headsign string, service_id string")


def gtfs_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each of the feed's files holds once it has been read."""
    f = feed(spark, sf_dir)
    calls = f["stop_times"].agg(F.count("*"), F.count_distinct("trip_id"), F.sum("stop_sequence").cast("double"), F.sum(gtfs.gtfs_seconds("departure_time")).cast("double"))
    trips = f["trips"].agg(F.count("*"), F.count_distinct("route_id", "service_id", "trip_headsign"), F.sum(F.col("trip_id").cast("double")), F.lit(0.0))
    stops = f["stops"].agg(F.count("*"), F.count_distinct("stop_name"), F.round(F.sum("stop_lat"), 6), F.round(F.sum("stop_lon"), 6))
    rows = [df.toDF("n", "n_distinct", "x", "y").select(F.lit(name).alias("file"), "*") for name, df in (("stop_times", calls), ("trips", trips), ("stops", stops))]
    return rows[0].unionByName(rows[1]).unionByName(rows[2])


def canonical_trips(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = feed(spark, sf_dir)
    return gtfs.canonical_trips(f["trips"], f["stop_times"], _routes(spark), FILTER, LONGEST)[0]


def reference_stops(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = feed(spark, sf_dir)
    return gtfs.reference_stops(f["trips"], f["stop_times"], _routes(spark))


def headway_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of every route: the median at its reference stop, the default where it has none."""
    f = feed(spark, sf_dir)
    found = gtfs.route_headways(f["trips"], f["stop_times"], _routes(spark))
    return gtfs.headway_table(f["trips"], found).withColumn("headway_min", F.round("headway_min", 6))


def supernetwork(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The grid's transit edges with walking links between all near stations."""
    metro = a.grid_edges(spark, sf_dir).filter(F.col("link_type") == TRANSIT)
    return network.build_supernetwork(a.nation_stations(spark, sf_dir), metro)[1].withColumn("duration", F.round("duration", 6))


def _ridership_files(spark: SparkSession, sf_dir: str) -> str:
    """Entries and exits by station, and trips by pair, as the ridership files have them."""
    folder = fresh_uri(spark, "ridership")
    entries, exits = demand_queries.counted_ends(spark, sf_dir)
    kinds = [(df.select("station_name", F.lit(kind).alias("Entry_Exit"), "trips")) for kind, df in (("Entry", entries), ("Exit", exits))]
    count = F.when(F.col("trips") < 50, "Less than 50").otherwise(F.format_number("trips", 0))
    tables.write_table(kinds[0].unionByName(kinds[1]).select(F.col("station_name").alias("Station"), "Entry_Exit", count.alias("Trip")), f"{folder}/entry_exit.csv", "csv")
    for name, df in (("entries", entries), ("exits", exits)):
        tables.write_table(df.select(F.col("station_name").alias("Station"), F.col("trips").alias("Ridership")), f"{folder}/{name}.csv", "csv", ";")
    pairs = demand_queries.named_pairs(spark, sf_dir).select(F.col("origin").alias("Origin Station"), F.col("destination").alias("Destination Station"), F.col("trips").alias("Ridership"))
    tables.write_table(pairs, f"{folder}/pairs.csv", "csv", ";")
    return folder


def ridership_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder, none = _ridership_files(spark, sf_dir), F.lit(None).cast("string")
    rows = tables.read_entry_exit(spark, f"{folder}/entry_exit.csv").select(F.col("kind").alias("file"), F.col("station_name").alias("origin"), none.alias("destination"), "trips")
    for name in ("entries", "exits"):
        rows = rows.unionByName(tables.read_ridership(spark, f"{folder}/{name}.csv").select(F.lit(name).alias("file"), F.col("station_name").alias("origin"), none.alias("destination"), "trips"))
    return rows.unionByName(tables.read_station_pairs(spark, f"{folder}/pairs.csv").select(F.lit("pairs").alias("file"), "origin", "destination", "trips"))


def demand_dispatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Measured pairs of a city with ridership files, with the demand of each pair's origin."""
    folder, stations = _ridership_files(spark, sf_dir), a.nation_stations(spark, sf_dir).select("station_id", "station_name")
    read = {name: tables.read_ridership(spark, f"{folder}/{name}.csv") for name in ("entries", "exits")}
    known, od = demand.load_demand("ridership", stations, **read, pairs=tables.read_station_pairs(spark, f"{folder}/pairs.csv"))
    return od.join(known.select(F.col("station_id").alias("origin_station_id"), "total_demand"), "origin_station_id", "left").select("origin_station_id", "dest_station_id", "total_trips", "total_demand")


def calendar_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A calendar file read back, with what runs on weekdays only: a service runs on the days that have at least its mean of orders."""
    folder, key = fresh_uri(spark, "calendar"), F.col("o_orderkey")
    days = a.table(spark, sf_dir, "orders").groupBy(F.concat(F.lit("S"), (key % 40).cast("string")).alias("service_id"), F.dayofweek("o_orderdate").alias("day")).agg(F.count("*").alias("n"))
    total = days.groupBy("service_id").agg(F.sum("n").alias("all"), *[F.coalesce(F.sum(F.when(F.col("day") == k, F.col("n"))), F.lit(0)).alias(f"d{k}") for k in range(1, 8)])
    names = [(d, 2 + k if k < 6 else 1) for k, d in enumerate(tables.DAYS)]
    tables.write_table(total.select("service_id", *[(F.col(f"d{k}") * 7 >= F.col("all")).cast("int").alias(d) for d, k in names]), f"{folder}/calendar.txt", "csv")
    return tables.read_calendar(spark, folder).withColumn("weekdays_only", gtfs.runs_on_weekdays_only())


def filtered_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calls of the trips with one headsign alone, by route and stop: the semi-join of a filtered scan."""
    f = feed(spark, sf_dir)
    trips = f["trips"].filter("trip_headsign = 'F'")
    calls = tables.trip_stop_times(f["stop_times"], trips).join(trips.select("trip_id", "route_id"), "trip_id")
    return calls.groupBy("route_id", "stop_id").agg(F.count("*").alias("n_calls"), F.min("departure_time").alias("first_departure"))


def processed_headways(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The headway table written as a processed file and read back; no file is an empty table."""
    folder = fresh_uri(spark, "processed")
    tables.write_table(headway_table(spark, sf_dir), f"{folder}/headways", "csv")
    return tables.read_headways(spark, f"{folder}/headways").unionByName(tables.read_headways(spark, f"{folder}/absent"))


QUERIES = {
    "gtfs_scan": gtfs_scan, "canonical_trips": canonical_trips, "reference_stops": reference_stops, "headway_table": headway_table, "supernetwork": supernetwork,
    "ridership_scans": ridership_scans, "demand_dispatch": demand_dispatch, "calendar_scan": calendar_scan,
    "filtered_calls": filtered_calls, "processed_headways": processed_headways,
}

_ROUTES = ", ".join("(" + ", ".join("NULL" if x is None else f"'{x}'" for x in row) + ")" for row in ROUTES)
FEED = f"""WITH trips_ AS (SELECT CAST(o_orderkey AS VARCHAR) AS trip_id, o_orderpriority AS route_id, 'S' || (o_orderkey % 4) AS service_id, o_orderstatus AS trip_headsign FROM orders),
calls_ AS (SELECT CAST(l_orderkey AS VARCHAR) AS trip_id, l_linenumber AS seq, CAST(s_nationkey % 5 AS VARCHAR) AS stop_id, l_orderkey * 37 % 100000 + 300 * l_linenumber AS sec FROM lineitem JOIN supplier ON l_suppkey = s_suppkey),
routes_(route_id, headsign, own) AS (VALUES {_ROUTES})"""
CANONICAL = f"""chosen AS (SELECT trip_id, t.route_id FROM trips_ t JOIN routes_ r ON t.route_id = r.route_id WHERE (headsign IS NULL OR trip_headsign = headsign) AND service_id = COALESCE(own, '{FILTER}')),
sig AS (SELECT trip_id, string_agg(stop_id, '|' ORDER BY seq, stop_id) AS signature, COUNT(*) AS n_stops FROM calls_ GROUP BY trip_id),
counted AS (SELECT route_id, signature, n_stops, COUNT(*) AS n FROM chosen JOIN sig USING (trip_id) GROUP BY ALL),
best AS (SELECT route_id, signature FROM counted QUALIFY ROW_NUMBER() OVER (PARTITION BY route_id ORDER BY CASE WHEN route_id = '{LONGEST[0]}' THEN n_stops ELSE n END DESC,
  CASE WHEN route_id = '{LONGEST[0]}' THEN n ELSE n_stops END DESC, signature) = 1)"""
REFERENCE = """ref AS (SELECT r.route_id, stop_id FROM calls_ JOIN trips_ t USING (trip_id) JOIN routes_ r ON t.route_id = r.route_id WHERE seq = 1 AND trip_headsign = headsign
  GROUP BY r.route_id, stop_id QUALIFY ROW_NUMBER() OVER (PARTITION BY r.route_id ORDER BY COUNT(*) DESC, stop_id) = 1)"""
HEADWAYS = """gaps AS (SELECT t.route_id, sec - LAG(sec) OVER (PARTITION BY t.route_id ORDER BY sec) AS gap FROM calls_ JOIN trips_ t USING (trip_id) JOIN routes_ r ON t.route_id = r.route_id
  JOIN ref ON ref.route_id = t.route_id AND ref.stop_id = calls_.stop_id WHERE trip_headsign = headsign AND (own IS NULL OR service_id = own)),
median AS (SELECT route_id, MEDIAN(gap) / 60 AS m FROM gaps WHERE gap > 0 AND gap < 3600 GROUP BY route_id)"""
_ENDS = """e AS (SELECT n_name AS name, COUNT(*)::DOUBLE AS x FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY ALL),
f AS (SELECT n_name AS name, COUNT(*)::DOUBLE AS x FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey GROUP BY ALL)"""
_PAIRS = "p AS (SELECT o.n_name AS origin, d.n_name AS destination, origin AS i, dest AS j, COUNT(*)::DOUBLE AS x FROM legs_ JOIN nation o ON o.n_nationkey = origin JOIN nation d ON d.n_nationkey = dest GROUP BY ALL)"

ORACLE_SQL = {
    "supernetwork": f"""WITH {a.GRID}, {network_queries.STATIONS}, transit AS (SELECT * FROM edges WHERE link_type = 'transit'), pairs AS (SELECT a, b, {network_queries.METRES}),
free AS (SELECT a, b, metres / 1.2::DOUBLE AS duration FROM pairs WHERE a <> b AND metres <= 500 AND NOT EXISTS (SELECT 1 FROM transit WHERE from_stop = a AND to_stop = b))
SELECT from_stop, to_stop, route_id, ROUND(duration, 6) AS duration, link_type FROM transit UNION ALL SELECT a, b, 'walk', ROUND(duration, 6), 'transfer' FROM free""",
    "gtfs_scan": f"""{FEED} SELECT 'stop_times' AS file, COUNT(*) AS n, COUNT(DISTINCT trip_id) AS n_distinct, SUM(seq)::DOUBLE AS x, SUM(sec)::DOUBLE AS y FROM calls_
UNION ALL SELECT 'trips', COUNT(*), COUNT(DISTINCT (route_id, service_id, trip_headsign)), SUM(trip_id::DOUBLE), 0 FROM trips_
UNION ALL SELECT 'stops', COUNT(*), COUNT(DISTINCT n_name), ROUND(SUM(-33.86::DOUBLE + 0.003::DOUBLE * (n_nationkey % 5)), 6), ROUND(SUM(151.20::DOUBLE + 0.003::DOUBLE * (n_nationkey // 5)), 6) FROM nation""",
    "canonical_trips": f"{FEED}, {CANONICAL} SELECT trip_id, route_id FROM chosen JOIN sig USING (trip_id) JOIN best USING (route_id, signature)",
    "reference_stops": f"{FEED}, {REFERENCE} SELECT route_id, stop_id FROM ref",
    "headway_table": f"{FEED}, {REFERENCE}, {HEADWAYS} SELECT route_id, ROUND(COALESCE(m, 10), 6) AS headway_min FROM (SELECT DISTINCT route_id FROM trips_) LEFT JOIN median USING (route_id)",
    "ridership_scans": f"""WITH {a.GRID}, {_ENDS}, {_PAIRS} SELECT 'Entry' AS file, name AS origin, NULL AS destination, CASE WHEN x < 50 THEN 25 ELSE x END AS trips FROM e
UNION ALL SELECT 'Exit', name, NULL, CASE WHEN x < 50 THEN 25 ELSE x END FROM f UNION ALL SELECT 'entries', name, NULL, x FROM e UNION ALL SELECT 'exits', name, NULL, x FROM f
UNION ALL SELECT 'pairs', origin, destination, x FROM p""",
    "demand_dispatch": f"""WITH {a.GRID}, {_ENDS}, {_PAIRS}, t AS (SELECT n_name AS name, COALESCE(e.x, 0) + COALESCE(f.x, 0) AS total, e.x IS NULL AND f.x IS NULL AS none FROM nation LEFT JOIN e ON e.name = n_name LEFT JOIN f ON f.name = n_name)
SELECT CAST(i AS VARCHAR) AS origin_station_id, CAST(j AS VARCHAR) AS dest_station_id, x AS total_trips, CASE WHEN NOT none THEN total END AS total_demand FROM p JOIN t ON t.name = origin""",
}
ORACLE_SQL["processed_headways"] = ORACLE_SQL["headway_table"]
ORACLE_SQL["filtered_calls"] = f"""{FEED} SELECT route_id, stop_id, COUNT(*) AS n_calls, MIN(printf('%02d:%02d:%02d', sec // 3600, sec // 60 % 60, sec % 60)) AS first_departure
FROM calls_ JOIN trips_ USING (trip_id) WHERE trip_headsign = 'F' GROUP BY route_id, stop_id"""
_RUNS = ", ".join(f"CAST(COUNT(*) FILTER (day = {(k + 1) % 7}) * 7 >= COUNT(*) AS INT) AS {d}" for k, d in enumerate(tables.DAYS))
ORACLE_SQL["calendar_scan"] = f"""WITH o AS (SELECT 'S' || (o_orderkey % 40) AS service_id, dayofweek(o_orderdate) AS day FROM orders), c AS (SELECT service_id, {_RUNS} FROM o GROUP BY service_id)
SELECT *, GREATEST(monday, tuesday, wednesday, thursday, friday) = 1 AND saturday = 0 AND sunday = 0 AS weekdays_only FROM c"""
