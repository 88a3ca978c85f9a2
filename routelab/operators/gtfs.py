"""Schedule operators: platform collapse, canonical patterns, services and headways.

Ties have fixed results: the more frequent value first, then (for patterns) the longer one, then the smallest in string order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from routelab.functions.scalar import gtfs_seconds, without_platform
from routelab.operators.ranks import exact_quantiles
from routelab.staging import staged

#: Gaps of one key up to which a task orders them all.
MANY_GAPS = 1_000_000
WEEKDAYS = ("monday", "tuesday", "wednesday", "thursday", "friday")


def most_frequent(df: DataFrame, keys: list[str], value: str, name: str | None = None) -> DataFrame:
    """The commonest value of each key; the smallest of those as common."""
    counts = df.filter(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("__n"))
    order = Window.partitionBy(*keys).orderBy(F.desc("__n"), value)
    return counts.withColumn("__at", F.row_number().over(order)).filter("__at = 1").select(*keys, F.col(value).alias(name or value))


def collapse_platforms(stops: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Stations (id, name, mean coordinates of all rows) and the map from stop to station.

    A station takes the name of its row of location type 1 where it has one, else of its least stop id.
    """
    rows = stops if "location_type" in stops.columns else stops.withColumn("location_type", F.lit(None).cast("double"))
    rows = rows.withColumn("station_id", F.coalesce("parent_station", "stop_id"))
    first = F.struct((F.coalesce("location_type", F.lit(0.0)) != 1).alias("other"), "stop_id")
    stations = rows.groupBy("station_id").agg(F.min_by(without_platform("stop_name"), first).alias("station_name"), F.avg("stop_lat").alias("stop_lat"), F.avg("stop_lon").alias("stop_lon"))
    return stations, rows.select("stop_id", "station_id").distinct()


def signatures(stop_times: DataFrame) -> DataFrame:
    """trip_id and its stops in order."""
    ordered = F.array_sort(F.collect_list(F.struct("stop_sequence", "stop_id")))
    return stop_times.groupBy("trip_id").agg(F.transform(ordered, lambda s: s["stop_id"]).alias("signature"))


def pattern_of_routes(trips: DataFrame, stop_times: DataFrame, longest: Column | None = None) -> DataFrame:
    """route_id, signature and n_stops, n_matching, n_candidate of each route's canonical pattern.

    ``longest`` marks the routes that take their longest pattern instead of the commonest.
    """
    own = signatures(stop_times.join(trips.select("trip_id").distinct(), "trip_id", "left_semi"))
    counts = trips.join(own, "trip_id").groupBy("route_id", "signature").agg(F.count("*").alias("n_matching"))
    long = F.coalesce(longest, F.lit(False)) if longest is not None else F.lit(False)
    size = F.size("signature")
    order = Window.partitionBy("route_id").orderBy(F.when(long, size).otherwise(F.col("n_matching")).desc(), F.when(long, F.col("n_matching")).otherwise(size).desc(), F.array_join("signature", "|"))
    total = F.sum("n_matching").over(Window.partitionBy("route_id"))
    best = counts.select("*", total.alias("n_candidate"), F.row_number().over(order).alias("__at")).filter("__at = 1")
    return best.select("route_id", "signature", size.alias("n_stops"), "n_matching", "n_candidate")


def canonical_trips(trips: DataFrame, stop_times: DataFrame, routes: DataFrame, service_filter: str | None = None, longest: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """Trips of each route's canonical pattern, and the patterns.

    ``routes`` has route_id, headsign and service_id; a null headsign or service filters nothing. A route's own service goes before
    ``service_filter``.
    """
    wanted = trips.join(routes.select("route_id", "headsign", F.col("service_id").alias("own_service")), "route_id")
    service = F.coalesce("own_service", F.lit(service_filter))
    chosen = wanted.filter((F.col("headsign").isNull() | (F.col("trip_headsign") == F.col("headsign"))) & (service.isNull() | (F.col("service_id") == service)))
    patterns = pattern_of_routes(chosen, stop_times, F.col("route_id").isin(longest or []))
    own = signatures(stop_times.join(chosen.select("trip_id").distinct(), "trip_id", "left_semi"))
    matching = chosen.join(own, "trip_id").join(patterns.select("route_id", "signature"), ["route_id", "signature"]).select("trip_id", "route_id")
    return matching, patterns


def reference_stops(trips: DataFrame, stop_times: DataFrame, routes: DataFrame) -> DataFrame:
    """route_id and the commonest first stop (sequence 1) of its trips with the route's headsign; none without a headsign."""
    own = trips.join(routes.filter("headsign is not null").select("route_id", "headsign"), "route_id").filter("trip_headsign = headsign")
    first = stop_times.filter("stop_sequence = 1").join(own.select("trip_id", "route_id"), "trip_id")
    return most_frequent(first, ["route_id"], "stop_id")


def median_gap_minutes(departures: DataFrame, keys: list[str], second: str, max_gap_sec: float) -> DataFrame:
    """Exact median, in minutes, of the gaps between neighbouring departures that are above 0 and below the limit.

    Departures are sorted within the hours of each key, however many one key has; the gaps between an hour's last and the next known
    hour's first are stitched in from a row an hour.
    """
    rows = departures.filter(F.col(second).isNotNull()).select(*keys, F.col(second).alias("__s"), F.floor(F.col(second) / 3600).alias("__hour"))
    within = F.col("__s") - F.lag("__s").over(Window.partitionBy(*keys, "__hour").orderBy("__s"))
    hours = rows.groupBy(*keys, "__hour").agg(F.min("__s").alias("first"), F.max("__s").alias("last"))
    between = F.col("first") - F.lag("last").over(Window.partitionBy(*keys).orderBy("__hour"))
    gaps = rows.select(*keys, within.alias("gap")).unionByName(hours.select(*keys, between.alias("gap")))
    gaps = staged(gaps.filter((F.col("gap") > 0) & (F.col("gap") < max_gap_sec)), "gaps")
    # Few gaps are ordered where they are; a key of many is narrowed down to its middle, with the same result.
    if (gaps.groupBy(*keys).count().agg(F.max("count")).first()[0] or 0) <= MANY_GAPS:
        return gaps.groupBy(*keys).agg((F.median("gap") / 60.0).alias("headway_min"))
    return exact_quantiles(gaps, keys, "gap", [0.5]).select(*keys, (F.col("quantile") / 60.0).alias("headway_min"))


def route_headways(trips: DataFrame, stop_times: DataFrame, routes: DataFrame, max_gap_sec: float = 3600.0) -> DataFrame:
    """route_id and the median headway at its reference stop, of its service where it has one."""
    stops = reference_stops(trips, stop_times, routes)
    own = trips.join(routes.select("route_id", "headsign", F.col("service_id").alias("own")), "route_id")
    own = own.filter("trip_headsign = headsign and (own is null or service_id = own)").select("trip_id", "route_id")
    calls = stop_times.join(own, "trip_id").join(stops, ["route_id", "stop_id"])
    return median_gap_minutes(calls.withColumn("second", gtfs_seconds("departure_time")), ["route_id"], "second", max_gap_sec)


def runs_on_weekdays_only() -> Column:
    return (F.greatest(*WEEKDAYS) == 1) & (F.col("saturday") == 0) & (F.col("sunday") == 0)


def weekday_services(calendar: DataFrame, trips: DataFrame) -> DataFrame:
    """route_id and the commonest service of its trips among services that run on weekdays only."""
    weekday = calendar.filter(runs_on_weekdays_only()).select("service_id").distinct()
    return most_frequent(trips.join(weekday, "service_id", "left_semi"), ["route_id"], "service_id")


def resolved_services(routes: DataFrame, weekday: DataFrame, manual: DataFrame, service_filter: str | None = None) -> DataFrame:
    """route_id and its service: of the calendar, else set by hand, else the city's filter, else null."""
    own = routes.select("route_id").distinct()
    out = own.join(weekday.select("route_id", F.col("service_id").alias("a")), "route_id", "left").join(manual.select("route_id", F.col("service_id").alias("b")), "route_id", "left")
    return out.select("route_id", F.coalesce("a", "b", F.lit(service_filter)).alias("service_id"))


def headway_table(routes: DataFrame, headways: DataFrame, default: float = 10.0) -> DataFrame:
    """route_id and headway_min of every route; the default where none could be found."""
    return routes.select("route_id").distinct().join(headways, "route_id", "left").select("route_id", F.coalesce("headway_min", F.lit(default)).alias("headway_min"))
