"""Plans: pruned scans, pushed filters, no accidental products, no Python where built-ins do."""

import re

from pyspark.sql import functions as F

from routelab.operators import network
from routelab.plans import adapters as a
from routelab.plans import registry

SF = "/root/testdata/sf0.001"
QUERIES = registry.queries()


def plan(df):
    return df._jdf.queryExecution().explainString(df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))


def test_scans_are_pruned(spark):
    text = plan(QUERIES["transit_edges"](spark, SF))
    assert all("value" not in s for s in re.findall(r"ReadSchema: (.*)", text))
    text = plan(a.nation_trips(spark, SF).filter("quantity > 10"))
    assert "GreaterThan(l_quantity,10.0)" in text and "l_comment" not in text and "o_totalprice" not in text


def test_no_products_or_python(spark):
    for name in ("transit_edges", "headway", "canonical_pattern", "od_matrix", "train_test_split", "demand_outer"):
        text = plan(QUERIES[name](spark, SF))
        assert not re.search("CartesianProduct|BroadcastNestedLoopJoin|Python|Pandas", text), name


def test_near_pairs_is_an_equi_join(spark):
    points = a.nation_stations(spark, SF).select(F.col("station_id").alias("id"), F.col("stop_lat").alias("lat"), F.col("stop_lon").alias("lon"))
    assert not re.search("CartesianProduct|NestedLoop", plan(network.near_pairs(points, points, 500, same=True)))
