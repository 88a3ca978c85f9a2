import math

import pytest
from pyspark.sql import functions as F

from routelab.functions import scalar


def one(spark, column, **values):
    names = list(values)
    kinds = ", ".join(f"{n} {'string' if isinstance(v, str) or v is None else 'double' if isinstance(v, float) else 'bigint'}" for n, v in values.items())
    df = spark.createDataFrame([tuple(values.values())], kinds) if names else spark.range(1)
    return df.select(column.alias("x")).first()["x"]


@pytest.mark.parametrize("text, want", [("01:02:03", 3723), ("25:00:00", 90000), ("garbage", None), ("1:2", None), (" 0:00:09 ", 9), (None, None)])
def test_gtfs_seconds(spark, text, want):
    assert one(spark, scalar.gtfs_seconds("t"), t=text) == want


def test_haversine(spark):
    far = one(spark, scalar.haversine_m(*[F.lit(x) for x in (-33.8568, 151.2153, -33.8523, 151.2108)]))
    assert 400 < far < 900
    assert one(spark, scalar.haversine_m(*[F.lit(x) for x in (1.0, 2.0, 1.0, 2.0)])) == pytest.approx(0, abs=1e-6)


def test_texts(spark):
    assert one(spark, scalar.without_platform("s"), s="Central Station,  Platform 12") == "Central Station"
    assert one(spark, scalar.single_spaced("s"), s="  a \t b ") == "a b"
    assert one(spark, scalar.ridership_count("s"), s="1,234") == 1234.0
    assert one(spark, scalar.ridership_count("s"), s="Less than 50") == 25.0
    assert one(spark, scalar.ridership_count("s"), s="junk") is None
    assert one(spark, scalar.node_id("s"), s="276610.0") == "276610"
    assert one(spark, scalar.path_text(scalar.path_nodes("s")), s="a|b|c") == "a|b|c"
    assert one(spark, scalar.prefixed("BUS_", "s"), s="7") == "BUS_7"


def test_numbers(spark):
    assert [one(spark, scalar.trips_to_draw(F.lit(x), 1.0, 2)) for x in (0.4, 2.5, 3.5)] == [2, 2, 4]
    assert one(spark, scalar.nest_scale(0.0)) == 0.5
    assert one(spark, scalar.nest_scale(-99.0)) == 1e-4
    assert one(spark, scalar.kumaraswamy_weight(F.lit(1.0))) == 1.0
    assert one(spark, scalar.kumaraswamy_weight(F.lit(0.0))) == 1e-12
    assert one(spark, scalar.generalized_time(F.lit(10.0), F.lit(2.0), F.lit(3.0))) == 20.0
    assert one(spark, scalar.impedance(F.lit(None).cast("double"), 0.05, F.lit(False))) == 0.0
    assert one(spark, scalar.impedance(F.lit(10.0), 0.05, F.lit(True))) == 0.0
    assert one(spark, scalar.walk_seconds(F.lit(120.0), 1.2)) == pytest.approx(100)
    assert scalar.two_sided_p(1.959963985) == pytest.approx(0.05, abs=1e-6)


def test_hashed_uniform(spark):
    u = [r[0] for r in spark.range(2000).select(scalar.hashed_uniform("id", F.lit(42))).collect()]
    assert 0 < min(u) and max(u) < 1 and abs(sum(u) / 2000 - 0.5) < 0.03
    g = [r[0] for r in spark.range(2000).select(scalar.gumbel(scalar.hashed_uniform("id", F.lit(42)))).collect()]
    assert abs(sum(g) / 2000 - 0.5772) < 0.12 and all(map(math.isfinite, g))
