"""Exact ranks and quantiles of groups of any size: no task ever holds a whole group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: A sketch's ranks are off by a group's rows over this at most.
ACCURACY = 10_000


def exact_quantiles(df: DataFrame, keys: list[str], value: str, probabilities: list[float], accuracy: int = ACCURACY) -> DataFrame:
    """keys, p and the exact quantile, interpolated between neighbours, of each group's values that aren't null.

    A mergeable sketch brackets the wanted ranks between two of the group's own values, with a proven error; then the rows below
    the bracket are counted and the few within it, eight rows in ``accuracy`` or so, are counted by value. Only
    these counts are put in order. A value however frequent is one row. ``df`` is read twice: stage it where it is dear.
    """
    rows = df.filter(F.col(value).isNotNull()).select(*keys, F.col(value).cast("double").alias("__x"))
    n = F.count("*").alias("__n")
    reach = 3.0 / accuracy  # one for the sketch's error, and room for the ranks next to the wanted one
    brackets = []
    for p in probabilities:
        low, high = (F.percentile_approx("__x", max(0.0, min(1.0, at)), accuracy) for at in (p - reach, p + reach))
        brackets.append(F.struct(F.lit(float(p)).alias("p"), low.alias("low"), high.alias("high")))
    groups = rows.groupBy(*keys).agg(n, F.array(*brackets).alias("__b")).select(*keys, "__n", F.explode("__b").alias("__b")).select(*keys, "__n", "__b.*")
    many = F.col("__n") > accuracy  # smaller groups need no bracket
    groups = groups.withColumns({"low": F.when(many, F.col("low")).otherwise(float("-inf")), "high": F.when(many, F.col("high")).otherwise(float("inf"))})
    # Interpolated quantiles lie between the ranks at and after (n - 1) p, counted from 0.
    groups = groups.withColumn("__at", (F.col("__n") - 1) * F.col("p"))
    # The least value stands for all below the bracket, so that these are one row as well.
    place = F.when(F.col("__x") < F.col("low"), F.lit(float("-inf"))).otherwise(F.col("__x"))
    near = rows.alias("r").join(groups.alias("g"), _same("r", "g", keys)).filter(F.col("__x") <= F.col("high"))
    counts = near.select(*[F.col(f"g.{k}").alias(k) for k in keys], "p", "__at", place.alias("__x")).groupBy(*keys, "p", "__at", "__x").agg(n)
    upto = F.sum("__n").over(Window.partitionBy(*keys, "p").orderBy("__x"))
    ends = counts.withColumn("__upto", upto)
    first = F.min(F.when(F.col("__upto") > F.floor("__at"), F.col("__x")))
    second = F.min(F.when(F.col("__upto") > F.ceil("__at"), F.col("__x")))
    found = ends.groupBy(*keys, "p", "__at").agg(first.alias("__a"), second.alias("__c"))
    part = F.col("__at") - F.floor("__at")
    return found.select(*keys, "p", (F.col("__a") + part * (F.coalesce("__c", "__a") - F.col("__a"))).alias("quantile"))


def _same(left: str, right: str, keys: list[str]) -> Column:
    on = F.lit(True)
    for k in keys:
        on = on & F.col(f"{left}.{k}").eqNullSafe(F.col(f"{right}.{k}"))
    return on


def ranked(df: DataFrame, strata: list[str], uniform: Column, key: str, buckets: int = 256, rank: str = "rank", size: str = "size") -> DataFrame:
    """``df`` with each row's exact rank from 1, by ``uniform`` in (0, 1) and then ``key``, in its stratum, and the stratum's size.

    Rows are ranked within equal parts of the interval, which spread a stratum of any size over ``buckets`` groups, and get the number
    of rows in the parts before; these counts, a row a part, are all that is summed by stratum.
    """
    rows = df.withColumns({"__u": uniform, "__part": F.floor(uniform * buckets)})
    counts = rows.groupBy(*strata, "__part").agg(F.count("*").alias("__n"))
    own = Window.partitionBy(*strata)
    upto = F.sum("__n").over(own.orderBy("__part")) - F.col("__n")
    offsets = counts.select(*strata, "__part", upto.alias("__before"), F.sum("__n").over(own).alias("__all"))
    within = F.row_number().over(Window.partitionBy(*strata, "__part").orderBy("__u", key))
    known = rows.withColumn("__within", within).alias("r").join(offsets.alias("g"), _same("r", "g", [*strata, "__part"]))
    return known.select(*[F.col(f"r.`{c}`") for c in df.columns], (F.col("__before") + F.col("__within")).alias(rank), F.col("__all").alias(size))
