"""Jump consistent hashing: a stable key and the number of shards decide the shard; there is no ring table.

An appended shard only takes rows into itself. Everything is DataFrame functions: the published generator's 64-bit product is
put together from 16- and 32-bit halves, which never overflow a signed 64-bit integer.

Defined cases: a null id hashes like the empty text; a null text has no bytes (size 8, crc32 0). Repeated rows share a shard
and get slots of their own. Ids that repeat share a shard. An empty table gives an empty result. Columns other than the id and
the text are dropped.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from routelab.llm.common import staged, utf8

#: Multiplier of the published 64-bit linear congruential generator, in 32-bit halves.
MULTIPLIER = 2862933555777941757
HIGH, LOW = MULTIPLIER >> 32, MULTIPLIER & 0xFFFFFFFF


def stable_key(id_: Column) -> tuple[Column, Column]:
    """The high and low 32 bits of a well-mixed 64-bit key of the id's text."""
    digest = F.md5(F.coalesce(id_.cast("string"), F.lit("")).cast("binary"))
    return tuple(F.conv(F.substring(digest, at, 8), 16, 10).cast("bigint") for at in (1, 9))


def _next(hi: Column, lo: Column) -> tuple[Column, Column]:
    """The halves of key * MULTIPLIER + 1 modulo 2**64."""

    def low_half(x: Column, by: int) -> Column:
        """x * by modulo some multiple of 2**32, below 2**50, for x and by below 2**32."""
        return (F.shiftright(x, 16) * by).bitwiseAND(0xFFFF) * 65536 + x.bitwiseAND(0xFFFF) * by

    first = lo.bitwiseAND(0xFFFF) * LOW + 1
    second = F.shiftright(lo, 16) * LOW + F.shiftright(first, 16)
    high = F.shiftright(second, 16) + low_half(hi, LOW) + low_half(lo, HIGH)
    return high.bitwiseAND(0xFFFFFFFF), second.bitwiseAND(0xFFFF) * 65536 + first.bitwiseAND(0xFFFF)


def jump_shard(id_: Column, shards: int) -> Column:
    """The shard, from 0, of each id among ``shards``.

    Each jump goes up by one shard at least, so ``shards`` steps always suffice; finished rows just carry their state.
    """
    if shards < 1:
        raise ValueError("at least one shard is needed")
    hi, lo = stable_key(id_)
    zero = F.struct(hi.alias("hi"), lo.alias("lo"), F.lit(-1).cast("bigint").alias("b"), F.lit(0).cast("bigint").alias("j"))

    def step(state: Column, _: Column) -> Column:
        new_hi, new_lo = _next(state["hi"], state["lo"])
        jump = F.floor((state["j"] + 1) * (F.lit(2147483648.0) / (F.shiftright(new_hi, 1) + 1).cast("double"))).cast("bigint")
        moved = F.struct(new_hi.alias("hi"), new_lo.alias("lo"), state["j"].alias("b"), jump.alias("j"))
        return F.when(state["j"] < shards, moved).otherwise(state)

    return F.aggregate(F.sequence(F.lit(1), F.lit(shards)), zero, step, lambda s: s["b"].cast("int"))


def shard(df: DataFrame, shards: int, id_: str = "doc_id", text: str = "text", buckets: int = 2048) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot and grown_shard of every row.

    Slots count a shard's rows without gaps. They are numbered within ``buckets`` hash buckets of each shard, each after the
    rows of the buckets before it, so that no task sorts a whole shard. Rows that are alike are one row with a count for each
    partition they lie in, and become rows again when they have their slots: no task meets a hot row more often than there are
    partitions. The narrow rows are staged first: the texts are read once.
    """
    size = F.octet_length(utf8(F.col(text))).cast("long") + 8
    narrow = df.select(F.col(id_).alias("doc_id"), size.alias("size"), F.crc32(utf8(F.col(text))).alias("text_crc32"), F.spark_partition_id().alias("part"))
    narrow = narrow.withColumns({"shard": jump_shard(F.col("doc_id"), shards), "grown_shard": jump_shard(F.col("doc_id"), shards + 1)})
    mixed = F.md5(F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("")), "text_crc32", "size").cast("binary"))
    rows = staged(narrow.withColumn("bucket", (F.conv(F.substring(mixed, 1, 8), 16, 10).cast("bigint") % buckets).cast("int")), "shards")
    alike = rows.groupBy("shard", "bucket", "doc_id", "size", "text_crc32", "grown_shard", "part").agg(F.count("*").alias("n"))
    counts = rows.groupBy("shard", "bucket").agg(F.count("*").alias("n"))
    before = Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("shard", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    within = Window.partitionBy("shard", "bucket").orderBy(F.col("doc_id").asc_nulls_first(), "text_crc32", "size", "part").rowsBetween(Window.unboundedPreceding, -1)
    # shards * buckets rows at most: the bound of what is broadcast.
    numbered = alike.withColumn("first", F.coalesce(F.sum("n").over(within), F.lit(0))).join(F.broadcast(offsets), ["shard", "bucket"])
    each = numbered.withColumn("at", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("n") - 1)))
    return each.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", (F.col("offset") + F.col("first") + F.col("at")).cast("long").alias("slot"), "grown_shard")
