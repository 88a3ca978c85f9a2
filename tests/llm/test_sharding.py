import hashlib
import zlib

from pyspark.sql import functions as F

from routelab.llm import queries, sharding


def jump(id_, shards):
    key = int(hashlib.md5(("" if id_ is None else str(id_)).encode()).hexdigest()[:16], 16)
    b, j = -1, 0
    while j < shards:
        b = j
        key = (key * 2862933555777941757 + 1) % 2**64
        j = int((b + 1) * (2147483648.0 / ((key >> 33) + 1)))
    return b


def check(rows, source):
    assert len(rows) == len(source)
    texts = {}
    for r in source:
        texts.setdefault(r["doc_id"], []).append((r["text"] or "").encode())
    for r in rows:
        assert r["shard"] == jump(r["doc_id"], 24) and r["grown_shard"] == jump(r["doc_id"], 25) and r["law"] == "key"
        assert r["grown_shard"] in (r["shard"], 24)
        assert (r["size"], r["text_crc32"]) in {(len(t) + 8, zlib.crc32(t)) for t in texts[r["doc_id"]]}
    for s in {r["shard"] for r in rows}:
        slots = sorted(r["slot"] for r in rows if r["shard"] == s)
        assert slots == list(range(len(slots)))


def test_query(spark, docs):
    check(queries.op5_jump_sharding(spark, "/root/testdata/sf0.001").collect(), docs.collect())


def test_odd_rows(odd):
    check(sharding.shard(odd, 24).collect(), odd.collect())
    assert sharding.shard(odd.limit(0), 24).count() == 0


def test_a_hot_row(spark):
    rows = [(7, "the same text")] * 5000 + [(k, f"text {k}") for k in range(100)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4)
    check(sharding.shard(df, 24, buckets=8).collect(), df.collect())


def test_shard_counts(spark):
    for shards in (1, 2, 7, 60):
        got = {r["id"]: r["s"] for r in spark.range(300).select("id", sharding.jump_shard(F.col("id"), shards).alias("s")).collect()}
        assert got == {k: jump(k, shards) for k in range(300)}
