"""The jobs: growing input, repeated and broken runs, odd rows, the command line."""

import glob
import json
import os
import subprocess
import sys
import time
from collections import Counter

import pytest
from pyspark.errors import StreamingQueryException
from pyspark.sql import functions as F

from jobs import common, link_flows, queries, update_headways

SF = "/root/testdata/sf0.001"
ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query_is_its_sql(name, compare):
    compare(queries.QUERIES[name], queries.ORACLE_SQL[name], SF)


def rows(df):
    return sorted(map(repr, df.select(sorted(df.columns)).collect()))


@pytest.fixture
def events(spark):
    df = spark.read.parquet(f"{SF}/events.parquet")
    days = [r[0] for r in df.select(F.to_date("ts").alias("d")).distinct().sort("d").collect()]
    return df, days


@pytest.fixture
def whole(spark, events):
    return rows(update_headways.headways(update_headways.as_calls(events[0], common.config("update_headways")), 3600.0))


def files(folder):
    return {d: sorted(glob.glob(f"{folder}/{d}/*.parquet")) for d in os.listdir(folder) if d.startswith("service_date=")}


def test_headways_of_growing_input(spark, events, whole, tmp_path):
    df, days = events
    late = (F.to_date("ts") == F.lit(days[3])) & (F.col("event_id") % 2 == 0)
    early = (F.to_date("ts") < F.lit(days[6])) & ~late
    feed, out, mark = (f"file://{tmp_path}/{x}" for x in ("feed", "out", "mark"))
    df.filter(early).coalesce(1).write.parquet(feed)
    first = update_headways.run(spark, feed, out, mark)
    assert first["batches"] == 1 and first["read"] == df.filter(early).count()
    before = files(f"{tmp_path}/out/headways")
    df.filter(~early).coalesce(1).write.mode("append").parquet(feed)
    df.filter(F.to_date("ts") == F.lit(days[10])).coalesce(1).write.mode("append").parquet(feed)  # a file that repeats calls
    second = update_headways.run(spark, feed, out, mark)
    assert second["read"] == df.filter(~early).count() + df.filter(F.to_date("ts") == F.lit(days[10])).count()
    assert rows(update_headways.table(spark, out)) == whole
    after = files(f"{tmp_path}/out/headways")
    touched = {d for d in before if before[d] != after[d]}
    assert touched == {f"service_date={days[3]}"}  # of the dates known before, only that of the late calls was written anew
    assert update_headways.run(spark, feed, out, mark) == {"batches": 0, "read": 0, "written": 0}
    assert rows(update_headways.table(spark, out)) == whole and files(f"{tmp_path}/out/headways") == after


def test_headways_after_a_broken_batch(spark, events, whole, tmp_path, monkeypatch):
    feed, out, mark = (f"file://{tmp_path}/{x}" for x in ("feed", "out", "mark"))
    events[0].repartition(3).write.parquet(feed)
    settings = common.config("update_headways") | {"files_per_batch": 1}
    write, calls = common.write_partitions, []

    def breaks(df, path, keys, dynamic=True):
        calls.append(path)
        if len(calls) == 4:  # the second batch's calls are written, its headways aren't
            raise OSError("disk full")
        return write(df, path, keys, dynamic)

    monkeypatch.setattr(update_headways, "write_partitions", breaks)
    with pytest.raises(StreamingQueryException):
        update_headways.run(spark, feed, out, mark, settings)
    monkeypatch.undo()
    assert update_headways.run(spark, feed, out, mark, settings)["batches"] == 2
    assert rows(update_headways.table(spark, out)) == whole
    # without its checkpoint the job takes all files again and gives the same
    update_headways.run(spark, feed, out, f"{mark}-lost", settings)
    assert rows(update_headways.table(spark, out)) == whole


def test_headways_of_odd_rows(spark, events, tmp_path):
    feed, out, mark = (f"file://{tmp_path}/{x}" for x in ("feed", "out", "mark"))
    odd = events[0].limit(1).select(*[F.lit(None).cast(t).alias(c) for c, t in events[0].dtypes]).withColumn("extra", F.lit("x"))
    odd.write.parquet(feed)
    assert update_headways.run(spark, feed, out, mark)["written"] == 0
    assert update_headways.table(spark, out).count() == 0


def test_link_flows_by_hand(spark, tmp_path):
    paths = [(1, "A|B|C", "r1"), (2, "A|B|B|C", "r1"), (3, "A|C", "r1"), (4, "A", "r1"), (5, "", "r1"), (6, None, "r1"), (7, "A|B", None), (7, "A|B", ""), (8, "X|Y", "r2")]
    spark.createDataFrame(paths, "id int, chosen_path string, route string").write.parquet(f"{tmp_path}/in")
    settings = common.config("link_flows") | {"route": "coalesce(nullif(route, ''), 'none')", "path": "chosen_path", "node": "[^|]+"}
    out = f"file://{tmp_path}/out"
    done = link_flows.run(spark, f"{tmp_path}/in", out, settings)
    assert done == {"read": 7, "flows": 6, "links": 6, "nodes": 7}
    got = {(r["route"], r["from_node"], r["to_node"]): (r["flow"], round(r["share"], 6)) for r in link_flows.table(spark, out).collect()}
    want = {("r1", "A", "B"): (2, 0.666667), ("r1", "A", "C"): (1, 0.333333), ("r1", "B", "C"): (2, 0.666667), ("r1", "B", "B"): (1, 0.333333), ("none", "A", "B"): (2, 1.0), ("r2", "X", "Y"): (1, 1.0)}
    assert got == want
    at = {(r["route"], r["node"]): (r["starts"], r["ends"], r["passes"]) for r in spark.read.schema(link_flows.NODES).parquet(f"{out}/nodes").collect()}
    assert at[("r1", "A")] == (4, 1, 4) and at[("r1", "B")] == (0, 0, 3) and at[("r1", "C")] == (0, 3, 3)
    # one route again, changed: the others stay
    spark.createDataFrame([(9, "Y|Z", "r2")], "id int, chosen_path string, route string").write.parquet(f"{tmp_path}/more")
    for _ in range(2):
        link_flows.run(spark, f"{tmp_path}/more", out, settings | {"least_flow": 1})
        got = {(r["route"], r["from_node"], r["to_node"]): r["flow"] for r in link_flows.table(spark, out).collect()}
        assert got == {k: v[0] for k, v in want.items() if k[0] != "r2"} | {("r2", "Y", "Z"): 1}


def test_link_flows_of_nothing(spark, tmp_path):
    spark.createDataFrame([], "text string, lang string").write.parquet(f"{tmp_path}/in")
    assert link_flows.run(spark, f"{tmp_path}/in", f"file://{tmp_path}/out") == {"read": 0, "flows": 0, "links": 0, "nodes": 0}
    assert link_flows.table(spark, f"file://{tmp_path}/out").count() == 0


def test_link_flows_cut_one_row_group_in_many_tasks_and_once(spark, tmp_path):
    spark.createDataFrame([(f"a{n} b c", "en") for n in range(400)], "text string, lang string").coalesce(1).write.parquet(f"{tmp_path}/in")
    trips = link_flows.trips(spark.read.parquet(f"{tmp_path}/in"), common.config("link_flows"))
    with common.setting(spark, "spark.sql.adaptive.coalescePartitions.enabled", "false"):
        tasks = trips.groupBy(F.spark_partition_id()).count().collect()
    assert len(tasks) > 4 and sum(r["count"] for r in tasks) == 400 and max(r["count"] for r in tasks) < 200
    text = link_flows.steps(trips)._jdf.queryExecution().executedPlan().toString()
    assert text.count("regexp_extract_all") == 1
    assert spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled") == "true"


def test_link_flows_in_rounds_are_whole_and_leave_no_shuffle_files(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(link_flows, "ROUND", 100, raising=False)  # all four rounds
    texts = [(f"the w{n % 7} the w{n % 11} v{n} of the the w{n % 5}", ("en", "de")[n % 2]) for n in range(150)]
    spark.createDataFrame(texts, "text string, lang string").write.parquet(f"{tmp_path}/in")
    want, leaving = Counter(), Counter()
    for text, lang in texts:
        w = text.split()
        want.update((lang, a, b) for a, b in zip(w, w[1:]))
        leaving.update((lang, a) for a in w[:-1])
    files = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    shuffled = lambda: {b.name() for b in spark._jvm.scala.jdk.javaapi.CollectionConverters.asJava(files.getAllBlocks()) if b.isShuffle()}
    for _ in range(2):
        before = shuffled()
        done = link_flows.run(spark, f"{tmp_path}/in", f"file://{tmp_path}/out")
        assert done == {"read": 150, "flows": len(want), "links": len(want), "nodes": len({(lang, w) for text, lang in texts for w in text.split()})}
        for _ in range(50):  # files are deleted in the background
            if not shuffled() - before:
                break
            time.sleep(0.2)
        assert not shuffled() - before
        got = {(r["route"], r["from_node"], r["to_node"]): (r["flow"], r["share"]) for r in link_flows.table(spark, f"file://{tmp_path}/out").collect()}
        assert got == {k: (n, n / leaving[k[:2]]) for k, n in want.items()}
        assert spark.read.parquet(f"{tmp_path}/out/flows").count() == 0 and spark.read.parquet(f"{tmp_path}/out/trips").count() == 0
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled") == "false"


def test_settings(tmp_path):
    (tmp_path / "own.json").write_text(json.dumps({"least_flow": 3}))
    assert common.config("link_flows", str(tmp_path / "own.json"))["least_flow"] == 3
    (tmp_path / "own.json").write_text(json.dumps({"leest_flow": 3}))
    with pytest.raises(ValueError, match="leest_flow"):
        common.config("link_flows", str(tmp_path / "own.json"))


def test_command_line(spark, tmp_path):
    spark.createDataFrame([("A B C", "en")], "text string, lang string").write.parquet(f"{tmp_path}/in")
    (tmp_path / "own.json").write_text(json.dumps({"node": "[A-Z]"}))
    done = subprocess.run([sys.executable, f"{ROOT}/jobs/link_flows.py", "--paths", f"{tmp_path}/in", "--output", f"{tmp_path}/out", "--config", str(tmp_path / "own.json")], capture_output=True, text=True, cwd=tmp_path)
    assert done.returncode == 0, done.stderr[-2000:]
    assert "1 paths read" in done.stderr and "2 links and 3 nodes written" in done.stderr
    assert {(r["from_node"], r["to_node"]) for r in link_flows.table(spark, f"{tmp_path}/out").collect()} == {("A", "B"), ("B", "C")}
