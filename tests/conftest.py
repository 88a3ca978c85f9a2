import os
import sys

import duckdb
import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "4g")
        .config("spark.sql.warehouse.dir", str(tmp_path_factory.mktemp("warehouse")))
        .config("spark.checkpoint.dir", f"file://{tmp_path_factory.mktemp('shared')}")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


def _plain(row, columns):
    return repr([round(x, 5) + 0.0 if isinstance(x := row[c], float) else x for c in columns])


@pytest.fixture(scope="session")
def compare(spark):
    """compare(query, sql, sf_dir): a Spark query's rows against DuckDB's, by column name."""

    def run(query, sql, sf_dir="/root/testdata/sf0.01"):
        con = duckdb.connect()
        for t in TABLES:
            con.execute(f"CREATE VIEW {t} AS FROM '{sf_dir}/{t}.parquet'")
        df = query(spark, sf_dir)
        rel = con.sql(sql)
        columns = sorted(df.columns)
        assert columns == sorted(rel.columns)
        got = sorted(_plain(r.asDict(), columns) for r in df.collect())
        want = sorted(_plain(dict(zip(rel.columns, r)), columns) for r in rel.fetchall())
        assert got == want

    return run
