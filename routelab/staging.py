"""Tables written into the folder that driver and executors share, to cut lineage."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """URI of the folder that driver and executors share: ``spark.checkpoint.dir``.

    Where the session names none one is made and set on a single machine; on a cluster that raises, as no local folder is shared.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = f"file://{tempfile.mkdtemp(prefix='routelab-')}"
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


_made: list[str] = []


def fresh_uri(spark: SparkSession, name: str) -> str:
    """A new URI below the shared folder."""
    _made.append(f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}")
    return _made[-1]


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it back: lineage ends there and survives lost executors."""
    uri = fresh_uri(df.sparkSession, name)
    df.write.parquet(uri)
    return df.sparkSession.read.schema(df.schema).parquet(uri)


def bucketed(df: DataFrame, name: str, key: str, buckets: int, table: str) -> DataFrame:
    """:func:`staged` as the table ``table``, dealt by ``key`` into one file for each bucket: joins on ``key`` don't shuffle its rows again."""
    uri = fresh_uri(df.sparkSession, name)
    df.repartition(buckets, key).write.bucketBy(buckets, key).option("path", uri).saveAsTable(table)
    return df.sparkSession.table(table)


def _delete(spark: SparkSession, uri: str) -> bool:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(uri)
    return bool(path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True))


class Scratch:
    """Stages the tables of one computation and deletes them at its end, whether its result has been staged elsewhere or it failed."""

    def __init__(self, spark: SparkSession):
        self.spark, self.uris, self.tables = spark, [], []

    def __call__(self, df: DataFrame, name: str) -> DataFrame:
        before = len(_made)
        try:
            return staged(df, name)
        finally:
            self.uris += _made[before:]

    def bucketed(self, df: DataFrame, name: str, key: str, buckets: int) -> DataFrame:
        before = len(_made)
        self.tables.append(f"{name}_{uuid.uuid4().hex}")
        try:
            return bucketed(df, name, key, buckets, self.tables[-1])
        finally:
            self.uris += _made[before:]

    def __enter__(self) -> Scratch:
        return self

    def __exit__(self, *_: object) -> None:
        self.clear()

    def clear(self) -> None:
        for table in self.tables:
            self.spark.sql(f"DROP TABLE IF EXISTS {table}")
        self.tables.clear()
        for uri in self.uris:
            _made.remove(uri)
            _delete(self.spark, uri)
        self.uris.clear()


def clear(spark: SparkSession) -> int:
    """Delete what this process has staged, once no result that reads it is needed any more; the number of tables deleted."""
    done = 0
    while _made:
        done += _delete(spark, _made.pop())
    return done
