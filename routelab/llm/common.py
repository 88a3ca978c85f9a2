"""Tables, columns and worker memory of the corpus operators."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from routelab.staging import fresh_uri, shared_dir, staged

__all__ = ["fresh_uri", "release", "shared_dir", "spread", "staged", "table", "tidy", "utf8"]

Batches = Iterable[pa.RecordBatch]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """A table read from files, dealt out to all cores where its files give fewer tasks than there are cores.

    Small inputs only: a corpus has more splits than a cluster has cores, and then no row moves.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores)


def utf8(text: Column) -> Column:
    """The UTF-8 bytes of a text; none for null."""
    return F.encode(F.coalesce(text, F.lit("")), "utf-8")


def release() -> None:
    """Give freed memory back to the system."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def tidy(run: Callable[[Batches], Iterator[pa.RecordBatch]], every: int = 8) -> Callable[[Batches], Iterator[pa.RecordBatch]]:
    """``run`` for mapInArrow, giving freed memory back to the system every few batches and at the end.

    Python workers outlive their tasks, and several share an executor: what they don't use mustn't stay theirs.
    """

    def wrapped(batches: Batches) -> Iterator[pa.RecordBatch]:
        for n, batch in enumerate(run(batches), 1):
            yield batch
            if n % every == 0:
                release()
        release()

    return wrapped
