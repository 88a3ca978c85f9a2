"""Token counts by separator scan of flat token files that have no index.

A file is nothing but ids of one width, each document followed by the end-of-document id. Files are read in blocks of fixed
size, whichever task gets them; numpy finds the separators of a block at once. A prefix scan over the blocks of each file
carries the number of documents and the place of the last separator across block boundaries.

Defined cases: two separators in a row are an empty document; ids after a file's last separator are a document that isn't
``ended``; an empty file has no documents. Ids that don't fit the width raise before anything is written. The writer gives null and empty texts no ids; repeated rows become documents
of their own; a null id of a document stays null, an id is a bigint and others raise; other columns are dropped. An empty table
gives no files and no rows. Texts of any length are written whole, and long documents span any number of blocks.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from routelab.llm import bpe, storage
from routelab.llm.common import fresh_uri, staged, tidy
from routelab.shipping import ship


def write_files(df: DataFrame, ranks_path: str, pattern: str, eod: int, width: int = 2, id_: str = "doc_id", text: str = "text", flush: int = 1 << 22) -> DataFrame:
    """Tokenise every text into one flat file a partition; file, ordinal and id of each document.

    A row of ordinal -1 ends each file and gives its bytes.
    """
    spark = df.sparkSession
    ship(spark)
    raw = bpe.read_ranks(ranks_path)
    if max(eod, max(bpe.parse_ranks(raw).values())) >= 1 << 8 * width:
        raise ValueError(f"ids don't fit into {width} bytes")
    shared = spark.sparkContext.broadcast(raw)
    folder = fresh_uri(spark, "tokens")
    kind = f"<u{width}"

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, end = bpe.codec(shared, pattern), np.array([eod], kind).tobytes()
        uri, size, ordinal = f"{folder}/{uuid.uuid4().hex}.tokens", 0, 0
        out = None
        for batch in batches:
            for start, stop in bpe.slices(batch.column(1), 2_000_000):
                part = batch.slice(start, stop - start)
                ids = [np.frombuffer(x, "<u4").astype(kind).tobytes() + end for x in own.encode(part.column(1).to_pylist())]
                out = out or storage.Appender(uri)
                size += out.write(b"".join(ids))
                yield _rows(uri, range(ordinal, ordinal + len(ids)), part.column(0).cast(pa.int64()), 0)
                ordinal += len(ids)
        if out:
            out.close()
            yield _rows(uri, [-1], pa.nulls(1, pa.int64()), size)

    def _rows(uri: str, ordinals: Iterable[int], ids: pa.Array, size: int) -> pa.RecordBatch:
        at = pa.array(list(ordinals), pa.int64())
        return pa.RecordBatch.from_arrays([pa.array([uri] * len(at)), at, ids, pa.array([size] * len(at), pa.int64())], names=["file", "ordinal", "id", "bytes"])

    return df.select(id_, text).mapInArrow(tidy(run), "file string, ordinal bigint, id bigint, bytes bigint")


def count_tokens(files: DataFrame, eod: int, width: int = 2, block_bytes: int = 1 << 23) -> DataFrame:
    """file, ordinal, token_start, n_tokens and ended of every document of the files (``file``, ``bytes``)."""
    ship(files.sparkSession)
    block_bytes -= block_bytes % width
    kind = f"<u{width}"
    blocks = files.filter("bytes > 0").select("file", "bytes", F.explode(F.sequence(F.lit(0), F.expr(f"cast((bytes - 1) div {block_bytes} as int)"))).alias("block"))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, size, block in zip(*(c.to_pylist() for c in batch.columns)):
                first = block * block_bytes
                with storage.RangeFile(file) as f:
                    ids = np.frombuffer(f.read(first, min(block_bytes, size - first)), kind)
                ends = np.flatnonzero(ids == eod) + first // width
                yield pa.RecordBatch.from_arrays(
                    [pa.array([file]), pa.array([block], pa.int32()), pa.array([size // width], pa.int64()), pa.array([first + block_bytes >= size])]
                    + [pa.array([ends], pa.list_(pa.int64())), pa.array([len(ends)], pa.int64()), pa.array([int(ends[-1]) if len(ends) else None], pa.int64())],
                    names=["file", "block", "tokens", "last", "ends", "n_ends", "last_end"],
                )

    tasks = storage.tasks_for(files.sparkSession, files.agg(F.coalesce(F.sum("bytes"), F.lit(0))).first()[0], block_bytes)
    schema = "file string, block int, tokens bigint, last boolean, ends array<bigint>, n_ends bigint, last_end bigint"
    found = staged(blocks.repartition(tasks, "file", "block").mapInArrow(tidy(run), schema), "separators")
    # The scan's rows are two numbers a block; places of separators are joined back afterwards.
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    carried = found.select(
        "file", "block", F.coalesce(F.sum("n_ends").over(before), F.lit(0)).alias("documents"), F.coalesce(F.max("last_end").over(before), F.lit(-1)).alias("open")
    )
    scanned = found.join(carried, ["file", "block"])
    last = F.coalesce("last_end", "open")
    unended = F.when(F.col("last") & (last < F.col("tokens") - 1), F.array("tokens")).otherwise(F.array().cast("array<bigint>"))
    each = scanned.select("file", "documents", "open", "tokens", "ends", F.posexplode(F.concat("ends", unended)).alias("k", "end"))
    start = F.when(F.col("k") == 0, F.col("open")).otherwise(F.get("ends", F.col("k") - 1)) + 1
    return each.select("file", (F.col("documents") + F.col("k")).alias("ordinal"), start.alias("token_start"), (F.col("end") - start).alias("n_tokens"), (F.col("end") < F.col("tokens")).alias("ended"))


def document_tokens(df: DataFrame, ranks_path: str, pattern: str, eod: int, width: int = 2, id_: str = "doc_id") -> DataFrame:
    """Write the texts' ids to flat files, scan those, and give each document its count: id, file, ordinal, token_start, n_tokens."""
    written = staged(write_files(df, ranks_path, pattern, eod, width, id_), "token-files")
    counts = count_tokens(written.filter("ordinal = -1").select("file", "bytes"), eod, width)
    ids = written.filter("ordinal >= 0").select("file", "ordinal", F.col("id").alias(id_))
    # Both sides have a row for each document: never a broadcast, however well they compress.
    return ids.hint("merge").join(counts, ["file", "ordinal"]).select(id_, "file", "ordinal", "token_start", "n_tokens")
