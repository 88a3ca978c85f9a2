"""N-gram Jaccard join with count-vector R-trees: classes of documents whose shingle sets are alike enough.

1. Every text's distinct shingles are hashed; equal sets become one representative, the least id.
2. Shingles have a global order, rare first, from counters of fixed size over the whole corpus. Two sets that are alike enough share
   one of the first ``n - ceil(s n) + 1`` of each. Sets that share such a shingle meet under its least id, the leader: a group.
3. In each group an R-tree indexes the sets' count vectors. Its bound, the sum of coordinate minima, joins the sets that may be
   alike into candidate classes; no text moves for that.
4. In each candidate class an R-tree over the texts' sets picks the pairs that are then verified exactly, best bound first. Sets
   already joined are not compared again, so a class of near copies costs a search and a comparison each.
   Joins on the way are sort-merge joins at every size: no table that grows with the corpus is broadcast.
5. Both steps split large groups into blocks, by rows and by shingles, that share their leader. What lies outside a group's largest class after that is
   searched for, as a query set and in blocks, among all of the group: no pair of different classes is left out.
6. Links become classes by connected components.

Links found span the same classes as all links; pairs within a class are not expanded. Defined cases: null and empty texts have an
empty set, link with nothing and are their own class. Rows that repeat an id are one document, whose texts' links all count; rows of
null id take no part and have a null class. Ids are bigints, others raise. Texts of any length are read whole. Other columns are
dropped. An empty table gives no rows. A table without links gives every document its own class.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from routelab.llm.bpe import slices
from routelab.llm.common import staged, tidy
from routelab.llm.components import connected_components
from routelab.llm.rtree import packed, point, point_links, set_links, unpacked
from routelab.llm.shingles import shingle_sets
from routelab.shipping import ship
from routelab.staging import Scratch

COUNTERS = 1 << 18
PART = 1 << 12
#: What a worker holds at once of a group: rows, and shingles (of 8 bytes, beside their texts).
BLOCK, QUERY_BLOCK = 256, 1024
BLOCK_SHINGLES, QUERY_SHINGLES = 1 << 21, 1 << 22
SLICE = 2_000_000


def _digest(own: np.ndarray) -> bytes:
    return hashlib.blake2b(own.tobytes(), digest_size=16).digest()


def set_digests(docs: DataFrame, width: int) -> DataFrame:
    """id, n and digest of each text's set, and, in rows of their own, each task's shingle counters in parts."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(COUNTERS, np.int64)
        for batch in batches:
            for start, stop in slices(batch.column(1), SLICE):
                part = batch.slice(start, stop - start)
                sets = shingle_sets(part.column(1).to_pylist(), width)
                if sum(map(len, sets)):
                    total += np.bincount((np.concatenate(sets) & np.uint64(COUNTERS - 1)).astype(np.int64), minlength=COUNTERS)
                rows = len(sets)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(list(map(len, sets)), pa.int64()), pa.array([_digest(s) for s in sets], pa.binary()), pa.nulls(rows, pa.int32()), pa.nulls(rows, pa.binary())],
                    names=["id", "n", "digest", "part", "counts"],
                )
        if total.any():
            parts = [total[a : a + PART].astype("<i8").tobytes() for a in range(0, COUNTERS, PART)]
            rows = len(parts)
            yield pa.RecordBatch.from_arrays(
                [pa.nulls(rows, pa.int64()), pa.nulls(rows, pa.int64()), pa.nulls(rows, pa.binary()), pa.array(range(rows), pa.int32()), pa.array(parts, pa.binary())], names=["id", "n", "digest", "part", "counts"]
            )

    return docs.mapInArrow(tidy(run), "id bigint, n bigint, digest binary, part int, counts binary")


def summed_counters(parts: DataFrame) -> np.ndarray:
    """The corpus' counters: parts are added up in two steps on the executors; COUNTERS numbers come to the driver."""

    def add(rows: pd.DataFrame) -> pd.DataFrame:
        total = np.zeros(PART, np.int64)
        for x in rows["counts"]:
            total += np.frombuffer(x, "<i8")
        return pd.DataFrame({"part": [rows["part"].iloc[0]], "counts": [total.tobytes()]})

    first = parts.withColumn("share", F.pmod(F.monotonically_increasing_id(), F.lit(509))).groupBy("part", "share").applyInPandas(add, "part int, counts binary")
    out = np.zeros(COUNTERS, np.int64)
    for row in first.groupBy("part").applyInPandas(add, "part int, counts binary").collect():
        out[row["part"] * PART : (row["part"] + 1) * PART] = np.frombuffer(row["counts"], "<i8")
    return out


def prefixes(docs: DataFrame, counters: np.ndarray, width: int, percent: int) -> DataFrame:
    """id, digest, size, count vector and the rarest shingles of each set that isn't empty: so many that two like sets share one."""
    shared = docs.sparkSession.sparkContext.broadcast(counters)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, mask = shared.value, np.uint64(COUNTERS - 1)
        for batch in batches:
            for start, stop in slices(batch.column(1), SLICE):
                part = batch.slice(start, stop - start)
                ids, digests, sizes, keys, points = [], [], [], [], []
                for id_, own in zip(part.column(0).to_pylist(), shingle_sets(part.column(1).to_pylist(), width)):
                    if len(own):
                        rare = np.argsort(counts[(own & mask).astype(np.int64)], kind="stable")  # ties by hash: the set is ascending
                        ids.append(id_)
                        digests.append(_digest(own))
                        sizes.append(len(own))
                        points.append(packed(point(own)))
                        keys.append(own[rare[: len(own) - (percent * len(own) + 99) // 100 + 1]].view(np.int64))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids, pa.int64()), pa.array(digests, pa.binary()), pa.array(sizes, pa.int64()), pa.array(points, pa.binary()), pa.array(keys, pa.list_(pa.int64()))], names=["id", "digest", "n", "point", "keys"]
                )

    return docs.mapInArrow(tidy(run), "id bigint, digest binary, n bigint, point binary, keys array<bigint>")


def block_links(rows: DataFrame, payload: str, width: int, percent: int) -> DataFrame:
    """Links (u, v) between classes within each (leader, block, chunk) of rows (leader, block, chunk, class, query, payload).

    Payload ``point`` links by bounds, payload ``text`` exactly.
    """
    keyed = rows.repartition("leader", "block", "chunk").sortWithinPartitions("leader", "block", "chunk").select("leader", "block", "chunk", "class", "query", payload)

    def found(held: list[tuple]) -> list[tuple[int, int]]:
        classes, queries, values = map(list, zip(*held))
        return (set_links if payload == "text" else point_links)(classes, values, percent, None if all(queries) else queries)

    def values_of(column: list) -> list[np.ndarray]:
        return shingle_sets(column, width) if payload == "text" else list(map(unpacked, column))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, held = None, []
        for batch in batches:
            for start, stop in slices(batch.column(5), SLICE):
                part = [batch.column(k).slice(start, stop - start).to_pylist() for k in range(6)]
                out = []
                for *key, class_, query, own in zip(*part[:5], values_of(part[5])):
                    if key != group:
                        out += found(held) if len(held) > 1 else []
                        group, held = key, []
                    held.append((class_, query, own))
                if out:
                    yield _links(out)
        if len(held) > 1 and (out := found(held)):
            yield _links(out)

    def _links(out: list[tuple[int, int]]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*out)], names=["u", "v"])

    return keyed.mapInArrow(tidy(run), "u bigint, v bigint")


def _share(id_: str, of: Column) -> Column:
    return F.pmod(F.xxhash64(id_), of).cast("int")


def _all(of: Column) -> Column:
    return F.explode(F.sequence(F.lit(0), (of - 1).cast("int")))


def _blocks(rows: Column, shingles: Column, most_rows: int, most_shingles: int) -> Column:
    return F.greatest(F.ceil(rows / most_rows), F.ceil(shingles / most_shingles), F.lit(1)).cast("int")


def group_blocks(groups: DataFrame, sizes: DataFrame) -> DataFrame:
    """Rows (leader, id) dealt into blocks; the leader is in all of its blocks. ``sizes`` has the large groups' blocks."""
    dealt = groups.join(sizes, "leader", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    every = dealt.filter("id = leader").select("leader", "id", _all(F.col("blocks")).alias("block"))
    rest = dealt.filter("id <> leader").select("leader", "id", _share("id", F.col("blocks")).alias("block"))
    return every.unionByName(rest).select("leader", "block", F.lit(0).alias("chunk"), "id", F.col("id").alias("class"), F.lit(True).alias("query"))


def query_blocks(groups: DataFrame, sizes: DataFrame, classes: DataFrame, stage: Scratch) -> DataFrame:
    """Of large groups, the documents outside the largest class as queries against blocks of the whole group."""
    labelled = groups.join(sizes, "leader").join(classes, F.col("id") == F.col("node"), "left").select("leader", "id", "n", F.coalesce("component", "id").alias("class"))
    labelled = stage(labelled, "large-groups")
    by_class = labelled.groupBy("leader", "class").agg(F.count("*").alias("rows"), F.sum("n").alias("n"))
    largest = F.max_by(F.struct("class", "rows", "n"), F.struct("rows", -F.col("class")))
    group = by_class.groupBy("leader").agg(largest.alias("top"), F.sum("rows").alias("rows"), F.sum("n").alias("n")).filter("rows > top.rows")
    up = lambda rows, n: _blocks(rows, n, QUERY_BLOCK, QUERY_SHINGLES)
    group = group.select("leader", F.col("top.class").alias("largest"), up(F.col("rows"), F.col("n")).alias("blocks"), up(F.col("rows") - F.col("top.rows"), F.col("n") - F.col("top.n")).alias("chunks"))
    rows = labelled.join(group, "leader")
    index = rows.select("leader", _share("id", F.col("blocks")).alias("block"), _all(F.col("chunks")).alias("chunk"), "id", "class", F.lit(False).alias("query"))
    asked = rows.filter("class <> largest").select("leader", _all(F.col("blocks")).alias("block"), _share("id", F.col("chunks")).alias("chunk"), "id", "class", F.lit(True).alias("query"))
    return index.unionByName(asked)


def group_classes(groups: DataFrame, payloads: DataFrame, payload: str, width: int, percent: int, stage: Scratch) -> DataFrame:
    """(node, component) of the ids that links within the groups (leader, id, n: shingles) join; ``payloads`` has id and the payload."""
    sizes = groups.groupBy("leader").agg(F.count("*").alias("rows"), F.sum("n").alias("n"))
    sizes = sizes.select("leader", _blocks(F.col("rows") - 1, F.col("n"), BLOCK, BLOCK_SHINGLES).alias("blocks")).filter("blocks > 1")
    sizes = stage(sizes, "large")
    own = stage(payloads.hint("merge").join(groups.select("id").distinct(), "id", "left_semi"), "payloads")
    routed = stage(group_blocks(groups, sizes), "blocks")
    found = stage(block_links(own.hint("merge").join(routed, "id"), payload, width, percent), "links")
    classes = stage(connected_components(found, stage), "classes")
    if sizes.isEmpty():
        return classes
    routed = stage(query_blocks(groups, sizes, classes, stage), "query-blocks")
    more = stage(block_links(own.hint("merge").join(routed, "id"), payload, width, percent), "links")
    if more.isEmpty():
        return classes
    stars = classes.filter("node <> component").select(F.col("node").alias("u"), F.col("component").alias("v"))
    return stage(connected_components(stars.unionByName(more), stage), "classes")


def jaccard_classes(df: DataFrame, width: int = 4, percent: int = 85, id_: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: id, n_shingles (size of its set) and component_id (the least id that its links reach, itself included)."""
    ship(df.sparkSession)
    with Scratch(df.sparkSession) as stage:
        return _classes_of(df, width, percent, id_, text, stage)


def same_document(sets: DataFrame, leaders: DataFrame, stage: Scratch) -> tuple[DataFrame, DataFrame] | None:
    """The ids that repeat with another set, and edges (u, v) that tie their sets' representatives; None where no id does."""
    several = sets.filter("id is not null").groupBy("id").agg(F.min("digest").alias("a"), F.max("digest").alias("b")).filter("a <> b").select("id")
    several = stage(several, "repeated")
    if several.isEmpty():
        return None
    reps = sets.hint("merge").join(several, "id").select("id", "digest").distinct().join(leaders, "digest").select("id", "rep")
    return several, stage(reps.join(reps.groupBy("id").agg(F.min("rep").alias("v")), "id").select(F.col("rep").alias("u"), "v").filter("u <> v").distinct(), "ties")


def _classes_of(df: DataFrame, width: int, percent: int, id_: str, text: str, stage: Scratch) -> DataFrame:
    docs = df.select(F.col(id_).cast("bigint").alias("id"), F.col(text).alias("text"))
    known = docs.filter("id is not null")

    digests = stage(set_digests(docs, width), "digests")
    sets = digests.filter("part is null").select("id", "n", "digest")
    counters = summed_counters(digests.filter("part is not null").select("part", "counts"))
    leaders = stage(sets.filter("n > 0 and id is not null").groupBy("digest").agg(F.min("id").alias("rep")), "leaders")
    ties = same_document(sets, leaders, stage)

    keys = prefixes(known, counters, width, percent).hint("merge").join(leaders.select("digest", F.col("rep").alias("id")), ["digest", "id"])
    keys = stage(keys.groupBy("digest", "id").agg(F.first("n").alias("n"), F.first("keys").alias("keys"), F.first("point").alias("point")).drop("digest"), "prefixes")
    each = keys.select("id", "n", F.explode("keys").alias("key"))
    buckets = each.groupBy("key").agg(F.min("id").alias("leader"), F.count("*").alias("rows")).filter("rows > 1").select("key", "leader")
    groups = stage(each.hint("merge").join(buckets, "key").groupBy("leader", "id").agg(F.max("n").alias("n")), "groups")

    candidates = group_classes(groups, keys.select("id", "point"), "point", width, percent, stage)
    found = candidates.hint("merge").join(keys.groupBy(F.col("id").alias("node")).agg(F.sum("n").alias("n")), "node")
    classes = group_classes(found.select(F.col("component").alias("leader"), F.col("node").alias("id"), "n"), known, "text", width, percent, stage)
    if ties is not None:
        stars = classes.filter("node <> component").select(F.col("node").alias("u"), F.col("component").alias("v"))
        classes = stage(connected_components(stars.unionByName(ties[1]), stage), "classes")

    of_rep = leaders.hint("merge").join(classes, F.col("rep") == F.col("node"), "left").select("digest", F.coalesce("component", "rep").alias("component"))
    out = sets.hint("merge").join(of_rep, "digest", "left")
    if ties is not None:
        by_id = sets.hint("merge").join(ties[0], "id").join(of_rep, "digest").groupBy("id").agg(F.min("component").alias("of_id"))
        out = out.hint("merge").join(by_id, "id", "left").withColumn("component", F.coalesce("of_id", "component"))
    least = F.when(F.col("id").isNotNull(), F.coalesce("component", "id"))
    return staged(out.select(F.col("id").alias(id_), F.col("n").alias("n_shingles"), least.alias("component_id")), "result")


def one_of_each_class(df: DataFrame, width: int = 5, percent: int = 80, id_: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents of least id of their class, all columns as they are, and every row of null id.

    Rows that repeat an id are one document: of them the row of least hash over all its columns stays.
    """
    first = jaccard_classes(df, width, percent, id_, text).filter(F.col("component_id") == F.col(id_)).groupBy(id_).agg(F.count("*").alias("rows"))
    first = staged(first, "firsts")
    once = df.join(first.filter("rows = 1").select(id_), id_, "left_semi").select(df.columns)
    row = F.struct(*[F.col(c) for c in df.columns])
    several = df.join(first.filter("rows > 1").select(id_), id_, "left_semi").groupBy(F.col(id_).alias("__id"))
    several = several.agg(F.min_by(row, F.struct(F.xxhash64(*df.columns), F.md5(F.coalesce(F.col(text), F.lit("")).cast("binary")))).alias("row")).select("row.*")
    return once.unionByName(several).unionByName(df.filter(F.col(id_).isNull()))
