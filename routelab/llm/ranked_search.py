"""Ranked lexical search over inverted treaps.

The index deals documents to shards of a bounded size, without a shuffle: each task cuts its own rows into shards and writes, for every
term of a shard, one treap of the term's postings. A treap is a search tree by document and a heap by impact, the term's part of a score
before its weight; equal impacts are ordered by a hash of the document, so that copies make no chains. Trees are stored in document order
with the places of each node's children, the root known by its own place, so that a term is one row of a Parquet table.

A search goes through all treaps of an item at once, within each shard. A state is a range of documents with one node for each term, the
highest of the term's treap in the range. The summed weights times impacts of these nodes bound every score in the range: a state whose
bound can't enter the shard's best k goes, with all subtrees below. Of the others the document of the greatest part is scored in full
and the range falls into those before and behind it. Many states of many items move at once as arrays; their number is bounded, as blocks
of states are taken depth first. The shards' best k meet in one window over the items, which Spark cuts to k rows a task first.

Scores are 64-bit integers. A term's weight is floor(1000 ln((2N + 2) / (2 df + 1))) over all N documents with a term; an impact is
(10^9 tf) div (1000 tf + 12 m), with m = 75 + (25 n N) div L of a document of n terms, all documents having L.

Defined cases: a null text, an empty one or one without terms is in no result. An item without terms, or whose terms no document holds,
has no rows. Each row of documents is a document: rows that repeat are ranked beside each other, and equal scores go by ascending id,
null ids last. Rows that repeat an item's id are one item with the terms of its different texts. Very long texts are taken whole, in a
shard of their own where they exceed its size. Other columns, whatever their names, aren't read. An empty table gives no rows.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from routelab.llm.common import tidy
from routelab.llm.url_reputation import LOWER, UPPER
from routelab.shipping import ship
from routelab.staging import Scratch, staged

#: Fixed value: a term is a maximal match, with only A-Z lowered.
TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_BYTES = bytes(b if b >= 128 or re.match(TERM, chr(b)) else 32 for b in range(256)).lower()

SHARD_BYTES = 16 << 20
#: Items that are searched for together, and distinct terms of items up to which these are sent to all tasks (some ten MB).
BLOCK_ITEMS, BROADCAST_TERMS = 1024, 100_000

INDEX = "shard bigint, term string, n int, docs binary, impacts binary, before binary, behind binary, ids binary"


@dataclass
class Index:
    """A staged index table with the number of documents that have a term, and of all their terms."""

    table: DataFrame
    documents: int
    terms: int


def lowered(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


def impact(tf: np.ndarray, n: np.ndarray, documents: int, terms: int) -> np.ndarray:
    return 1_000_000_000 * tf // (1000 * tf + 12 * (75 + 25 * n * documents // terms))


class _Numbers(dict):
    """Numbers its keys in the order of their first use."""

    def __missing__(self, key: bytes) -> int:
        self[key] = found = len(self)
        return found


def treap(docs: np.ndarray, impacts: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For postings in document order, those of a term from one of ``starts`` to the next: each node's child before and behind it.

    Children are places within the term, -1 for none. The tree of a term is the one that has both orders.
    """
    n = len(docs)
    mixed = (docs.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(40)
    keys = (impacts.astype(np.int64) << 24 | mixed.astype(np.int64)).tolist()
    before, behind = [-1] * n, [-1] * n
    bounds = [*starts.tolist(), n]
    for first, stop in zip(bounds, bounds[1:]):
        spine: list[int] = []
        for k in range(first, stop):
            last, key = -1, keys[k]
            while spine and keys[spine[-1]] < key:
                last = spine.pop()
            if last >= 0:
                before[k] = last - first
            if spine:
                behind[spine[-1]] = k - first
            spine.append(k)
    return np.array(before, np.int32), np.array(behind, np.int32)


class _Shard:
    """The documents of a shard while they come in."""

    def __init__(self) -> None:
        self.bytes, self.ids, self.sizes = 0, [], []
        self.numbers = _Numbers()
        self.terms: list[np.ndarray] = []
        self.counts: list[np.ndarray] = []

    def add(self, doc_id: int | None, text: str) -> None:
        found = text.encode().translate(_BYTES).split()
        if found:
            counts = Counter(found)
            self.terms.append(np.fromiter(map(self.numbers.__getitem__, counts), np.int32, len(counts)))
            self.counts.append(np.fromiter(counts.values(), np.int64, len(counts)))
            self.ids.append(doc_id)
            self.sizes.append(len(found))
            self.bytes += len(text) + 8 * len(counts)

    def rows(self, shard: int, documents: int, terms: int, batch: int = 1 << 21) -> Iterator[pa.RecordBatch]:
        """The index rows of the shard: its ids (null ones are the last documents and left out), then a row for each term in string order, in batches of about so many postings."""
        schema = pa.schema([("shard", pa.int64()), ("term", pa.string()), ("n", pa.int32()), *((c, pa.binary()) for c in ("docs", "impacts", "before", "behind", "ids"))])
        order = sorted(range(len(self.ids)), key=lambda k: (self.ids[k] is None, self.ids[k] or 0))
        named = [self.ids[k] for k in order if self.ids[k] is not None]
        yield pa.RecordBatch.from_pylist([{"shard": shard, "n": len(order), "ids": np.array(named, np.int64).tobytes()}], schema)
        place = np.empty(len(order), np.int32)
        place[order] = np.arange(len(order), dtype=np.int32)
        words = sorted(self.numbers)
        rank = np.empty(len(words), np.int32)
        rank[[self.numbers[w] for w in words]] = np.arange(len(words), dtype=np.int32)
        lengths = list(map(len, self.terms))
        term, count = rank[np.concatenate(self.terms)], np.concatenate(self.counts)
        size, doc = np.repeat(np.array(self.sizes, np.int64), lengths), np.repeat(place, lengths)
        sort = np.lexsort((doc, term))
        term, doc = term[sort], doc[sort]
        impacts = impact(count[sort], size[sort], documents, terms).astype(np.int32)
        starts = np.searchsorted(term, np.arange(len(words))).astype(np.int64)
        sides = treap(doc, impacts, starts)
        bounds = np.append(starts, len(term))
        first = 0
        while first < len(words):
            stop = max(first + 1, int(np.searchsorted(bounds, bounds[first] + batch, "right")) - 1)
            offsets = pa.py_buffer(((bounds[first : stop + 1] - bounds[first]) * 4).astype(np.int32))
            part = slice(bounds[first], bounds[stop])
            blobs = [pa.Array.from_buffers(pa.binary(), stop - first, [None, offsets, pa.py_buffer(np.ascontiguousarray(x[part], np.int32))]) for x in (doc, impacts, *sides)]
            names = pa.array([w.decode() for w in words[first:stop]], pa.string())
            sizes = pa.array(np.diff(bounds[first : stop + 1]).astype(np.int32))
            yield pa.RecordBatch.from_arrays([pa.array(np.full(stop - first, shard)), names, sizes, *blobs, pa.nulls(stop - first, pa.binary())], schema=schema)
            first = stop


def build_index(docs: DataFrame, id: str = "doc_id", text: str = "text", shard_bytes: int = SHARD_BYTES, stage=staged) -> Index:
    """Index every row of ``docs``: one pass for the corpus' counts, one that writes the treaps."""
    spark = docs.sparkSession
    ship(spark)
    rows = docs.select(F.col(id).cast("bigint").alias("id"), F.col(text).alias("text"))
    n = F.coalesce(F.regexp_count("text", F.lit(TERM)), F.lit(0)).cast("bigint")
    documents, terms = rows.select(n.alias("n")).agg(F.count_if(F.col("n") > 0), F.coalesce(F.sum("n"), F.lit(0))).first()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number, shard = TaskContext.get().partitionId() << 32, _Shard()
        for batch in batches:
            for doc_id, body in zip(batch.column(0).to_pylist(), batch.column(1)):
                shard.add(doc_id, body.as_py() or "")
                if shard.bytes >= shard_bytes:
                    yield from shard.rows(number, documents, terms)
                    number, shard = number + 1, _Shard()
        if shard.ids:
            yield from shard.rows(number, documents, terms)

    return Index(stage(rows.mapInArrow(tidy(run), INDEX), "treaps"), documents, terms)


class Trees:
    """The treaps of a shard for the terms of a block of items, end to end."""

    def __init__(self, docs: list[bytes], impacts: list[bytes], before: list[bytes], behind: list[bytes], n_docs: int):
        sizes = np.array([len(x) // 4 for x in docs], np.int64)
        starts = np.concatenate([[0], np.cumsum(sizes)[:-1]]) if len(sizes) else np.zeros(0, np.int64)
        self.docs, self.impacts = (np.frombuffer(b"".join(x), np.int32).astype(np.int64) for x in (docs, impacts))
        shift = np.repeat(starts, sizes)
        self.before, self.behind = (np.where((x := np.frombuffer(b"".join(side), np.int32)) < 0, -1, x + shift) for side in (before, behind))
        #: A node is found by its term and document; the root of a term is the node that is nobody's child.
        self.n_docs, self.keys = n_docs, np.repeat(np.arange(len(sizes)), sizes) * n_docs + self.docs
        root = np.ones(len(self.docs), bool)
        root[self.before[self.before >= 0]] = root[self.behind[self.behind >= 0]] = False
        self.roots = np.flatnonzero(root)
        #: Nodes of states that a search has looked at, and states that it has left out.
        self.visited = self.pruned = 0

    def search(self, item: np.ndarray, term: np.ndarray, weight: np.ndarray, k: int, slots: int = 400_000) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The best ``k`` documents of each item as (item, document, score), for rows of (item, term, weight > 0) sorted by item.

        Items are numbers from 0 on, terms places of this shard's treaps. Blocks of more than ``slots`` nodes are split.
        """
        n_items = int(item.max()) + 1 if len(item) else 0
        least, last = np.zeros(n_items, np.int64), np.full(n_items, -1, np.int64)
        best = tuple(np.zeros(0, np.int64) for _ in range(3))
        heads, firsts = np.unique(item, return_index=True)
        first_state = (heads, np.zeros(len(heads), np.int64), np.full(len(heads), self.n_docs - 1), np.diff(np.append(firsts, len(item))), self.roots[term], term, weight)
        blocks = [first_state]
        while blocks:
            owner, lo, hi, width, node, tree, heavy = blocks.pop()
            if len(node) > slots and len(owner) > 1:
                half = len(owner) // 2
                cut = int(width[:half].sum())
                blocks.append((owner[half:], lo[half:], hi[half:], width[half:], node[cut:], tree[cut:], heavy[cut:]))
                blocks.append((owner[:half], lo[:half], hi[:half], width[:half], node[:cut], tree[:cut], heavy[:cut]))
                continue
            state = np.repeat(np.arange(len(owner)), width)
            while True:  # down to the highest node within the range
                doc = self.docs[node]
                high, low = doc > hi[state], doc < lo[state]
                if not (high | low).any():
                    break
                node = np.where(high, self.before[node], np.where(low, self.behind[node], node))
                kept = node >= 0
                state, node, tree, heavy = state[kept], node[kept], tree[kept], heavy[kept]
            self.visited += len(node)
            part = heavy * self.impacts[node]
            alive, start = np.unique(state, return_index=True)
            if not len(alive):
                continue
            bound = np.add.reduceat(part, start)
            own = owner[alive]
            good = (bound > least[own]) | ((bound == least[own]) & (lo[alive] < last[own]))
            self.pruned += int((~good).sum())
            if not good.any():
                continue
            keep = np.repeat(good, np.diff(np.append(start, len(state))))
            alive, state, node, tree, heavy, part = alive[good], state[keep], node[keep], tree[keep], heavy[keep], part[keep]
            own, lo, hi = owner[alive], lo[alive], hi[alive]
            start = np.flatnonzero(np.diff(state, prepend=-1))
            width = np.diff(np.append(start, len(state)))
            state = np.repeat(np.arange(len(alive)), width)
            greatest = np.maximum.reduceat(part, start)
            chosen = np.flatnonzero(part == greatest[state])
            chosen = chosen[np.diff(state[chosen], prepend=-1) > 0]
            pivot = self.docs[node[chosen]]
            wanted = tree * self.n_docs + pivot[state]
            at = np.minimum(np.searchsorted(self.keys, wanted), len(self.keys) - 1)
            score = np.add.reduceat(np.where(self.keys[at] == wanted, heavy * self.impacts[at], 0), start)
            best = self._merged(best, (own, pivot, score), k, least, last)
            two = np.concatenate([np.arange(len(own))] * 2)
            lo, hi = np.concatenate([lo, pivot + 1]), np.concatenate([pivot - 1, hi])
            real = np.flatnonzero(lo <= hi)
            spread = _ranges(start[two[real]], width[two[real]])
            blocks.append((own[two[real]], lo[real], hi[real], width[two[real]], node[spread], tree[spread], heavy[spread]))
        return best

    @staticmethod
    def _merged(best, more, k: int, least: np.ndarray, last: np.ndarray):
        """The best ``k`` of each item of two tables; a full item's least score and its last document go to ``least`` and ``last``."""
        item, doc, score = (np.concatenate(x) for x in zip(best, more))
        order = np.lexsort((doc, -score, item))
        item, doc, score = item[order], doc[order], score[order]
        place = np.arange(len(item)) - np.searchsorted(item, item)
        full = place == k - 1
        least[item[full]], last[item[full]] = score[full], doc[full]
        return item[place < k], doc[place < k], score[place < k]


def _ranges(start: np.ndarray, width: np.ndarray) -> np.ndarray:
    ends = np.cumsum(width)
    return np.repeat(start - ends + width, width) + np.arange(ends[-1] if len(ends) else 0)


def item_terms(items: DataFrame, id: str = "item_id", text: str = "text") -> DataFrame:
    """(item, term, times) of the items' terms, repeats counted."""
    texts = items.select(F.col(id).alias("item"), lowered(F.col(text)).alias("text")).distinct()
    words = texts.select("item", F.explode(F.regexp_extract_all("text", F.lit(TERM), F.lit(0))).alias("term"))
    return words.groupBy("item", "term").agg(F.count("*").alias("times"))


def search(index: Index, items: DataFrame, k: int = 20, id: str = "item_id", text: str = "text", stage=staged) -> DataFrame:
    """``id``, rank, doc_id and score of the ``k`` best documents of each item."""
    spark = items.sparkSession
    terms = stage(item_terms(items, id, text), "item-terms")
    n_items, n_terms = terms.agg(F.count_distinct(F.struct("item")), F.count_distinct("term")).first()
    block = F.pmod(F.xxhash64("item"), F.lit(max(1, -(-n_items // BLOCK_ITEMS)))).cast("int")
    n_blocks = max(1, -(-n_items // BLOCK_ITEMS))
    few = F.broadcast if n_terms <= BROADCAST_TERMS else (lambda df: df)
    held = index.table.filter("term IS NOT NULL").select("shard", "term", "n").join(few(terms.select("term").distinct()), "term", "left_semi")
    df = stage(held.groupBy("term").agg(F.sum("n").alias("df")), "term-documents")
    weight = F.floor(1000 * F.log((2.0 * index.documents + 2.0) / (2.0 * F.col("df") + 1.0)))
    weighed = terms.join(few(df), "term").select("item", "term", (weight * F.col("times")).cast("bigint").alias("weight"), block.alias("block")).filter("weight > 0")
    asked = weighed.groupBy("block", "term").agg(F.collect_list(F.struct("item", "weight")).alias("asked"))
    trees = index.table.filter("term IS NOT NULL").drop("ids").join(few(asked), "term").withColumn("ids", F.lit(None).cast("binary"))
    ids = index.table.filter("term IS NULL").withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(n_blocks - 1)))).withColumn("asked", F.lit(None).cast(asked.schema["asked"].dataType))
    item_type = terms.schema["item"].dataType.simpleString()
    both = trees.unionByName(ids).select("block", "shard", "n", "docs", "impacts", "before", "behind", "asked", "ids")

    def run(group: pd.DataFrame) -> pd.DataFrame:
        head, group = group[group["ids"].notna()], group[group["ids"].isna()]
        empty = pd.DataFrame({"item": pd.Series([], dtype=object), "doc_id": pd.Series([], dtype="Int64"), "score": pd.Series([], dtype="int64")})
        if group.empty:
            return empty
        doc_ids, n_docs = np.frombuffer(head["ids"].iloc[0], np.int64), int(head["n"].iloc[0])
        trees = Trees(group["docs"].tolist(), group["impacts"].tolist(), group["before"].tolist(), group["behind"].tolist(), n_docs)
        rows = [(a["item"], t, a["weight"]) for t, asked in enumerate(group["asked"]) for a in asked]
        names = {x: n for n, x in enumerate(dict.fromkeys(r[0] for r in rows))}
        item, term, heavy = (np.array(c, np.int64) for c in zip(*((names[i], t, w) for i, t, w in rows)))
        order = np.argsort(item, kind="stable")
        item, doc, score = trees.search(item[order], term[order], heavy[order], k)
        back = list(names)
        ids = pd.array([int(doc_ids[d]) if d < len(doc_ids) else None for d in doc.tolist()], dtype="Int64")
        return pd.DataFrame({"item": pd.Series([back[i] for i in item.tolist()], dtype=object), "doc_id": ids, "score": score})

    ship(spark)
    found = both.groupBy("block", "shard").applyInPandas(run, f"item {item_type}, doc_id bigint, score bigint")
    ranked = found.withColumn("rank", F.row_number().over(Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))))
    return ranked.filter(F.col("rank") <= k).select(F.col("item").alias(id), "rank", "doc_id", "score")


def ranked_search(docs: DataFrame, items: DataFrame, k: int = 20) -> DataFrame:
    """Index and search in one go: the result is staged, the index and all between deleted."""
    with Scratch(docs.sparkSession) as scratch:
        index = build_index(docs, stage=scratch)
        return staged(search(index, items, k, stage=scratch), "ranked")
