"""Benchmark decontamination by pigeonhole edit matching.

Texts are compared as lower-cased runs of word characters with one space between. An item of n characters may differ by
``int(n * budget)`` edits; it is cut into that many pieces plus one, so every match keeps a piece whole. An Aho-Corasick automaton
finds piece hits. A hit climbs a binary tree over the item's pieces: a node of p pieces must occur, within p - 1 edits, around the
hit, by Myers' bit-parallel distance; the root is the item with its whole budget. (If a node occurs within its budget one of its
children does too, so no match is lost on the way.)

An item stands between word borders: it is searched with a space before and behind it, in a text with one at each end, so that "cat" is
not found in "concatenate"; a border that is missing costs an edit. Items of fewer than ten characters have no edits to spend at a
budget of a tenth and match as whole words only.

Each item is reported once a document, at its place of least edits; of places with as few, at that of the least start, then end.

Defined cases: null or empty texts match nothing, and neither do items without word characters. Empty tables give no rows; an empty
table of items finds nothing. Repeated items are reported
each; repeated documents too. Ids of either table keep their type, nulls included. Extra columns are dropped. Very long texts are
searched whole. Items beyond ``block_bytes`` take a further pass over the documents for each such block, so that a worker never
holds more than one block's automaton.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from routelab.llm.common import tidy
from routelab.shipping import ship

NOT_WORD = re.compile(r"[\W_]+")


def normal(text: str | None) -> str:
    return NOT_WORD.sub(" ", text.lower()).strip() if text else ""


class Pattern:
    """Bit masks of a string for Myers' search."""

    def __init__(self, text: str):
        self.size, self.masks = len(text), {}
        for at, c in enumerate(text):
            self.masks[c] = self.masks.get(c, 0) | 1 << at

    def best(self, text: str, most: int) -> tuple[int, int] | None:
        """Least edits, and the first end in ``text``, of an occurrence within ``most`` edits."""
        full, high, masks = (1 << self.size) - 1, 1 << self.size - 1, self.masks.get
        up, down, score, found = full, 0, self.size, None
        for at, c in enumerate(text, 1):
            same = masks(c, 0)
            x = same | down
            h = (((same & up) + up) ^ up) | same
            plus, minus = down | ~(h | up) & full, up & h
            if plus & high:
                score += 1
            elif minus & high:
                score -= 1
            if score <= most:
                found, most = (score, at), score - 1
                if not score:
                    break
            plus, minus = plus << 1 & full, minus << 1 & full
            up, down = minus | ~(x | plus) & full, plus & x
        return found


class Matcher:
    """Searches texts for the items of one block; ``borders``: between word borders only."""

    def __init__(self, items: list[tuple[int, str]], budget: float, borders: bool = False):
        self.space = " " if borders else ""
        self.items, self.cuts, self.nodes, self.paths = {}, {}, {}, {}
        self.pieces = ahocorasick.Automaton()
        places: dict[str, list[tuple[int, int]]] = {}
        for k, (_, text) in enumerate(items):
            n = int(len(text) * budget) + 1
            text = f"{self.space}{text}{self.space}"
            size = len(text)
            cuts = [size * j // n for j in range(n + 1)]
            self.items[k], self.cuts[k] = text, cuts
            for j, (a, b) in enumerate(zip(cuts, cuts[1:])):
                places.setdefault(text[a:b], []).append((k, j))
        self.ids = [item for item, _ in items]
        for piece, where in places.items():
            self.pieces.add_word(piece, (len(piece), where))
        self.pieces.make_automaton()

    def node(self, k: int, low: int, high: int) -> Pattern:
        if (k, low, high) not in self.nodes:
            self.nodes[k, low, high] = Pattern(self.items[k][self.cuts[k][low] : self.cuts[k][high]])
        return self.nodes[k, low, high]

    def path(self, k: int, j: int) -> tuple[list[tuple[int, int, int, Pattern]], list[str]]:
        """Of the nodes above piece j of item k, lowest first: budget, characters before and after the piece's start, pattern.

        Also strings of which the lowest node must hold one: with the piece whole, its budget falls on the rest of the node,
        which is cut into one part more than that.
        """
        if (k, j) not in self.paths:
            cuts = self.cuts[k]
            low, high, out, rest = 0, len(cuts) - 1, [], ""
            while high - low > 1:
                out.append((high - low - 1, cuts[j] - cuts[low], cuts[high] - cuts[j], self.node(k, low, high)))
                middle = (low + high) // 2
                a, b = (low, middle) if j < middle else (middle, high)
                rest = self.items[k][cuts[low] : cuts[a]] or self.items[k][cuts[b] : cuts[high]]
                low, high = a, b
            parts = out[-1][0] + 1 if out else 1
            self.paths[k, j] = out[::-1], [rest[len(rest) * i // parts : len(rest) * (i + 1) // parts] for i in range(parts)]
        return self.paths[k, j]

    def climb(self, text: str, start: int, k: int, j: int) -> tuple[int, int, int] | None:
        """Edits, start and end of the item around its piece j at ``start``."""
        path, rests = self.path(k, j)
        if not path:
            return 0, start, start + len(self.items[k])
        for most, before, after, node in path:
            first = start - before - most
            if first < 0:
                first = 0
            window = text[first : start + after + most]
            if rests:
                if not any(map(window.__contains__, rests)):
                    return None
                rests = None
            found = node.best(window, most)
            if not found:
                return None
        edits, end = found
        back = Pattern(self.items[k][::-1]).best(window[:end][::-1], edits)
        return edits, first + end - back[1], first + end

    def __call__(self, text: str | None) -> list[tuple[int, int, int, int]]:
        """(item id, edits, start, end) of each item found, at its best place, in the normal form of ``text``."""
        text = normal(text)
        best: dict[int, tuple[int, int, int]] = {}
        if not text:
            return []
        length, text = len(text), f"{self.space}{text}{self.space}"
        for last, (size, where) in self.pieces.iter(text):
            start = last + 1 - size
            for k, j in where:
                if k in best and best[k][0] == 0 and best[k][1] <= start:
                    continue
                if (found := self.climb(text, start, k, j)) and (k not in best or found < best[k]):
                    best[k] = found
        # Without the spaces around it a place begins where its first space does, as the text's own first space is cut too.
        cut = 2 * len(self.space)
        return [(self.ids[k], edits, min(start, length), max(min(start, length), min(end - cut, length))) for k, (edits, start, end) in best.items()]


def blocks(items: DataFrame, item: str, text: str, block_bytes: int) -> Iterator[list[tuple[int, str]]]:
    """The items' ids and normal forms in blocks of bounded size: the stated query set, whatever its size."""
    held, size = [], 0
    for row in items.select(item, text).toLocalIterator():
        form = normal(row[1])
        if not form:
            continue
        if held and size + len(form) > block_bytes:
            yield held
            held, size = [], 0
        held.append((row[0], form))
        size += len(form)
    if held:
        yield held


def find_items(docs: DataFrame, items: DataFrame, budget: float = 0.1, doc: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text", block_bytes: int = 4_000_000) -> DataFrame:
    """doc_id, item_id, edits and the place in the normal text of every item that a document contains.

    One pass over the documents for each block of items; a block's automaton is the only thing sent to the executors.
    """
    spark = docs.sparkSession
    ship(spark)
    own = docs.select(doc, text)
    schema = T.StructType([T.StructField(doc, own.schema[doc].dataType), T.StructField(item, items.schema[item].dataType)])
    schema = schema.add("edits", T.IntegerType()).add("match_start", T.LongType()).add("match_end", T.LongType())
    doc_kind, item_kind = (to_arrow_type(f.dataType) for f in schema.fields[:2])
    out = None
    for block in blocks(items, item, item_text, block_bytes):
        shared = spark.sparkContext.broadcast(block)

        def run(batches: Iterable[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            search = Matcher(shared.value, budget, True)
            for batch in batches:
                rows = [(d, *found) for d, t in zip(batch.column(0).to_pylist(), batch.column(1)) for found in search(t.as_py())]
                columns = list(zip(*rows)) or [()] * 5
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (doc_kind, item_kind, pa.int32(), pa.int64(), pa.int64()))], names=[doc, item, "edits", "match_start", "match_end"])

        found = own.mapInArrow(tidy(run), schema)
        out = found if out is None else out.unionByName(found)
    return spark.createDataFrame([], schema) if out is None else out


def without_items(docs: DataFrame, items: DataFrame, budget: float = 0.1, text: str = "text", item: str = "item_id", item_text: str = "text", block_bytes: int = 4_000_000) -> DataFrame:
    """The documents that contain no item, all columns as they are; rows of null id are judged like others."""
    spark = docs.sparkSession
    ship(spark)
    for block in blocks(items, item, item_text, block_bytes):
        shared = spark.sparkContext.broadcast(block)

        def run(batches: Iterable[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            search = Matcher(shared.value, budget, True)
            for batch in batches:
                clean = [not search(t.as_py()) for t in batch.column(batch.schema.names.index(text))]
                yield batch.filter(pa.array(clean, pa.bool_()))

        docs = docs.mapInArrow(tidy(run), docs.schema)
    return docs
