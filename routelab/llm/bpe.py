"""Byte-level BPE encoding and decoding over length-bucketed padded matrices.

Texts are cut by the tokenizer's pattern. Distinct pieces of a batch go into matrices of one row per piece, bucketed by
length. Each round merges, in every row, the leftmost pair of least rank; rows that have none left leave the matrix. Pair
ranks come from an open-addressing hash table, and only the two pairs beside a merge are looked up again.

Pieces above ``giant`` bytes (long runs without a cut) take the same merges from a heap, as a matrix would need quadratic time.

Defined cases: a null or empty text has no ids and decodes to no bytes. Texts of any length are taken whole; an empty table gives no
rows; ids of documents, null or not, aren't looked at. Repeated rows stay repeated. Other columns pass
through; a column already named like an output is replaced. Nulls in other columns pass through.
"""

from __future__ import annotations

import base64
import heapq
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from routelab.llm.common import tidy
from routelab.shipping import ship

NO_RANK = np.int32(2**31 - 1)
_MIX = np.uint64(0x9E3779B97F4A7C15)


def read_ranks(path: str) -> bytes:
    """The rank file (a megabyte or so) as it is; it travels to the executors as a broadcast."""
    with open(path, "rb") as f:
        return f.read()


def parse_ranks(raw: bytes) -> dict[bytes, int]:
    return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in raw.splitlines() if line.strip())}


class PairTable:
    """Open-addressing hash table from a pair of ids to the id of its concatenation."""

    def __init__(self, ranks: dict[bytes, int]):
        keys, values = [], []
        for token, rank in ranks.items():
            for cut in range(1, len(token)):
                left, right = ranks.get(token[:cut]), ranks.get(token[cut:])
                if left is not None and right is not None:
                    keys.append(left << 32 | right)
                    values.append(rank)
        keys, values = np.array(keys, np.uint64), np.array(values, np.int32)
        bits = max(4, int(np.ceil(np.log2(max(1, len(keys)) * 4))))
        self.mask, self.shift = np.int64((1 << bits) - 1), np.uint64(64 - bits)
        self.keys = np.full(1 << bits, np.uint64(2**64 - 1))
        self.values = np.full(1 << bits, NO_RANK, np.int32)
        at, left = self._slot(keys), np.arange(len(keys))
        while len(left):
            free = self.keys[at[left]] == np.uint64(2**64 - 1)
            slots, first = np.unique(at[left[free]], return_index=True)
            placed = left[free][first]
            self.keys[slots], self.values[slots] = keys[placed], values[placed]
            left = np.setdiff1d(left, placed, assume_unique=True)
            at[left] = (at[left] + 1) & self.mask

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * _MIX) >> self.shift).astype(np.int64)

    def look_up(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The merged id, which is also the rank, of each pair; NO_RANK where a pair doesn't merge or an id is negative."""
        keys = (left.astype(np.int64) << 32 | right.astype(np.int64) & 0xFFFFFFFF).astype(np.uint64)
        at = self._slot(keys)
        out = self.values[at]
        held = self.keys[at]
        out = np.where(held == keys, out, NO_RANK)
        open_ = np.flatnonzero((held != keys) & (held != np.uint64(2**64 - 1)))
        while len(open_):
            at[open_] = (at[open_] + 1) & self.mask
            held = self.keys[at[open_]]
            hit = held == keys[open_]
            out[open_[hit]] = self.values[at[open_[hit]]]
            open_ = open_[~hit & (held != np.uint64(2**64 - 1))]
        out[(left < 0) | (right < 0)] = NO_RANK
        return out


class Codec:
    """Encoder and decoder of one vocabulary. ``cache`` bounds the remembered pieces, ``cells`` a matrix, ``giant`` a row."""

    def __init__(self, raw: bytes, pattern: str, cache: int = 100_000, cells: int = 2_000_000, giant: int = 4096):
        self.ranks = parse_ranks(raw)
        self.pairs = PairTable(self.ranks)
        self.byte_ids = np.array([self.ranks[bytes([b])] for b in range(256)], np.int32)
        self.tokens = [b""] * (max(self.ranks.values()) + 1)
        for token, rank in self.ranks.items():
            self.tokens[rank] = token
        # The library's white space is Unicode's White_Space property, which leaves out U+001C to U+001F.
        self.pieces = regex.compile(pattern.replace(r"\s", r"\p{White_Space}").replace(r"\S", r"\P{White_Space}")).findall
        self.cache, self.most, self.cells, self.giant = {}, cache, cells, giant

    def encode_pieces(self, pieces: list[bytes]) -> list[bytes]:
        """The ids of each piece as little-endian unsigned 32-bit integers."""
        out: list[bytes] = [b""] * len(pieces)
        lengths = np.fromiter(map(len, pieces), np.int64, len(pieces))
        order = np.argsort(lengths, kind="stable")
        start = int(np.searchsorted(lengths[order], 1))
        while start < len(order):
            least = int(lengths[order[start]])
            if least > self.giant:
                out[order[start]] = self._giant(pieces[order[start]])
                start += 1
                continue
            widest = min(self.giant, least + least // 4)
            stop = int(np.searchsorted(lengths[order], widest, "right"))
            stop = min(stop, start + max(1, self.cells // widest))
            self._matrix([pieces[k] for k in order[start:stop]], order[start:stop], out)
            start = stop
        return out

    def _matrix(self, pieces: list[bytes], rows: np.ndarray, out: list[bytes]) -> None:
        width = max(map(len, pieces))
        sizes = np.fromiter(map(len, pieces), np.int64, len(pieces))
        raw = np.frombuffer(b"".join(p.ljust(width, b"\0") for p in pieces), np.uint8).reshape(len(pieces), width)
        ids = np.where(np.arange(width) < sizes[:, None], self.byte_ids[raw], np.int32(-1))
        ranks = self.pairs.look_up(ids[:, :-1].ravel(), ids[:, 1:].ravel()).reshape(len(pieces), width - 1)
        while True:
            if ranks.shape[1]:
                at = ranks.argmin(1)
                least = ranks[np.arange(len(at)), at]
                done = least == NO_RANK
            else:
                done = np.ones(len(ids), bool)
            if done.any():
                for k, row in zip(rows[done].tolist(), ids[done]):
                    out[k] = row[row >= 0].astype("<u4").tobytes()
                live = ~done
                rows, ids, ranks = rows[live], ids[live], ranks[live]
                if not len(rows):
                    return
                at, least = at[live], least[live]
            n, width = ids.shape
            r = np.arange(n)
            ids[r, at] = least
            kept = np.ones((n, width), bool)
            kept[r, at + 1] = False
            ids = ids[kept].reshape(n, width - 1)
            kept = np.ones((n, width - 1), bool)
            kept[r, at] = False
            ranks = ranks[kept].reshape(n, width - 2)
            before, after = np.flatnonzero(at > 0), np.flatnonzero(at < width - 2)
            left = self.pairs.look_up(ids[before, at[before] - 1], ids[before, at[before]])
            right = self.pairs.look_up(ids[after, at[after]], ids[after, at[after] + 1])
            ranks[before, at[before] - 1] = left
            ranks[after, at[after]] = right

    def _giant(self, piece: bytes) -> bytes:
        """The same merges, leftmost least rank first, by a heap over a linked list: for rows too long for a matrix."""
        ids = self.byte_ids[np.frombuffer(piece, np.uint8)].tolist()
        n = len(ids)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        first = self.pairs.look_up(np.array(ids[:-1], np.int32), np.array(ids[1:], np.int32))
        heap = [(int(rank), k) for k, rank in enumerate(first.tolist()) if rank != NO_RANK]
        heapq.heapify(heap)
        rank_of, tokens = self.ranks.get, self.tokens
        while heap:
            rank, k = heapq.heappop(heap)
            j = after[k]
            if ids[k] < 0 or j >= n or rank_of(tokens[ids[k]] + tokens[ids[j]]) != rank:
                continue
            ids[k], ids[j] = rank, -1
            after[k] = after[j]
            if after[k] < n:
                before[after[k]] = k
            for a, b in ((before[k], k), (k, after[k])):
                if a >= 0 and b < n and (found := rank_of(tokens[ids[a]] + tokens[ids[b]])) is not None:
                    heapq.heappush(heap, (found, a))
        return np.array([x for x in ids if x >= 0], "<u4").tobytes()

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """The ids of each text, as :meth:`encode_pieces` gives them."""
        cut = [self.pieces(t) if t else [] for t in texts]
        if len(self.cache) > self.most:
            self.cache.clear()
        cache = self.cache
        new = {p for pieces in cut for p in pieces if p not in cache}
        if new:
            new = list(new)
            cache.update(zip(new, self.encode_pieces([p.encode() for p in new])))
        return [b"".join([cache[p] for p in pieces]) for pieces in cut]

    def decode(self, ids: bytes) -> bytes:
        tokens = self.tokens
        return b"".join([tokens[k] for k in np.frombuffer(ids, "<u4").tolist()])


_codecs: dict[int, Codec] = {}


def codec(shared, pattern: str) -> Codec:
    """The worker's codec of a broadcast rank file."""
    raw = shared.value
    key = hash((raw, pattern))
    if key not in _codecs:
        _codecs.clear()
        _codecs[key] = Codec(raw, pattern)
    return _codecs[key]


def with_column(batch: pa.RecordBatch, name: str, values: pa.Array) -> pa.RecordBatch:
    names = [n for n in batch.schema.names if n != name]
    return pa.RecordBatch.from_arrays([batch.column(batch.schema.names.index(n)) for n in names] + [values], names=[*names, name])


def slices(texts: pa.Array, most: int) -> Iterator[tuple[int, int]]:
    """Runs of rows of about ``most`` bytes of text."""
    sizes = np.asarray(pc.fill_null(pc.binary_length(texts), 0), np.int64)
    ends = np.cumsum(sizes)
    start = 0
    while start < len(texts):
        stop = max(start + 1, int(np.searchsorted(ends, (ends[start - 1] if start else 0) + most, "right")))
        yield start, stop
        start = stop


def _schema_with(df: DataFrame, name: str) -> T.StructType:
    return T.StructType([f for f in df.schema.fields if f.name != name] + [T.StructField(name, T.BinaryType())])


def encode(df: DataFrame, ranks_path: str, pattern: str, text: str = "text", ids: str = "token_ids", batch_bytes: int = 2_000_000) -> DataFrame:
    """Add ``ids``: the text's token ids as little-endian unsigned 32-bit integers, end to end in a binary."""
    ship(df.sparkSession)
    shared = df.sparkSession.sparkContext.broadcast(read_ranks(ranks_path))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(shared, pattern)
        for batch in batches:
            texts = batch.column(batch.schema.names.index(text))
            for start, stop in slices(texts, batch_bytes):
                part = batch.slice(start, stop - start)
                yield with_column(part, ids, pa.array(own.encode(texts.slice(start, stop - start).to_pylist()), pa.binary()))

    return df.mapInArrow(tidy(run), _schema_with(df, ids))


def decode(df: DataFrame, ranks_path: str, pattern: str, ids: str = "token_ids", decoded: str = "decoded", batch_bytes: int = 8_000_000) -> DataFrame:
    """Add ``decoded``: the bytes of the tokens whose ids ``ids`` holds (null: none)."""
    ship(df.sparkSession)
    shared = df.sparkSession.sparkContext.broadcast(read_ranks(ranks_path))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(shared, pattern)
        for batch in batches:
            column = batch.column(batch.schema.names.index(ids))
            for start, stop in slices(column, batch_bytes):
                part = batch.slice(start, stop - start)
                yield with_column(part, decoded, pa.array([own.decode(x or b"") for x in column.slice(start, stop - start).to_pylist()], pa.binary()))

    return df.mapInArrow(tidy(run), _schema_with(df, decoded))


def round_trip(df: DataFrame, ranks_path: str, pattern: str, text: str = "text", ids: str = "token_ids", decoded: str = "decoded", batch_bytes: int = 1_000_000) -> DataFrame:
    """:func:`encode` and then :func:`decode` in one worker, which holds the vocabulary once."""
    ship(df.sparkSession)
    shared = df.sparkSession.sparkContext.broadcast(read_ranks(ranks_path))
    schema = _schema_with(df, ids)
    schema = T.StructType([f for f in schema.fields if f.name != decoded] + [T.StructField(decoded, T.BinaryType())])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(shared, pattern)
        for batch in batches:
            texts = batch.column(batch.schema.names.index(text))
            for start, stop in slices(texts, batch_bytes):
                encoded = own.encode(texts.slice(start, stop - start).to_pylist())
                part = with_column(batch.slice(start, stop - start), ids, pa.array(encoded, pa.binary()))
                yield with_column(part, decoded, pa.array(list(map(own.decode, encoded)), pa.binary()))

    return df.mapInArrow(tidy(run), schema)
