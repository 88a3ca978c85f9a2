"""Quality classifier: naive Bayes support vectors over n-gram indicators.

Features are indicators of hashed n-grams of word shapes (case, length, first and last character, digits, equality with either
of the two words before), one to three words long; on request also of the words themselves, as long. Each indicator is scaled by its log-count ratio between the classes; a
linear hinge-loss model of unit-length rows is fitted by dual coordinate descent; Platt's sigmoid over margins of models fitted
without the row turns margins into scores.

The fit sees at most ``max_rows`` labelled ids, those of least md5 of the id, and of those, in that order, as many as have feature
sets of at most ``max_bytes`` (four a feature) together: a documented bound, so that driver memory is bounded. Whole texts make the features.
Scoring covers every row and whole texts, of any length; an empty table gives no rows, and trains a model without features.

Defined cases: a null or empty text has no features; its margin is the bias. Rows with a null label don't train, and neither do
labels without a document; of repeated labels of a document the least counts; of rows that repeat an id
that with the least feature set in byte order trains. Without
rows of both classes the score is the share of label 1 (0.5 without labels). Other columns pass through, those named like an
output are replaced.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from routelab.llm.bpe import slices
from routelab.llm.common import release, staged, tidy
from routelab.shipping import ship

BITS = 18
SIZE = 1 << BITS
_ODD = np.uint64(0x9E3779B97F4A7C15)
_POWERS = (np.random.default_rng(7).integers(0, 2**63, 64, dtype=np.uint64) << np.uint64(1)) | np.uint64(1)
SPACE, LOWER, UPPER, DIGIT, LETTER, OTHER = range(6)
#: ASCII marks have classes of their own from 6 on, in this order.
MARKS = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"


def _class_table() -> np.ndarray:
    table = np.full(0x3000, OTHER, np.uint8)
    for k in range(0x3000):
        c = chr(k)
        table[k] = LOWER if c.islower() else UPPER if c.isupper() else DIGIT if c.isdigit() else LETTER if c.isalpha() else OTHER
    table[[9, 10, 11, 12, 13, 32]] = SPACE
    for k, c in enumerate(MARKS):
        table[ord(c)] = 6 + k
    return table


_CLASSES = _class_table()


def _mixed(x: np.ndarray) -> np.ndarray:
    x = x * _ODD
    return x ^ (x >> np.uint64(29))


def features(texts: list[str | None], words_too: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Row numbers and feature numbers of the distinct features of each text, by row; ``words_too`` adds one to three words."""
    chars = [np.frombuffer((t or "").encode("utf-32-le", "surrogatepass") + b"\x20\0\0\0", np.uint32) for t in texts]
    sizes = np.fromiter(map(len, chars), np.int64, len(chars))
    code = np.concatenate(chars) if chars else np.empty(0, np.uint32)
    kind = np.where(code < 0x3000, _CLASSES[np.minimum(code, 0x2FFF)], LETTER)
    inside = kind != SPACE
    starts = np.flatnonzero(inside & ~np.concatenate(([False], inside[:-1])))
    if not len(starts):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    ends = np.flatnonzero(inside & ~np.concatenate((inside[1:], [False]))) + 1
    row = np.searchsorted(np.cumsum(sizes), starts, "right")
    at = np.arange(len(code)) - np.repeat(starts, np.diff(np.concatenate((starts, [len(code)]))))[: len(code)] if starts[0] == 0 else np.concatenate(
        (np.zeros(starts[0], np.int64), np.arange(starts[0], len(code)) - np.repeat(starts, np.diff(np.concatenate((starts, [len(code)])))))
    )
    sums = lambda x: np.add.reduceat(np.where(inside, x, 0), starts)
    word = np.add.reduceat(np.where(inside, _mixed(code.astype(np.uint64) + np.uint64(1)) * _POWERS[at & 63], np.uint64(0)), starts)
    upper, lower, digits = (sums(kind == k) for k in (UPPER, LOWER, DIGIT))
    length = ends - starts
    same = lambda k: np.concatenate((np.zeros(k, bool), (word[k:] == word[:-k]) & (row[k:] == row[:-k])))[: len(word)]
    shape = np.minimum(length, 12) // 3  # 0 to 4
    for part, most in ((np.minimum(kind[starts], 6), 7), (kind[ends - 1], 64), ((upper > 1) & (lower == 0), 2), (digits > 0, 2), (same(1), 2), (same(2), 2)):
        shape = shape * most + part
    shape = _mixed(shape.astype(np.uint64) + np.uint64(3))
    found = []
    for ones in (shape, word) if words_too else (shape,):
        grams = [ones]
        for n in (1, 2):
            grams.append(_mixed(grams[-1][:-1] * np.uint64(31) + ones[n:] + np.uint64(n)))
        found += [row[: len(g)][row[: len(g)] == row[n:]] * SIZE + (_mixed(g)[row[: len(g)] == row[n:]] >> np.uint64(64 - BITS)).astype(np.int64) for n, g in enumerate(grams)]
    found = np.unique(np.concatenate(found))
    return found >> BITS, found & (SIZE - 1)


@dataclass
class Model:
    """Margin = sum of ``weights`` over a row's features / root of the sum of ``squares`` + ``bias``; score = 1/(1+exp(-(a m + c)))."""

    weights: np.ndarray
    squares: np.ndarray
    bias: float
    a: float
    c: float
    words_too: bool = False

    def margins(self, rows: np.ndarray, found: np.ndarray, n: int) -> np.ndarray:
        norm = np.sqrt(np.bincount(rows, self.squares[found], n))
        return np.bincount(rows, self.weights[found], n) / np.where(norm > 0, norm, 1) + self.bias

    def scores(self, rows: np.ndarray, found: np.ndarray, n: int) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.a * self.margins(rows, found, n) + self.c, -50, 50)))


def log_count_ratio(sets: list[np.ndarray] | Packed, good: np.ndarray, alpha: float = 1.0) -> np.ndarray:
    counts = np.full((2, SIZE), alpha)
    for s, g in zip(sets, good):
        counts[int(g), s] += 1  # a set's features are distinct
    return np.log(counts[1] / counts[1].sum()) - np.log(counts[0] / counts[0].sum())


def packed(found: np.ndarray) -> bytes:
    """A sorted set of feature numbers in half its size: how many have each value above their low 16 bits, and these bits."""
    return np.bincount(found >> 16, minlength=SIZE >> 16).astype("<i4").tobytes() + (found & 0xFFFF).astype("<u2").tobytes()


class Packed:
    """Sets that :func:`packed` made, over views of their bytes; one is unpacked when it is asked for."""

    HEAD = 4 * (SIZE >> 16)

    def __init__(self, parts: list):
        self.parts = parts

    def __len__(self) -> int:
        return len(self.parts)

    def __getitem__(self, k: int) -> np.ndarray:
        raw = self.parts[k]
        high = np.repeat(np.arange(SIZE >> 16, dtype=np.int32) << 16, np.frombuffer(raw, "<i4", SIZE >> 16))
        return high | np.frombuffer(raw, "<u2", offset=self.HEAD)

    def __iter__(self) -> Iterator[np.ndarray]:
        return (self[k] for k in range(len(self)))


class Scaled:
    """The values of rows, their features' ratios at unit length: made when a row is visited, so that only the sets take memory."""

    def __init__(self, sets: list[np.ndarray] | Packed, ratio: np.ndarray):
        self.sets, self.ratio = sets, ratio
        self.norms = [max(np.sqrt(v @ v), 1e-12) for v in (ratio[s] for s in sets)]

    def __len__(self) -> int:
        return len(self.sets)

    def __getitem__(self, k: int) -> np.ndarray:
        return (self.ratio[self.sets[k]] / self.norms[k]).astype(np.float32)

    def __iter__(self) -> Iterator[np.ndarray]:
        return (self[k] for k in range(len(self)))


def descend(sets: list[np.ndarray] | Packed, values: list[np.ndarray] | Scaled, good: np.ndarray, cost: np.ndarray, epochs: int, seed: int = 1) -> tuple[np.ndarray, float]:
    """Dual coordinate descent for the L1-loss linear SVM with a bias feature of 1: min 1/2 |w|^2 + sum cost * hinge."""
    weights, bias = np.zeros(SIZE), 0.0
    sign, alpha = np.where(good == 1, 1.0, -1.0), np.zeros(len(good))
    diagonal = np.array([v @ v for v in values]) + 1.0
    shuffle = np.random.default_rng(seed)
    for _ in range(epochs):
        moved = 0.0
        for k in shuffle.permutation(len(good)):
            s, v = sets[k], values[k]
            gradient = sign[k] * (weights[s] @ v + bias) - 1
            new = min(max(alpha[k] - gradient / diagonal[k], 0.0), cost[k])
            if new != alpha[k]:
                step = (new - alpha[k]) * sign[k]
                weights[s] += step * v
                bias += step
                moved = max(moved, abs(new - alpha[k]))
                alpha[k] = new
        if moved < 1e-3:
            break
    return weights, bias


def sigmoid_of(margins: np.ndarray, good: np.ndarray) -> tuple[float, float]:
    """Platt's a and c by Newton steps, with his smoothed targets."""
    n1, n0 = good.sum(), (1 - good).sum()
    target = np.where(good == 1, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    x = np.stack((margins, np.ones(len(margins))), 1)
    beta = np.array([1.0, np.log((n1 + 1) / (n0 + 1))])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        h = (x * (p * (1 - p) + 1e-9)[:, None]).T @ x + 1e-6 * np.eye(2)
        step = np.linalg.solve(h, x.T @ (target - p))
        beta += np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-8:
            break
    return float(beta[0]), float(beta[1])


def fit(sets: list[np.ndarray] | Packed, good: np.ndarray, c: float = 10.0, beta: float = 0.9, epochs: int = 20, folds: int = 3) -> Model:
    """Fit over rows given as arrays of distinct feature numbers and labels 0 or 1."""
    if len(good) == 0 or good.min() == good.max():
        share = float(good.mean()) if len(good) else 0.5
        share = min(max(share, 1e-6), 1 - 1e-6)
        return Model(np.zeros(SIZE), np.zeros(SIZE), 0.0, 0.0, float(np.log(share / (1 - share))))

    def linear(rows: np.ndarray) -> Model:
        own, y = Packed([sets.parts[k] for k in rows]) if isinstance(sets, Packed) else [sets[k] for k in rows], good[rows]
        ratio = log_count_ratio(own, y)
        values = Scaled(own, ratio)
        share = y.mean()
        cost = np.where(y == 1, c * 0.5 / share, c * 0.5 / (1 - share))
        weights, bias = descend(own, values, y, cost, epochs)
        # interpolated towards the mean weight, as in the published method
        weights = (1 - beta) * np.abs(weights).sum() / max(1, np.count_nonzero(weights)) + beta * weights
        return Model(weights * ratio, ratio * ratio, bias, 1.0, 0.0)

    part = np.arange(len(good)) % folds
    margins = np.zeros(len(good))
    for f in range(folds):
        rest, out = np.flatnonzero(part != f), np.flatnonzero(part == f)
        if good[rest].min() == good[rest].max() or not len(out):
            continue
        other = linear(rest)
        for k in out:
            own = sets[k]
            margins[k] = other.margins(np.zeros(len(own), np.int64), own, 1)[0]
    model = linear(np.arange(len(good)))
    model.a, model.c = sigmoid_of(margins, good)
    return model


def fold(id_: Column, folds: int = 5) -> Column:
    """crc32 of the id's text modulo ``folds``."""
    return F.crc32(F.coalesce(id_.cast("string"), F.lit("")).cast("binary")) % folds


def training_rows(docs: DataFrame, labels: DataFrame, label: str, id_: str, text: str, max_rows: int) -> DataFrame:
    """Labelled ``(y, text)`` rows outside fold 0, at most ``max_rows`` ids: those of least md5."""
    known = labels.filter(F.col(id_).isNotNull() & F.col(label).isNotNull() & (fold(F.col(id_)) != 0))
    known = known.groupBy(F.col(id_).alias("__id")).agg(F.min(label).cast("int").alias("y")).filter("y in (0, 1)")
    known = known.orderBy(F.md5(F.col("__id").cast("string").cast("binary")), "__id").limit(max_rows)
    # max_rows rows of two numbers: the bound of what is broadcast.
    own = docs.select(F.col(id_).alias("id"), F.col(text).alias("text"))
    return own.join(F.broadcast(known), F.col("id") == F.col("__id")).select("id", "y", "text")


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", id_: str = "doc_id", text: str = "text", max_rows: int = 20_000, words_too: bool = False, max_bytes: int = 1 << 27) -> Model:
    """Fit on the labelled rows outside fold 0; only their distinct feature numbers, ``max_bytes`` at most, come to the driver."""
    ship(docs.sparkSession)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, stop in slices(batch.column(2), 1_000_000):
                part = batch.slice(start, stop - start)
                rows, found = features(part.column(2).to_pylist(), words_too)
                cut = np.searchsorted(rows, np.arange(stop - start + 1))
                sets = [packed(found[a:b]) for a, b in zip(cut, cut[1:])]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(sets, pa.binary())], names=["id", "y", "found"])

    rows = training_rows(docs, labels, label, id_, text, max_rows)
    schema = T.StructType([rows.schema["id"], rows.schema["y"], T.StructField("found", T.BinaryType())])
    once = staged(rows.mapInArrow(tidy(run), schema).groupBy("id", "y").agg(F.min("found").alias("found")), "features")
    # max_rows rows of two numbers in this window, and at most as many ids in the broadcast.
    first = Window.orderBy(F.md5(F.col("id").cast("string").cast("binary")), "id")
    upto = once.select("id", (2 * (F.octet_length("found") - Packed.HEAD)).alias("size")).withColumn("upto", F.sum("size").over(first)).filter(F.col("upto") <= max_bytes)
    got = once.join(F.broadcast(upto.select("id")), "id").select("id", "y", "found").toArrow()
    ids, good = got["id"].to_pylist(), np.array(got["y"].to_pylist(), np.int64)
    views = [x.as_buffer() for x in got["found"]]  # the sets are the most of the driver's memory
    order = sorted(range(len(ids)), key=lambda k: (ids[k], hashlib.md5(views[k]).digest()))
    model = fit(Packed([views[k] for k in order]), good[order])
    del got, views, ids
    release()
    model.words_too = words_too
    return model


def score(docs: DataFrame, model: Model, text: str = "text", threshold: float = 0.3) -> DataFrame:
    """Add ``score`` and ``predicted`` (1 from ``threshold`` on) to every row."""
    spark = docs.sparkSession
    ship(spark)
    shared = spark.sparkContext.broadcast(model)  # two arrays of SIZE numbers
    fields = [f for f in docs.schema.fields if f.name not in ("score", "predicted")]
    keep = [f.name for f in fields]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in batches:
            at = batch.schema.names.index
            texts = batch.column(at(text))
            for start, stop in slices(texts, 1_000_000):
                part = batch.slice(start, stop - start)
                rows, found = features(texts.slice(start, stop - start).to_pylist(), own.words_too)
                p = own.scores(rows, found, stop - start)
                columns = [pa.array(p, pa.float64()), pa.array((p >= threshold).astype(np.int32), pa.int32())]
                yield pa.RecordBatch.from_arrays([part.column(at(c)) for c in keep] + columns, names=[*keep, "score", "predicted"])

    return docs.mapInArrow(tidy(run), T.StructType([*fields, T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())]))
