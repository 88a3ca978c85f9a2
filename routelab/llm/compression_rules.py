"""Quality rules: zstandard compression bands over whole documents and fixed chunks, beside plain word and line counts.

A ratio is UTF-8 bytes over bytes of one zstandard frame at a fixed level. Short texts compress badly and long ones well, so limits
go by length: a band is half an octave of bytes. Limits are Tukey's far fences of the corpus' own texts of that band: the quartiles
of the ratios' logarithms, less or plus ``fence`` times their distance (at least ``least_spread``). All texts that pass the base
rule count, each different text once, so that copies can't move the fences. Repetitive text lies above its band, incompressible text
below. Bands with fewer than ``least_texts`` texts take the fixed ``limits``. Chunks catch long documents of which only part is bad:
a chunk is judged by the band of its own length, and a document goes if more than ``chunk_share`` of its bytes are in chunks
outside. Every byte of a text longer than a chunk counts once: a rest under ``least_chunk`` is judged with the bytes before it, as
the text's last ``chunk`` bytes. A text of a chunk or less is a single chunk, which the whole-text band has judged.

Defined cases: a null or empty text has no words, fails the base rule and has ratio 0. Repeated rows stay. The text is dropped;
other columns pass through, nulls included, but those named like an output are replaced. Texts of any length are read whole. An
empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import math
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from routelab.llm.common import staged, tidy
from routelab.shipping import ship

#: What parts words, and the characters that count as symbols.
SPACES = " \t\n\r\x0b\x0c"
SYMBOLS = "#*$%&|<>"


#: Ratios are compared as steps: their base-2 logarithm in 512ths, rounded.
STEPS = 512
BANDS = 128


@dataclass(frozen=True)
class Bands:
    """``limits``: (from this many bytes, least ratio, greatest ratio), ascending, for bands with few texts; shorter texts than the first have none."""

    limits: tuple[tuple[int, float, float], ...] = (
        (64, 0.6, 2.2), (128, 0.8, 2.6), (256, 1.1, 2.8), (512, 1.2, 3.0), (1024, 1.3, 3.2), (2048, 1.4, 3.4), (16384, 1.4, 3.8), (131072, 1.4, 4.5),
    )
    level: int = 3
    chunk: int = 2048
    least_chunk: int = 1024
    chunk_share: float = 0.2
    fence: int = 3
    least_spread: int = 22
    least_texts: int = 50
    min_words: int = 50
    max_repeat_percent: int = 50


MEASURES = (
    ("n_words", T.LongType(), pa.int64()), ("word_chars", T.LongType(), pa.int64()), ("n_symbols", T.LongType(), pa.int64()),
    ("n_dup_lines", T.LongType(), pa.int64()), ("n_repeat_words", T.LongType(), pa.int64()), ("base_failed", T.BooleanType(), pa.bool_()),
    ("n_bytes", T.LongType(), pa.int64()), ("ratio", T.DoubleType(), pa.float64()), ("text_key", T.LongType(), pa.int64()),
    ("chunks", T.ArrayType(T.LongType()), pa.list_(pa.int64())),
)
FIELDS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "ratio", "least_ratio", "greatest_ratio", "bad_chunk_share")


def band_of(size: int) -> int:
    """The half octave of a number of bytes."""
    return int(2 * math.log2(size)) if size else 0


def steps_of(ratio: float) -> int:
    return round(STEPS * math.log2(ratio)) if ratio else 0


def repeated_words(words: list[bytes]) -> int:
    """Words that lie in a three-word window which occurs twice or more."""
    windows = list(zip(words, words[1:], words[2:]))
    if len(set(windows)) == len(windows):
        return 0
    counts = Counter(windows)
    total, covered = 0, 0
    for at, window in enumerate(windows):
        if counts[window] > 1:
            total += at + 3 - max(at, covered)
            covered = at + 3
    return total


def repeated_lines(text: str) -> int:
    """Lines with a word that equal an earlier line."""
    lines = [line for line in text.split("\n") if line.strip(SPACES)]
    return len(lines) - len(set(lines))


class Meter:
    """Counts, ratio and chunks of a text."""

    def __init__(self, bands: Bands):
        self.bands = bands
        self.compress = zstandard.ZstdCompressor(level=bands.level, write_content_size=False, write_checksum=False).compress

    def ratio(self, raw: bytes) -> float:
        return len(raw) / len(self.compress(raw)) if raw else 0.0

    def chunks(self, raw: bytes) -> list[tuple[int, bytes]]:
        """(bytes it stands for, chunk) of a text longer than a chunk; a short rest is judged as part of the last ``chunk`` bytes."""
        size = self.bands.chunk
        if len(raw) <= size:
            return []
        parts = [raw[at : at + size] for at in range(0, len(raw), size)]
        return [(len(p), p if len(p) >= self.bands.least_chunk else raw[-size:]) for p in parts]

    def __call__(self, text: str | None) -> tuple:
        """MEASURES of a text; each chunk is bytes, band and steps, one after the other in one list."""
        bands, text = self.bands, text or ""
        raw = text.encode()
        words = raw.split()  # bytes split at ASCII white space only
        n = len(words)
        repeats = repeated_words(words)
        failed = n < bands.min_words or 100 * repeats > bands.max_repeat_percent * n
        chunks = [x for size, c in self.chunks(raw) for x in (size, band_of(len(c)), steps_of(self.ratio(c)))]
        word_chars = len(text) - sum(map(text.count, SPACES))
        key = int.from_bytes(hashlib.blake2b(raw, digest_size=8).digest(), "little", signed=True)
        return n, word_chars, sum(map(text.count, SYMBOLS)), repeated_lines(text), repeats, failed, len(raw), self.ratio(raw), key, chunks


def measure(df: DataFrame, text: str = "text", bands: Bands = Bands()) -> DataFrame:
    """MEASURES of every row instead of its text, with its band and steps."""
    ship(df.sparkSession)
    names = [name for name, _, _ in MEASURES] + ["band", "steps"]
    fields = [f for f in df.schema.fields if f.name not in {*names, *FIELDS, text}]
    keep = [f.name for f in fields]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        meter = Meter(bands)
        for batch in batches:
            at = batch.schema.names.index
            found = [meter(t.as_py()) for t in batch.column(at(text))]
            found = [(*x, min(band_of(x[6]), BANDS - 1), steps_of(x[7])) for x in found]
            kinds = [kind for _, _, kind in MEASURES] + [pa.int32(), pa.int32()]
            columns = [pa.array(c, kind) for c, kind in zip(zip(*found) if found else [()] * len(kinds), kinds)]
            yield pa.RecordBatch.from_arrays([batch.column(at(c)) for c in keep] + columns, names=keep + names)

    schema = [*fields, *[T.StructField(name, kind) for name, kind, _ in MEASURES], T.StructField("band", T.IntegerType()), T.StructField("steps", T.IntegerType())]
    return df.mapInArrow(tidy(run), T.StructType(schema))


def quartile(histogram: list[tuple[int, int]], quarter: int) -> int:
    """The least value that at least ``quarter`` quarters of a (value, count) histogram don't exceed."""
    total, upto = sum(n for _, n in histogram), 0
    for value, n in sorted(histogram):
        upto += n
        if 4 * upto >= quarter * total:
            return value
    raise ValueError("an empty histogram has no quartiles")


def limits_of(measured: DataFrame, bands: Bands) -> list[tuple[int, int] | None]:
    """Least and greatest steps of each band, None without limits.

    The histogram counts different texts by band and step, so at most BANDS times a few thousand rows come to the driver.
    """
    once = measured.filter("not base_failed").select("band", "steps", "text_key").distinct()
    found: dict[int, list[tuple[int, int]]] = {}
    for row in once.groupBy("band", "steps").agg(F.count("*").alias("n")).collect():
        found.setdefault(row["band"], []).append((row["steps"], row["n"]))
    out: list[tuple[int, int] | None] = []
    for band in range(BANDS):
        histogram = found.get(band, [])
        if sum(n for _, n in histogram) >= bands.least_texts:
            low, high = quartile(histogram, 1), quartile(histogram, 3)
            reach = bands.fence * max(high - low, bands.least_spread)
            out.append((low - reach, high + reach))
        else:
            fixed = next(((low, high) for start, low, high in reversed(bands.limits) if band >= band_of(start)), None)
            out.append(fixed and (steps_of(fixed[0]), steps_of(fixed[1])))
    return out


def compression_rules(df: DataFrame, text: str = "text", bands: Bands = Bands()) -> DataFrame:
    """FIELDS of every row: counts, the whole-text ratio and its limits (null: none), the share of bytes in bad chunks, ``base_failed`` and ``kept``.

    Texts are read and compressed once; the narrow measures are staged, and verdicts follow once the limits are known.
    """
    # The table's own columns go under numbers, so that no name of theirs meets a measure's.
    passed = {f"c{k}": c for k, c in enumerate(df.columns) if c not in FIELDS and c != text}
    rows = df.select(F.col(text).alias("text"), *[F.col(f"`{c}`").alias(number) for number, c in passed.items()])
    measured = staged(measure(rows, "text", bands), "compression")
    limits = limits_of(measured, bands)
    least, greatest = (F.array(*[F.lit(x[k] if x else None).cast("int") for x in limits]) for k in (0, 1))

    def outside(band: Column, steps: Column) -> Column:
        return F.coalesce((steps < F.get(least, band)) | (steps > F.get(greatest, band)), F.lit(False))

    each = F.sequence(F.lit(0), (F.size("chunks") / 3).cast("int") - 1)
    none = F.lit(0).cast("bigint")
    part = lambda at, k: F.get("chunks", 3 * at + k)
    bad = F.aggregate(each, none, lambda s, at: s + F.when(outside(part(at, 1).cast("int"), part(at, 2).cast("int")), part(at, 0)).otherwise(none))
    bad = F.when(F.size("chunks") > 0, bad / F.col("n_bytes")).otherwise(0.0)
    known = measured.withColumn("bad_chunk_share", bad).withColumn("kept", ~F.col("base_failed") & ~outside(F.col("band"), F.col("steps")) & (F.col("bad_chunk_share") <= bands.chunk_share))
    shown = {"least_ratio": F.pow(F.lit(2.0), F.get(least, F.col("band")) / STEPS), "greatest_ratio": F.pow(F.lit(2.0), F.get(greatest, F.col("band")) / STEPS)}
    return known.withColumns(shown).select(*[F.col(number).alias(c) for number, c in passed.items()], *FIELDS)
