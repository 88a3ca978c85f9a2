"""BPE with word ends: a backtracking encoder over Aho-Corasick matches, and a decoder over an offset table.

A word is a row of symbols, its bytes, the last of which carries the word's end. One pass of an Aho-Corasick automaton over a word gives
the longest token that starts at each place. The encoder goes on from left to right with the longest token that may stand beside the one
before it; where none may, it takes the next shorter one, and where that is exhausted it marks the place as dead and takes back a token.
Which two tokens may stand side by side is kept in a compatibility table, filled as pairs come up: undoing the merges that made the two,
latest first, no pair across their border may ever have been due earlier. Exact merges leave one row of pairwise compatible tokens for
each beginning of a word, so a place needs one visit only and time is linear in the word's length.

Decoding joins tokens by single spaces, as the library does for files without a decoder: an offset table over the end-to-end bytes of all
tokens turns ids into one gather.

Defined cases: a null or empty text, or one of white space only, has no ids and decodes to the empty text. The file's special tokens are
found in the text before anything else, as the library does. Very long texts are cut before white space, which no token crosses, and
taken piece by piece; a word of any length takes linear time and memory. Repeated rows stay repeated; ids of documents, null or not,
are not looked at. Other columns pass through, nulls too; a column already named like an output is replaced. An empty table gives none.
"""

from __future__ import annotations

import json
import unicodedata
from collections.abc import Iterable, Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from tokenizers import Tokenizer

from routelab.llm.bpe import slices, with_column
from routelab.llm.common import tidy
from routelab.shipping import ship

#: What a tokenizer file must say for this encoder to be right.
PIECES = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
NORMALIZER = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]
SPLITTER = [
    {"type": "Split", "pattern": {"Regex": PIECES}, "behavior": "Removed", "invert": True},
    {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
]
MODEL = {"type": "BPE", "dropout": None, "unk_token": None, "continuing_subword_prefix": None, "fuse_unk": False, "byte_fallback": False, "ignore_merges": False}
ADDED = {"single_word": False, "lstrip": False, "rstrip": False, "normalized": False, "special": True}

#: Symbols of the automaton: a byte within a word, and the byte that ends one.
INNER, LAST = 0x100, 0x200
_NEVER = 1 << 62


def byte_letters() -> list[str]:
    """The letter that stands for each byte in a byte-level vocabulary: printable Latin-1 as it is, the others from U+0100 on."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    others = iter(range(0x100, 0x200))
    return [chr(b if b in plain else next(others)) for b in range(256)]


class Merges:
    """The merge table with symbols 0-255 (bytes), 256-511 (bytes that end a word) and 512 + k for the k-th merge."""

    def __init__(self, model: dict):
        end = model["end_of_word_suffix"]
        letters = byte_letters()
        number = {letter: b for b, letter in enumerate(letters)} | {letter + end: 256 + b for b, letter in enumerate(letters)}
        spelled = [chr(INNER + b) for b in range(256)] + [chr(LAST + b) for b in range(256)]
        self.head, self.tail, self.merged = [-1] * 512, [-1] * 512, {}
        for left, right in model["merges"]:
            new, (a, b) = len(self.head), (number[left], number[right])
            if left + right in number:
                raise ValueError(f"two merges make {left + right!r}")
            number[left + right] = self.merged[a, b] = new
            self.head.append(a)
            self.tail.append(b)
            spelled.append(spelled[a] + spelled[b])
        self.spelled = spelled
        self.ids = np.zeros(len(spelled), np.uint32)
        for token, symbol in number.items():
            self.ids[symbol] = model["vocab"][token]

    def stays(self, left: int, right: int, due: int = _NEVER) -> bool:
        """Whether no pair across the border of two tokens is merged before ``due``, through the merges that made them."""
        merged, head, tail = self.merged, self.head, self.tail
        while merged.get((left, right), _NEVER) >= due:
            if left < 512 and right < 512:
                return True
            if left > right:  # the later merge is undone; a tie goes to the left one, which the library takes first
                due, left = left, tail[left]
            else:
                due, right = right + 1, head[right]
        return False


class WordCodec:
    """Encoder and decoder of one tokenizer file. ``cache`` bounds the remembered words, ``table`` the remembered pairs."""

    def __init__(self, raw: bytes, cache: int = 150_000, table: int = 1_000_000, window: int = 1 << 18):
        spec = json.loads(raw)
        model = spec["model"]
        suits = (
            (spec["normalizer"] or {}).get("normalizers") == NORMALIZER
            and (spec["pre_tokenizer"] or {}).get("pretokenizers") == SPLITTER
            and spec["post_processor"] is None
            and spec["decoder"] is None
            and all(model.get(k) == v for k, v in MODEL.items())
            and bool(model.get("end_of_word_suffix"))
            and all({k: t[k] for k in ADDED} == ADDED for t in spec["added_tokens"])
        )
        if not suits:
            raise ValueError("the tokenizer file asks for steps that this encoder doesn't take")
        self.merges = Merges(model)
        head, tail, spelled = self.merges.head, self.merges.tail, self.merges.spelled
        # A token is of use if its own symbols merge to it: its halves do, and their border holds until it is due.
        whole = [True] * 512
        for k in range(512, len(head)):
            whole.append(whole[head[k]] and whole[tail[k]] and self.merges.stays(head[k], tail[k], k))
        number = {spelled[k]: k for k in range(len(spelled)) if whole[k]}
        self.automaton = ahocorasick.Automaton()
        for word, k in number.items():
            self.automaton.add_word(word, k)
        self.automaton.make_automaton()
        self.length = [len(s) for s in spelled]
        #: The longest token that a token begins with; -1 for single symbols.
        self.shorter = [-1] * len(spelled)
        for word, k in number.items():
            self.shorter[k] = next((number[word[:cut]] for cut in range(len(word) - 1, 0, -1) if word[:cut] in number), -1)
        self.ids = [int(k).to_bytes(4, "little") for k in self.merges.ids]
        self.fits: dict[int, bool] = {}
        self.cache: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.most_words, self.most_pairs, self.window = cache, table, window
        self.special = {t["content"]: np.uint32(t["id"]).astype("<u4").tobytes() for t in spec["added_tokens"]}
        self.cut_special = regex.compile("|".join(map(regex.escape, self.special)) or r"(?!)").split
        self.find_special = regex.compile("|".join(map(regex.escape, self.special)) or r"(?!)").findall
        # The library's white space is Unicode's White_Space property, which leaves out U+001C to U+001F.
        self.pieces = regex.compile(PIECES.replace(r"\s", r"\p{White_Space}").replace("+", "++")).findall
        self.raw, self.library, self.known = raw, None, set(map(chr, range(128)))
        self.space = regex.compile(r"\p{White_Space}").search
        tokens = {v: k for k, v in model["vocab"].items()} | {t["id"]: t["content"] for t in spec["added_tokens"]}
        spaced = [(tokens.get(k, "") + " ").encode() for k in range(max(tokens) + 1)]
        self.offsets = np.concatenate([[0], np.cumsum([len(s) for s in spaced])]).astype(np.int64)
        self.letters = np.frombuffer(b"".join(spaced), np.uint8)

    def symbols(self, word: str) -> list[int]:
        """The exact merges of a word of at least one character."""
        data = word.encode()
        row = data[:-1].decode("latin-1").translate(_INNER) + chr(LAST + data[-1])
        n, length, shorter, fits, stays = len(row), self.length, self.shorter, self.fits, self.merges.stays
        longest = [0] * n
        for end, token in self.automaton.iter(row):  # of the tokens with one start those found later are longer
            longest[end + 1 - length[token]] = token
        dead = bytearray(n + 1)
        out: list[int] = []
        at, token = 0, longest[0]
        while True:
            stop = at + length[token]
            good = not dead[stop]
            if good and out:
                pair = out[-1] << 32 | token
                good = fits.get(pair)
                if good is None:
                    if len(fits) >= self.most_pairs:
                        fits.clear()
                    good = fits[pair] = stays(out[-1], token)
            if good:
                out.append(token)
                if stop == n:
                    return out
                at, token = stop, longest[stop]
                continue
            token = shorter[token]
            while token < 0:
                dead[at] = 1
                last = out.pop()
                at -= length[last]
                token = shorter[last]

    def _windows(self, text: str) -> Iterator[str]:
        start = 0
        while len(text) - start > self.window:
            cut = self.space(text, start + self.window)
            if cut is None:
                break
            yield text[start : cut.start()]
            start = cut.start()
        yield text[start:]

    def _cut(self, part: str) -> list[str]:
        """The normalized pieces of a part of a text."""
        if not part.isascii() and (new := set(part) - self.known):
            if any(unicodedata.category(c) == "Cn" for c in new):
                # Python, regex and the library may each have their own Unicode version for these: the library says what they are.
                self.library = library = self.library or Tokenizer.from_buffer(self.raw)
                plain = library.normalizer.normalize_str(part)
                return [plain[a:b] for _, (a, b) in library.pre_tokenizer.pre_tokenize_str(plain)]
            self.known |= new
        # Each character is lowered by itself: no final form of sigma.
        return self.pieces(unicodedata.normalize("NFC", part).replace("Σ", "σ").lower())

    def _words(self, text: str, out: list[bytes]) -> None:
        cache = self.cache
        for part in self._windows(text):
            for word in self._cut(part):
                ids = cache.get(word)
                if ids is None:
                    ids = self.older.get(word) or b"".join([self.ids[k] for k in self.symbols(word)])
                    if len(word) <= 64:
                        if len(cache) >= self.most_words:  # the words met since the last time that the table was full are kept
                            self.older, self.cache = cache, {}
                            cache = self.cache
                        cache[word] = ids
                out.append(ids)

    def encode(self, text: str | None) -> bytes:
        """The text's ids as little-endian unsigned 32-bit integers."""
        if not text:
            return b""
        out: list[bytes] = []
        found = self.find_special(text)
        for k, part in enumerate(self.cut_special(text)):
            if k:
                out.append(self.special[found[k - 1]])
            if part:
                self._words(part, out)
        return b"".join(out)

    def decode(self, ids: bytes, block: int = 1 << 16) -> bytes:
        """The tokens of the ids, joined by single spaces, in UTF-8."""
        rows, parts = np.frombuffer(ids, "<u4").astype(np.int64), []
        for k in range(0, len(rows), block):
            start, sizes = self.offsets[rows[k : k + block]], self.offsets[rows[k : k + block] + 1] - self.offsets[rows[k : k + block]]
            ends = np.cumsum(sizes)
            parts.append(self.letters[np.repeat(start - ends + sizes, sizes) + np.arange(ends[-1])].tobytes())
        return b"".join(parts)[:-1]


_INNER = {b: chr(INNER + b) for b in range(256)}
_codecs: dict[int, WordCodec] = {}


def _codec(shared) -> WordCodec:
    """The worker's codec of a broadcast tokenizer file."""
    key = hash(shared.value)
    if key not in _codecs:
        _codecs.clear()
        _codecs[key] = WordCodec(shared.value)
    return _codecs[key]


def _file(df: DataFrame, path: str):
    """The tokenizer file (a few MB) as a broadcast."""
    ship(df.sparkSession)
    with open(path, "rb") as f:
        return df.sparkSession.sparkContext.broadcast(f.read())


def _schema(df: DataFrame, *names: str) -> T.StructType:
    return T.StructType([f for f in df.schema.fields if f.name not in names] + [T.StructField(n, T.BinaryType()) for n in names])


def encode(df: DataFrame, path: str, text: str = "text", ids: str = "token_ids", batch_bytes: int = 1_000_000) -> DataFrame:
    """Add ``ids``: the text's token ids as little-endian unsigned 32-bit integers, end to end in a binary."""
    shared = _file(df, path)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = _codec(shared)
        for batch in batches:
            texts = batch.column(batch.schema.names.index(text))
            for start, stop in slices(texts, batch_bytes):
                encoded = map(own.encode, texts.slice(start, stop - start).to_pylist())
                yield with_column(batch.slice(start, stop - start), ids, pa.array(encoded, pa.binary()))

    return df.mapInArrow(tidy(run), _schema(df, ids))


def decode(df: DataFrame, path: str, ids: str = "token_ids", decoded: str = "decoded", batch_bytes: int = 1_000_000) -> DataFrame:
    """Add ``decoded``: the UTF-8 bytes of the text that ``ids`` stands for (null: none)."""
    shared = _file(df, path)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = _codec(shared)
        for batch in batches:
            column = batch.column(batch.schema.names.index(ids))
            for start, stop in slices(column, batch_bytes):
                texts = [own.decode(x or b"") for x in column.slice(start, stop - start).to_pylist()]
                yield with_column(batch.slice(start, stop - start), decoded, pa.array(texts, pa.binary()))

    return df.mapInArrow(tidy(run), _schema(df, decoded))


def round_trip(df: DataFrame, path: str, text: str = "text", ids: str = "token_ids", decoded: str = "decoded", batch_bytes: int = 1_000_000) -> DataFrame:
    """:func:`encode` and then :func:`decode` in one worker, which holds the vocabulary once."""
    shared = _file(df, path)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = _codec(shared)
        for batch in batches:
            texts = batch.column(batch.schema.names.index(text))
            for start, stop in slices(texts, batch_bytes):
                encoded = list(map(own.encode, texts.slice(start, stop - start).to_pylist()))
                part = with_column(batch.slice(start, stop - start), ids, pa.array(encoded, pa.binary()))
                yield with_column(part, decoded, pa.array(map(own.decode, encoded), pa.binary()))

    return df.mapInArrow(tidy(run), _schema(df, ids, decoded))
