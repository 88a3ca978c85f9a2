"""Sets of 64-bit shingle hashes of texts, a batch at a time, over their UTF-8 bytes."""

from __future__ import annotations

import numpy as np

SPACE_BYTES = [9, 10, 11, 12, 13, 32]

_random = np.random.default_rng(20240229)
_BASE = np.uint64(0x5851F42D4C957F2D)
_BASE_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_BYTES = _random.integers(0, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BYTES[np.arange(65, 91)] = _BYTES[np.arange(97, 123)]  # A-Z count as a-z
_IN_WORD = np.ones(256, bool)
_IN_WORD[SPACE_BYTES] = False
_JOIN = np.uint64(0x9E3779B97F4A7C15)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class _Powers:
    up = down = np.ones(1, np.uint64)

    @classmethod
    def of(cls, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(cls.up) < n:
            size = 1 << int(n - 1).bit_length()
            cls.up, cls.down = (np.concatenate(([np.uint64(1)], np.cumprod(np.full(size - 1, b, np.uint64)))) for b in (_BASE, _BASE_INVERSE))
        return cls.up[:n], cls.down


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words in order, and each text's first word's place among them (with the total at the end)."""
    raw = np.frombuffer(b"\n" + b"\n".join(texts) + b"\n", np.uint8)
    inside = _IN_WORD[raw]
    starts = np.flatnonzero(inside[1:] & ~inside[:-1]) + 1
    ends = np.flatnonzero(inside[:-1] & ~inside[1:]) + 1
    up, down = _Powers.of(len(raw))
    total = np.cumsum(_BYTES[raw] * up)
    word = mixed((total[ends - 1] - total[starts - 1]) * down[starts] + (ends - starts).astype(np.uint64) * _JOIN)
    edges = np.cumsum(np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts))) + 1
    return word, np.concatenate(([0], np.searchsorted(starts, edges)))


def shingle_sets(texts: list[str | None], width: int = 4) -> list[np.ndarray]:
    """Each text's distinct hashes of ``width`` words in a row, ascending.

    A text with fewer words has its whole sequence as one; one without words, or null, has none.
    """
    if not texts:
        return []
    word, first = word_hashes([t.encode() if t else b"" for t in texts])
    n = max(0, len(word) - width + 1)
    shingle = word[:n]
    for k in range(1, width):
        shingle = mixed(shingle * _JOIN + word[k : k + n])
    out = []
    for a, b in zip(first.tolist(), first[1:].tolist()):
        if b - a >= width:
            own = np.sort(shingle[a : b - width + 1])
            new = np.empty(len(own), bool)
            new[0] = True
            np.not_equal(own[1:], own[:-1], out=new[1:])
            out.append(own[new])
        elif b > a:
            whole = np.array([b - a], np.uint64)
            for w in word[a:b]:
                whole = mixed(whole * _JOIN + w)
            out.append(whole)
        else:
            out.append(np.empty(0, np.uint64))
    return out
