"""Words of many texts at once: borders, 64-bit hashes and shingles as numpy arrays."""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa

from flowloom.llm.columns import text_bytes

_U = np.uint64
#: Odd factors of the rolling sums; any odd numbers serve.
BYTE_FACTOR, WORD_FACTOR = 0x9E3779B97F4A7C15 | 1, 0xC2B2AE3D27D4EB4F | 1
_MASK = (1 << 64) - 1

SEPARATOR = np.zeros(256, bool)
SEPARATOR[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """Spread 64-bit values (shift, multiply, repeat), so equal inputs alone give equal outputs."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


@lru_cache(maxsize=4)
def _powers(factor: int, size: int) -> np.ndarray:
    out = np.full(size, factor, _U)
    out[0] = 1
    return np.multiply.accumulate(out)


def powers(factor: int, count: int) -> np.ndarray:
    """factor ** 0 .. factor ** (count - 1), modulo 2 ** 64."""
    return _powers(factor & _MASK, 1 << max(16, (count - 1).bit_length()))[:count]


def span_sums(values: np.ndarray, exponents: np.ndarray | None, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Polynomial hash of each span [start, end) of ``values``; ``exponents`` (default: the position) never fall."""
    top = len(values) if exponents is None else int(exponents[-1]) + 1 if len(exponents) else 0
    up = powers(BYTE_FACTOR, top + 1)
    down = powers(pow(BYTE_FACTOR, -1, 1 << 64), top + 1)
    total = np.zeros(len(values) + 1, _U)
    np.cumsum(values * (up[: len(values)] if exponents is None else up[exponents]), out=total[1:])
    return (total[ends] - total[starts]) * (down[starts] if exponents is None else down[exponents[starts]])


class Words:
    """Words ``[^\\x20\\x09-\\x0D]+`` of a group of texts.

    ``starts`` and ``ends`` are byte positions in ``data``; the words of text i are ``first[i]`` to ``first[i + 1]``.
    """

    def __init__(self, texts: pa.Array, lower: bool = False):
        data, self.offsets = text_bytes(texts)
        self.data = LOWER[data] if lower else data
        inside = ~SEPARATOR[data]
        before = np.zeros(len(data) + 1, bool)
        before[1:] = inside
        before[self.offsets] = False
        after = np.zeros(len(data) + 1, bool)
        after[:-1] = inside
        after[self.offsets] = False
        self.starts = np.flatnonzero(inside & ~before[:-1])
        self.ends = np.flatnonzero(inside & ~after[1:]) + 1
        self.first = np.searchsorted(self.starts, self.offsets)

    def hashes(self) -> np.ndarray:
        if not len(self.starts):
            return np.zeros(0, _U)
        return mix(span_sums(self.data.astype(_U) + _U(1), None, self.starts, self.ends) + (self.ends - self.starts).astype(_U))

    def text_of(self, i: int) -> int:
        return int(self.first[i + 1] - self.first[i])


def runs(hashes: np.ndarray, size: int) -> np.ndarray:
    """Hash of the ``size`` words that begin at each word (a run may reach into the next text)."""
    count = max(0, len(hashes) - size + 1)
    out = np.zeros(count, _U)
    for j in range(size):
        out = out * _U(WORD_FACTOR) + hashes[j : j + count]
    return mix(out)


def shingle_sets(words: Words, size: int) -> list[np.ndarray]:
    """Sorted distinct shingles of each text; a text of fewer words is one shingle, one without words has none."""
    hashes = words.hashes()
    grams = runs(hashes, size)
    out = []
    for a, b in zip(words.first[:-1].tolist(), words.first[1:].tolist(), strict=True):
        if b - a >= size:
            out.append(np.unique(grams[a : b - size + 1]))
        elif b > a:
            out.append(runs(hashes[a:b], b - a) ^ _U(b - a))
        else:
            out.append(np.zeros(0, _U))
    return out
