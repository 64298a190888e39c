"""Language identification with hyperdimensional profiles.

Every letter has a fixed random vector of +1 and -1. A letter trigram is bound from the vectors of its letters, the
first rotated twice, the second once. A text is the bundle (sum) of its trigrams; a language's prototype is the bundle
of its learning texts; a text gets the language whose prototype has the largest cosine. Unrelated texts have cosines
around 0 with a standard deviation of 1 / sqrt(dimensions).

Nulls and edges: a null text, an empty one, or one without a letter is ``und`` with score 0. Without any learning row
every text is ``und``. Of equal cosines the first language in alphabetical order wins. Repeated rows count each time.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flowloom.llm.columns import add_columns, place_of
from flowloom.llm.words import mix

DIMENSIONS = 4096
#: Dimensions that travel in one row when partial bundles are added.
PIECE = 64
UNKNOWN = "und"
#: Trigram vectors that a worker keeps; beyond, it starts anew, so memory stays bounded for any alphabet.
KEPT_VECTORS = 16_384


@lru_cache(maxsize=1)
def _is_letter() -> np.ndarray:
    return np.array([chr(i).isalpha() for i in range(0x110000)])


def trigram_counts(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct letter trigrams (three 21-bit code points) and their counts; other characters make one blank."""
    points = np.frombuffer((text or "").lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    letter = _is_letter()[points]
    if not letter.any():
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    kept = letter.copy()
    kept[1:] |= letter[:-1]
    line = np.full(int(kept.sum()) + 2, 32, np.uint64)
    line[1:-1] = np.where(letter, points, 32)[kept]
    return np.unique(line[:-2] << np.uint64(42) | line[1:-1] << np.uint64(21) | line[2:], return_counts=True)


@lru_cache(maxsize=4096)
def letter_bits(point: int, dimensions: int, turns: int) -> np.ndarray:
    """The letter's own +1 (as 1) and -1 (as 0), drawn from its code point and rotated."""
    seeds = np.full(-(-dimensions // 64), point, np.uint64) << np.uint64(32) | np.arange(-(-dimensions // 64), dtype=np.uint64)
    return np.roll(np.unpackbits(mix(seeds + np.uint64(1)).view(np.uint8))[:dimensions], turns)


class TrigramVectors:
    """Rows of trigram vectors, made when first asked for; +1 is kept as 1 and -1 as 0."""

    def __init__(self, dimensions: int):
        self.dimensions = dimensions
        self._forget()

    def _forget(self) -> None:
        self.codes = np.zeros(0, np.uint64)
        self.rows = np.zeros(0, np.int64)
        self.table = np.zeros((KEPT_VECTORS, self.dimensions), np.uint8)  # pages that no vector has reached take no memory

    def bind(self, code: int) -> np.ndarray:
        a, b, c = (letter_bits(code >> shift & 0x1FFFFF, self.dimensions, turns) for shift, turns in ((42, 2), (21, 1), (0, 0)))
        return a ^ b ^ c  # a product of three signs is +1 where an odd number of them is

    def bundle(self, codes: np.ndarray, counts: np.ndarray) -> np.ndarray:
        ones = np.zeros(self.dimensions, np.int64)
        for at in range(0, len(codes), KEPT_VECTORS // 4):
            part = slice(at, at + KEPT_VECTORS // 4)
            rows, left, bit = self._find(codes[part]), counts[part], 0
            while left.any():
                odd = rows[(left & 1).astype(bool)]
                for i in range(0, len(odd), 255):  # so many ones fit into a byte
                    ones += np.add.reduce(self.table[odd[i : i + 255]], axis=0, dtype=np.uint8).astype(np.int64) << bit
                left, bit = left >> 1, bit + 1
        return (2 * ones - int(counts.sum())).astype(np.float64)

    def _find(self, codes: np.ndarray) -> np.ndarray:
        at = np.searchsorted(self.codes, codes)
        known = np.zeros(len(codes), bool)
        known[at < len(self.codes)] = self.codes[at[at < len(self.codes)]] == codes[at < len(self.codes)]
        if not known.all():
            if len(self.codes) + len(codes) > KEPT_VECTORS:
                self._forget()
                known[:] = False
            new, base = codes[~known], len(self.codes)
            for i, code in enumerate(new.tolist()):
                self.table[base + i] = self.bind(code)
            order = np.argsort(np.concatenate([self.codes, new]))
            self.rows = np.concatenate([self.rows, np.arange(base, base + len(new))])[order]
            self.codes = np.concatenate([self.codes, new])[order]
            at = np.searchsorted(self.codes, codes)
        return self.rows[at]


@lru_cache(maxsize=2)
def _vectors(dimensions: int) -> TrigramVectors:
    return TrigramVectors(dimensions)


class Profiles:
    """Unit prototypes of the learned languages, in alphabetical order."""

    def __init__(self, languages: list[str], vectors: np.ndarray):
        self.languages = languages
        self.unit = vectors / np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-30) if languages else vectors
        self.dimensions = vectors.shape[1]

    def predict(self, text: str | None) -> tuple[str, float]:
        codes, counts = trigram_counts(text)
        if not len(codes) or not self.languages:
            return UNKNOWN, 0.0
        vector = _vectors(self.dimensions).bundle(codes, counts)
        norm = np.linalg.norm(vector)
        if not norm:
            return self.languages[0], 0.0
        cosines = self.unit @ vector / norm
        best = int(np.argmax(cosines))
        return self.languages[best], float(min(1.0, max(0.0, cosines[best])))


def learn(rows: DataFrame, text: str = "text", lang: str = "lang", dimensions: int = DIMENSIONS, most: int | None = None) -> Profiles:
    """Prototypes from every row that has a language. ``most``: more languages than this are an error (none: any number).

    Each partition counts trigrams by language and bundles the counts once; Spark adds the partial bundles, so one
    vector a language reaches the driver.
    """

    pieces, columns = -(-dimensions // PIECE), [f"v{i}" for i in range(PIECE)]

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counted: dict[str, dict[int, int]] = {}
        vectors, sums = _vectors(dimensions), {}

        def settle(name: str) -> None:
            found = counted.pop(name)
            part = vectors.bundle(np.fromiter(found.keys(), np.uint64, len(found)), np.fromiter(found.values(), np.int64, len(found)))
            sums[name] = sums.get(name, 0) + part

        for batch in batches:
            for t, name in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                codes, counts = trigram_counts(t)
                own = counted.setdefault(name, {})
                for c, n in zip(codes.tolist(), counts.tolist(), strict=True):
                    own[c] = own.get(c, 0) + n
                if len(own) > 8 * KEPT_VECTORS:
                    settle(name)
        for name in list(counted):
            settle(name)
        _vectors.cache_clear()
        if sums:
            found = np.zeros((len(sums), pieces * PIECE))
            found[:, :dimensions] = list(sums.values())
            names = pa.array(np.repeat(np.array(list(sums), object), pieces), pa.string())
            yield pa.RecordBatch.from_arrays([names, pa.array(np.tile(np.arange(pieces, dtype=np.int32), len(sums))), *map(pa.array, found.reshape(-1, PIECE).T.copy())], names=["lang", "piece", *columns])

    partial = rows.filter(F.col(lang).isNotNull()).select(F.col(text).cast("string"), F.col(lang).cast("string")).mapInArrow(step, ", ".join(["lang string, piece int", *[f"{c} double" for c in columns]]))
    summed = partial.groupBy("lang", "piece").agg(F.array(*[F.sum(c) for c in columns]).alias("v"))
    rows = summed.groupBy("lang").agg(F.flatten(F.sort_array(F.collect_list(F.struct("piece", "v")))["v"]).alias("vector")).orderBy("lang").collect()
    if most is not None and len(rows) > most:
        raise ValueError(f"column {lang} has more than {most} values")
    return Profiles([r["lang"] for r in rows], np.array([r["vector"] for r in rows]).reshape(len(rows), pieces * PIECE)[:, :dimensions])


def identify(docs: DataFrame, profiles: Profiles, text: str = "text") -> DataFrame:
    """``docs`` with ``lang_pred`` and ``score`` (the cosine, not below 0)."""

    fields = [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())]
    at = place_of(docs, text, fields)

    def make(batch: pa.RecordBatch) -> list[pa.Array]:
        found = [profiles.predict(t.as_py()) for t in batch.column(at)]
        return [pa.array([x[0] for x in found], pa.string()), pa.array([x[1] for x in found], pa.float64())]

    return add_columns(docs, make, fields, done=_vectors.cache_clear)


def learning_rows(docs: DataFrame, fold: Column, held_out: int) -> DataFrame:
    """Rows whose fold is known and is not the held-out one."""
    return docs.filter(fold != held_out)
