"""Text quality: logistic regression on hashed word n-grams, trained by follow-the-regularised-leader updates.

The n-grams are words and word pairs, and the same over word shapes (runs of capitals, small letters, digits; other
characters stay) and over "repeats the word before". A text's value for an n-gram is the square root of its share.

Nulls and edges: a null, empty or blank text has the constant feature only and gets the score of that constant. A
learning row needs a label and a document; several labels of one document count as their rounded mean. Without
learning rows every score is 0.5.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flowloom.llm.columns import add_columns, groups, place_of
from flowloom.llm.words import Words, mix, span_sums

_U = np.uint64
BITS = 18
#: Bound of the learning sample (expected rows), the number of models trained side by side, and passes over the rows.
FIT_ROWS, SHARDS, PASSES = 16_000, 4, 4
ALPHA, BETA, L1, L2 = 0.5, 1.0, 0.02, 0.1

_SHAPE = np.arange(256, dtype=np.uint8)
_SHAPE[ord("A") : ord("Z") + 1] = ord("A")
_SHAPE[ord("a") : ord("z") + 1] = ord("a")
_SHAPE[ord("0") : ord("9") + 1] = ord("0")
_SHAPE[128:] = ord("a")


def features(texts: pa.Array, bits: int = BITS) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Slots and values of each text; slot 0 is the constant."""
    for start, stop in groups(texts):
        part = texts.slice(start, stop - start)
        words = Words(part)
        hashes = words.hashes()
        shape = _SHAPE[words.data]
        turns = np.ones(len(shape), bool)
        turns[1:] = shape[1:] != shape[:-1]
        turns[words.starts] = True
        shapes = mix(span_sums(np.where(turns, shape, 0).astype(_U), np.cumsum(turns) - 1, words.starts, words.ends)) if len(words.starts) else hashes
        same = np.zeros(len(hashes), bool)
        same[1:] = hashes[1:] == hashes[:-1]
        inner = np.ones(len(hashes), bool)
        inner[words.first[:-1][words.first[:-1] < len(hashes)]] = False
        kinds = [hashes, shapes, np.where(same & inner, _U(7), _U(11))]
        kinds += [np.where(inner, x * _U(0x9E3779B97F4A7C15) + np.roll(x, 1), _U(0)) for x in kinds[:2]]
        slots = np.stack([mix(x + _U((k + 1) * 0xD1B54A32D192ED03 % (1 << 64))) >> _U(64 - bits) for k, x in enumerate(kinds)], axis=1)
        for a, b in zip(words.first[:-1].tolist(), words.first[1:].tolist(), strict=True):
            found, counts = np.unique(slots[a:b].ravel(), return_counts=True)
            yield np.concatenate([[0], found.astype(np.int64)]), np.concatenate([[1.0], np.sqrt(counts / max(1, b - a))])


class Leader:
    """Per-coordinate follow-the-regularised-leader with both penalties."""

    def __init__(self, size: int):
        self.z, self.n = np.zeros(size), np.zeros(size)

    def weights(self, at: np.ndarray | slice = slice(None)) -> np.ndarray:
        z = self.z[at]
        return np.where(np.abs(z) > L1, -(z - np.sign(z) * L1) / ((BETA + np.sqrt(self.n[at])) / ALPHA + L2), 0.0)

    def update(self, at: np.ndarray, x: np.ndarray, label: int) -> None:
        w = self.weights(at)
        gradient = (1 / (1 + np.exp(-np.clip(w @ x, -35, 35))) - label) * x
        n = self.n[at]
        self.z[at] += gradient - (np.sqrt(n + gradient**2) - np.sqrt(n)) / ALPHA * w
        self.n[at] = n + gradient**2


def learn(docs: DataFrame, labels: DataFrame, label: str = "quality", fit_rows: int = FIT_ROWS, bits: int = BITS) -> np.ndarray:
    """Weights by slot.

    ``fit_rows`` bounds the sample: labels are thinned by a hash of the id to about that many rows, so the sampled
    labels are small by construction and are sent to the documents. ``SHARDS`` models are trained in parallel and
    averaged; at most ``2 ** bits`` weights reach the driver.
    """
    known = labels.filter(F.col("doc_id").isNotNull() & F.col(label).isNotNull()).groupBy("doc_id").agg(F.round(F.avg(label)).cast("int").alias("label"))
    total = known.count()
    grain = 1 << 20
    keep = grain if total <= fit_rows else grain * fit_rows // total
    sample = known.filter(F.pmod(F.xxhash64(F.lit(97), "doc_id"), F.lit(grain)) < keep)
    rows = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id").withColumn("turn", F.xxhash64("doc_id", F.lit(5)))
    rows = rows.repartition(SHARDS, F.pmod("turn", F.lit(SHARDS))).sortWithinPartitions("turn", F.xxhash64("text"))

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, seen = Leader(1 << bits), []
        for batch in batches:
            texts, marks = batch.column(0), batch.column(1).to_pylist()
            for (at, x), y in zip(features(texts, bits), marks, strict=True):
                model.update(at, x, y)
                seen.append((at.astype(np.int32), x.astype(np.float32), y))
        for _ in range(PASSES - 1):
            for at, x, y in seen:
                model.update(at, x, y)
        if seen:
            weights = model.weights()
            used = np.flatnonzero(weights)
            yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.array(weights[used] * len(seen)), pa.array(np.full(len(used), len(seen)), pa.int64())], names=["slot", "weight", "n"])
            yield pa.RecordBatch.from_arrays([pa.array([-1], pa.int32()), pa.array([0.0]), pa.array([len(seen)], pa.int64())], names=["slot", "weight", "n"])

    found = rows.select("text", "label").mapInArrow(step, "slot int, weight double, n long").groupBy("slot").agg(F.sum("weight").alias("weight"), F.sum("n").alias("n")).toPandas()
    out = np.zeros(1 << bits)
    if len(found):
        learned = found[found.slot >= 0]
        out[learned.slot.to_numpy()] = learned.weight.to_numpy() / found.n[found.slot < 0].iloc[0]
    return out


def score(docs: DataFrame, weights: np.ndarray, text: str = "text") -> DataFrame:
    """``docs`` with ``score``: the sparse dot product of the text's features and the weights, as a probability."""
    sent = docs.sparkSession.sparkContext.broadcast(weights)
    bits = (len(weights) - 1).bit_length()

    fields = [T.StructField("score", T.DoubleType())]
    place = place_of(docs, text, fields)

    def make(batch: pa.RecordBatch) -> list[pa.Array]:
        sums = [float(x @ sent.value[at]) for at, x in features(batch.column(place), bits)]
        return [pa.array(1 / (1 + np.exp(-np.clip(np.array(sums, float), -35, 35))))]

    return add_columns(docs, make, fields)
