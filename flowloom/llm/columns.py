"""Run a numpy step over Arrow batches and put its results beside the columns that came in."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Texts are taken in groups of about so many bytes, which bounds the work arrays.
GROUP_BYTES = 1 << 20


def place_of(df: DataFrame, column: str, fields: list[T.StructField]) -> int:
    """Where ``add_columns`` puts a column of ``df``. Letter case does not count, as in Spark; a missing column is an error."""
    names = {f.name.lower() for f in fields}
    kept = [c for c in df.columns if c.lower() not in names]
    found = [i for i, c in enumerate(kept) if c == column] or [i for i, c in enumerate(kept) if c.lower() == column.lower()]
    if len(found) != 1:
        raise ValueError(f"column {column!r} is {'missing' if not found else 'not unique'} in {df.columns}")
    return found[0]


def add_columns(df: DataFrame, make: Callable[[pa.RecordBatch], list[pa.Array]], fields: list[T.StructField], done: Callable[[], None] | None = None) -> DataFrame:
    """``df`` and the columns that ``make`` computes from each batch; ``done`` is called at the end of each task.

    A column of ``df`` that has the name of a new one gives way to it, as with ``withColumn``.
    """
    names = {f.name.lower() for f in fields}
    base = df.select(*[F.col(f"`{c}`") for c in df.columns if c.lower() not in names])

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            new = make(batch)
            yield pa.RecordBatch.from_arrays(list(batch.columns) + new, names=list(batch.schema.names) + [f.name for f in fields])
        if done:
            done()
        pa.default_memory_pool().release_unused()

    return base.mapInArrow(step, T.StructType(base.schema.fields + fields))


@contextmanager
def batches_of(spark: SparkSession, rows: int) -> Iterator[None]:
    """Let plans that run inside send at most so many rows to a Python worker at a time; for rows that are large."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(rows))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts, and where each begins (one entry more than texts); null counts as empty."""
    if texts.null_count:
        texts = texts.fill_null("")
    if not pa.types.is_large_string(texts.type):
        texts = texts.cast(pa.large_string())
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = texts.buffers()[2]
    if data is None or not len(texts):
        return np.zeros(0, np.uint8), np.zeros(len(texts) + 1, np.int64)
    return np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]], offsets - offsets[0]


def groups(texts: pa.Array, size: int = GROUP_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of about ``size`` bytes each; a longer text is a range of its own."""
    _, offsets = text_bytes(texts)
    start = 0
    while start < len(texts):
        stop = max(start + 1, int(np.searchsorted(offsets, offsets[start] + size, side="right")) - 1)
        yield start, stop
        start = stop


def fold_of(doc_id: Column, folds: int) -> Column:
    """crc32 of the id as text, modulo ``folds``; null for a null id."""
    return F.crc32(doc_id.cast("string").cast("binary")) % folds
