"""Connected components of a link table, by alternating star steps."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flowloom.functions.lineage import cut

#: Links that one task connects by itself; their number is counted first. More go through steps over all tasks.
FEW = 200_000


def _connected(edges: DataFrame) -> DataFrame:
    """Components by joining roots, in one task."""

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        root: dict = {}

        def find(x: object) -> object:
            top = x
            while root[top] != top:
                top = root[top]
            while root[x] != top:
                root[x], x = top, root[x]
            return top

        kind = None
        for batch in batches:
            kind = batch.schema.field(0).type
            for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                root.setdefault(a, a)
                root.setdefault(b, b)
                low, high = sorted((find(a), find(b)))
                root[high] = low
        if root:
            nodes = list(root)
            yield pa.RecordBatch.from_arrays([pa.array(nodes, kind), pa.array([find(n) for n in nodes], kind)], names=["node", "component"])

    kind = edges.schema["a"].dataType
    return edges.coalesce(1).mapInArrow(step, T.StructType([T.StructField("node", kind), T.StructField("component", kind)]))


def components(links: DataFrame, few: int = FEW) -> DataFrame:
    """(node, component) for every node of ``links`` (columns a, b); the component is its smallest node.

    Each step hangs the larger neighbours of a node, then the smaller ones, on the smallest node in sight, until
    nothing changes; the number of steps is logarithmic in the longest path. Every step is written down, so a lost
    executor costs one step. A table of at most ``few`` links is connected by one task instead, with the same result. Empty links
    give an empty table.
    """
    edges = cut(links.filter("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    seen = _mark(edges)
    if seen[0] <= few:
        return cut(_connected(edges))
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").filter("b != m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        edges = cut(small.unionByName(least.withColumnRenamed("m", "b")).distinct())
        mark = _mark(edges)
        if mark == seen:
            break
        seen = mark
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())


def _mark(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
