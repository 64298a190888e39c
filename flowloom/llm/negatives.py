"""Hard negatives by exact inner-product search over STR-packed R-trees.

1. Rows that take part become integer vectors. Spark cuts them, in the order of label and first coordinate, into tiles of
   about ``TILE_ROWS`` rows; ties are broken by a hash of the id, so no value makes a large tile.
2. Each tile is packed by sort-tile-recursive: labels with enough rows apart from each other, then slabs along one coordinate
   after the other (the widest first), ceil(pages ** (1 / coordinates left)) slabs each, down to leaves of ``LEAF`` rows. Leaves
   are rows of a table (``pack``); the boxes of the inner levels, ``FANOUT`` children each, follow from theirs.
3. A search keeps a queue of boxes by their largest possible inner product with the anchor. A box is pruned when its labels
   do not fit, when its bounds miss every score window, or when its upper bound is strictly below the k-th score of
   every window that it meets. The result is exact, ties included.
4. Anchors meet the tiles twice: for their positives, only the tiles that hold their label; for the negatives of all
   positives at once, every tile. The tiles' lists are merged by rank.

Nulls and edges: rows without ``vec_id`` or label, with a null vector, or with a null or non-finite component take no part.
A shorter vector counts as filled up with zeros. Rows of one ``vec_id`` are separate rows, though none is "another row" or a
negative of the others; a repeated anchor gives its rows again. Scores beyond 64 bits raise an error. Empty tables give no row.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flowloom.functions.lineage import cut

TILE_ROWS, LEAF, FANOUT = 8192, 64, 32
#: Leaves whose rows are scored at a time.
TOGETHER = 8
_EXACT = 1 << 53


def integer_rows(rows: DataFrame, vector: str = "embedding", scale: int = 256) -> DataFrame:
    """vec_id, label and x (floor of ``scale`` times each component) of the rows that take part."""
    usable = F.forall(vector, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(math.inf)))
    kept = rows.filter(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col(vector).isNotNull() & usable)
    x = F.transform(vector, lambda c: F.floor(c.cast("double") * scale).cast("long"))
    return kept.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), x.alias("x"))


def _matrix(lists: pa.Array, width: int) -> np.ndarray:
    """Lists as rows of a matrix, filled up with zeros."""
    sizes = np.diff(lists.offsets.to_numpy())
    out = np.zeros((len(sizes), width), np.int64)
    out[np.arange(width) < sizes[:, None]] = lists.flatten().to_numpy()
    return out


def str_order(x: np.ndarray, leaf: int) -> list[np.ndarray]:
    """Row numbers of each leaf, by sort-tile-recursive over the coordinates, the widest first."""
    axes = np.argsort(-np.ptp(x, axis=0).astype(float), kind="stable") if x.size else np.zeros(0, int)
    out: list[np.ndarray] = []

    def tile(rows: np.ndarray, depth: int) -> None:
        pages = -(-len(rows) // leaf)
        if pages <= 1 or depth == len(axes):
            out.extend(rows[i : i + leaf] for i in range(0, len(rows), leaf))
            return
        slabs = math.ceil(pages ** (1 / (len(axes) - depth)) - 1e-9)
        size = leaf * -(-pages // max(2, slabs))
        ordered = rows[np.argsort(x[rows, axes[depth]], kind="stable")]
        for i in range(0, len(ordered), size):
            tile(ordered[i : i + size], depth + 1)

    tile(np.arange(len(x)), 0)
    return out


def leaves_of(labels: np.ndarray, x: np.ndarray, leaf: int = LEAF) -> list[np.ndarray]:
    """Row numbers of the leaves of one tile; labels that fill a leaf do not share one."""
    out: list[np.ndarray] = []
    order = np.argsort(labels, kind="stable")
    rest = []
    for rows in np.split(order, np.flatnonzero(np.diff(labels[order])) + 1):
        if len(rows) >= leaf:
            out += [rows[part] for part in str_order(x[rows], leaf)]
        else:
            rest.append(rows)
    if rest:
        few = np.concatenate(rest)  # by label
        out += [few[i : i + leaf] for i in range(0, len(few), leaf)]
    return [part for part in out if len(part)]


def pack(rows: DataFrame, tiles: int, width: int, leaf: int = LEAF) -> DataFrame:
    """The packed leaves: tile, leaf, labels (distinct), and ids, row labels and vectors as 64-bit integers."""

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [(b.column(0).to_numpy(), b.column(1).to_numpy(), _matrix(b.column(2), width)) for b in batches if b.num_rows]
        if not held:
            return
        ids, labels, x = (np.concatenate(part) for part in zip(*held, strict=True))
        tile = TaskContext.get().partitionId()
        parts = leaves_of(labels, x, leaf)
        for start in range(0, len(parts), 32):
            some = parts[start : start + 32]
            yield pa.RecordBatch.from_arrays(
                [pa.array([tile] * len(some), pa.int32()), pa.array(range(start, start + len(some)), pa.int32()), pa.array([np.unique(labels[p]).tolist() for p in some], pa.list_(pa.int64())),
                 *(pa.array([np.ascontiguousarray(a[p]).tobytes() for p in some], pa.binary()) for a in (ids, labels, x))],
                names=["tile", "leaf", "labels", "ids", "row_labels", "vectors"],
            )

    keyed = rows.select("vec_id", "label", "x", F.get("x", F.lit(0)).alias("first"), F.xxhash64("vec_id").alias("tie"))
    dealt = keyed.repartitionByRange(tiles, "label", "first", "tie").select("vec_id", "label", "x")
    return dealt.mapInArrow(step, "tile int, leaf int, labels array<long>, ids binary, row_labels binary, vectors binary")


class Tree:
    """One tile's R-tree."""

    def __init__(self, ids: list[bytes], labels: list[bytes], vectors: list[bytes], width: int):
        read = [[np.frombuffer(b, np.int64) for b in part] for part in (ids, labels, vectors)]
        sizes = np.array([len(b) for b in read[0]], np.int64)
        self.ids, self.labels = np.concatenate(read[0]), np.concatenate(read[1])
        self.whole = np.concatenate(read[2]).reshape(len(self.ids), width)
        self.width, self.cuts = width, np.append(0, np.cumsum(sizes))
        self.largest = max(int(self.whole.max()), -int(self.whole.min())) if self.whole.size else 0
        self.scored = self.bounded = 0
        self._build(np.float64)

    def _build(self, kind: type) -> None:
        """Boxes of all levels, as doubles (exact for vectors of moderate size) or as Python integers."""
        self.x = self.whole.astype(kind)
        at = self.cuts[:-1]
        width = self.width
        boxes = tuple(f.reduceat(self.x, at, axis=0) if width else self.x[: len(at)] for f in (np.minimum, np.maximum))
        marks = (np.minimum.reduceat(self.labels, at), np.maximum.reduceat(self.labels, at))
        self.levels = [(*boxes, *marks)]
        while len(self.levels[-1][2]) > 1:
            below = self.levels[-1]
            at = np.arange(0, len(below[2]), FANOUT)
            self.levels.append(tuple(f.reduceat(part, at, axis=0) if part.size else part[: len(at)] for f, part in zip((np.minimum, np.maximum) * 2, below, strict=True)))

    def search(self, q: np.ndarray, anchor: int, label: int, same: bool, windows: list[tuple], k: int) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each window (least, most): scores and ids of the first k rows in it, of the same label or of all others."""
        if self.x.dtype != object and self.width * self.largest * max(map(abs, q.tolist()), default=0) >= _EXACT:
            self._build(object)  # sums would be rounded
        q = q.astype(self.x.dtype)
        up, down = np.maximum(q, 0), np.minimum(q, 0)
        found = [(np.zeros(0, q.dtype), np.zeros(0, np.int64)) for _ in windows]
        kth = [least for least, _ in windows]  # no smaller score is of use
        queue: list[tuple] = []

        def wanted(best: float, least: float) -> bool:
            return any(best >= at and least <= most for at, (_, most) in zip(kth, windows, strict=True))

        def push(level: int, start: int, stop: int) -> None:
            low, high, first, last = (part[start:stop] for part in self.levels[level])
            best, least = high @ up + low @ down, low @ up + high @ down
            fits = (first <= label) & (label <= last) if same else (first != label) | (last != label)
            self.bounded += stop - start
            for i in np.flatnonzero(fits):
                if wanted(best[i], least[i]):
                    heapq.heappush(queue, (-best[i], level, start + int(i), least[i]))

        push(len(self.levels) - 1, 0, len(self.levels[-1][2]))
        while queue:
            together = []
            while queue and len(together) < TOGETHER:
                best, level, node, least = heapq.heappop(queue)
                if not wanted(-best, least):
                    continue
                if level:
                    push(level - 1, node * FANOUT, min((node + 1) * FANOUT, len(self.levels[level - 1][2])))
                else:
                    together.append(np.arange(self.cuts[node], self.cuts[node + 1]))
            if not together:
                continue
            rows = np.concatenate(together)
            rows = rows[((self.labels[rows] == label) if same else (self.labels[rows] != label)) & (self.ids[rows] != anchor)]
            scores = self.x[rows] @ q
            self.scored += len(rows)
            for w, (_, most) in enumerate(windows):
                inside = np.flatnonzero((scores >= kth[w]) & (scores <= most))
                if len(inside):
                    s, i = np.concatenate([found[w][0], scores[inside]]), np.concatenate([found[w][1], self.ids[rows[inside]]])
                    order = np.lexsort((i, -s))[:k]
                    found[w] = s[order], i[order]
                    if len(order) == k:
                        kth[w] = max(kth[w], found[w][0][-1])
        return found


def _asked(leaves: DataFrame, queries: DataFrame, width: int, same: bool, k: int, tiles: int) -> DataFrame:
    """a, w, score, id: what each tile has for each query (tile, a, vec_id, label, x, lows, highs)."""
    none = F.lit(None)
    stored = leaves.select("tile", "leaf", "ids", "row_labels", "vectors", *[none.cast(t).alias(n) for n, t in (("a", "long"), ("vec_id", "long"), ("label", "long"), ("x", "array<long>"), ("lows", "array<long>"), ("highs", "array<long>"))])
    asked = queries.select("tile", F.lit(None).cast("int").alias("leaf"), *[none.cast("binary").alias(n) for n in ("ids", "row_labels", "vectors")], "a", "vec_id", "label", "x", "lows", "highs")
    rows = stored.unionByName(asked).repartition(tiles, "tile").sortWithinPartitions("tile", F.col("leaf").asc_nulls_last())

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tile, tree, parts = None, None, ([], [], [])
        for batch in batches:
            out: list[tuple] = []
            numbers, leaf = batch.column(0).to_pylist(), batch.column(1).is_valid().to_numpy(zero_copy_only=False)
            for i, number in enumerate(numbers):
                if number != tile:
                    tile, tree, parts = number, None, ([], [], [])
                if leaf[i]:
                    for c, part in enumerate(parts):
                        part.append(batch.column(2 + c)[i].as_py())
                    continue
                if tree is None:
                    if not parts[0]:
                        continue  # no row lies in this tile
                    tree, parts = Tree(*parts, width), ([], [], [])
                a, anchor, label = (batch.column(c)[i].as_py() for c in (5, 6, 7))
                q = _matrix(batch.column(8).slice(i, 1), width)[0]
                windows = [(-math.inf, math.inf)] if same else list(zip(batch.column(9)[i].as_py(), batch.column(10)[i].as_py(), strict=True))
                for w, (scores, ids) in enumerate(tree.search(q, anchor, label, same, windows, k)):
                    out += [(a, w, int(s), int(d)) for s, d in zip(scores, ids, strict=True)]
            if out:
                if max(max(r[2], -r[2]) for r in out) >= 1 << 63:
                    raise ValueError("an inner product does not fit into 64 bits")
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int64(), pa.int32(), pa.int64(), pa.int64()), strict=True)], names=["a", "w", "score", "id"])

    found = rows.mapInArrow(step, "a long, w int, score long, id long")
    order = Window.partitionBy("a", "w").orderBy(F.desc("score"), "id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def mine(rows: DataFrame, is_anchor: Column, positives: int = 5, negatives: int = 10, low: int = 30, high: int = 90, vector: str = "embedding", scale: int = 256, tile_rows: int = TILE_ROWS) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score and negative_score.

    ``rows`` have vec_id, label and the vector. Each anchor's positives are its first ``positives`` rows of the same label; for
    each, the first ``negatives`` rows of other labels are returned whose score is ``low`` to ``high`` hundredths of its own.
    """
    known = integer_rows(rows, vector, scale)
    count, width = known.agg(F.count("*"), F.coalesce(F.max(F.size("x")), F.lit(0))).first()
    tiles = max(1, -(-count // tile_rows))
    leaves = cut(pack(known, tiles, width))
    tiles = (leaves.agg(F.max("tile")).first()[0] or 0) + 1
    anchors = cut(known.filter(is_anchor).withColumn("a", F.monotonically_increasing_id()))
    none = F.lit(None).cast("array<long>")
    holding = leaves.select("tile", F.explode("labels").alias("label")).distinct()
    near = _asked(leaves, anchors.join(holding, "label").withColumns({"lows": none, "highs": none}), width, True, positives, tiles)
    near = cut(near.select("a", F.col("rank").alias("p"), F.col("id").alias("positive_id"), F.col("score").alias("positive_score")))
    # Whole scores s with low * p <= 100 * s <= high * p.
    exact = F.col("positive_score").cast("decimal(38,0)")
    ends = near.select("a", "p", F.ceil(exact * low / 100).cast("long").alias("least"), F.floor(exact * high / 100).cast("long").alias("most"))
    sides = ends.groupBy("a").agg(F.sort_array(F.collect_list(F.struct("p", "least", "most"))).alias("ends"))
    queries = anchors.join(sides, "a").select("*", F.col("ends.least").alias("lows"), F.col("ends.most").alias("highs"))
    queries = queries.withColumn("tile", F.explode(F.sequence(F.lit(0), F.lit(tiles - 1)))).drop("ends")
    far = _asked(leaves, queries, width, False, negatives, tiles).select("a", (F.col("w") + 1).alias("p"), F.col("rank").cast("int").alias("rank"), F.col("id").alias("negative_id"), F.col("score").alias("negative_score"))
    named = near.join(anchors.select("a", F.col("vec_id").alias("anchor_id")), "a")
    return far.join(named, ["a", "p"]).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
