"""Near-duplicate classes: an inverted join over the coordinates of MinHash signatures.

1. Every document gets the minima of ``POSTED`` hash functions over its shingles. Documents of one shingle set
   are one class, joined on two 64-bit sums over the set.
2. Classes are posted under each (coordinate, value). Two classes above the threshold
   collide in at least ``LEAST_POSTED`` of these, so each leaves out its ``LEAST_POSTED - 1`` longest lists: a common
   passage makes long lists, and only documents that consist of it mostly stay in them (prefix merging). Values that one
   class alone has are no list, and a class with too few shared values is not looked at again (skip merging).
3. Classes that stay in a list get a finer sketch (``FINE`` coordinates of one byte). Pairs that meet in a list are kept
   when their sketches collide in ``LEAST_FINE`` coordinates, and are then confirmed on the full shingle sets of the texts.
4. Large groups of copies are not expanded into pairs. Each list first compares its members with one centre, the member
   that shares most, in ``STAR_ROUNDS`` rounds; what these links connect is not compared again. Lists that still hold
   several components are cut into blocks; block against block, sketches are compared in memory, and a pair of different
   components that passes comes out once, at the first list that both share. Of these pairs the closest of each document
   are confirmed first, then those that are still in different components.

At a similarity of 0.75 the chance to miss a pair in step 2 or 3 is about 2 in a million; more similar pairs are safer.

Nulls and edges: a null text, or one without words, has no shingle and no link. A null ``doc_id`` is its own class,
stays and has a null ``component_id``. Rows of one ``doc_id`` are one document: linked if any of their texts is.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flowloom.functions.lineage import cut
from flowloom.llm.columns import add_columns, batches_of, groups
from flowloom.llm.graph import components
from flowloom.llm.words import Words, mix, shingle_sets

SHINGLE, PERCENT = 5, 75
POSTED, LEAST_POSTED = 32, 12
#: At 0.75 a sketch is expected to collide in 769 coordinates, with a standard deviation of 13.9.
FINE, LEAST_FINE = 1024, 701
STAR_ROUNDS, BLOCK = 2, 256
#: Texts that go to a Python worker at a time.
TEXT_ROWS = 1024

_U = np.uint64
#: Shingles that are hashed at a time.
_CHUNK = 4096


def _minima(shingles: np.ndarray, first: int, count: int) -> np.ndarray:
    """Minima of hash functions ``first`` to ``first + count`` over a set, a function being an odd factor and a shift."""
    steps = mix(np.arange(2 * first + 1, 2 * (first + count) + 1, dtype=np.uint64))
    times, plus = steps[:count] | _U(1), steps[count:]
    best = np.full(count, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(shingles), _CHUNK):
        np.minimum(best, (shingles[at : at + _CHUNK, None] * times + plus).min(axis=0), out=best)
    return best


def signature(shingles: np.ndarray) -> np.ndarray:
    """The upper halves of the minima, as signed 32-bit values."""
    return (_minima(shingles, 0, POSTED) >> _U(32)).astype(np.uint32).view(np.int32)


def sketch(shingles: np.ndarray) -> bytes:
    """One byte of each of the finer minima."""
    return (_minima(shingles, POSTED, FINE) >> _U(40)).astype(np.uint8).tobytes()


def signatures(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """doc_id, n_shingles, two sums that name the shingle set, and the signature."""

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, first, second, signs = [], [], [], []
            for start, stop in groups(batch.column(1)):
                for found in shingle_sets(Words(batch.column(1).slice(start, stop - start), lower=True), shingle):
                    sizes.append(len(found))
                    first.append(mix(found ^ _U(0xA0761D6478BD642F)).sum(dtype=np.uint64))
                    second.append(mix(found ^ _U(0xE7037ED1A0B428DB)).sum(dtype=np.uint64))
                    signs.append(signature(found))
            flat = np.concatenate(signs) if signs else np.zeros(0, np.int32)
            lists = pa.ListArray.from_arrays(np.arange(0, len(flat) + 1, POSTED, dtype=np.int32), pa.array(flat))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), *(pa.array(np.array(x, np.uint64).view(np.int64)) for x in (first, second)), lists], names=["doc_id", "n_shingles", "h1", "h2", "signs"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(step, f"doc_id {kind}, n_shingles long, h1 long, h2 long, signs array<int>")


def confirmed(pairs: DataFrame, texts: DataFrame, percent: int = PERCENT, shingle: int = SHINGLE) -> DataFrame:
    """Pairs (a, b) whose full shingle sets share ``percent`` of their union. ``texts``: node, text."""
    sides = pairs.join(texts.select(F.col("node").alias("b"), F.col("text").alias("text_b")), "b")
    sides = sides.join(texts.select(F.col("node").alias("a"), F.col("text").alias("text_a")), "a").select("a", "b", "text_a", "text_b")

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: tuple = (None, None)  # rows come in the order of a
        for batch in batches:
            kept = np.zeros(batch.num_rows, bool)
            for i in range(batch.num_rows):
                text_a = batch.column(2)[i].as_py()
                if last[0] != text_a:
                    last = text_a, shingle_sets(Words(batch.column(2).slice(i, 1), lower=True), shingle)[0]
                other = shingle_sets(Words(batch.column(3).slice(i, 1), lower=True), shingle)[0]
                both = len(np.intersect1d(last[1], other, assume_unique=True))
                kept[i] = 100 * both >= percent * (len(last[1]) + len(other) - both) and both > 0
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(kept))

    return sides.mapInArrow(step, sides.select("a", "b").schema).distinct()


def _sketched(texts: DataFrame, shingle: int) -> DataFrame:
    """``texts`` (node, text) and the sketch of each."""

    def make(batch: pa.RecordBatch) -> list[pa.Array]:
        out = []
        for start, stop in groups(batch.column(1)):
            out += [sketch(x) for x in shingle_sets(Words(batch.column(1).slice(start, stop - start), lower=True), shingle)]
        return [pa.array(out, pa.binary())]

    return add_columns(texts.select("node", "text"), make, [T.StructField("sketch", T.BinaryType())])


def _alike(pairs: DataFrame, sketches: DataFrame) -> DataFrame:
    """Pairs (a, b) whose sketches collide often enough."""
    sides = pairs.join(sketches.select(F.col("node").alias("a"), F.col("sketch").alias("sa")), "a")
    sides = sides.join(sketches.select(F.col("node").alias("b"), F.col("sketch").alias("sb")), "b").select("a", "b", "sa", "sb")

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            left, right = (_matrix(batch.column(k).to_pylist()) for k in (2, 3))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array((left == right).sum(axis=1) >= LEAST_FINE))

    return sides.mapInArrow(step, sides.select("a", "b").schema).distinct()


def _matrix(sketches: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(sketches), np.uint8).reshape(len(sketches), FINE)


def _between_parts(members: DataFrame, classes: DataFrame, sketches: DataFrame) -> DataFrame:
    """(a, b, n): pairs of different parts that share a list and n of their fine coordinates, each pair once.

    ``members``: key, node, part, of lists with several parts. Rows in and out are blocks and passing pairs.
    """
    coordinate = F.floor((F.col("key") + (1 << 31)) / F.lit(float(1 << 32))).cast("int")
    masks = members.groupBy("node").agg(F.sum(F.element_at(F.array(*[F.lit(1 << k) for k in range(POSTED)]).cast("array<long>"), coordinate + 1)).alias("mask"))
    known = masks.join(classes.select("node", "signs"), "node").join(sketches.select("node", "sketch"), "node").dropDuplicates(["node"])
    blocks = members.groupBy("key").agg(F.ceil(F.count("*") / BLOCK).alias("blocks"))
    dealt = members.join(blocks, "key").join(known, "node")
    rows = dealt.groupBy("key", F.pmod(F.xxhash64("node"), F.col("blocks")).alias("block")).agg(F.collect_list(F.struct("node", "part", "mask", "signs", "sketch")).alias("rows"))
    rows = cut(rows)
    sides = rows.select("key", F.col("block").alias("i"), F.col("rows").alias("left")).join(rows.select("key", F.col("block").alias("j"), F.col("rows").alias("right")), "key").filter("i <= j")
    kind = members.schema["node"].dataType.simpleString()

    def read(rows: pa.StructScalar) -> tuple:
        node, part, mask, signs, sketches = (rows.values.field(n) for n in ("node", "part", "mask", "signs", "sketch"))
        return node.to_numpy(), part.to_numpy(), mask.to_numpy(), signs.flatten().to_numpy().reshape(-1, POSTED), _matrix(sketches.to_pylist())

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                here = int((batch.column(0)[k].as_py() + (1 << 31)) >> 32)
                left, right = read(batch.column(1)[k]), read(batch.column(2)[k])
                found = [_passing(left, i, right, here) for i in range(0, len(left[0]), 32)]
                if not batch.column(3)[k].as_py():
                    found += [_passing(right, i, left, here) for i in range(0, len(right[0]), 32)]
                a, b, n = (np.concatenate(x) for x in zip(*found, strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.array(n, pa.int32())], names=["a", "b", "n"])

    return sides.select("key", "left", "right", F.col("i") == F.col("j")).mapInArrow(step, f"a {kind}, b {kind}, n int")


def _passing(left: tuple, at: int, right: tuple, here: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Passing pairs of rows ``at`` to ``at + 32`` of one block with larger nodes of another."""
    nodes, parts, masks, signs, sketches = (x[at : at + 32] for x in left)
    i, j = np.nonzero((nodes[:, None] < right[0]) & (parts[:, None] != right[1]))
    if not len(i):
        return nodes[i], nodes[i], i
    same = np.empty(len(i), np.int64)
    for k in range(0, len(i), 4096):
        same[k : k + 4096] = (sketches[i[k : k + 4096]] == right[4][j[k : k + 4096]]).sum(axis=1)
    passed = same >= LEAST_FINE
    i, j, same = i[passed], j[passed], same[passed]
    # The pair belongs to the first coordinate that both are posted under and have in common.
    shared = (signs[i] == right[3][j]) & ((masks[i] & right[2][j])[:, None] >> np.arange(POSTED) & 1).astype(bool)
    first = shared.argmax(axis=1) == here
    return nodes[i][first], right[0][j][first], same[first]


def inverted_lists(classes: DataFrame) -> DataFrame:
    """(key, node): the lists that each class stays in. ``classes``: node, signs."""
    posted = classes.select("node", F.posexplode("signs").alias("i", "v")).select((F.col("i").cast("long") * (1 << 32) + F.col("v")).alias("key"), "node")
    shared = posted.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1")
    ranked = posted.join(shared, "key").groupBy("node").agg(F.sort_array(F.collect_list(F.struct("n", "key")), asc=False).alias("lists"))
    return ranked.filter(F.size("lists") >= LEAST_POSTED).select("node", F.explode(F.slice("lists", LEAST_POSTED, 2 * POSTED)).alias("list")).select(F.col("list.key").alias("key"), "node").distinct()


def near_classes(docs: DataFrame, percent: int = PERCENT, shingle: int = SHINGLE) -> DataFrame:
    """doc_id, n_shingles, component_id (smallest doc_id reachable over links) and kept, one row per document."""
    with batches_of(docs.sparkSession, TEXT_ROWS):
        signed = cut(signatures(docs, shingle))
    known = signed.filter("n_shingles > 0 and doc_id is not null")
    # One row a shingle set: its smallest document stands for it.
    classes = cut(known.groupBy("h1", "h2").agg(F.min("doc_id").alias("node"), F.min_by("signs", "doc_id").alias("signs")))
    lists = cut(inverted_lists(classes), release=True)
    with batches_of(docs.sparkSession, TEXT_ROWS):
        texts = cut(_sketched(docs.select(F.col("doc_id").alias("node"), "text").join(lists.select("node").distinct(), "node", "left_semi"), shingle), release=True)
    sizes = lists.groupBy("key").agg(F.count("*").alias("n"))
    shares = cut(lists.join(sizes, "key").groupBy("node").agg(F.sum("n").alias("shares")))
    labels = lists.select("node", F.col("node").alias("component")).limit(0)

    def parted() -> DataFrame:
        """(key, node, part) of lists that hold several components."""
        members = lists.join(labels.withColumnRenamed("component", "part"), "node", "left").select("key", "node", F.coalesce("part", "node").alias("part"))
        several = members.groupBy("key").agg(F.min("part").alias("low"), F.max("part").alias("high")).filter("low < high").select("key")
        return cut(members.join(several, "key", "left_semi"))

    def apart(pairs: DataFrame) -> DataFrame:
        """Pairs whose ends are in different components, with these."""
        for side in ("a", "b"):
            pairs = pairs.join(labels.select(F.col("node").alias(side), F.col("component").alias(f"c{side}")), side, "left").withColumn(f"c{side}", F.coalesce(f"c{side}", side))
        return pairs.filter("ca != cb").select("a", "b", "ca", "cb")

    def add(pairs: DataFrame) -> None:
        """Confirm pairs, and join the components that the new links connect."""
        nonlocal labels
        with batches_of(docs.sparkSession, 256):  # two texts a row
            joins = cut(apart(confirmed(pairs, texts, percent, shingle)).select(F.col("ca").alias("a"), F.col("cb").alias("b")).distinct())
        if joins.isEmpty():
            return
        moved = components(joins)
        old = labels.join(moved.select(F.col("node").alias("component"), F.col("component").alias("to")), "component", "left").select("node", F.coalesce("to", "component").alias("component"))
        labels = cut(old.unionByName(moved.join(labels.select("node"), "node", "left_anti").select("node", "component")))

    for turn in range(STAR_ROUNDS):
        # The centre of a list is the member of most shares; from the second round on, of a part that has not been centre.
        members = parted().join(shares, "node")
        order = F.struct(F.col("part") == F.col("node"), "shares", "node") if turn else F.struct(F.lit(True), "shares", "node")
        centre = members.groupBy("key").agg(F.max_by(F.struct("node", "part"), order).alias("c"))
        pairs = members.join(centre, "key").filter("part != c.part").select(F.least("node", "c.node").alias("a"), F.greatest("node", "c.node").alias("b")).distinct()
        add(_alike(pairs, texts))
    between = _between_parts(parted(), classes, texts).distinct()
    with batches_of(docs.sparkSession, 8):  # two blocks a row
        close = cut(between)
    ranked = [F.row_number().over(Window.partitionBy(side).orderBy(F.desc("n"), "a", "b")) for side in ("a", "b")]
    best = [close.withColumn("rank", rank).filter("rank <= 2").select("a", "b") for rank in ranked]
    add(best[0].union(best[1]).distinct())
    add(apart(close).select("a", "b"))
    named = classes.select("h1", "h2", "node").join(labels, "node", "left").select("h1", "h2", F.coalesce("component", "node").alias("root"))
    out = signed.select("doc_id", "n_shingles", "h1", "h2").join(named, ["h1", "h2"], "left")
    root = F.when(F.col("n_shingles") > 0, F.least("root", "doc_id")).otherwise(F.col("doc_id"))
    return out.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), root).alias("component_id")).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def one_of_each(docs: DataFrame, percent: int = PERCENT, shingle: int = SHINGLE) -> DataFrame:
    """``docs`` without the documents that a smaller ``doc_id`` of their class stands for.

    Of rows that share the kept ``doc_id``, the one with the smallest text stays (null first; then by a hash of the row).
    """
    kept = cut(near_classes(docs, percent, shingle).filter("kept and doc_id is not null").groupBy("doc_id").agg(F.count("*").alias("_rows")))
    columns = [F.col(f"`{c}`") for c in docs.columns]
    out = docs.join(kept.filter("_rows = 1"), "doc_id", "left_semi").select(*columns).unionByName(docs.filter("doc_id is null"))
    shared = kept.filter("_rows > 1")
    if shared.isEmpty():
        return out
    order = Window.partitionBy("doc_id").orderBy(F.col("text").asc_nulls_first(), F.xxhash64(*columns))
    several = docs.join(shared, "doc_id", "left_semi").select(*columns, F.row_number().over(order).alias("_place")).filter("_place = 1")
    return out.unionByName(several.drop("_place"))
