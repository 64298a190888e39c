"""Removal of word sequences that an earlier document has, with an FM-index per shard.

1. A window of ``WINDOW`` words has an anchor: its run of ``ANCHOR`` words with the smallest hash. Equal windows have equal
   anchors, so an anchor that one document alone has rules its windows out; the others are the shards' key.
2. The windows of one anchor lie together, as a segment of at most 2 * WINDOW - ANCHOR words. Equal segments of a batch
   of documents are merged, with the smallest ``doc_id``, before they are sent; a shard indexes the segments of its anchors,
   searches every window of them backwards and takes the smallest ``doc_id`` over the interval that matches. A shard is
   closed at a border of anchors once it has ``SHARD_SEGMENTS`` segments.
3. An anchor with more than ``HOT_SEGMENTS`` segments, as a passage of many documents has at its ends, is not sent to a
   shard: its windows are rows of their own, and Spark takes the smallest ``doc_id`` of equal ones with a map-side combine.
4. A window that a smaller ``doc_id`` has is removed: its words go, whatever else covers them.

Every text is sent twice: to meet the anchors that it shares, and, if it has any, to lose its words.

Nulls and edges: a null text has no words. A row without ``doc_id`` stays whole and removes nothing. Rows of one
``doc_id`` do not remove words of each other. Texts of fewer than ``WINDOW`` words stay whole. What is kept is joined by one
space.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flowloom.functions.lineage import cut
from flowloom.llm.columns import add_columns, groups
from flowloom.llm.fm_index import FMIndex, least_in
from flowloom.llm.words import Words, mix, runs, span_sums

WINDOW, ANCHOR = 13, 7
#: An anchor with more segments than this is told apart by window.
HOT_SEGMENTS = 1024
#: Segments, and bytes of their words, of which an index is built at once (a batch and an anchor may come on top).
SHARD_SEGMENTS, SHARD_BYTES = 1 << 16, 1 << 25
_U = np.uint64
_FIELDS = [T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("kept_sha256", T.StringType()), T.StructField("kept", T.StringType())]


def anchors(hashes: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each window that lies in one text: where it starts and where its anchor does."""
    grams = runs(hashes, ANCHOR)
    span = WINDOW - ANCHOR + 1
    count = max(0, len(grams) - span + 1)
    best, at = grams[:count].copy(), np.arange(count)
    for j in range(1, span):
        smaller = grams[j : j + count] < best
        best[smaller] = grams[j : j + count][smaller]
        at[smaller] = np.flatnonzero(smaller) + j
    inside = np.zeros(count, bool)
    for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        inside[a : max(a, b - WINDOW + 1)] = True
    starts = np.flatnonzero(inside)
    return starts, at[starts]


def _name(hashes: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    return mix(span_sums(hashes, None, starts, ends) + (ends - starts).astype(_U))


def _segments_of(words: Words, hashes: np.ndarray) -> tuple[np.ndarray, ...]:
    """Of each segment: first word, end, text, hash of the anchor and hash of the words."""
    starts, at = anchors(hashes, words.first)
    found = np.flatnonzero(np.append(True, at[1:] != at[:-1])[: len(at)])
    lo, hi = starts[found], starts[np.append(found[1:], len(at))[: len(found)] - 1] + WINDOW
    owner = np.searchsorted(words.first, lo, side="right") - 1
    return lo, hi, owner, runs(hashes, ANCHOR)[at[found]], _name(hashes, lo, hi)


def _keys(docs: DataFrame) -> DataFrame:
    """(key, doc_id): the anchor of each distinct segment of a text."""

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, stop in groups(batch.column(1)):
                words = Words(batch.column(1).slice(start, stop - start))
                _, _, owner, grams, names = _segments_of(words, words.hashes())
                order = np.lexsort((names, grams, owner))
                owner, grams, names = owner[order], grams[order], names[order]
                new = np.ones(len(order), bool)
                new[1:] = (owner[1:] != owner[:-1]) | (grams[1:] != grams[:-1]) | (names[1:] != names[:-1])
                rows = pa.array(owner[new] + start)
                yield pa.RecordBatch.from_arrays([pa.array(grams[new].view(np.int64)), batch.column(0).take(rows)], names=["key", "doc_id"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(step, f"key long, doc_id {kind}")


class _Run:
    """Rows of one key that come in several batches; they wait until it is known what they are, ``most`` rows at most once a second document has come."""

    def __init__(self, most: int):
        self.most, self.held, self.rows, self.first, self.several = most, [], 0, None, False

    def add(self, batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        docs = batch.column(1).to_numpy()
        self.first = docs[0] if self.first is None else self.first
        self.several = self.several or bool((docs != self.first).any())
        self.rows += len(docs)
        self.held.append(batch)
        if self.several and self.rows > self.most:
            yield from self.close()

    def close(self) -> Iterator[pa.RecordBatch]:
        held, self.held = self.held, []
        for batch in held if self.several else []:
            yield _marked(batch, np.full(batch.num_rows, self.rows > self.most))


def _marked(batch: pa.RecordBatch, hot: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([*batch.columns, pa.array(hot)], names=["key", "doc_id", "hot"])


def _shared(keys: DataFrame) -> DataFrame:
    """Rows of ``keys`` whose key several documents have, and ``hot``: whether it has more than ``HOT_SEGMENTS`` rows."""
    most = HOT_SEGMENTS

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        run, last_key = _Run(most), None
        for batch in batches:
            if not batch.num_rows:
                continue
            key, doc = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            starts = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
            counts = np.diff(np.append(starts, len(key)))
            if key[0] != last_key:
                yield from run.close()
                run = _Run(most)
            yield from run.add(batch.slice(0, int(counts[0])))
            last_key = key[-1]
            if len(starts) == 1:
                continue
            yield from run.close()
            several = np.minimum.reduceat(doc, starts) != np.maximum.reduceat(doc, starts)
            several[[0, -1]] = False
            keep = np.repeat(several, counts)
            if keep.any():
                yield _marked(batch.filter(pa.array(keep)), np.repeat(counts > most, counts)[keep])
            run = _Run(most)
            yield from run.add(batch.slice(int(starts[-1])))
        yield from run.close()

    n = int(keys.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return keys.repartition(n, "key").sortWithinPartitions("key").mapInArrow(step, T.StructType([*keys.schema.fields, T.StructField("hot", T.BooleanType())]))


def _tags(keys: np.ndarray, rows: np.ndarray) -> np.ndarray:
    return mix(keys ^ mix(rows.astype(_U) + _U(1)))


def _in_lists(lists: pa.Array, grams: np.ndarray, owner: np.ndarray) -> np.ndarray:
    """Whether the text that owns an anchor has it in its list."""
    rows = np.repeat(np.arange(len(lists)), pc.fill_null(pc.list_value_length(lists), 0).to_numpy())
    return np.isin(_tags(grams, owner), _tags(lists.flatten().to_numpy().view(_U), rows))


def _segments(marked: DataFrame, what: str) -> DataFrame:
    """Segments of the ``keys`` of a text and windows of its ``hot_keys``: doc_id, anchor (key) and a hash of the words (name).

    what = "places": both, with text_hash and the first window. what = "words": segments with their words.
    what = "windows": windows alone. In the latter two, equal rows of a batch are one, with the smallest ``doc_id``.
    """

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            docs = batch.column(0).to_numpy()
            out: list[list] = [[], [], [], []]
            texts: list[bytes] = []
            for start, stop in groups(batch.column(2)):
                words = Words(batch.column(2).slice(start, stop - start))
                hashes = words.hashes()
                found = _segments_of(words, hashes)
                parts = []
                if what != "windows":
                    wanted = _in_lists(batch.column(3).slice(start, stop - start), found[3], found[2])
                    parts.append([x[wanted] for x in found])
                if what != "words":
                    wanted = _in_lists(batch.column(4).slice(start, stop - start), found[3], found[2])
                    lo, hi, owner, grams = (x[wanted] for x in found[:4])
                    count = hi - lo - WINDOW + 1
                    first = np.repeat(lo, count) + np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count)
                    parts.append([first, first + WINDOW, np.repeat(owner, count), np.repeat(grams, count), _name(hashes, first, first + WINDOW)])
                lo, hi, owner, grams, names = (np.concatenate(x) for x in zip(*parts, strict=True))
                grams, names, rows = grams.view(np.int64), names.view(np.int64), owner + start
                if what != "places":
                    order = np.lexsort((docs[rows], names, grams))
                    new = np.append(True, (grams[order][1:] != grams[order][:-1]) | (names[order][1:] != names[order][:-1]))[: len(order)]
                    lo, hi, owner, grams, names, rows = (x[order[new]] for x in (lo, hi, owner, grams, names, rows))
                if what == "words":
                    raw = words.data.tobytes()
                    texts += [raw[a:b] for a, b in zip(words.starts[lo].tolist(), words.ends[hi - 1].tolist(), strict=True)]
                for kept, new_part in zip(out, (rows, lo - words.first[owner], grams, names), strict=True):
                    kept.append(new_part)
            rows, at, grams, names = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in out)
            arrays = [batch.column(0).take(pa.array(rows)), pa.array(grams), pa.array(names)]
            if what == "words":
                arrays.append(pa.array(texts, pa.binary()))
            elif what == "places":
                arrays += [batch.column(1).take(pa.array(rows)), pa.array(at, pa.int32())]
            yield pa.RecordBatch.from_arrays(arrays, names=fields)

    kind = marked.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, key long, name long" + {"words": ", words binary", "places": ", text_hash long, at int", "windows": ""}[what]
    fields = [x.split()[0] for x in schema.split(", ")]
    return marked.select("doc_id", "text_hash", "text", "keys", "hot_keys").mapInArrow(step, schema)


def shards(batches: Iterator[pa.RecordBatch], most: int, most_bytes: int) -> Iterator[pa.Table]:
    """Rows that come sorted by key, as tables that end at a border of keys, once they have ``most`` rows or ``most_bytes``."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        if sum(b.num_rows for b in held) < most and sum(b.nbytes for b in held) < most_bytes:
            continue
        table = pa.Table.from_batches(held)
        keys = table.column("key").to_numpy()
        border = int(np.searchsorted(keys, keys[-1]))
        if border:
            yield table.slice(0, border)
            held = table.slice(border).to_batches()
    if held:
        yield pa.Table.from_batches(held)


def _searched(segments: DataFrame) -> DataFrame:
    """(key, name, first): for the windows of each distinct segment, the smallest doc_id that has them."""
    n = int(segments.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    most, most_bytes = SHARD_SEGMENTS, SHARD_BYTES

    def search(table: pa.Table) -> Iterator[pa.RecordBatch]:
        keys, names, docs = (table.column(c).to_numpy() for c in ("key", "name", "doc_id"))
        order = np.lexsort((docs, names, keys))
        new = np.append(True, (keys[order][1:] != keys[order][:-1]) | (names[order][1:] != names[order][:-1]))
        table, docs = table.take(pa.array(order[new])), docs[order[new]]
        words = Words(table.column("words").combine_chunks().cast(pa.string()))
        ids = np.unique(words.hashes(), return_inverse=True)[1]
        counts = np.diff(words.first)
        # Segments one after another, each with a 0 behind.
        line = np.zeros(len(ids) + len(counts), np.int64)
        line[np.arange(len(ids)) + np.repeat(np.arange(len(counts)), counts)] = ids + 1
        windows = counts - WINDOW + 1
        inner = np.arange(int(windows.sum())) - np.repeat(np.cumsum(windows) - windows, windows)
        starts = np.repeat(words.first[:-1] + np.arange(len(counts)), windows) + inner
        index = FMIndex(line)
        of_suffix = np.repeat(docs, counts + 1)[index.suffixes]
        low, high = np.empty(len(starts), np.int64), np.empty(len(starts), np.int64)
        for at in range(0, len(starts), 1 << 16):
            part = slice(at, at + (1 << 16))
            low[part], high[part] = index.intervals(starts[part], WINDOW)
        lists = pa.ListArray.from_arrays(np.append(0, np.cumsum(windows)).astype(np.int32), pa.array(least_in((low, high), of_suffix)))
        out = pa.Table.from_arrays([table.column("key"), table.column("name"), lists], names=["key", "name", "first"])
        yield from out.to_batches(max_chunksize=10_000)

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in shards(batches, most, most_bytes):
            yield from search(table.combine_chunks())

    kind = segments.schema["doc_id"].dataType.simpleString()
    return segments.repartition(n, "key").sortWithinPartitions("key").mapInArrow(step, f"key long, name long, first array<{kind}>")


def _cut_words(texts: pa.Array, starts: pa.Array, keep_text: bool) -> list[pa.Array]:
    rows = []
    for i in range(len(texts)):
        words = Words(texts.slice(i, 1))
        count = len(words.starts)
        covered = np.zeros(count + 1, np.int64)
        gone = starts[i].values
        if gone is not None and len(gone):
            at = np.unique(gone.to_numpy(zero_copy_only=False))
            np.add.at(covered, at, 1)
            np.add.at(covered, at + WINDOW, -1)
        stay = np.cumsum(covered[:-1]) == 0
        raw = words.data.tobytes()
        kept = b" ".join([raw[a:b] for a, b in zip(words.starts[stay].tolist(), words.ends[stay].tolist(), strict=True)])
        rows.append((count, count - int(stay.sum()), hashlib.sha256(kept).hexdigest(), kept.decode() if keep_text else None))
    columns = list(zip(*rows, strict=True)) if rows else [[]] * 4
    return [pa.array(c, k) for c, k in zip(columns, (pa.int64(), pa.int64(), pa.string(), pa.string()), strict=True)]


def remove_repeats(docs: DataFrame, keep_text: bool = True) -> DataFrame:
    """``docs`` with n_words, n_removed, kept_sha256 and kept (null unless ``keep_text``)."""
    added = [f.name for f in _FIELDS]
    others = [c for c in docs.columns if c not in ("doc_id", "text", *added)]
    # Other columns travel in one, so their names cannot meet those in use here.
    named = docs.select("doc_id", "text", F.struct(*[F.col(f"`{c}`") for c in others] or [F.lit(0).alias("none")]).alias("others"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("text_hash"))
    hits = _shared(_keys(named.filter("doc_id is not null"))).groupBy("doc_id").agg(F.collect_set(F.when(~F.col("hot"), F.col("key"))).alias("keys"), F.collect_set(F.when(F.col("hot"), F.col("key"))).alias("hot_keys"))
    marked = named.join(hits, "doc_id", "left")

    def whole(batch: pa.RecordBatch) -> list[pa.Array]:
        names = batch.schema.names
        texts = batch.column(names.index("text"))
        none = pa.nulls(len(texts), pa.list_(pa.int64()))
        out = _cut_words(texts, none, keep_text)
        return out

    first = add_columns(marked, whole, _FIELDS)
    if not keep_text:
        # A text without shared anchors is finished here and need not be sent again.
        first = first.withColumn("text", F.when(F.col("keys").isNotNull(), F.col("text")))
    first = cut(first, release=True)
    open_ = first.filter("keys is not null")
    searched = _searched(_segments(open_.filter(F.size("keys") > 0), "words"))
    windows = _segments(open_.filter(F.size("hot_keys") > 0), "windows").groupBy("key", "name").agg(F.array(F.min("doc_id")).alias("first"))
    found = _segments(open_, "places").join(searched.unionByName(windows), ["key", "name"])
    late = F.filter(F.transform("first", lambda f, i: F.when(f < F.col("doc_id"), F.col("at") + i)), lambda x: x.isNotNull())
    gone = found.select("doc_id", "text_hash", late.alias("gone")).filter(F.size("gone") > 0)
    gone = cut(gone.groupBy("doc_id", "text_hash").agg(F.flatten(F.collect_list("gone")).alias("gone")), release=True)
    joined = first.join(gone, ["doc_id", "text_hash"], "left")

    def rest(batch: pa.RecordBatch) -> list[pa.Array]:
        names = batch.schema.names
        out = [batch.column(names.index("_" + f.name)) for f in _FIELDS]
        gone_at = batch.column(names.index("gone"))
        rows = np.flatnonzero(gone_at.is_valid().to_numpy(zero_copy_only=False))
        if not len(rows):
            return out
        picked = pa.array(rows)
        new = _cut_words(batch.column(names.index("text")).take(picked), gone_at.take(picked), keep_text)
        where = pa.array(np.isin(np.arange(batch.num_rows), rows))
        return [pc.replace_with_mask(o, where, n) for o, n in zip(out, new, strict=True)]

    out = add_columns(joined.withColumnsRenamed({f.name: "_" + f.name for f in _FIELDS}), rest, _FIELDS)
    names = {c: F.col(f"others.`{c}`").alias(c) for c in others} | {c: F.col(c) for c in ("doc_id", "text")}
    return out.select(*[names[c] for c in docs.columns if c in names], *added)
