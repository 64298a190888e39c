"""Sequential rules over the events of a key, cut into chunks of time that run in parallel.

``cooldown``   which events fire when none may fire within a pause after the last one that did
``handed_on``  which events a sliding limit lets through

What a chunk does depends on the chunk before, but not on more than a state. For the cooldown a chunk is one pause long, so at
most one event fires in it, and the state is the time of that event. A node of ``FAN`` chunks is the function from the state
before it to the state behind it, as a table of the few states that can occur; nodes are composed upwards, and the states
are handed down again. For the limit there are too many states for a table: every chunk first guesses its state by running from
the chunk before; chunks whose guess proves wrong run again from the state that is handed on, in nodes of doubled length, until
all states fit. Nothing else passes between tasks, and no task holds more than one node's events at a time, as a stream.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flowloom.functions.lineage import cut

FAN = 16
#: State before a node: nothing that could still matter has fired.
NONE = -(1 << 62)


def same_keys(left: str, right: str, keys: Sequence[str]) -> Column:
    """Equality of key columns in which nulls are equal."""
    on = F.lit(True)
    for k in keys:
        on = on & F.col(f"{left}.{k}").eqNullSafe(F.col(f"{right}.{k}"))
    return on


def per_key(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str], machine: Callable, schema: T.StructType) -> DataFrame:
    """Stream each key's rows in ``order`` through an object of its own.

    ``machine()`` gives an object with ``feed(batch)`` and ``close()``, both of which return columns or None. The rows that come out
    are the keys and these columns. Spark marks the first row of a key, so null keys and keys of any type stay apart.
    """
    first = F.row_number().over(Window.partitionBy(*keys).orderBy(*order)) == 1
    rest = [c for c in df.columns if c not in keys]
    marked = df.select(first.alias("_first"), *keys, *rest)
    names = [*keys, *schema.names]
    out_schema = T.StructType([*(df.schema[k] for k in keys), *schema.fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, head = None, None

        def out(columns: list[pa.Array] | None) -> Iterator[pa.RecordBatch]:
            if columns is not None and len(columns[0]):
                copies = pa.array(np.zeros(len(columns[0]), np.int64))
                yield pa.RecordBatch.from_arrays([h.take(copies) for h in head] + list(columns), names=names)

        for batch in batches:
            if not batch.num_rows:
                continue
            new = np.flatnonzero(batch.column(0).to_numpy(zero_copy_only=False))
            starts = new if len(new) and new[0] == 0 else np.append(0, new)
            for a, z in zip(starts, [*starts[1:], batch.num_rows], strict=True):
                rows = batch.slice(a, z - a)
                if batch.column(0)[int(a)].as_py():
                    if current is not None:
                        yield from out(current.close())
                    current, head = machine(), [rows.column(1 + k).slice(0, 1) for k in range(len(keys))]
                yield from out(current.feed(rows.select(rest)))
        if current is not None:
            yield from out(current.close())

    return marked.mapInArrow(run, out_schema)


def _part(column: str, length: int) -> Column:
    """Number of the part of ``length`` that a whole number lies in."""
    return F.expr(f"({column} - pmod({column}, {length})) div {length}")


def _longs(*columns: np.ndarray | list) -> list[pa.Array]:
    return [pa.array(np.asarray(c, np.int64)) for c in columns]


class _Chunks:
    """Times of a stream, given out chunk by chunk."""

    def __init__(self, length: int):
        self.length, self.held = length, []

    def add(self, times: np.ndarray) -> Iterator[np.ndarray]:
        while len(times):
            chunk = times[0] // self.length
            if self.held and self.held[0][0] // self.length != chunk:
                yield self.rest()
            stop = int(np.searchsorted(times, (chunk + 1) * self.length))
            self.held.append(times[:stop])
            times = times[stop:]

    def rest(self) -> np.ndarray:
        whole, self.held = np.concatenate(self.held) if self.held else np.zeros(0, np.int64), []
        return whole


def cooldown(times: DataFrame, pause: int, keys: Sequence[str] = (), fan: int = FAN) -> DataFrame:
    """keys and ts_us of the times that fire: the first of a key, and each first that is more than ``pause`` after the last one.

    ``times`` holds each time of a key once.
    """
    length = pause + 1  # a time that fires and the next one are never in one chunk
    span = length * fan
    node = _part("ts_us", span)
    rows = cut(times.select(*keys, "ts_us", node.alias("node")))
    low, high = rows.agg(F.min("node"), F.max("node")).first()
    if low is None:
        return rows.select(*keys, "ts_us")
    keys = list(keys)

    class Table:
        """State behind a node for every state before it."""

        def __init__(self):
            self.chunks, self.before, self.state, self.at, self.end = _Chunks(length), [np.array([NONE])], None, None, 0

        def feed(self, batch: pa.RecordBatch) -> None:
            ts, lent = batch.column(0).to_numpy(), batch.column(1).to_numpy(zero_copy_only=False)
            self.end = int(batch.column(2)[0].as_py())
            if self.state is None:  # lent rows come first
                self.before.append(ts[lent])
            for own in self.chunks.add(ts[~lent]):
                self.step(own)

        def step(self, own: np.ndarray) -> None:
            if self.state is None:
                self.before = np.concatenate(self.before)
                self.state, self.at = self.before, np.arange(len(self.before))
            i = np.searchsorted(own, self.state + length)
            moved = np.where(i < len(own), own[np.minimum(i, len(own) - 1)], self.state)
            self.state, where = np.unique(moved, return_inverse=True)
            self.at = where[self.at]

        def close(self) -> list[pa.Array] | None:
            own = self.chunks.rest()
            if len(own):
                self.step(own)
            if self.state is None:
                return None  # only lent rows: nothing happens here
            behind = np.where(self.state >= (self.end + 1) * span - length, self.state, NONE)
            return _longs(self.before, behind[self.at])

    class Composed:
        """Composition of the tables of a node's children."""

        def __init__(self):
            self.child, self.held, self.before, self.state = None, [], None, None

        def feed(self, batch: pa.RecordBatch) -> None:
            child, before, behind = (c.to_numpy() for c in batch.columns)
            starts = np.flatnonzero(np.append(True, child[1:] != child[:-1]))
            for a, z in zip(starts, np.append(starts[1:], len(child)), strict=True):
                if self.child is not None and child[a] != self.child:
                    self.step()
                self.child = int(child[a])
                self.held.append((before[a:z], behind[a:z]))

        def step(self) -> None:
            before, behind = (np.concatenate(x) for x in zip(*self.held, strict=True))
            self.held = []
            if self.before is None:
                self.before = before if self.child % fan == 0 else np.array([NONE])
                self.state, self.last = self.before, self.child - 1
            state = self.state if self.child == self.last + 1 else np.full(len(self.state), NONE)
            i = np.minimum(np.searchsorted(before, state), len(before) - 1)
            self.state, self.last = np.where(before[i] == state, behind[i], behind[0]), self.child

        def close(self) -> list[pa.Array]:
            self.step()
            # A child that is missing at the end leaves nothing behind.
            full = self.last % fan == fan - 1
            return _longs(self.before, self.state if full else np.full(len(self.state), NONE))

    class Handed:
        """The state before each child, from the state before the node."""

        def __init__(self):
            self.child, self.held, self.state, self.last, self.out = None, [], NONE, None, []

        def feed(self, batch: pa.RecordBatch) -> None:
            child, before, behind = (c.to_numpy(zero_copy_only=False) for c in batch.columns)
            starts = np.flatnonzero(np.append(True, child[1:] != child[:-1]))
            for a, z in zip(starts, np.append(starts[1:], len(child)), strict=True):
                if self.child is not None and child[a] != self.child:
                    self.step()
                self.child = int(child[a])
                self.held.append((before[a:z], behind[a:z]))

        def step(self) -> None:
            before, behind = (np.concatenate(x) for x in zip(*self.held, strict=True))
            self.held = []
            if self.child < 0:  # the node's own state
                self.state, self.last = int(before[0]), None
                return
            if self.last is not None and self.child != self.last + 1 or self.last is None and self.child % fan:
                self.state = NONE
            self.out.append((self.child, self.state))
            i = min(int(np.searchsorted(before, self.state)), len(before) - 1)
            self.state, self.last = int(behind[i] if before[i] == self.state else behind[0]), self.child

        def close(self) -> list[pa.Array]:
            self.step()
            return _longs(*zip(*self.out, strict=True)) if self.out else None

    class Fired:
        """The times of a node that fire, from the state before it."""

        def __init__(self):
            self.chunks, self.state, self.out = _Chunks(length), NONE, []

        def feed(self, batch: pa.RecordBatch) -> list[pa.Array] | None:
            ts, given = batch.column(0).to_numpy(), batch.column(1).to_numpy(zero_copy_only=False)
            for state in ts[given]:
                self.state = int(state)
            for own in self.chunks.add(ts[~given]):
                self.step(own)
            return self.flush()

        def step(self, own: np.ndarray) -> None:
            i = int(np.searchsorted(own, self.state + length))
            if i < len(own):
                self.state = int(own[i])
                self.out.append(self.state)

        def flush(self) -> list[pa.Array]:
            out, self.out = self.out, []
            return _longs(out)

        def close(self) -> list[pa.Array]:
            own = self.chunks.rest()
            if len(own):
                self.step(own)
            return self.flush()

    rows = rows.withColumn("node", F.col("node") - low)
    base = low * span

    def shifted(c: str) -> Column:
        return F.col(c) - F.lit(base)  # chunks then begin at zero

    rows = rows.withColumn("ts_us", shifted("ts_us"))
    two = T.StructType([T.StructField(n, T.LongType()) for n in ("before", "behind")])
    given = rows.select(*keys, "node", F.lit(None).cast("long").alias("ts_us")).limit(0)
    if high > low:
        last_chunk = F.col("ts_us") >= (F.col("node") + 1) * span - length
        lent = rows.where(last_chunk).select(*keys, (F.col("node") + 1).alias("node"), "ts_us", F.lit(True).alias("lent"), (F.col("node") + 1).alias("end"))
        both = rows.select(*keys, "node", "ts_us", F.lit(False).alias("lent"), F.col("node").alias("end")).unionByName(lent)
        tables = [cut(per_key(both, [*keys, "node"], ["ts_us"], Table, two))]
        top = high - low
        while (top := top // fan) > 0:
            up = tables[-1].select(*keys, F.floor(F.col("node") / fan).alias("parent"), F.col("node").alias("child"), "before", "behind")
            tables.append(cut(per_key(up, [*keys, "parent"], ["child", "before"], Composed, two).withColumnRenamed("parent", "node")))
        # Above the last level every key has one node at most, before which nothing has fired.
        handed = tables[-1].select(*keys, F.lit(0).cast("long").alias("parent")).distinct().withColumn("state", F.lit(NONE).cast("long"))
        for level in reversed(tables):
            down = level.select(*keys, F.floor(F.col("node") / fan).alias("parent"), F.col("node").alias("child"), "before", "behind")
            known = handed.select(*keys, "parent", F.lit(-1).cast("long").alias("child"), F.col("state").alias("before"), F.lit(NONE).cast("long").alias("behind"))
            states = T.StructType([T.StructField(n, T.LongType()) for n in ("child", "state")])
            found = per_key(down.unionByName(known), [*keys, "parent"], ["child", "before"], Handed, states)
            handed = cut(found.select(*keys, F.col("child").alias("parent"), "state"))
        given = handed.where(F.col("state") > NONE).select(*keys, F.col("parent").alias("node"), F.col("state").alias("ts_us"))
    marked = rows.select(*keys, "node", "ts_us", F.lit(False).alias("given")).unionByName(given.withColumn("given", F.lit(True)))
    fired = per_key(marked, [*keys, "node"], [F.desc("given"), "ts_us"], Fired, T.StructType([T.StructField("ts_us", T.LongType())]))
    return fired.select(*keys, (F.col("ts_us") + F.lit(base)).alias("ts_us"))


def admission(times: np.ndarray, passed: deque | None, keep: np.ndarray, most: int, window: int) -> deque:
    """Mark the times that a sliding limit lets through; ``passed`` holds the last admitted ones."""
    passed = deque(maxlen=most) if passed is None else passed
    i = 0
    while i < len(times):
        if len(passed) == most and passed[0] >= times[i] - window:
            i = int(np.searchsorted(times, passed[0] + window, side="right"))
            continue
        passed.append(int(times[i]))
        keep[i] = True
        i += 1
    return passed


def handed_on(events: DataFrame, most: int, window: int, order: Sequence[str], keys: Sequence[str] = (), chunk: int | None = None) -> DataFrame:
    """Events that find fewer than ``most`` admitted ones in ``[ts_us - window, ts_us]``.

    ``chunk``: length of a chunk of time, at least one window and one more.
    """
    keys = list(keys)
    length = max(window + 1, 16 * (window + 1) if chunk is None else chunk)
    # Of the events of one time only the first few can pass; ranks are limited before the shuffle.
    rank = F.row_number().over(Window.partitionBy(*keys, "ts_us").orderBy(*order))
    names = events.columns
    events = events.withColumn("_rank", rank).where(F.col("_rank") <= most).drop("_rank")
    events = cut(events.withColumn("_chunk", _part("ts_us", length)))
    times = events.select(*keys, "_chunk", "ts_us")

    def run(rows: DataFrame, states: DataFrame | None, shift: int) -> DataFrame:
        """keys, _chunk, entry and exit of every chunk in nodes of 2 ** shift chunks; warm-up rows have no entry of their own."""

        class Walk:
            def __init__(self):
                self.passed, self.chunk, self.entry, self.out = deque(maxlen=most), None, [], []

            def feed(self, batch: pa.RecordBatch) -> list[pa.Array] | None:
                chunk, ts, warm = (c.to_numpy(zero_copy_only=False) for c in batch.columns[:3])
                given = batch.column(3)
                starts = np.flatnonzero(np.append(True, (chunk[1:] != chunk[:-1]) | (warm[1:] != warm[:-1])))
                for a, z in zip(starts, np.append(starts[1:], len(ts)), strict=True):
                    if given[int(a)].is_valid:  # the state before this node
                        self.passed, a = deque(given[int(a)].as_py(), maxlen=most), a + 1
                        if a == z:
                            continue
                    if chunk[a] != self.chunk:
                        self.flush()
                        self.chunk, self.warm = int(chunk[a]), bool(warm[a])
                        self.entry = self.state(self.chunk)
                    own = ts[a:z]
                    admission(own, self.passed, np.zeros(len(own), bool), most, window)
                return self.take()

            def state(self, chunk: int) -> list[int]:
                return [t for t in self.passed if t >= chunk * length - window]

            def flush(self) -> None:
                if self.chunk is not None and not self.warm:
                    self.out.append((self.chunk, self.entry, self.state(self.chunk + 1)))

            def take(self) -> list[pa.Array] | None:
                out, self.out = self.out, []
                if not out:
                    return None
                lists = pa.list_(pa.int64())
                return [pa.array([r[0] for r in out], pa.int64()), pa.array([r[1] for r in out], lists), pa.array([r[2] for r in out], lists)]

            def close(self) -> list[pa.Array] | None:
                self.flush()
                return self.take()

        none = F.lit(None).cast("array<long>")
        node = F.shiftright("_chunk", shift)
        marked = rows.select(*keys, node.alias("_node"), "_chunk", "ts_us", F.lit(False).alias("warm"), none.alias("given"))
        if states is None:
            marked = marked.unionByName(rows.select(*keys, (F.col("_chunk") + 1).alias("_node"), "_chunk", "ts_us", F.lit(True).alias("warm"), none.alias("given")))
        else:
            marked = marked.unionByName(states.select(*keys, "_node", "_chunk", F.lit(NONE).alias("ts_us"), F.lit(False).alias("warm"), "given"))
        lists = T.ArrayType(T.LongType())
        schema = T.StructType([T.StructField("_at", T.LongType()), T.StructField("entry", lists), T.StructField("exit", lists)])
        return per_key(marked, [*keys, "_node"], ["_chunk", "ts_us"], Walk, schema).select(*keys, F.col("_at").alias("_chunk"), "entry", "exit")

    known = cut(run(times, None, 0))
    shift = 0
    while True:
        # Chunks whose state differs from what the chunk before has handed on; behind a pause that is nothing.
        ahead = known.select(*keys, (F.col("_chunk") + 1).alias("_chunk"), F.col("exit").alias("given"))
        on = (F.col("k._chunk") == F.col("a._chunk")) & same_keys("k", "a", keys)
        given = known.alias("k").join(ahead.alias("a"), on, "left").select("k.*", F.coalesce("a.given", F.array().cast("array<long>")).alias("given"))
        given = cut(given)
        wrong = given.where(F.col("entry") != F.col("given"))
        if wrong.isEmpty():
            break
        shift += 1
        nodes = cut(wrong.select(*keys, F.shiftright("_chunk", shift).alias("_node")).distinct())
        on = (F.shiftright("r._chunk", shift) == F.col("n._node")) & same_keys("r", "n", keys)
        again = times.alias("r").join(nodes.alias("n"), on, "left_semi")
        kept = given.alias("r").join(nodes.alias("n"), on, "left_anti").select(*keys, "_chunk", "entry", "exit")
        inside = given.alias("r").join(nodes.alias("n"), on, "left_semi")
        # The state before a node is that before its first chunk with events.
        first = inside.groupBy(*keys, F.shiftright("_chunk", shift).alias("_node")).agg(F.min_by("given", "_chunk").alias("given"), F.min("_chunk").alias("_chunk"))
        known = cut(kept.unionByName(run(again, first, shift)))

    class Mark:
        def __init__(self):
            self.passed = None

        def feed(self, batch: pa.RecordBatch) -> list[pa.Array] | None:
            if self.passed is None:  # the first row of a chunk is its state
                self.passed, batch = deque(batch.column(batch.num_columns - 1)[0].as_py(), maxlen=most), batch.slice(1)
            keep = np.zeros(batch.num_rows, bool)
            admission(batch.column(batch.schema.names.index("ts_us")).to_numpy(), self.passed, keep, most, window)
            return batch.filter(pa.array(keep)).columns[:-1]

        def close(self) -> None:
            return None

    states = given.select(*keys, "_chunk", F.col("entry").alias("_given"))
    rows = events.unionByName(states, allowMissingColumns=True)
    rest = [c for c in names if c not in keys]
    schema = T.StructType([T.StructField(c, events.schema[c].dataType) for c in rest])
    rows = rows.select(*keys, "_chunk", *rest, "_given")
    return per_key(rows, [*keys, "_chunk"], [F.col("_given").isNull(), "ts_us", *order], Mark, schema).select(*names)
