"""Periodic view of flows that are still active, and totals so far with latency percentiles, as batch tables."""

from __future__ import annotations

import math
from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flowloom.functions.lineage import cut
from flowloom.operators.chunked import per_key
from flowloom.operators.flows import DEFAULT_TIMEOUT_US, FLOW_KEY, _atoms, _segments, _stitch, with_flow_key

TICK_US = 5_000_000
MIN_PACKETS = 5


def active_snapshots(
    packets: DataFrame, tick_us: int = TICK_US, timeout_us: int = DEFAULT_TIMEOUT_US, min_packets: int = MIN_PACKETS,
    preaggregate: bool = False,
) -> DataFrame:
    """At every tick: totals so far of each flow that has not timed out and has enough packets.

    Tick ``k`` sees packets before ``k * tick_us``. Slices of one tick are added up along the
    flow and each running total is repeated until the next slice or the time-out. Packets with
    one time stamp are summed first when a tick of one 5-tuple is crowded (``preaggregate``).
    """
    stitched = _stitch(_segments(_atoms(with_flow_key(packets), tick_us, preaggregate)), timeout_us)
    order = Window.partitionBy(*FLOW_KEY, "session").orderBy("slice")
    upto = order.rowsBetween(Window.unboundedPreceding, 0)
    so_far = stitched.select(
        *FLOW_KEY, "session", "slice",
        F.sum(F.col("fwd_n") + F.col("bwd_n")).over(upto).alias("total_packets"),
        F.sum(F.col("fwd_bytes") + F.col("bwd_bytes")).over(upto).alias("total_bytes"),
        F.min("first_us").over(upto).alias("start_us"),
        F.max("last_us").over(upto).alias("last_us"),
        F.lead("slice").over(order).alias("_next"),
    )
    expiry = F.floor((F.col("last_us") + F.lit(timeout_us)) / F.lit(tick_us))
    end = F.coalesce("_next", expiry)
    return (
        so_far.where((F.col("total_packets") >= min_packets) & (end >= F.col("slice") + 1))
        .select(*FLOW_KEY, "session", "total_packets", "total_bytes", "start_us", "last_us",
                F.explode(F.sequence(F.col("slice") + 1, end)).alias("tick"))
    )


#: Ratio of the borders of a latency class; a percentile is off by half of its last digit at most.
LATENCY_RATIO = 1.01
#: Class of latencies that are not above zero.
ZERO_CLASS = -(1 << 30)
#: Windows that one task adds up.
WINDOWS = 4096


def latency_class(latency: Column) -> Column:
    """Number of the class that a latency falls into: borders are powers of ``LATENCY_RATIO``. Counts per class merge by addition."""
    x = latency.cast("double")
    return F.when(x > 0, F.ceil(F.log(x) / F.lit(math.log(LATENCY_RATIO))).cast("int")).when(x <= 0, F.lit(ZERO_CLASS))


def class_quantiles(seen: dict[int, int], probs: Sequence[float]) -> list[float | None]:
    """Middle of the class in which each rank lies."""
    order, total = sorted(seen.items()), sum(seen.values())
    out = []
    for p in probs:
        rank, upto, value = p * (total - 1), 0, None
        for k, n in order:
            upto += n
            if value is None and upto > rank:
                value = 0.0 if k == ZERO_CLASS else LATENCY_RATIO ** (k - 0.5)
        out.append(value)
    return out


def running_windows(per: DataFrame, keys: Sequence[str], counts: Sequence[str], classes: bool) -> DataFrame:
    """After each window of ``per``: its counts (``new_...``), the totals so far and the percentiles of all latencies so far.

    ``per`` has rows per window (and latency ``class``, with ``timed`` latencies). Stretches of ``WINDOWS`` windows run side by
    side; what lies before a stretch comes from the sums of the stretches before it.
    """
    if not keys:
        return running_windows(per.withColumn("_all", F.lit(0)), ["_all"], counts, classes).drop("_all")
    keys, counts = list(keys), list(counts)
    start = F.unix_micros("window.start")
    part = F.floor(start / ((F.unix_micros("window.end") - start) * WINDOWS)).alias("_part")
    kind = [F.col("class"), F.col("timed")] if classes else [F.lit(None).cast("int").alias("class"), F.lit(0).cast("long").alias("timed")]
    rows = cut(per.select(*keys, part, "window", *counts, *kind))
    by_key = Window.partitionBy(*keys).orderBy("_part")
    before = by_key.rowsBetween(Window.unboundedPreceding, -1)
    parts = cut(rows.groupBy(*keys, "_part").agg(*[F.sum(c).alias(c) for c in counts]))
    totals = parts.select(*keys, "_part", *[F.coalesce(F.sum(c).over(before), F.lit(0)).alias(c) for c in counts], F.lit(None).cast("int").alias("class"), F.lit(0).cast("long").alias("timed"))
    # Counts of a class so far hold from the stretch behind its own up to the next one that has it.
    per_class = Window.partitionBy(*keys, "class").orderBy("_part")
    found = rows.where("class is not null").groupBy(*keys, "_part", "class").agg(F.sum("timed").alias("timed"))
    last = parts.groupBy(*[F.col(k).alias(f"_{k}") for k in keys]).agg(F.max("_part").alias("_last"))
    on = F.lit(True)
    for k in keys:
        on = on & F.col(k).eqNullSafe(F.col(f"_{k}"))
    upto = found.select(*keys, "_part", "class", F.sum("timed").over(per_class).alias("timed"), F.lead("_part").over(per_class).alias("_next")).join(last, on)
    ends = F.coalesce("_next", "_last")
    held = upto.where(ends > F.col("_part")).select(*keys, F.explode(F.sequence(F.col("_part") + 1, ends)).alias("_part"), *[F.lit(0).cast("long").alias(c) for c in counts], "class", "timed")
    given = totals.unionByName(held).withColumns({"window": F.lit(None).cast(rows.schema["window"].dataType), "given": F.lit(True)})
    both = rows.withColumn("given", F.lit(False)).unionByName(given)
    both = both.select(*keys, "_part", "given", "window", *counts, "class", "timed")

    class Adding:
        def __init__(self):
            self.totals, self.seen, self.window, self.own, self.out = dict.fromkeys(counts, 0), {}, None, None, []

        def feed(self, batch: pa.RecordBatch) -> list[pa.Array] | None:
            columns = [c.to_pylist() for c in batch.columns]
            for given, window, *numbers, kind, timed in zip(*columns, strict=True):
                if not given and window != self.window:
                    self.flush()
                    self.window, self.own = window, dict.fromkeys(counts, 0)
                for c, v in zip(counts, numbers, strict=True):
                    self.totals[c] += v
                    if not given:
                        self.own[c] += v
                if kind is not None:
                    self.seen[kind] = self.seen.get(kind, 0) + timed
            return self.take()

        def flush(self) -> None:
            if self.window is not None:
                more = class_quantiles(self.seen, (0.5, 0.95, 0.99)) if classes else []
                self.out.append((self.window, *self.own.values(), *self.totals.values(), *more))

        def take(self) -> list[pa.Array] | None:
            out, self.out = self.out, []
            return [pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)] if out else None

        def close(self) -> list[pa.Array] | None:
            self.flush()
            return self.take()

    time = pa.timestamp("us", tz="UTC")
    kinds = [pa.struct([("start", time), ("end", time)])] + [pa.int64()] * (2 * len(counts)) + [pa.float64()] * 3 * classes
    fields = [rows.schema["window"], *[T.StructField(c, T.LongType()) for c in (*[f"new_{c}" for c in counts], *counts)]]
    fields += [T.StructField(c, T.DoubleType()) for c in ("p50_ms", "p95_ms", "p99_ms")] * classes
    out = per_key(both, [*keys, "_part"], [F.desc("given"), "window"], Adding, T.StructType(fields))
    return out.drop("_part")
