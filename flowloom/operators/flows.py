"""Packets to bidirectional flows.

A flow is a run of packets with one canonical 5-tuple in which no silence lasts longer than the
time-out. One 5-tuple may own a large share of all packets, so nothing is ever windowed over a
whole 5-tuple at packet level:

1. packets are cut into short time *slices* per 5-tuple. A slice is never longer than the
   time-out, hence a slice lies inside one flow and ordinary sums describe it. Only the
   inter-arrival gaps need order, and they are taken inside a slice.
2. slice rows (a few numbers each) are stitched: the gap across a slice border comes from the
   last time stamp before it, and a silence longer than the time-out starts a new flow.

All times are integer microseconds and all moments are exact integers, so the result does not
depend on partitioning or on the order in which partial sums meet.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

FLOW_KEY = ("src_ip", "src_port", "dst_ip", "dst_port", "protocol")
DEFAULT_TIMEOUT_US = 120_000_000
SHORT_SLICE_US = 10_000_000
# The square of a gap up to this length fits a long.
LONG_GAP_US = 2_000_000_000

# TCP flag bits.
TCP_FLAGS = {
    "FIN": 0x01,
    "SYN": 0x02,
    "RST": 0x04,
    "PSH": 0x08,
    "ACK": 0x10,
    "URG": 0x20,
    "ECE": 0x40,
    "CWR": 0x80,
}

_SUMS = ("n", "bytes", "payload", "len_sq", "psh", "urg")
_DIRS = ("fwd", "bwd")
_FLAG_NAMES = tuple(f.lower() for f in TCP_FLAGS)


def flag(name: str, mask: Column | str = "flags") -> Column:
    """Is one TCP flag set in the bit mask?"""
    col = F.col(mask) if isinstance(mask, str) else mask
    return col.bitwiseAND(F.lit(TCP_FLAGS[name])) != 0


def with_tcp_flags(packets: DataFrame, mask: str = "flags") -> DataFrame:
    """Add one boolean column per TCP flag."""
    return packets.select("*", *[flag(f, mask).alias(f.lower()) for f in TCP_FLAGS])


def with_flow_key(packets: DataFrame) -> DataFrame:
    """Replace the endpoints by the canonical pair and add ``is_fwd``.

    Endpoints compare as (address text, port number). A packet is forward when its source is the
    smaller endpoint; equal endpoints count as backward.
    """
    src = F.struct("src_ip", "src_port")
    dst = F.struct("dst_ip", "dst_port")
    fwd = src < dst
    return packets.select(
        *[c for c in packets.columns if c not in FLOW_KEY],
        F.when(fwd, F.col("src_ip")).otherwise(F.col("dst_ip")).alias("src_ip"),
        F.when(fwd, F.col("src_port")).otherwise(F.col("dst_port")).alias("src_port"),
        F.when(fwd, F.col("dst_ip")).otherwise(F.col("src_ip")).alias("dst_ip"),
        F.when(fwd, F.col("dst_port")).otherwise(F.col("src_port")).alias("dst_port"),
        "protocol",
        fwd.alias("is_fwd"),
    )


def _slice(slice_us: int) -> Column:
    return F.floor(F.col("ts_us") / F.lit(slice_us))


def _atoms(keyed: DataFrame, slice_us: int, preaggregate: bool) -> DataFrame:
    """Rows with the additive measures of one packet, or of all packets with one time stamp."""
    length = F.col("length").cast("long")
    payload = F.col("payload_length").cast("long")
    one = F.lit(1).cast("long")
    base = keyed.select(
        *FLOW_KEY,
        _slice(slice_us).alias("slice"),
        "is_fwd",
        "ts_us",
        one.alias("n"),
        length.alias("bytes"),
        payload.alias("payload"),
        (length * length).alias("len_sq"),
        length.alias("len_min"),
        length.alias("len_max"),
        *[flag(f).cast("long").alias(f.lower()) for f in TCP_FLAGS],
    )
    if not preaggregate:
        return base
    sums = ("n", "bytes", "payload", "len_sq", *_FLAG_NAMES)
    return base.groupBy(*FLOW_KEY, "slice", "is_fwd", "ts_us").agg(
        *[F.sum(c).alias(c) for c in sums],
        F.min("len_min").alias("len_min"),
        F.max("len_max").alias("len_max"),
    )


def with_interarrival(packets: DataFrame, slice_us: int = SHORT_SLICE_US,
                      timeout_us: int = DEFAULT_TIMEOUT_US) -> DataFrame:
    """Packets with ``session`` number and ``iat_us`` to the previous packet of its direction.

    The first packet of a direction in a flow has a null gap. Packets are sent once, by (5-tuple, slice); gaps are taken
    inside the slice, and the first packet of a direction looks up the last one of the slices before in a small table of
    slice borders. The 5-tuple is one struct column, in which null equals null.
    """
    keyed = with_flow_key(packets)
    rows = keyed.select("*", F.struct(*FLOW_KEY).alias("_key"), _slice(slice_us).alias("slice")).repartition("_key", "slice")
    ends = [F.min("ts_us").alias("first_us"), F.max("ts_us").alias("last_us")]
    for d in _DIRS:
        own = F.when(F.col("is_fwd") if d == "fwd" else ~F.col("is_fwd"), F.col("ts_us"))
        ends += [F.min(own).alias(f"{d}_first"), F.max(own).alias(f"{d}_last")]
    border = _stitch(rows.groupBy("_key", "slice").agg(*ends), timeout_us, ("_key",)).select("_key", "slice", "session", "fwd_prev", "bwd_prev")
    within = Window.partitionBy("_key", "slice").orderBy("is_fwd", "ts_us", "packet_id")
    local = F.when(F.lag("is_fwd").over(within) == F.col("is_fwd"), F.lag("ts_us").over(within))
    prev = F.coalesce("_local", F.when(F.col("is_fwd"), F.col("fwd_prev")).otherwise(F.col("bwd_prev")))
    placed = rows.withColumn("_local", local).join(border, ["_key", "slice"])
    return placed.select(*keyed.columns, "session", (F.col("ts_us") - prev).alias("iat_us"))


def _segments(atoms: DataFrame) -> DataFrame:
    """One row per (5-tuple, slice); the only packet-level shuffle."""
    order = Window.partitionBy(*FLOW_KEY, "slice").orderBy("is_fwd", "ts_us")
    gap = F.when(
        F.lag("is_fwd").over(order) == F.col("is_fwd"), F.col("ts_us") - F.lag("ts_us").over(order)
    )
    rows = atoms.withColumn("gap", gap)
    # Packets sharing a time stamp within one row are zero microseconds apart.
    zero = F.lit(0).cast("long")
    low_gap = F.when(F.col("n") > 1, zero).otherwise(F.col("gap"))
    high_gap = F.when(F.col("n") > 1, F.coalesce(F.col("gap"), zero)).otherwise(F.col("gap"))
    aggs = [F.min("ts_us").alias("first_us"), F.max("ts_us").alias("last_us")]
    for d in _DIRS:
        own = F.col("is_fwd") if d == "fwd" else ~F.col("is_fwd")

        def of(c, own=own):
            return F.when(own, c if isinstance(c, Column) else F.col(c))

        aggs += [F.coalesce(F.sum(of(c)), F.lit(0)).alias(f"{d}_{c}") for c in _SUMS]
        aggs += [
            F.min(of("len_min")).alias(f"{d}_len_min"),
            F.max(of("len_max")).alias(f"{d}_len_max"),
            F.min(of("ts_us")).alias(f"{d}_first"),
            F.max(of("ts_us")).alias(f"{d}_last"),
            F.min(of(low_gap)).alias(f"{d}_gap_min"),
            F.max(of(high_gap)).alias(f"{d}_gap_max"),
            # Gaps in a slice add up to at most its width, so their squares fit a long.
            F.coalesce(F.sum(of(F.col("gap") * F.col("gap"))), F.lit(0)).alias(f"{d}_gap_sq"),
        ]
    aggs += [F.sum(f).alias(f"{f}_count") for f in _FLAG_NAMES]
    return rows.groupBy(*FLOW_KEY, "slice").agg(*aggs)


def _stitch(segments: DataFrame, timeout_us: int, key: Sequence[str] = FLOW_KEY) -> DataFrame:
    """Number the flows of a 5-tuple and close the gaps that cross slice borders."""
    order = Window.partitionBy(*key).orderBy("slice")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    upto = order.rowsBetween(Window.unboundedPreceding, 0)
    starts = F.coalesce(F.col("first_us") - F.lag("last_us").over(order) > F.lit(timeout_us), F.lit(True))
    out = segments.select(
        "*", starts.alias("_new"), *[F.last(f"{d}_last", ignorenulls=True).over(before).alias(f"_{d}_prev") for d in _DIRS]
    )
    out = out.select(
        "*",
        F.sum(F.col("_new").cast("long")).over(upto).alias("session"),
        F.last(F.when(F.col("_new"), F.col("first_us")), ignorenulls=True).over(upto).alias("_start"),
    )
    for d in _DIRS:
        known = F.col(f"_{d}_prev") >= F.col("_start")
        prev = F.when(known & F.col(f"{d}_first").isNotNull(), F.col(f"_{d}_prev"))
        out = out.withColumn(f"{d}_prev", prev)
    return out.drop("_new", "_start", *[f"_{d}_prev" for d in _DIRS])


def _wide_sum(square: Column) -> Column:
    """Exact sum of non-negative longs beyond the long range: high and low halves add up apart."""
    low = F.sum(square.bitwiseAND(F.lit(2**31 - 1))).cast("decimal(38,0)")
    high = F.sum(F.shiftright(square, 31)).cast("decimal(20,0)")
    return (low + high * F.lit(2**31).cast("decimal(11,0)")).cast("decimal(38,0)")


def _merge(stitched: DataFrame, timeout_us: int) -> DataFrame:
    """Slice rows of one flow to the flow row. Gaps of long time-outs are squared as decimals."""
    exact = timeout_us > LONG_GAP_US
    aggs = [F.min("first_us").alias("start_us"), F.max("last_us").alias("end_us")]
    for d in _DIRS:
        cross = F.col(f"{d}_first") - F.col(f"{d}_prev")
        wide = cross.cast("decimal(19,0)") if exact else cross
        square = F.col(f"{d}_gap_sq") + F.coalesce(wide * wide, F.lit(0))
        aggs += [F.sum(f"{d}_{c}").alias(f"{d}_{c}") for c in _SUMS]
        aggs += [
            F.min(f"{d}_len_min").alias(f"{d}_len_min"),
            F.max(f"{d}_len_max").alias(f"{d}_len_max"),
            F.min(F.least(f"{d}_gap_min", cross)).alias(f"{d}_gap_min"),
            F.max(F.greatest(f"{d}_gap_max", cross)).alias(f"{d}_gap_max"),
            (F.max(f"{d}_last") - F.min(f"{d}_first")).alias(f"{d}_gap_sum"),
            F.greatest(F.sum(f"{d}_n") - 1, F.lit(0)).alias(f"{d}_gap_n"),
            (F.sum(square).cast("decimal(38,0)") if exact else _wide_sum(square)).alias(f"{d}_gap_sq"),
        ]
    aggs += [F.sum(f"{f}_count").alias(f"{f}_count") for f in _FLAG_NAMES]
    return stitched.groupBy(*FLOW_KEY, "session").agg(*aggs)


def flow_moments(
    packets: DataFrame,
    timeout_us: int = DEFAULT_TIMEOUT_US,
    slice_us: int | None = None,
    preaggregate: bool = False,
) -> DataFrame:
    """One row per flow with every additive measure the features need.

    Slices are ``slice_us`` long whatever the data are, so what one task sorts is bounded by the line rate. With
    ``preaggregate`` packets of one time stamp are summed first, at the price of a shuffle.
    """
    width = min(slice_us or SHORT_SLICE_US, timeout_us)
    atoms = _atoms(with_flow_key(packets), width, preaggregate)
    return _merge(_stitch(_segments(atoms), timeout_us), timeout_us)


def flow_table(moments: DataFrame) -> DataFrame:
    """Public flow columns: endpoints, duration, totals, flags and plain rates (0 when instantaneous)."""
    seconds = (F.col("end_us") - F.col("start_us")) / F.lit(1_000_000.0)
    packets = F.col("fwd_n") + F.col("bwd_n")
    size = F.col("fwd_bytes") + F.col("bwd_bytes")

    def rate(total: Column) -> Column:
        return F.when(seconds > 0, total / seconds).otherwise(F.lit(0.0))

    return moments.select(
        *FLOW_KEY,
        "session",
        F.col("start_us").alias("timestamp_us"),
        F.col("end_us").alias("last_us"),
        seconds.alias("duration"),
        F.col("fwd_n").alias("total_fwd_packets"),
        F.col("bwd_n").alias("total_bwd_packets"),
        F.col("fwd_bytes").alias("total_fwd_bytes"),
        F.col("bwd_bytes").alias("total_bwd_bytes"),
        F.col("fwd_payload").alias("fwd_payload_bytes"),
        F.col("bwd_payload").alias("bwd_payload_bytes"),
        F.col("fwd_psh").alias("fwd_psh_flags"),
        F.col("bwd_psh").alias("bwd_psh_flags"),
        F.col("fwd_urg").alias("fwd_urg_flags"),
        F.col("bwd_urg").alias("bwd_urg_flags"),
        *[F.col(f"{f}_count") for f in _FLAG_NAMES],
        (F.col("fwd_bytes") - F.col("fwd_payload")).alias("fwd_header_length"),
        (F.col("bwd_bytes") - F.col("bwd_payload")).alias("bwd_header_length"),
        packets.alias("total_packets"),
        size.alias("total_bytes"),
        rate(packets).alias("packets_per_second"),
        rate(size).alias("bytes_per_second"),
    )


def oldest_flow(moments: DataFrame) -> DataFrame:
    """The flow whose last packet is the oldest (ties: smallest key)."""
    key = F.struct(*FLOW_KEY, "session")
    return moments.agg(F.min(F.struct(F.col("end_us"), key.alias("k"))).alias("m")).select(
        *[F.col(f"m.k.{c}").alias(c) for c in (*FLOW_KEY, "session")], F.col("m.end_us").alias("last_us")
    )
