"""Packet streams to flows, snapshots, alerts and sinks with Structured Streaming."""

from __future__ import annotations

import pickle
from collections import deque
from collections.abc import Iterator, Sequence
from datetime import datetime, timedelta
from decimal import Decimal
from itertools import groupby

import numpy as np
import pandas as pd
from pyspark.ml import PipelineModel
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, StatefulProcessor, StatefulProcessorHandle, TimerValues

from flowloom.operators.alerts import COOLDOWN_US, THRESHOLD, WINDOW_US, severity
from flowloom.operators.chunked import admission
from flowloom.operators.evaluate import binary_scores, confusion_counts
from flowloom.operators.features import FEATURE_NAMES, feature_columns, snake
from flowloom.operators.flows import FLOW_KEY, SHORT_SLICE_US, TCP_FLAGS, flag, with_flow_key
from flowloom.operators.live import MIN_PACKETS, TICK_US, class_quantiles, latency_class, running_windows
from flowloom.operators.models import predict

PACKET_SCHEMA = (
    "packet_id long, ts_us long, src_ip string, dst_ip string, src_port int, dst_port int, protocol int, "
    "length int, payload_length int, flags int"
)


def packet_stream(spark: SparkSession, path: str, schema: str = PACKET_SCHEMA, max_files: int = 100, watermark: str = "10 seconds") -> DataFrame:
    """Packet files as a stream; the file limit per trigger is the back-pressure and nothing is dropped."""
    raw = spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files).parquet(path)
    return with_event_time(raw, watermark)


def with_event_time(packets: DataFrame, watermark: str = "10 seconds") -> DataFrame:
    """Add the event time ``ts`` and its watermark."""
    return packets.withColumn("ts", F.timestamp_micros("ts_us")).withWatermark("ts", watermark)


def once_per_packet(packets: DataFrame, key: str = "packet_id") -> DataFrame:
    """Drop packets that were replayed within the watermark."""
    return packets.dropDuplicatesWithinWatermark([key])


def slice_stream(packets: DataFrame, width_us: int = SHORT_SLICE_US) -> DataFrame:
    """A row per 5-tuple and slice of time with the columns of the batch slices, once the watermark has passed the slice.

    Only open slices keep times of packets (two packets may need a third one between them), so the state is bounded by the
    line rate times slice and watermark, however long a flow lasts. ``at`` is the event time of what follows.
    """
    keyed = with_flow_key(packets)
    length, payload = F.col("length").cast("long"), F.col("payload_length").cast("long")
    aggs = [F.min("ts_us").alias("first_us"), F.max("ts_us").alias("last_us")]
    for d in ("fwd", "bwd"):
        own = F.col("is_fwd") if d == "fwd" else ~F.col("is_fwd")
        aggs += [
            F.count_if(own).alias(f"{d}_n"),
            F.coalesce(F.sum(F.when(own, length)), F.lit(0)).alias(f"{d}_bytes"),
            F.coalesce(F.sum(F.when(own, payload)), F.lit(0)).alias(f"{d}_payload"),
            F.coalesce(F.sum(F.when(own, length * length)), F.lit(0)).alias(f"{d}_len_sq"),
            F.count_if(own & flag("PSH")).alias(f"{d}_psh"),
            F.count_if(own & flag("URG")).alias(f"{d}_urg"),
            F.min(F.when(own, length)).alias(f"{d}_len_min"),
            F.max(F.when(own, length)).alias(f"{d}_len_max"),
            F.sort_array(F.collect_list(F.when(own, F.col("ts_us")))).alias(f"_{d}"),
        ]
    aggs += [F.count_if(flag(f)).alias(f"{f.lower()}_count") for f in TCP_FLAGS]
    slices = keyed.groupBy(*FLOW_KEY, F.window("ts", f"{width_us} microseconds").alias("w")).agg(*aggs)
    for d in ("fwd", "bwd"):
        times = F.col(f"_{d}")
        n = F.size(times)
        gaps = F.when(n > 1, F.zip_with(F.slice(times, F.lit(2), n - 1), F.slice(times, F.lit(1), n - 1), lambda a, b: a - b)).otherwise(F.array().cast("array<bigint>"))
        slices = slices.withColumns({
            f"{d}_first": F.try_element_at(times, F.lit(1)), f"{d}_last": F.try_element_at(times, F.lit(-1)), f"{d}_gap_min": F.array_min(gaps), f"{d}_gap_max": F.array_max(gaps),
            # Gaps in a slice add up to at most its width, so their squares fit a long.
            f"{d}_gap_sq": F.aggregate(gaps, F.lit(0).cast("bigint"), lambda a, g: a + g * g)})
    return slices.withColumn("at", F.window_time("w")).drop("w", "_fwd", "_bwd")


_DIR_SUMS = ("n", "bytes", "payload", "len_sq", "psh", "urg")
_ADDED = (*[f"{d}_{c}" for d in ("fwd", "bwd") for c in _DIR_SUMS], *[f"{f.lower()}_count" for f in TCP_FLAGS])
_LEAST = tuple(f"{d}_{c}" for d in ("fwd", "bwd") for c in ("len_min", "gap_min", "first"))
_MOST = tuple(f"{d}_{c}" for d in ("fwd", "bwd") for c in ("len_max", "gap_max", "last"))
_SQUARES = ("fwd_gap_sq", "bwd_gap_sq")
_KEY_SCHEMA = "src_ip string, src_port int, dst_ip string, dst_port int, protocol int"
_FLOW_STATE = ", ".join([f"{c} long" for c in ("start_us", "end_us", "tick", *_ADDED, *_LEAST, *_MOST)] + [f"{c} decimal(38,0)" for c in _SQUARES])


def _extended(flow: dict | None, part: Row, timeout_us: int) -> tuple[dict, bool]:
    """A flow with one more slice, or a new flow when the silence before the slice was too long; and whether it is new."""
    new = flow is None or part["first_us"] - flow["end_us"] > timeout_us
    if new:
        flow = {c: 0 for c in _ADDED} | {c: None for c in (*_LEAST, *_MOST)} | {c: Decimal(0) for c in _SQUARES} | {"start_us": part["first_us"], "end_us": part["last_us"], "tick": None}
    out = dict(flow)
    for c in _ADDED:
        out[c] += part[c]
    for names, better in ((_LEAST, min), (_MOST, max)):
        for c in names:
            out[c] = better((v for v in (flow[c], part[c]) if v is not None), default=None)
    for d in ("fwd", "bwd"):
        out[f"{d}_gap_sq"] += part[f"{d}_gap_sq"]
        if flow[f"{d}_last"] is not None and part[f"{d}_first"] is not None:
            gap = part[f"{d}_first"] - flow[f"{d}_last"]
            out[f"{d}_gap_sq"] += gap * gap
            out[f"{d}_gap_min"] = min(v for v in (out[f"{d}_gap_min"], gap) if v is not None)
            out[f"{d}_gap_max"] = max(v for v in (out[f"{d}_gap_max"], gap) if v is not None)
    out["end_us"] = max(flow["end_us"], part["last_us"])
    return out, new


class _PerFlow(StatefulProcessor):
    """One flow of a 5-tuple as state: sums, extremes and border times, of the same size however many packets it has."""

    def __init__(self, timeout_us: int, width_us: int):
        self.timeout_us, self.width_us = timeout_us, width_us

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.flow = handle, handle.getValueState("flow", _FLOW_STATE)
        self.names = [f.strip().split(" ")[0] for f in _FLOW_STATE.replace("decimal(38,0)", "decimal").split(",")]

    def load(self) -> dict | None:
        return dict(zip(self.names, self.flow.get(), strict=True)) if self.flow.exists() else None

    def save(self, flow: dict | None, wake_us: int = 0) -> None:
        for ms in list(self.handle.listTimers()):
            self.handle.deleteTimer(ms)
        if flow is None:
            self.flow.clear()
        else:
            self.flow.update(tuple(flow[c] for c in self.names))
            self.handle.registerTimer(-(-wake_us // 1000))

    def close(self) -> None:
        pass


class _Finished(_PerFlow):
    """A row for every slice that is seen, and one for every flow whose time-out has passed."""

    def expiry(self, flow: dict) -> int:
        return flow["end_us"] + self.timeout_us + self.width_us

    def done(self, key: tuple, flow: dict) -> Row:
        out = {"kind": "flow", "at": _time(self.expiry(flow)), "packets": 0, "bytes": 0, "opened": 0, "start_us": flow["start_us"], "end_us": flow["end_us"], **{c: flow[c] for c in (*_ADDED, *_SQUARES)}}
        for d in ("fwd", "bwd"):
            out |= {f"{d}_{c}": flow[f"{d}_{c}"] for c in ("len_min", "len_max", "gap_min", "gap_max")}
            n = flow[f"{d}_n"]
            out |= {f"{d}_gap_n": max(n - 1, 0), f"{d}_gap_sum": flow[f"{d}_last"] - flow[f"{d}_first"] if n else None}
        return Row(**dict(zip(FLOW_KEY, key, strict=True)), **{c: out.get(c) for c in _EVENT_COLUMNS})

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues: TimerValues) -> Iterator[Row]:  # noqa: N802
        flow = self.load()
        for part in sorted(rows, key=lambda r: r["first_us"]):
            before = flow
            flow, new = _extended(flow, part, self.timeout_us)
            if new and before is not None:
                yield self.done(key, before)
            seen = {"kind": "seen", "at": part["at"], "packets": part["fwd_n"] + part["bwd_n"], "bytes": part["fwd_bytes"] + part["bwd_bytes"], "opened": int(new)}
            yield Row(**dict(zip(FLOW_KEY, key, strict=True)), **{c: seen.get(c) for c in _EVENT_COLUMNS})
        self.save(flow, self.expiry(flow))

    def handleExpiredTimer(self, key: tuple, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[Row]:  # noqa: N802
        flow = self.load()
        if flow is not None:
            yield self.done(key, flow)
        self.flow.clear()


_MOMENTS = ", ".join(
    f"{c} long" for c in ("start_us", "end_us", *_ADDED, *[f"{d}_{c}" for d in ("fwd", "bwd") for c in ("len_min", "len_max", "gap_min", "gap_max", "gap_n", "gap_sum")])
) + ", " + ", ".join(f"{c} decimal(38,0)" for c in _SQUARES)
_EVENTS = f"kind string, at timestamp, packets long, bytes long, opened int, {_MOMENTS}"
_EVENT_COLUMNS = [f.strip().split(" ")[0] for f in _EVENTS.replace("decimal(38,0)", "decimal").split(",")]
_MOMENT_COLUMNS = _EVENT_COLUMNS[5:]


def _time(us: int) -> datetime:
    return datetime.fromtimestamp(us // 1_000_000) + timedelta(microseconds=us % 1_000_000)


def _microseconds(timeout: str | int) -> int:
    """A number of microseconds, or a text like "120 seconds"."""
    return timeout if isinstance(timeout, int) else int(pd.Timedelta(timeout).value // 1000)


def flow_events(packets: DataFrame, timeout: str | int = "120 seconds", width_us: int = SHORT_SLICE_US) -> DataFrame:
    """Two kinds of rows, in append mode: ``seen`` for each slice (packets, bytes, whether it opens a flow) and ``flow`` with the
    moments of each flow, once no packet of it can come any more. ``at`` is their event time."""
    timeout_us = _microseconds(timeout)
    width_us = min(width_us, timeout_us)
    return slice_stream(packets, width_us).groupBy(*FLOW_KEY).transformWithState(
        _Finished(timeout_us, width_us), f"{_KEY_SCHEMA}, {_EVENTS}", "Append", "EventTime", eventTimeColumnName="at")


def flow_stream(packets: DataFrame, timeout: str | int = "120 seconds", width_us: int = SHORT_SLICE_US) -> DataFrame:
    """Flow moments emitted once a flow has been silent for the time-out (append mode).

    Same columns as the batch ``flow_moments`` but for the flow number, for which the flow's start stands; ``at`` is the time
    at which the flow is closed. Packets that arrive late but within the watermark take their place.
    """
    events = flow_events(packets, timeout, width_us).where("kind = 'flow'")
    return events.select(*FLOW_KEY, F.col("start_us").alias("session"), "at", *_MOMENT_COLUMNS)


def scored_flows(moments: DataFrame, model: PipelineModel, contract: Sequence[str], threshold: float = 0.5) -> DataFrame:
    """Flow results (stream or table): features, one model pass, decision, and the columns the sinks need.

    A pipeline model that starts with its scaler scales live flows exactly as in training.
    """
    names = tuple(n for n in FEATURE_NAMES if snake(n) in contract)
    exprs = feature_columns()
    rows = moments.select(
        *FLOW_KEY,
        "session",
        F.col("start_us").alias("timestamp"),
        ((F.col("end_us") - F.col("start_us")) / F.lit(1_000_000.0)).alias("duration"),
        (F.col("fwd_n") + F.col("bwd_n")).alias("packets"),
        (F.col("fwd_bytes") + F.col("bwd_bytes")).alias("bytes"),
        *[exprs[n].alias(snake(n)) for n in names],
    )
    return predict(model, rows, threshold)


def attack_windows(flows: DataFrame, width: str, is_attack: Column) -> DataFrame:
    """Flows and attacks per tumbling window of the closing time of finished flows."""
    return flows.groupBy(F.window("at", width).alias("window")).agg(
        F.count(F.lit(1)).alias("flows"), F.count_if(is_attack).alias("attacks"))


_COUNTS = ("flows", "alerts", "true_positives", "false_positives", "true_negatives", "false_negatives")


class _Running(StatefulProcessor):
    """Totals so far and counts per latency class, per key; a row for each closed window, in order."""

    def __init__(self, keys: Sequence[str], counts: Sequence[str], classes: bool):
        self.keys, self.counts, self.classes = list(keys), list(counts), classes

    def init(self, handle: StatefulProcessorHandle) -> None:
        totals = ", ".join(f"{c} long" for c in self.counts)
        self.state = handle.getValueState("totals", f"{totals}, seen map<string,long>")

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues: TimerValues) -> Iterator[Row]:  # noqa: N802
        held = self.state.get() if self.state.exists() else None
        totals = dict(zip(self.counts, held, strict=False)) if held else dict.fromkeys(self.counts, 0)
        seen = {int(k): n for k, n in held[-1].items()} if held else {}  # keys of a stored map are texts
        for start, part in groupby(sorted(rows, key=lambda r: r["window"]["start"]), key=lambda r: r["window"]["start"]):
            own = dict.fromkeys(self.counts, 0)
            for r in part:
                end = r["window"]["end"]
                for c in self.counts:
                    own[c] += r[c]
                if self.classes and r["class"] is not None:
                    seen[r["class"]] = seen.get(r["class"], 0) + r["timed"]
            totals = {c: totals[c] + own[c] for c in self.counts}
            out = dict(zip(self.keys, key, strict=True)) | {"window": Row(start=start, end=end)} | {f"new_{c}": own[c] for c in self.counts} | totals
            if self.classes:
                out |= dict(zip(("p50_ms", "p95_ms", "p99_ms"), class_quantiles(seen, (0.5, 0.95, 0.99)), strict=True))
            yield Row(**out)
        self.state.update((*[totals[c] for c in self.counts], {str(k): n for k, n in seen.items()}))

    def handleExpiredTimer(self, key: tuple, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[Row]:  # noqa: N802
        yield from ()

    def close(self) -> None:
        pass


def _running(per: DataFrame, keys: Sequence[str], counts: Sequence[str], classes: bool) -> DataFrame:
    """Totals so far of a table or stream with a window column; in a stream a constant key stands for the whole of it."""
    keys = list(keys)
    if not per.isStreaming:
        return running_windows(per, keys, counts, classes)
    named = per if keys else per.withColumn("_all", F.lit(0))
    by = keys or ["_all"]
    fields = [named.schema[k] for k in by] + [named.schema["window"]] + [T.StructField(c, T.LongType()) for c in (*[f"new_{c}" for c in counts], *counts)]
    fields += [T.StructField(c, T.DoubleType()) for c in ("p50_ms", "p95_ms", "p99_ms")] * classes
    out = named.groupBy(*by).transformWithState(_Running(by, counts, classes), T.StructType(fields), "Append", "EventTime")
    return out if keys else out.drop("_all")


def live_metrics(scored: DataFrame, width: str = "1 second", latency: str | None = "latency_ms", groups: Sequence[str] = ()) -> DataFrame:
    """After each tumbling window of a scored stream with ``ts``: new and total counts, confusion cells and scores so far, and
    the percentiles of all latencies so far (within half a per cent).

    A window sends one row per latency class; the state holds the totals and the classes, which merge by addition.
    """
    cells = confusion_counts(F.col("y_true"), F.col("prediction"))
    kind = latency_class(F.col(latency)) if latency else F.lit(None).cast("int")
    aggs = [F.count(F.lit(1)).alias("flows"), F.count_if(F.col("prediction") == 1).alias("alerts"), *[c.alias(k) for k, c in cells.items()]]
    per = scored.withColumn("class", kind).groupBy(*groups, F.window("ts", width).alias("window"), "class").agg(*aggs)
    total = _running(per.withColumn("timed", F.col("flows")), groups, _COUNTS, True)
    return total.withColumns(binary_scores())


def live_totals(events: DataFrame, width: str = "1 second", is_attack: Column | None = None) -> DataFrame:
    """After each tumbling window of ``flow_events``: packets and bytes in it, and so far packets, bytes, finished flows, attacks, and
    their share, and the flows that are open. ``is_attack`` decides on the moments of a finished flow."""
    done = F.col("kind") == "flow"
    attack = F.lit(False) if is_attack is None else is_attack
    per = events.groupBy(F.window("at", width).alias("window")).agg(
        F.sum("packets").alias("packets"), F.sum("bytes").alias("bytes"), F.sum("opened").alias("opened"), F.count_if(done).alias("flows"), F.count_if(done & attack).alias("attacks"))
    total = _running(per, (), ("packets", "bytes", "opened", "flows", "attacks"), False)
    seconds = (F.unix_micros("window.end") - F.unix_micros("window.start")) / F.lit(1e6)
    return total.select(
        "window", F.col("new_packets").alias("packets"), F.col("new_bytes").alias("bytes"), (F.col("new_packets") / seconds).alias("packets_per_sec"), F.col("packets").alias("total_packets"), F.col("bytes").alias("total_bytes"),
        F.col("flows").alias("total_flows"), F.col("attacks").alias("total_attacks"), (F.col("opened") - F.col("flows")).alias("active_flows"), (F.col("attacks") / F.greatest(F.col("flows"), F.lit(1))).alias("attack_rate"))


def packet_totals(packets: DataFrame, width: str = "1 second") -> DataFrame:
    """Packets and bytes per tumbling window."""
    return packets.groupBy(F.window("ts", width).alias("window")).agg(
        F.count(F.lit(1)).alias("packets"), F.sum("length").alias("bytes"))


class _Active(_PerFlow):
    """The totals of a flow at every tick that the watermark passes, until its time-out."""

    def __init__(self, timeout_us: int, tick_us: int, min_packets: int):
        super().__init__(timeout_us, tick_us)
        self.min_packets = min_packets

    def emit(self, key: tuple, flow: dict, until: int) -> Iterator[Row]:
        last = min(until, (flow["end_us"] + self.timeout_us) // self.width_us)
        n, size = (flow[f"fwd_{c}"] + flow[f"bwd_{c}"] for c in ("n", "bytes"))
        if n >= self.min_packets:
            for k in range(flow["tick"], last + 1):
                yield Row(**dict(zip(FLOW_KEY, key, strict=True)), tick=k, total_packets=n, total_bytes=size, start_us=flow["start_us"], last_us=flow["end_us"])
        flow["tick"] = max(flow["tick"], last + 1)

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues: TimerValues) -> Iterator[Row]:  # noqa: N802
        flow = self.load()
        for part in sorted(rows, key=lambda r: r["first_us"]):
            home = part["first_us"] // self.width_us
            if flow is not None:  # ticks up to this slice see the totals without it
                yield from self.emit(key, flow, home)
            tick = flow["tick"] if flow else None
            flow, new = _extended(flow, part, self.timeout_us)
            flow["tick"] = home + 1 if new else tick
        self.save(flow, flow["tick"] * self.width_us)

    def handleExpiredTimer(self, key: tuple, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[Row]:  # noqa: N802
        flow = self.load()
        if flow is None:
            return
        yield from self.emit(key, flow, timerValues.getCurrentWatermarkInMs() * 1000 // self.width_us)
        over = flow["tick"] > (flow["end_us"] + self.timeout_us) // self.width_us
        self.save(None if over else flow, flow["tick"] * self.width_us)


def active_flow_stream(
    packets: DataFrame, tick_us: int = TICK_US, timeout_us: int = 120_000_000, min_packets: int = MIN_PACKETS
) -> DataFrame:
    """Totals of active flows, repeated at every tick the watermark passes (append mode).

    Packets are added up per tick first; the state of a flow is one row, and a timer wakes it at the next tick.
    """
    if tick_us > timeout_us:
        raise ValueError("a tick may not be longer than the time-out")
    schema = f"{_KEY_SCHEMA}, tick long, total_packets long, total_bytes long, start_us long, last_us long"
    return slice_stream(packets, tick_us).groupBy(*FLOW_KEY).transformWithState(
        _Active(timeout_us, tick_us, min_packets), schema, "Append", "EventTime")


def _wake(state: GroupState, us: int) -> None:
    """Come back when the watermark has passed a time."""
    state.setTimeoutTimestamp(max(us // 1000 + 1, int(state.getCurrentWatermarkMs()) + 1))


def burst_alert_stream(
    attacks: DataFrame, key: str, threshold: int = THRESHOLD, window_us: int = WINDOW_US, cooldown_us: int = COOLDOWN_US
) -> DataFrame:
    """Burst alerts per key with cooldown, the same as in the batch, once the watermark has passed their time.

    Until then attacks wait, so late ones take their place in time order. The state holds (time, count) pairs of the
    waiting attacks and of one window before, and the last alert; it expires with the window and the cooldown.
    """
    key_type = attacks.schema[key].dataType
    out = T.StructType([T.StructField(key, key_type), T.StructField("ts_us", T.LongType()), T.StructField("attack_count", T.LongType())])

    def step(k: tuple, chunks: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        times, counts, taken, last = state.get if state.exists else ([], [], 0, None)
        seen_until = times[taken - 1] if taken else None
        times, counts = np.asarray(times, dtype=np.int64), np.asarray(counts, dtype=np.int64)
        if not state.hasTimedOut:
            for c in chunks:
                new, n = np.unique(c["ts_us"].to_numpy(dtype=np.int64), return_counts=True)
                merged, place = np.unique(np.concatenate([times, new]), return_inverse=True)
                counts = np.bincount(place, np.concatenate([counts, n]), minlength=len(merged)).astype(np.int64)
                times = merged
        mark = int(state.getCurrentWatermarkMs()) * 1000
        start = 0 if seen_until is None else int(np.searchsorted(times, seen_until, side="right"))
        stop = max(start, int(np.searchsorted(times, mark, side="left")))
        total = np.concatenate([[0], np.cumsum(counts)])
        before = total[:-1] - total[np.searchsorted(times, times - window_us, side="right")]
        spots = start + np.flatnonzero(before[start:stop] + counts[start:stop] >= threshold)
        rows, i = [], 0 if last is None else int(np.searchsorted(times[spots], last + cooldown_us, side="right"))
        while i < len(spots):
            last = int(times[spots[i]])
            rows.append((*k, last, max(int(before[spots[i]]) + 1, threshold)))
            i = int(np.searchsorted(times[spots], last + cooldown_us, side="right"))
        drop = min(stop, int(np.searchsorted(times, mark - window_us, side="right")))
        times, counts, taken = times[drop:], counts[drop:], stop - drop
        if not len(times) and (last is None or last + cooldown_us < mark):
            state.remove()
        else:
            state.update((times.tolist(), counts.tolist(), taken, last))
            _wake(state, int(times[taken]) if taken < len(times) else max([last + cooldown_us] if last is not None else [], default=0) or int(times[-1]) + window_us)
        if rows:
            yield pd.DataFrame(rows, columns=out.names)

    found = attacks.select(key, "ts", "ts_us").groupBy(key).applyInPandasWithState(
        step, out, "times array<long>, counts array<long>, taken int, last long", "append", GroupStateTimeout.EventTimeTimeout)
    return found.withColumn("severity", severity(F.col("attack_count"), threshold))


def admission_stream(events: DataFrame, key: str, max_events: int, window_us: int, order: Sequence[str]) -> DataFrame:
    """Events a sliding limit lets through per key, the same as in the batch, once the watermark has passed their time.

    The state holds the waiting events and the last admitted times; it expires with the window.
    """
    schema = events.schema

    def step(k: tuple, chunks: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        passed, held = state.get if state.exists else ([], None)
        parts = [pickle.loads(held)] if held else []
        if not state.hasTimedOut:
            parts += list(chunks)
        rows = pd.concat(parts).sort_values(["ts_us", *order]) if parts else pd.DataFrame(columns=schema.names)
        mark = int(state.getCurrentWatermarkMs()) * 1000
        times = rows["ts_us"].to_numpy(dtype=np.int64)
        ready = int(np.searchsorted(times, mark, side="left"))
        keep = np.zeros(ready, dtype=bool)
        passed = list(admission(times[:ready], deque(passed, maxlen=max_events), keep, max_events, window_us))
        if ready == len(rows) and (not passed or passed[-1] + window_us < mark):
            state.remove()
        else:
            state.update((passed, pickle.dumps(rows[ready:]) if ready < len(rows) else None))
            _wake(state, int(times[ready]) if ready < len(rows) else passed[-1] + window_us)
        if keep.any():
            yield rows[:ready][keep]

    return events.groupBy(key).applyInPandasWithState(
        step, schema, "passed array<long>, held binary", "append", GroupStateTimeout.EventTimeTimeout)
