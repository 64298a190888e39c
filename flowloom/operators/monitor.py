"""Rolling metrics, snapshots and session reports over scored traffic."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flowloom.functions.lineage import cut
from flowloom.functions.ordered import grouped_quantiles, row_positions, running_totals, trailing_rows
from flowloom.operators.chunked import same_keys
from flowloom.operators.evaluate import binary_scores, confusion_counts

_COUNTERS = ("flows_processed", "alerts_generated", "true_positives", "false_positives", "true_negatives", "false_negatives")


def snapshots(
    scored: DataFrame, interval_us: int, groups: Sequence[str] = (), time_us: str = "ts_us", latency: str | None = None
) -> DataFrame:
    """Cumulative counters per interval with rates since the interval before.

    Rows are counted per interval first; only one row per interval goes into the running sums. With ``latency`` the exact
    interpolated p50, p95 and p99 of the interval are added, found by running counts over ranges of latencies.
    """
    tick = F.floor(F.col(time_us) / F.lit(interval_us))
    cells = confusion_counts(F.col("y_true"), F.col("prediction"))
    per = scored.groupBy(*groups, tick.alias("tick")).agg(
        F.count(F.lit(1)).alias("flows"), F.count_if(F.col("prediction") == 1).alias("alerts"),
        *[c.alias(f"d_{k}") for k, c in cells.items()])
    quantiles = ["p50_ms", "p95_ms", "p99_ms"] if latency else []
    if latency:
        timed = scored.select(*groups, tick.alias("tick"), F.col(latency).cast("double").alias("_latency"))
        found = grouped_quantiles(timed, "_latency", (0.5, 0.95, 0.99), quantiles, [*groups, "tick"])
        per = per.alias("p").join(found.alias("q"), same_keys("p", "q", [*groups, "tick"]), "left").select("p.*", *[f"q.{n}" for n in quantiles])
    names = {"flows_processed": "flows", "alerts_generated": "alerts", **{k: f"d_{k}" for k in cells}}
    total = cut(running_totals(cut(per), ["tick"], {k: F.col(v) for k, v in names.items()}, groups))
    total = trailing_rows(total, 2, ["tick"], {"_before": F.min("tick")}, groups)
    # The first interval has no interval before it and counts as one interval long.
    seconds = F.greatest(F.col("tick") - F.col("_before"), F.lit(1)) * F.lit(interval_us / 1e6)
    return total.select(
        *groups, "tick", *_COUNTERS,
        (F.col("flows") / seconds).alias("flows_per_second"), (F.col("alerts") / seconds).alias("alerts_per_second"), *quantiles,
    ).withColumns({k: v for k, v in binary_scores().items() if k != "specificity"})


def moving_stats(df: DataFrame, value: str, n: int = 100, order: Sequence[str] = ("ts_us",), groups: Sequence[str] = ()) -> DataFrame:
    """Mean, extremes and sample deviation over the last ``n`` values (deviation 0 for one value)."""
    v = F.col(value)
    raw = trailing_rows(df, n, order, {"mean": F.avg(v), "min": F.min(v), "max": F.max(v), "std": F.stddev_samp(v)}, groups)
    return raw.withColumn("std", F.coalesce(F.when(~F.isnan("std"), F.col("std")), F.lit(0.0)))


def recent_attack_rate(df: DataFrame, n: int = 100, order: Sequence[str] = ("ts_us",), groups: Sequence[str] = ()) -> DataFrame:
    """Share of attacks among the last ``n`` results."""
    return trailing_rows(df, n, order, {"recent_attack_rate": F.avg(F.col("is_attack").cast("double"))}, groups)


def attack_timeline(df: DataFrame, bucket_us: int, time_us: str = "ts_us") -> DataFrame:
    """Per time bucket: cumulative flows and attacks and the attack share so far in percent."""
    per = df.groupBy(F.floor(F.col(time_us) / F.lit(bucket_us)).alias("tick")).agg(
        F.count(F.lit(1)).alias("flows"), F.count_if("is_attack").alias("attacks"))
    total = running_totals(per, ["tick"], {"flows_total": F.col("flows"), "attacks_total": F.col("attacks")})
    share = F.lit(100.0) * F.col("attacks_total") / F.greatest(F.col("flows_total"), F.lit(1))
    return total.select("tick", "flows_total", "attacks_total", share.alias("attack_rate"))


def with_batch_number(df: DataFrame, size: int, order: Sequence[str]) -> DataFrame:
    """Replay batch of each row: dense position divided by the batch size."""
    return row_positions(df, order, "_pos").withColumn("batch_id", F.floor(F.col("_pos") / F.lit(size))).drop("_pos")


def session_stats(packets: DataFrame, flows: DataFrame) -> DataFrame:
    """Totals of a session; one aggregate per table, the run time spans first to last packet."""
    p = packets.agg(F.count(F.lit(1)).alias("n"), F.min("ts_us").alias("a"), F.max("ts_us").alias("z")).first()
    seconds = ((p["z"] or 0) - (p["a"] or 0)) / 1e6
    total, attacks = F.count(F.lit(1)), F.count_if("is_attack")
    return flows.agg(
        F.lit(seconds).alias("runtime_seconds"), F.lit(p["n"]).cast("long").alias("total_packets"), total.alias("total_flows"),
        attacks.alias("total_attacks"), (attacks / F.greatest(total, F.lit(1))).alias("attack_rate"),
        F.lit(p["n"] / seconds if seconds > 0 else 0.0).alias("packets_per_second"))


def live_totals(packets: DataFrame, flows: DataFrame, bucket_us: int, timeout_us: int = 120_000_000) -> DataFrame:
    """Per time bucket: packets, and so far packets, flows, attacks and their share, and the flows that are still open.

    ``flows`` has start_us, end_us and is_attack. A flow counts from its first packet on and is open until its time-out
    has passed. Each table is counted per bucket before anything is added up.
    """
    def tick(c: Column) -> Column:
        return F.floor(c / F.lit(bucket_us)).alias("tick")

    zero = F.lit(0).cast("long")
    seen = packets.select(tick(F.col("ts_us")), F.lit(1).cast("long").alias("packets"), *[zero.alias(c) for c in ("flows", "attacks", "open")])
    opened = flows.select(
        tick(F.col("start_us")), zero.alias("packets"), F.lit(1).cast("long").alias("flows"), F.col("is_attack").cast("long").alias("attacks"), F.lit(1).cast("long").alias("open"))
    closed = flows.select((tick(F.col("end_us") + F.lit(timeout_us)) + 1).alias("tick"), *[zero.alias(c) for c in ("packets", "flows", "attacks")], F.lit(-1).cast("long").alias("open"))
    per = seen.unionByName(opened).unionByName(closed).groupBy("tick").agg(*[F.sum(c).alias(c) for c in ("packets", "flows", "attacks", "open")])
    total = running_totals(per, ["tick"], {"total_packets": F.col("packets"), "total_flows": F.col("flows"), "total_attacks": F.col("attacks"), "active_flows": F.col("open")})
    return total.select(
        "tick", "packets", "total_packets", (F.col("packets") / F.lit(bucket_us / 1e6)).alias("packets_per_sec"), "total_flows", "total_attacks", "active_flows",
        (F.col("total_attacks") / F.greatest(F.col("total_flows"), F.lit(1))).alias("attack_rate"))


def top_values(df: DataFrame, keys: dict[str, Column], k: int = 10) -> DataFrame:
    """Most frequent values of several columns (ties by value)."""
    parts = []
    for name, c in keys.items():
        per = df.groupBy(c.cast("string").alias("value")).agg(F.count(F.lit(1)).alias("count"))
        top = per.orderBy(F.desc("count"), "value").limit(k)
        parts.append(top.select(F.lit(name).alias("key"), "value", "count"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def last_rows(df: DataFrame, n: int, order: Sequence[str] = ("ts_us",), groups: Sequence[str] = ()) -> DataFrame:
    """The newest ``n`` rows, overall or per group; group ranks are limited before the shuffle."""
    newest = [F.col(c).desc() for c in order]
    if not groups:
        return df.orderBy(*newest).limit(n)
    rank = F.row_number().over(Window.partitionBy(*groups).orderBy(*newest))
    return df.withColumn("_rank", rank).where(F.col("_rank") <= n).drop("_rank")


def named_counters(df: DataFrame, name: str, value: Column) -> DataFrame:
    """Sum per counter name."""
    return df.groupBy(F.col(name).alias("name")).agg(F.sum(value).alias("value"))
