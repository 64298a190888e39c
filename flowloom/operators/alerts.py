"""Burst alerts with cooldown, and a sliding-window admission limit.

Counting is done per distinct microsecond inside time blocks that borrow the end of the block
before, so one busy key is spread over many tasks. Whether an alert fires depends on the alert before, and
the limit on what it has let through; both run in chunks of time that hand on their state (``chunked``).
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flowloom.functions.lineage import cut
from flowloom.operators.chunked import cooldown, handed_on, same_keys

THRESHOLD = 10
WINDOW_US = 60_000_000
COOLDOWN_US = 300_000_000


def trailing_sums(
    df: DataFrame, span_us: int, sums: Mapping[str, str], groups: Sequence[str] = (), include_now: bool = True
) -> DataFrame:
    """Add sums of whole-number columns over the rows of the last ``span_us`` microseconds.

    With ``include_now`` the frame is ``(ts - span, ts]``, else ``[ts - span, ts)``. Rows without a time are left out.

    Blocks are four spans long and lend their last span to the next block. Inside a block every row also leaves, one span after
    its time, with the opposite sign; what has come and not left is one running total, whatever the number of rows in a span.
    """
    length = 4 * span_us
    home = F.floor(F.col("ts_us") / F.lit(length))
    lends = F.col("ts_us") - home * F.lit(length) >= F.lit(length - span_us)
    at, block = F.col("ts_us"), F.col("_home")

    def moment(ts: Column, where: Column, own: bool) -> Column:
        return F.struct(ts.alias("at"), where.alias("block"), F.lit(own).alias("own"))

    # A row that lends leaves in the next block, where it also comes; any other comes and leaves at home.
    away = F.array(moment(at, block, True), moment(at, block + 1, False), moment(at + F.lit(span_us), block + 1, False))
    near = F.array(moment(at, block, True), moment(at + F.lit(span_us), block, False))
    timed = df.where(F.col("ts_us").isNotNull()).withColumn("_home", home)
    spread = timed.select("*", F.explode(F.when(lends, away).otherwise(near)).alias("_m"))
    leaves = F.col("_m.at") > F.col("ts_us")
    so_far = Window.partitionBy(*groups, "_m.block").orderBy("_m.at").rangeBetween(Window.unboundedPreceding, 0 if include_now else -1)
    total = {k: F.sum(F.when(leaves, -F.col(c)).otherwise(F.col(c))).over(so_far) for k, c in sums.items()}
    return spread.select("*", *[t.alias(k) for k, t in total.items()]).where("_m.own").drop("_home", "_m")


def recent_attacks(attacks: DataFrame, window_us: int = WINDOW_US, groups: Sequence[str] = ()) -> DataFrame:
    """Attacks in the trailing window at every attack time; one row per distinct time."""
    per = attacks.groupBy(*groups, "ts_us").agg(F.count(F.lit(1)).alias("attacks"))
    return trailing_sums(per, window_us, {"recent": "attacks"}, groups)


def severity(count: Column, threshold: int = THRESHOLD) -> Column:
    """Severity from the number of attacks."""
    return (
        F.when(count >= threshold * 5, "critical").when(count >= threshold * 2, "high").when(count >= threshold, "medium").otherwise("low")
    )


def burst_alerts(
    attacks: DataFrame,
    groups: Sequence[str] = (),
    threshold: int = THRESHOLD,
    window_us: int = WINDOW_US,
    cooldown_us: int = COOLDOWN_US,
) -> DataFrame:
    """Alerts: at least ``threshold`` attacks in the window and more than the cooldown since the last alert.

    Attacks of one microsecond count one after another, so an alert's ``attack_count`` ends with the attack that fires
    it; ``at_once`` says the how-many-th of its microsecond that is.
    """
    seen = recent_attacks(attacks, window_us, groups).where(F.col("recent") >= threshold)
    before = F.col("recent") - F.col("attacks")
    candidates = seen.select(*groups, "ts_us", F.greatest(before + 1, F.lit(threshold)).alias("attack_count"), before.alias("_before"))

    candidates = cut(candidates)
    on = (F.col("c.ts_us") == F.col("f.ts_us")) & same_keys("c", "f", groups)
    fired = candidates.alias("c").join(cooldown(candidates.select(*groups, "ts_us"), cooldown_us, groups).alias("f"), on, "left_semi")
    return fired.select(
        *groups, "ts_us", "attack_count", severity(F.col("attack_count"), threshold).alias("severity"), (F.col("attack_count") - F.col("_before")).alias("at_once"))


def alert_breakdown(
    attacks: DataFrame,
    alerts: DataFrame,
    keys: Mapping[str, str],
    order: Sequence[str],
    groups: Sequence[str] = (),
    window_us: int = WINDOW_US,
    top: Mapping[str, int] | None = None,
) -> DataFrame:
    """Most frequent values of each key column among the attacks of an alert's window, up to the attack that fired it.

    ``order`` orders attacks of one microsecond. ``top`` limits single kinds; without a limit all values are kept.
    Alerts are few; each is matched by the one or two window-long cells its window touches.
    Ties go to the value seen first.
    """
    cell = F.floor(F.col("alert_us") / F.lit(window_us))
    names = [f"_g{i}" for i in range(len(groups))]
    spots = alerts.select(*[F.col(g).alias(n) for g, n in zip(groups, names)], F.col("ts_us").alias("alert_us"), "at_once").select(
        "*", F.explode(F.array(cell - 1, cell)).alias("_spot"))
    rows = attacks.withColumn("_nth", F.row_number().over(Window.partitionBy(*groups, "ts_us").orderBy(*order)))
    rows = rows.withColumn("_cell", F.floor(F.col("ts_us") / F.lit(window_us)))
    on = F.col("_cell") == F.col("_spot")
    for g, n in zip(groups, names):
        on = on & F.col(g).eqNullSafe(F.col(n))
    late, early = F.col("alert_us"), F.col("alert_us") - F.lit(window_us)
    upto = (F.col("ts_us") < late) | ((F.col("ts_us") == late) & (F.col("_nth") <= F.col("at_once")))
    inside = rows.join(spots, on).where(upto & (F.col("ts_us") > early))
    cells = F.array(*[F.struct(F.lit(k).alias("kind"), F.col(c).cast("string").alias("value")) for k, c in keys.items()])
    per = (
        inside.select(*groups, "alert_us", "ts_us", F.explode(cells).alias("c"))
        .groupBy(*groups, "alert_us", "c.kind", "c.value")
        .agg(F.count(F.lit(1)).alias("count"), F.min("ts_us").alias("_first"))
    )
    rank = F.row_number().over(
        Window.partitionBy(*groups, "alert_us", "kind").orderBy(F.desc("count"), "_first", "value"))
    kept = F.lit(True)
    for kind, limit in (top or {}).items():
        kept = kept & ((F.col("kind") != kind) | (F.col("rank") <= limit))
    return per.withColumn("rank", rank).where(kept).drop("_first")


def admit(events: DataFrame, max_events: int, window_us: int, order: Sequence[str], groups: Sequence[str] = ()) -> DataFrame:
    """Events that a sliding limit lets through: fewer than ``max_events`` admitted in ``[ts - window, ts]``."""
    return handed_on(events, max_events, window_us, order, groups)
