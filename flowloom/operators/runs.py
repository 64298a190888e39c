"""Run log and alert store as append-only tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowloom.functions.ordered import row_positions

# Fields of a run that an update may set.
RUN_FIELDS = ("data_source", "batch_size", "status", "total_flows", "total_alerts", "precision", "recall", "f1", "accuracy",
              "latency_p50", "latency_p95", "report")
FINAL_STATES = ("completed", "failed")


def current_runs(log: DataFrame, fields: Sequence[str] = RUN_FIELDS) -> DataFrame:
    """Latest state per run: for each field the last value that was not null.

    ``finished_at`` is the time of the last entry that set a final state. Plain maxima, so a run
    with very many entries is combined before the shuffle.
    """
    have = [f for f in fields if f in log.columns]
    last = [F.max_by(f, F.when(F.col(f).isNotNull(), F.col("seq"))).alias(f) for f in have]
    done = F.col("status").isin(*FINAL_STATES)
    return log.groupBy("run_id").agg(
        F.min("logged_us").alias("started_us"),
        F.max(F.when(done, F.col("logged_us"))).alias("finished_us"),
        *last,
    )


def newest_runs(runs: DataFrame, limit: int = 100) -> DataFrame:
    """Most recent runs first."""
    return runs.orderBy(F.desc("started_us"), F.desc("run_id")).limit(limit)


def numbered_alerts(scored: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Alerts of scored flows with a dense id per run in flow order."""
    alerts = scored.where(F.col("probability") >= F.lit(threshold)).select(
        "run_id", "flow_index", "ts_us", F.lit(1).alias("prediction"), "probability", F.col("y_true").alias("true_label"),
        (F.col("y_true") == 1).alias("is_correct"), F.col("latency_ms").alias("inference_time_ms"))
    return row_positions(alerts, ["flow_index"], "id", groups=["run_id"], first=1)


def with_alert_defaults(alerts: DataFrame) -> DataFrame:
    """Fill the columns a submitted alert may lack."""
    defaults = {"flow_index": 0, "prediction": 1, "probability": 0.0, "inference_time_ms": 0.0}
    out = alerts
    for c, v in defaults.items():
        out = out.withColumn(c, F.coalesce(F.col(c), F.lit(v)) if c in alerts.columns else F.lit(v))
    for c, t in (("true_label", "int"), ("is_correct", "boolean")):
        if c not in alerts.columns:
            out = out.withColumn(c, F.lit(None).cast(t))
    return out


def alert_page(alerts: DataFrame, run_id: int, limit: int = 100, offset: int = 0, only_incorrect: bool = False) -> DataFrame:
    """A page of one run's alerts in id order."""
    page = alerts.where(F.col("run_id") == run_id)
    if only_incorrect:
        page = page.where(~F.col("is_correct"))
    return page.orderBy("id").offset(offset).limit(limit)


def count_alerts(alerts: DataFrame) -> DataFrame:
    """Alerts per run."""
    return alerts.groupBy("run_id").agg(F.count(F.lit(1)).alias("alerts"))


def runs_with_alerts(runs: DataFrame, alerts: DataFrame) -> DataFrame:
    """Runs with their alerts; runs without alerts keep one row.

    The matching part is an inner join, which the skew join may split on either side when one
    run owns most alerts; runs without alerts are found from the distinct run ids.
    """
    extra = [c for c in alerts.columns if c != "run_id"]
    matched = runs.join(alerts, "run_id")
    lonely = runs.join(alerts.select("run_id").distinct(), "run_id", "left_anti")
    blank = lonely.select("*", *[F.lit(None).cast(alerts.schema[c].dataType).alias(c) for c in extra])
    return matched.unionByName(blank)


def delete_runs(runs: DataFrame, alerts: DataFrame, gone: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Runs and alerts that remain after deleting the given run ids."""
    ids = gone.select("run_id").distinct()
    return runs.join(ids, "run_id", "left_anti"), alerts.join(ids, "run_id", "left_anti")


def flag_alerts(flows: DataFrame, alerts: DataFrame, key: str = "flow_index") -> DataFrame:
    """Mark flows that have an alert."""
    hits = alerts.select(key).distinct().withColumn("_hit", F.lit(True))
    return flows.join(hits, key, "left").withColumn("is_attack", F.coalesce("_hit", F.lit(False))).drop("_hit")
