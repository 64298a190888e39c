"""The batch steps in their order: audit, clean, label, split, scale; and score with a report."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowloom.functions.lineage import cut
from flowloom.operators import audit, clean, evaluate, labels, models, scale, split


@dataclass
class Prepared:
    """What the batch pipeline leaves: findings on the raw rows, the splits, and the scaler of the training rows."""

    findings: DataFrame
    splits: dict[str, DataFrame]
    features: list[str]
    scaler: scale.Params = field(default_factory=dict)


def run_pipeline(
    raw: DataFrame,
    key: Sequence[str],
    rules: clean.CleanRules = clean.CleanRules(),
    scaler: str = "robust",
    test_size: float = 0.15,
    val_size: float = 0.15,
    seed: int = 42,
) -> Prepared:
    """Raw labelled rows to scaled training, validation and test rows.

    Rows are cleaned as a whole, then labelled and split by class with exact sizes. The scaler is fitted on the training
    rows alone and applied to all three splits. ``key`` columns tell rows apart and are no features.
    """
    cleaned = labels.with_labels(clean.clean(raw, rules), rules.label)
    features = [c for c in audit.numeric_columns(cleaned) if c not in (*key, "label_binary", "label_multiclass")]
    placed = cut(split.stratified_split(cleaned, key, "label_binary", test_size, val_size, seed))
    bounded = clean.zero_bad_cells(placed, features)
    params = scale.fit_scaler(bounded.where(F.col("split") == "train"), features, scaler)
    scaled = scale.apply_scaler(bounded, params)
    return Prepared(audit.issues(raw), {s: scaled.where(F.col("split") == s).drop("split") for s in ("train", "val", "test")}, features, params)


def score_and_report(model: PipelineModel, rows: DataFrame, label: str = "y_true", threshold: float = 0.5) -> tuple[DataFrame, DataFrame]:
    """Scored rows and one row of totals with, where the truth is known, the binary metrics.

    Truth comes from a known label column (``labels.with_ground_truth``); without one the report has totals alone.
    """
    truth, source = labels.with_ground_truth(rows, label)
    scored = cut(models.predict(model, truth, threshold))
    report = evaluate.scoring_summary(scored)
    if source is None:
        return scored, report
    return scored, report.crossJoin(evaluate.binary_metrics(scored, label))
