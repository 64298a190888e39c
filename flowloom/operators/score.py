"""Threshold decisions and voting on tables of model scores."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Columns of a result row as consumers read it, and of the two result files.
RESULT_COLUMNS = ("timestamp", "src_ip", "src_port", "dst_ip", "dst_port", "protocol", "packets", "bytes",
                  "is_attack", "confidence", "class_name")
FLOW_FILE_COLUMNS = ("timestamp", "src_ip", "src_port", "dst_ip", "dst_port", "protocol", "duration", "packets",
                     "bytes", "prediction", "class_name", "confidence", "is_attack")
ATTACK_FILE_COLUMNS = ("timestamp", "src_ip", "src_port", "dst_ip", "dst_port", "protocol", "duration", "packets",
                       "bytes", "confidence", "probability")


def confidence(probability: Column, is_attack: Column) -> Column:
    """Probability of the class that was decided for."""
    return F.when(is_attack, probability).otherwise(F.lit(1.0) - probability)


def decide(df: DataFrame, threshold: float = 0.5, probability: str = "probability") -> DataFrame:
    """Add prediction, ``is_attack``, class name and confidence; a score at the threshold is an attack."""
    p = F.col(probability)
    attack = p >= F.lit(threshold)
    return df.withColumns({
        "prediction": attack.cast("int"),
        "is_attack": attack,
        "class_name": F.when(attack, "ATTACK").otherwise("BENIGN"),
        "confidence": confidence(p, attack),
    })


def soft_vote(scores: Sequence[Sequence[Column]], weights: Sequence[float] | None = None) -> tuple[list[Column], Column]:
    """Weighted mean per class and the class with the largest one (first on ties).

    ``scores[m][k]`` is the probability of class ``k`` under model ``m``.
    """
    weights = list(weights) if weights else [1.0] * len(scores)
    total = sum(weights)
    mean = []
    for k in range(len(scores[0])):
        terms = [m[k] * F.lit(w / total) for m, w in zip(scores, weights)]
        mean.append(sum(terms[1:], terms[0]))
    best = F.array_position(F.array(*mean), F.greatest(*mean)) - 1 if len(mean) > 1 else F.lit(0)
    return mean, best.cast("int")


def majority(votes: Column) -> Column:
    """Most frequent class of an array of votes, the smallest one on ties; null votes do not count. No shuffle."""
    cast = F.filter(votes, lambda v: v.isNotNull())
    counted = F.transform(F.array_distinct(cast), lambda v: F.struct(F.size(F.filter(cast, lambda x: x == v)).alias("n"), (-v).alias("c")))
    return -F.array_max(counted)["c"]


def hard_vote(df: DataFrame, key: str, prediction: str = "prediction") -> DataFrame:
    """Most frequent prediction per key, the smallest one on ties; input has one row per model."""
    per = df.groupBy(key, prediction).agg(F.count(F.lit(1)).alias("votes"))
    return per.groupBy(key).agg(
        F.max_by(prediction, F.struct(F.col("votes"), -F.col(prediction))).alias(prediction)
    )


def model_rows(df: DataFrame, key: str, models: dict[str, str]) -> DataFrame:
    """One row per (key, model) with the model's score."""
    cells = [F.struct(F.lit(name).alias("model"), F.col(c).alias("probability")) for name, c in models.items()]
    return df.select(key, F.explode(F.array(*cells)).alias("m")).select(key, "m.model", "m.probability")


def result_rows(flows: DataFrame) -> DataFrame:
    """The short row consumers get for each analysed flow."""
    return flows.select(*RESULT_COLUMNS)


def _four(c: str) -> Column:
    return F.format_string("%.4f", F.col(c).cast("double"))


def flow_file_rows(flows: DataFrame) -> DataFrame:
    """Columns of the flow file; duration and confidence as text with four decimals."""
    return flows.withColumns({"duration": _four("duration"), "confidence": _four("confidence")}).select(*FLOW_FILE_COLUMNS)


def attack_file_rows(flows: DataFrame) -> DataFrame:
    """Columns of the attack file."""
    return flows.where("is_attack").withColumns(
        {"duration": _four("duration"), "confidence": _four("confidence")}
    ).select(*ATTACK_FILE_COLUMNS)


def attack_log_lines(flows: DataFrame) -> DataFrame:
    """One readable line per attack."""
    return flows.where("is_attack").select(
        F.format_string("[%s] ATTACK: %s:%d -> %s:%d (%.1f%%)", F.col("timestamp").cast("string"), "src_ip", "src_port", "dst_ip",
                        "dst_port", F.col("confidence") * 100.0).alias("value"))
