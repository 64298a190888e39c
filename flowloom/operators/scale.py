"""Feature scaling with fitted parameters as a small table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.feature import SQLTransformer
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowloom.functions.ordered import quantiles
from flowloom.operators.clean import replace_columns

KINDS = ("standard", "robust", "minmax")
Params = dict[str, tuple[float, float]]


def fit_scaler(df: DataFrame, cols: Sequence[str], kind: str = "robust") -> Params:
    """(centre, divisor) per feature from one aggregate; a divisor of 0 counts as 1."""
    if kind == "robust":
        found = quantiles(df, {c: F.col(c).cast("double") for c in cols}, [0.25, 0.5, 0.75])
        raw = {c: (mid, None if mid is None else high - low) for c, (low, mid, high) in found.items()}
    elif kind in KINDS:
        pair = (F.avg, F.stddev_pop) if kind == "standard" else (F.min, F.max)
        row = df.agg(*[f(F.col(c).cast("double")).alias(f"{k}{i}") for i, c in enumerate(cols) for k, f in zip("ab", pair)]).first()
        raw = {c: (row[f"a{i}"], row[f"b{i}"]) for i, c in enumerate(cols)}
        if kind == "minmax":
            raw = {c: (a, None if a is None else b - a) for c, (a, b) in raw.items()}
    else:
        raise ValueError(f"unknown scaler: {kind}")
    return {c: (0.0 if a is None else float(a), float(b) if b else 1.0) for c, (a, b) in raw.items()}


def apply_scaler(df: DataFrame, params: Params | None) -> DataFrame:
    """Scale with stored parameters."""
    if params is None:
        raise ValueError("fitted parameters are required")
    return replace_columns(
        df, {c: (F.col(c).cast("double") - F.lit(a)) / F.lit(b) for c, (a, b) in params.items() if c in df.columns}
    )


def params_frame(spark: SparkSession, params: Params) -> DataFrame:
    """Parameters as a table (one row per feature)."""
    rows = [(c, a, b) for c, (a, b) in params.items()]
    return spark.createDataFrame(rows, "feature string, centre double, divisor double")


def params_from_frame(frame: DataFrame) -> Params:
    """Read parameters back; one row per feature, so the table is as small as the schema."""
    return {r["feature"]: (r["centre"], r["divisor"]) for r in frame.collect()}


def scaled_name(column: str) -> str:
    """Name of the scaled twin of a feature inside a model pipeline."""
    return f"{column}__scaled"


def scaler_stage(params: Params) -> SQLTransformer:
    """The fitted scaler as a pipeline stage, saved and loaded together with the model."""
    cells = ", ".join(
        f"(CAST(`{c}` AS DOUBLE) - CAST('{a!r}' AS DOUBLE)) / CAST('{b!r}' AS DOUBLE) AS `{scaled_name(c)}`" for c, (a, b) in params.items()
    )
    return SQLTransformer(statement=f"SELECT *, {cells} FROM __THIS__")
