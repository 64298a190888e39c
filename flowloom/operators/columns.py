"""Column naming and selection rules."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import types as T

# Columns that identify a flow instead of describing it.
ID_COLUMNS = ("Flow ID", "Source IP", "Destination IP", "Timestamp")
COPY_MARK = ".1"


def strip_names(df: DataFrame) -> DataFrame:
    """Remove blanks around column names."""
    return df.toDF(*[c.strip() for c in df.columns])


def plain_names(df: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """Snake-case names without dots, slashes or blanks, plus the way back to the originals."""
    names: dict[str, str] = {}
    for c in df.columns:
        base = re.sub(r"[^0-9a-z_]+", "_", c.strip().lower().replace("/s", "_per_s")).rstrip("_")
        name, n = base, 1
        while name in names:
            n += 1
            name = f"{base}_{n}"
        names[name] = c
    return df.toDF(*names), names


def is_meta(name: str) -> bool:
    """Columns the pipeline itself added."""
    return name.startswith("_")


def copied_columns(df: DataFrame, mark: str = COPY_MARK) -> list[str]:
    """Columns whose name carries the mark of a repeated header."""
    return [c for c in df.columns if mark in c]


def drop_copied_columns(df: DataFrame, mark: str = COPY_MARK) -> DataFrame:
    """Drop repeated columns."""
    return df.drop(*copied_columns(df, mark))


def numeric_columns(df: DataFrame, meta: bool = False) -> list[str]:
    """Numeric columns in order."""
    return [
        f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType) and (meta or not is_meta(f.name))
    ]


def choose_features(
    df: DataFrame,
    target: str,
    ids: Sequence[str] = ID_COLUMNS,
    mark: str = COPY_MARK,
) -> dict[str, list[str]]:
    """Feature contract from the schema alone: numeric and categorical features, and what was left out."""
    meta = [c for c in df.columns if is_meta(c)]
    copies = copied_columns(df, mark)
    out = [*ids, *meta, target, *copies]
    kept = [c for c in df.columns if c not in out]
    numeric = [c for c in numeric_columns(df, meta=True) if c in kept]
    return {
        "feature_columns": numeric,
        "categorical_columns": [c for c in kept if c not in numeric],
        "drop_columns": out,
        "duplicate_columns": copies,
        "meta_columns": meta,
    }


def require_columns(df: DataFrame, wanted: Sequence[str]) -> list[str]:
    """Match wanted columns exactly or else ignoring case; name up to ten that are missing."""
    folded = {c.lower(): c for c in df.columns}
    found = [c if c in df.columns else folded.get(c.lower()) for c in wanted]
    missing = [c for c, f in zip(wanted, found) if f is None]
    if missing:
        raise KeyError(f"missing columns: {missing[:10]}")
    return [f for f in found if f is not None]


def flat_columns(df: DataFrame) -> DataFrame:
    """Only columns a flat file can hold."""
    nested = (T.ArrayType, T.MapType, T.StructType)
    return df.select(*[f"`{f.name}`" for f in df.schema.fields if not isinstance(f.dataType, nested)])
