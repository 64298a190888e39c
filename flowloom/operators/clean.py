"""Cleaning of labelled flow tables.

Statistics come from a few aggregates over all columns at once; the rows themselves are only
filtered and projected. NaN becomes null first, because quantiles and means skip only nulls.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flowloom.functions.lineage import cut
from flowloom.functions.ordered import between, finite, no_nan, order_statistics, quantiles
from flowloom.operators.columns import drop_copied_columns, is_meta, numeric_columns

INF = math.inf


@dataclass(frozen=True)
class CleanRules:
    """What to do with bad cells; the defaults are those of the labelled data set."""

    label: str = "label"
    drop_duplicates: bool = True
    infinities: str = "nan"
    missing: str = "median"
    clip: bool = True
    lower: float = 0.001
    upper: float = 0.999
    copy_mark: str = ".1"


def replace_columns(df: DataFrame, new: Mapping[str, Column]) -> DataFrame:
    """One projection that swaps some columns and keeps the order."""
    return df.select(*[new[c].alias(c) if c in new else F.col(f"`{c}`") for c in df.columns])


def nan_to_null(df: DataFrame) -> DataFrame:
    """NaN to null in every floating column."""
    return replace_columns(
        df,
        {
            f.name: F.nanvl(F.col(f"`{f.name}`"), F.lit(None).cast(f.dataType))
            for f in df.schema.fields
            if isinstance(f.dataType, (T.DoubleType, T.FloatType))
        },
    )


def drop_unlabelled(df: DataFrame, label: str) -> DataFrame:
    """Drop rows without a label."""
    return df.where(F.col(label).isNotNull())


def keep_first(df: DataFrame) -> DataFrame:
    """Drop rows that repeat all non-meta columns; the smallest meta values stand for "first".

    One aggregation, so copies are combined before the shuffle and a large group of copies
    never gathers in one task.
    """
    meta = [c for c in df.columns if is_meta(c)]
    keys = [c for c in df.columns if not is_meta(c)]
    if not meta:
        return df.distinct()
    first = df.groupBy(*keys).agg(F.min(F.struct(*meta)).alias("_first"))
    return first.select(*[F.col(f"_first.{c}").alias(c) if c in meta else F.col(c) for c in df.columns])


def replace_infinities(df: DataFrame, cols: Sequence[str], strategy: str) -> DataFrame:
    """Infinite cells: to null, to the finite extremes (``clip``), or to the finite median."""
    if strategy == "nan":
        return replace_columns(
            df, {c: F.when(F.abs(F.col(c)) == F.lit(INF), F.lit(None)).otherwise(F.col(c)) for c in cols}
        )
    if strategy == "clip":
        row = df.agg(
            *[f(finite(c)).alias(f"{k}{i}") for i, c in enumerate(cols) for k, f in (("a", F.min), ("z", F.max))]
        ).first()
        low = {c: row[f"a{i}"] for i, c in enumerate(cols)}
        high = {c: row[f"z{i}"] for i, c in enumerate(cols)}
    elif strategy == "median":
        mid = quantiles(df, {c: finite(c) for c in cols}, [0.5])
        low = high = {c: mid[c][0] for c in cols}
    else:
        raise ValueError(f"unknown rule for infinities: {strategy}")
    return replace_columns(
        df,
        {
            c: F.when(F.col(c) == F.lit(INF), F.lit(high[c]))
            .when(F.col(c) == F.lit(-INF), F.lit(low[c]))
            .otherwise(F.col(c))
            for c in cols
            if low[c] is not None
        },
    )


def fill_missing(df: DataFrame, cols: Sequence[str], strategy: str) -> DataFrame:
    """Null cells: column median or mean (0 when the column is empty), zero, or drop the row."""
    if strategy == "drop":
        return df.dropna(subset=list(cols))
    if strategy == "zero":
        fill = {c: 0.0 for c in cols}
    elif strategy == "median":
        fill = {c: v[0] for c, v in quantiles(df, {c: no_nan(c) for c in cols}, [0.5]).items()}
    elif strategy == "mean":
        row = df.agg(*[F.avg(no_nan(c)).alias(f"m{i}") for i, c in enumerate(cols)]).first()
        fill = {c: row[f"m{i}"] for i, c in enumerate(cols)}
    else:
        raise ValueError(f"unknown rule for missing cells: {strategy}")
    return _filled(df, fill)


def _filled(df: DataFrame, fill: Mapping[str, float | None]) -> DataFrame:
    return replace_columns(df, {c: F.coalesce(F.col(c), F.lit(0.0 if x is None else x)) for c, x in fill.items()})


def clip_bounds(df: DataFrame, cols: Sequence[str], lower: float, upper: float) -> dict[str, tuple[float, float]]:
    """Quantile bounds per column; columns with no spread are left out."""
    found = quantiles(df, {c: no_nan(c) for c in cols}, [lower, upper])
    return {c: (a, b) for c, (a, b) in found.items() if a is not None and b is not None and a < b}


def median_and_bounds(df: DataFrame, cols: Sequence[str], lower: float, upper: float) -> tuple[dict[str, float | None], dict[str, tuple[float, float]]]:
    """What ``fill_missing`` with medians, and ``clip_bounds`` of the result, would find, by one search.

    Filling puts copies of the median into the middle of the sorted values. So every rank of the filled column is a rank of
    the values, or the median, and which one follows from two counts.
    """
    if not cols:
        return {}, {}
    exprs = {c: no_nan(c) for c in cols}
    row = df.agg(F.count(F.lit(1)).alias("n"), *[F.count(x).alias(f"n{i}") for i, x in enumerate(exprs.values())]).first()
    rows, counts = row["n"], {c: row[f"n{i}"] for i, c in enumerate(cols)}

    def place(c: str, rank: int) -> int | None:
        """Rank among the values of a rank in the filled column; None: the median."""
        left, added = (counts[c] + 1) // 2, rows - counts[c]
        return rank if rank < left else rank - added if rank >= left + added else None

    spots = [(rows - 1) * p for p in (lower, upper)]
    ends = [(math.floor(s), math.ceil(s)) for s in spots]
    ranks = {}
    for c in cols:
        wanted = {(counts[c] - 1) // 2, counts[c] // 2, *(place(c, r) for pair in ends for r in pair)} if counts[c] else set()
        ranks[c] = sorted(wanted - {None})
    known = order_statistics(df, exprs, ranks, counts)
    fill, bounds = {}, {}
    for c in cols:
        if not counts[c]:
            fill[c] = None
            continue
        fill[c] = between(known[c, (counts[c] - 1) // 2], known[c, counts[c] // 2], (counts[c] - 1) / 2)
        pairs = [[fill[c] if (at := place(c, r)) is None else known[c, at] for r in pair] for pair in ends]
        low, high = (between(*pair, s) for pair, s in zip(pairs, spots, strict=True))
        if low < high:
            bounds[c] = low, high
    return fill, bounds


def clip_outliers(df: DataFrame, bounds: Mapping[str, tuple[float, float]]) -> DataFrame:
    """Pull values into the bounds; nulls stay null."""
    return replace_columns(
        df,
        {
            c: F.when(F.col(c) < a, F.lit(a)).when(F.col(c) > b, F.lit(b)).otherwise(F.col(c))
            for c, (a, b) in bounds.items()
        },
    )


def count_clipped(df: DataFrame, bounds: Mapping[str, tuple[float, float]]) -> DataFrame:
    """Rows per column that lie outside the bounds."""
    cells = [
        F.struct(F.lit(c).alias("feature"), F.lit(a).alias("lower"), F.lit(b).alias("upper"),
                 F.count_if((F.col(c) < a) | (F.col(c) > b)).alias("clipped"))
        for c, (a, b) in bounds.items()
    ]
    return df.agg(F.array(*cells).alias("r")).select(F.explode("r").alias("r")).select("r.*")


def clean(df: DataFrame, rules: CleanRules = CleanRules()) -> DataFrame:
    """The whole cleaning chain; de-duplicated rows are written once and re-read per statistic."""
    out = drop_unlabelled(nan_to_null(df), rules.label)
    if rules.drop_duplicates:
        out = keep_first(out)
    out = cut(drop_copied_columns(out, rules.copy_mark))
    cols = [c for c in numeric_columns(out)]
    out = replace_infinities(out, cols, rules.infinities)
    if rules.clip and rules.missing == "median":
        fill, bounds = median_and_bounds(out, cols, rules.lower, rules.upper)
        return clip_outliers(_filled(out, fill), bounds)
    out = fill_missing(out, cols, rules.missing)
    if rules.clip:
        out = clip_outliers(out, clip_bounds(out, cols, rules.lower, rules.upper))
    return out


def zero_bad_cells(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Infinite, NaN and null cells to 0, the last step before scaling."""
    return replace_columns(df, {c: F.coalesce(finite(c), F.lit(0.0)) for c in cols})


def coerce_features(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Anything that is not a finite number becomes 0."""
    return replace_columns(
        df, {c: F.coalesce(finite(F.col(c).cast("string").try_cast("double")), F.lit(0.0)) for c in cols}
    )


def bound_live_cells(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Live rule: NaN to 0, infinities to 1e10, everything within 1e15."""
    new = {}
    for c in cols:
        x = F.col(c).cast("double")
        plain = F.when(F.isnan(x), 0.0).when(x == F.lit(INF), 1e10).when(x == F.lit(-INF), -1e10).otherwise(x)
        new[c] = F.greatest(F.least(F.coalesce(plain, F.lit(0.0)), F.lit(1e15)), F.lit(-1e15))
    return replace_columns(df, new)
