"""Data-quality audit of wide flow tables.

Each check is one aggregate over all columns, turned into rows afterwards; no column is scanned
on its own.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flowloom.functions.ordered import finite, quantiles
from flowloom.operators.columns import is_meta, numeric_columns
from flowloom.operators.labels import DAYS

INF = math.inf


def _rows(df: DataFrame, structs: Sequence[Column]) -> DataFrame:
    """One aggregate whose structs become rows."""
    return df.agg(F.array(*structs).alias("r")).select(F.explode("r").alias("r")).select("r.*")


def _is_missing(df: DataFrame, name: str) -> Column:
    c = F.col(f"`{name}`")
    floating = isinstance(df.schema[name].dataType, (T.DoubleType, T.FloatType))
    return c.isNull() | F.isnan(c) if floating else c.isNull()


def basic_stats(df: DataFrame) -> DataFrame:
    """Rows, columns and columns per type."""
    kinds: dict[str, int] = {}
    for _, t in df.dtypes:
        kinds[t] = kinds.get(t, 0) + 1
    cells = [F.struct(F.lit(t).alias("dtype"), F.lit(n).alias("columns"), F.count(F.lit(1)).alias("total_rows"),
                      F.lit(len(df.columns)).alias("total_columns")) for t, n in sorted(kinds.items())]
    return _rows(df, cells)


def missing_values(df: DataFrame) -> DataFrame:
    """Null or NaN cells per column that has any."""
    cells = [
        F.struct(F.lit(c).alias("column"), F.count_if(_is_missing(df, c)).alias("count"),
                 F.count(F.lit(1)).alias("_n")) for c in df.columns
    ]
    return (
        _rows(df, cells)
        .where(F.col("count") > 0)
        .select("column", "count", F.round(F.lit(100.0) * F.col("count") / F.col("_n"), 4).alias("percent"))
        .orderBy(F.desc("count"), "column")
    )


def infinities(df: DataFrame) -> DataFrame:
    """Positive and negative infinities per numeric column that has any."""
    cells = []
    for c in numeric_columns(df, meta=True):
        x = F.col(c).cast("double")
        cells.append(F.struct(
            F.lit(c).alias("column"), F.count_if(x == F.lit(INF)).alias("positive_inf"),
            F.count_if(x == F.lit(-INF)).alias("negative_inf"), F.count(F.lit(1)).alias("_n")))
    total = F.col("positive_inf") + F.col("negative_inf")
    return (
        _rows(df, cells)
        .where(total > 0)
        .select("column", "positive_inf", "negative_inf", total.alias("total"),
                F.round(F.lit(100.0) * total / F.col("_n"), 4).alias("percent"))
    )


def duplicate_rows(df: DataFrame) -> DataFrame:
    """Rows that repeat an earlier one, over all columns and over the non-meta columns."""
    plain = [c for c in df.columns if not is_meta(c)]
    whole = df.groupBy(*df.columns).count()
    per_plain = whole.groupBy(*plain).agg(F.sum("count").alias("n"), F.count(F.lit(1)).alias("kinds"))
    return per_plain.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("total_rows"),
        F.coalesce(F.sum(F.col("n") - F.col("kinds")), F.lit(0)).alias("full_duplicates"),
        F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("without_meta"),
    )


def label_distribution(df: DataFrame, label: str) -> DataFrame:
    """Rows and share per label, most frequent first; the share counts unlabelled rows too."""
    per = df.groupBy(label).agg(F.count(F.lit(1)).alias("count"))
    total = F.sum("count").over(Window.partitionBy())
    return (
        per.select(label, "count", F.round(F.lit(100.0) * F.col("count") / total, 2).alias("percent"))
        .where(F.col(label).isNotNull())
        .orderBy(F.desc("count"), label)
    )


def extreme_columns(df: DataFrame, first: int | None = None) -> DataFrame:
    """Columns whose extremes lie far outside their 1 % and 99 % quantiles."""
    cols = numeric_columns(df, meta=True)[:first]
    found = quantiles(df, {c: finite(c) for c in cols}, [0.01, 0.99])
    cells = []
    for c in cols:
        low, high = found[c]
        if low is None:
            continue
        top, bottom = F.max(finite(c)), F.min(finite(c))
        hit = top > F.lit(high * 100)
        if low != 0:
            hit = hit | (bottom < F.lit(low * 100))
        cells.append(F.struct(F.lit(c).alias("column"), bottom.alias("min"), top.alias("max"),
                              F.lit(low).alias("q01"), F.lit(high).alias("q99"), hit.alias("extreme")))
    return _rows(df, cells)


def repeated_names(header: Sequence[str], similar: str = "Fwd Header Length") -> dict[str, list[str]]:
    """Header checks: repeated names, else several names that share a stem."""
    names = [h.strip() for h in header]
    repeated = sorted({h for h in names if names.count(h) > 1})
    alike = [h for h in names if similar in h]
    return {"repeated": repeated, "similar": alike if not repeated and len(alike) > 1 else []}


def issues(df: DataFrame, first: int | None = None) -> DataFrame:
    """The findings above as text rows; only findings that apply appear."""
    missing = missing_values(df).agg(F.count(F.lit(1)).alias("n")).select(
        F.lit(1).alias("ord"), F.when(F.col("n") > 0, F.format_string("Found %d columns with NaN values", "n")).alias("issue"))
    infinite = infinities(df).agg(F.count(F.lit(1)).alias("n")).select(
        F.lit(2).alias("ord"), F.when(F.col("n") > 0, F.format_string("Found %d columns with Inf values", "n")).alias("issue"))
    share = F.lit(100.0) * F.col("full_duplicates") / F.col("total_rows")
    copies = duplicate_rows(df).select(
        F.lit(3).alias("ord"),
        F.when(F.col("full_duplicates") > 0, F.format_string(
            "Found %,d duplicate rows (%.1f%%)", F.col("full_duplicates"), share)).alias("issue"))
    extreme = extreme_columns(df, first).where("extreme").agg(F.array_sort(F.collect_list("column")).alias("c")).select(
        F.lit(5).alias("ord"),
        F.when(F.size("c") > 0, F.concat(F.lit("Columns with extreme outliers: "),
                                          F.concat_ws(", ", F.slice("c", 1, 5)))).alias("issue"))
    return missing.unionByName(infinite).unionByName(copies).unionByName(extreme).where("issue is not null")


def feature_stats(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Per feature over its finite values: extremes, moments, quantiles, and what was left out."""
    found = quantiles(df, {c: finite(c) for c in cols}, [0.01, 0.5, 0.99])
    cells = []
    for c in cols:
        x, raw = finite(c), F.col(c).cast("double")
        low, mid, high = found[c]
        if mid is None:
            continue
        cells.append(F.struct(
            F.lit(c).alias("feature"), F.lit(dict(df.dtypes)[c]).alias("dtype"),
            F.min(x).alias("min"), F.max(x).alias("max"), F.avg(x).alias("mean"),
            F.coalesce(F.stddev_samp(x), F.lit(0.0)).alias("std"), F.lit(mid).alias("median"), F.lit(low).alias("q01"),
            F.lit(high).alias("q99"), F.count_if(_is_missing(df, c)).alias("null_count"),
            F.count_if(F.abs(raw) == F.lit(INF)).alias("inf_count")))
    return _rows(df, cells)


def weekday_traffic(df: DataFrame, label: str, day: str = "_day") -> DataFrame:
    """Benign and attack rows per weekday, in week order."""
    order = F.array_position(F.array(*[F.lit(d) for d in DAYS]), F.col(day))
    kind = F.when(F.col(label) != "BENIGN", "Attack").otherwise("Benign")
    return (
        df.where(F.col(label).isNotNull() & F.col(day).isin(*DAYS))
        .select(F.col(day).alias("day"), order.cast("int").alias("day_ord"), kind.alias("kind"))
        .groupBy("day", "day_ord")
        .pivot("kind", ["Benign", "Attack"])
        .count()
        .fillna(0)
        .withColumnsRenamed({"Benign": "benign", "Attack": "attack"})
        .orderBy("day_ord")
    )


def top_variance(df: DataFrame, cols: Sequence[str], k: int = 30) -> list[str]:
    """The ``k`` columns with the largest variance; columns with infinities have none and come last."""
    if len(cols) <= k:
        return list(cols)
    row = df.agg(*[F.var_samp(F.nanvl(F.col(c).cast("double"), F.lit(None))).alias(f"v{i}") for i, c in enumerate(cols)]).first()

    def size(i: int) -> float:
        v = row[f"v{i}"]
        return -INF if v is None or math.isnan(v) else v

    ranked = sorted(range(len(cols)), key=lambda i: (-size(i), i))
    return [cols[i] for i in ranked[:k]]


def correlations(df: DataFrame, cols: Sequence[str], k: int = 30) -> DataFrame:
    """Pearson correlation of every column pair over rows where both are finite, in one aggregate; null where one is constant."""
    chosen = top_variance(df, cols, k)
    cells = []
    for i, a in enumerate(chosen):
        for b in chosen[i:]:
            x, y = F.when(finite(b).isNotNull(), finite(a)), F.when(finite(a).isNotNull(), finite(b))
            # Spark's own corr divides by zero, an error in ANSI mode, where a column is constant.
            r = F.try_divide(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y))
            cells.append(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.when(~F.isnan(r), r).alias("corr")))
    return _rows(df, cells)


def histograms(df: DataFrame, cols: Sequence[str], bins: int = 30) -> DataFrame:
    """Equal-width histograms of values pulled into their 1 % to 99 % range."""
    found = quantiles(df, {c: finite(c) for c in cols}, [0.01, 0.99])
    cells = []
    for c in cols:
        low, high = found[c]
        if low is None:
            continue
        x = F.least(F.greatest(finite(c), F.lit(low)), F.lit(high))
        width = (high - low) / bins
        bin_no = F.least(F.floor((x - F.lit(low)) / F.lit(width)), F.lit(bins - 1)) if width > 0 else F.when(x.isNotNull(), F.lit(0))
        cells.append(F.when(finite(c).isNotNull(), F.struct(
            F.lit(c).alias("feature"), bin_no.cast("int").alias("bin"), F.lit(low).alias("low"), F.lit(high).alias("high"))))
    per = (
        df.select(F.explode(F.array(*cells)).alias("r"))
        .where("r is not null")
        .groupBy("r.feature", "r.bin", "r.low", "r.high")
        .agg(F.count(F.lit(1)).alias("count"))
    )
    width = (F.col("high") - F.col("low")) / F.lit(bins)
    return per.select("feature", "bin", (F.col("low") + width * F.col("bin")).alias("bin_start"), "count")
