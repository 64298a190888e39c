"""Train / validation / test splits and deterministic samples.

Every row gets a hash of its key. Exact sizes come from the k-th smallest hash of a class, found
by ``grouped_selection``; after that a split is a look-up in a row per class. Rows with one key
share a hash and stay on one side, so copies cannot leak between splits.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flowloom.functions.hashing import HASH_RANGE, hash_order
from flowloom.functions.lineage import cut
from flowloom.functions.ordered import SMALL, grouped_selection, order_statistics, row_positions

# Default days per split.
TEMPORAL_DAYS = {
    "train": ("Monday", "Tuesday", "Wednesday"),
    "val": ("Thursday",),
    "test": ("Friday",),
}


def temporal_split(df: DataFrame, days: Mapping[str, Sequence[str]] = TEMPORAL_DAYS, day: str = "_day") -> DataFrame:
    """Add ``split`` by weekday; days in no list drop out."""
    if day not in df.columns:
        raise ValueError(f"column {day!r} not found")
    out: Column | None = None
    for name, members in days.items():
        hit = F.col(day).isin(*members)
        out = F.when(hit, name) if out is None else out.when(hit, name)
    return df.withColumn("split", out).where("split is not null")


def _shares(sizes: DataFrame, wanted: Column, name: str) -> DataFrame:
    """Add whole numbers that add up to ``wanted`` in proportion to column ``n`` (largest remainder, then the smaller stratum)."""
    everything = Window.partitionBy()
    exact = wanted * F.col("n") / F.sum("n").over(everything)
    out = sizes.withColumn("_exact", exact).withColumn("_whole", F.floor("_exact"))
    rank = F.row_number().over(Window.orderBy((F.col("_exact") - F.col("_whole")).desc(), "stratum"))
    left = wanted - F.sum("_whole").over(everything)
    return out.withColumns({"_rank": rank, "_left": left}).select("*", (F.col("_whole") + (F.col("_rank") <= F.col("_left")).cast("long")).alias(name)).drop("_exact", "_whole", "_rank", "_left")


def stratified_split(
    df: DataFrame,
    key: Sequence[str],
    stratum: str | None = "label_binary",
    test_size: float = 0.15,
    val_size: float = 0.15,
    seed: int = 42,
) -> DataFrame:
    """Add ``split`` with exact sizes per class; without ``stratum`` (or its column) one class.

    Sizes and borders are tables with a row per class, so there may be any number of classes.
    """
    hashed = df.withColumn("_h", hash_order(key, seed))
    # One class for all rows is a column as well, so that the join below has a key.
    hashed = hashed.withColumn("_stratum", F.col(stratum) if stratum in df.columns else F.pmod("_h", F.lit(1)))
    # Class and hash are all the search needs.
    narrow = cut(hashed.select(F.col("_stratum").alias("stratum"), "_h"))
    everything = Window.partitionBy()
    sizes = narrow.groupBy("stratum").agg(F.count(F.lit(1)).alias("n"))
    sizes = _shares(sizes, F.ceil(F.sum("n").over(everything) * F.lit(test_size)), "test")
    left = sizes.select("stratum", "test", (F.col("n") - F.col("test")).alias("n"))
    left = _shares(left, F.ceil(F.sum("n").over(everything) * F.lit(val_size) / F.lit(1 - test_size)), "val")
    ends = cut(left.select("stratum", (F.col("test") - 1).alias("last_test"), (F.col("test") + F.col("val") - 1).alias("last_val")))
    found = grouped_selection(narrow, "_h", ends.select("stratum", F.array_distinct(F.array("last_test", "last_val")).alias("ranks")), ["stratum"])
    on = F.col("e.stratum").eqNullSafe(F.col("f.stratum"))
    hit = {n: F.max(F.when(F.col("f.rank") == F.col(f"e.{n}"), F.col("f._h"))) for n in ("last_test", "last_val")}
    borders = ends.alias("e").join(found.alias("f"), on, "left").groupBy(F.col("e.stratum").alias("_s")).agg(*[F.coalesce(c, F.lit(-1).cast("long")).alias(f"_{n}") for n, c in hit.items()])
    part = F.when(F.col("_h") <= F.col("_last_test"), "test").when(F.col("_h") <= F.col("_last_val"), "val").otherwise("train")
    # One row a class: Spark sends it to the rows when it is small.
    joined = hashed.join(cut(borders), F.col("_stratum").eqNullSafe(F.col("_s")))
    return joined.select(*[F.col(f"`{c}`") for c in df.columns if c != "split"], part.alias("split"))


def sample_fraction(df: DataFrame, fraction: float, key: Sequence[str], seed: int = 42) -> DataFrame:
    """About ``fraction`` of the rows, the same rows on every run."""
    return df.where(hash_order(key, seed) < F.lit(int(fraction * HASH_RANGE)))


def sample_rows(df: DataFrame, n: int, key: Sequence[str], seed: int = 42, small: int = SMALL) -> DataFrame:
    """The ``n`` rows with the smallest key hash, or all rows when there are fewer.

    Rows that share the last hash are told apart by a hash of all their columns; of equal rows any will do.
    """
    h = hash_order(key, seed)
    total = df.count()
    if total <= n:
        return df
    last = order_statistics(df, {"h": h}, {"h": [n - 1]}, {"h": total}, small)["h", n - 1]
    last = F.lit(int(last))
    below, at = df.agg(F.count_if(h < last), F.count_if(h == last)).first()
    if below + at == n:
        return df.where(h <= last)
    # Rows with one key: positions among them, found in ranges.
    ties = df.where(h == last).withColumn("_tie", F.xxhash64(*[F.col(f"`{c}`") for c in df.columns]))
    ties = row_positions(ties, ["_tie"], "_place").where(F.col("_place") < n - below).drop("_tie", "_place")
    return df.where(h < last).unionByName(ties)


def shuffled(df: DataFrame, key: Sequence[str], seed: int = 42) -> DataFrame:
    """Rows in hash order (a range-partitioned sort)."""
    return df.orderBy(hash_order(key, seed), *key)


def sample_positives(df: DataFrame, n: int, label: str, key: Sequence[str], seed: int = 42) -> DataFrame:
    """``n`` attack rows, all of them when there are fewer."""
    return sample_rows(df.where(F.col(label) == 1), n, key, seed)


def split_summary(df: DataFrame) -> DataFrame:
    """Rows, share, class counts per split."""
    per = df.groupBy("split").agg(
        F.count(F.lit(1)).alias("rows"),
        F.count_if(F.col("label_binary") == 0).alias("benign"),
        F.count_if(F.col("label_binary") == 1).alias("attack"),
        F.count_distinct("label_multiclass").alias("classes"),
    )
    total = F.sum("rows").over(Window.partitionBy())
    return per.select(
        "split", "rows", (F.lit(100.0) * F.col("rows") / total).alias("percent"), "benign", "attack",
        (F.lit(100.0) * F.col("benign") / F.col("rows")).alias("benign_percent"),
        (F.lit(100.0) * F.col("attack") / F.col("rows")).alias("attack_percent"), "classes",
    )


def split_balance(df: DataFrame) -> DataFrame:
    """Largest difference of attack shares between splits, with a verdict."""
    shares = df.groupBy("split").agg(F.avg((F.col("label_binary") == 1).cast("double")).alias("ratio"))
    gap = shares.agg((F.max("ratio") - F.min("ratio")).alias("max_diff"))
    return gap.withColumn(
        "verdict",
        F.when(F.col("max_diff") < 0.05, "balanced").when(F.col("max_diff") < 0.15, "minor").otherwise("significant"),
    )


def split_distributions(df: DataFrame) -> DataFrame:
    """Rows per split, per binary class and per class number, in one scan."""
    return (
        df.groupingSets(
            [["split"], ["split", "label_binary"], ["split", "label_multiclass"]],
            "split", "label_binary", "label_multiclass",
        )
        .agg(F.grouping_id().alias("_g"), F.count(F.lit(1)).alias("rows"))
        .select(
            "split",
            F.when(F.col("_g") == 3, "all").when(F.col("_g") == 1, "binary").otherwise("multiclass").alias("kind"),
            F.coalesce("label_binary", "label_multiclass").alias("label"),
            "rows",
        )
    )
