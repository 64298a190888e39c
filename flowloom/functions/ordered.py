"""Exact order statistics and running totals without sorting everything in one task.

``order_statistics``  exact k-th smallest values of many expressions at once
``quantiles``         exact linear-interpolated quantiles built on it
``running_totals``    cumulative sums over a total order, globally or per group
``row_positions``     dense 0-based positions in a total order
``trailing_rows``     aggregates over the last n rows
``grouped_selection`` exact k-th smallest values of any number of groups, as a table
``grouped_quantiles`` exact linear-interpolated quantiles of any number of groups, as a table
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Largest number of values one task may rank on its own.
SMALL = 1_000_000
# Accuracy of the quantile sketch that narrows the search.
SKETCH = 10_000


def finite(c: Column | str) -> Column:
    """The value as double, with NaN and both infinities turned into null."""
    x = (F.col(c) if isinstance(c, str) else c).cast("double")
    return F.when(~F.isnan(x) & (F.abs(x) != F.lit(math.inf)), x)


def no_nan(c: Column | str) -> Column:
    """The value as double, with NaN turned into null; infinities stay."""
    x = (F.col(c) if isinstance(c, str) else c).cast("double")
    return F.when(~F.isnan(x), x)


def order_statistics(
    df: DataFrame,
    exprs: Mapping[str, Column],
    ranks: Mapping[str, Sequence[int]],
    counts: Mapping[str, int],
    small: int = SMALL,
) -> dict[tuple[str, int], float]:
    """Value at each 0-based rank of each numeric expression, nulls left out.

    A target is one rank or two neighbouring ones. Each target keeps a bracket of values that
    must contain it. A mergeable sketch proposes a narrower bracket (targets that still share a
    bracket share a sketch), one exact count accepts it, and the loop ends when a bracket holds
    few enough rows to rank. Each round is two aggregates over the data for all targets together.
    """
    targets = [_Target(name, a, b, counts[name]) for name, ks in ranks.items() for a, b in _pairs(ks)]
    while todo := [t for t in targets if t.open(small)]:
        sketches: dict[tuple, list[_Target]] = {}
        for t in todo:
            sketches.setdefault((t.name, t.lo, t.hi), []).append(t)
        aggs = []
        for i, shared in enumerate(sketches.values()):
            spots = [p for t in shared for p in t.near()]
            aggs.append(F.percentile_approx(shared[0].bracket(exprs), F.array(*[F.lit(p) for p in spots]), SKETCH).alias(f"b{i}"))
        proposed = df.agg(*aggs).first()
        checks = []
        for i, shared in enumerate(sketches.values()):
            for k, t in enumerate(shared):
                t.low, t.high = proposed[f"b{i}"][2 * k : 2 * k + 2]
        for i, t in enumerate(todo):
            x = exprs[t.name]
            checks.append(F.count_if(x < F.lit(t.low)).alias(f"l{i}"))
            checks.append(F.count_if((x >= F.lit(t.low)) & (x <= F.lit(t.high))).alias(f"m{i}"))
        seen = df.agg(*checks).first()
        for i, t in enumerate(todo):
            t.narrow(seen[f"l{i}"], seen[f"m{i}"])
    found = {(t.name, k): t.lo for t in targets if t.closed() for k in (t.first, t.last)}
    rest = [t for t in targets if not t.closed()]
    if rest:
        # One row per distinct value in a bracket; copies of a value meet in the map-side count.
        cells = F.array(*[F.struct(F.lit(i).alias("t"), t.bracket(exprs).alias("v")) for i, t in enumerate(rest)])
        values = df.select(F.explode(cells).alias("c")).where("c.v is not null").groupBy("c.t", "c.v").count()
        upto = Window.partitionBy("t").orderBy("v").rowsBetween(Window.unboundedPreceding, 0)

        def at(which: str) -> Column:
            spots = F.array(*[F.lit(getattr(t, which) - t.below) for t in rest])
            return F.min(F.when(F.col("upto") > F.element_at(spots, F.col("t") + 1), F.col("v"))).alias(which)

        picked = values.withColumn("upto", F.sum("count").over(upto)).groupBy("t").agg(at("first"), at("last"))
        for r in picked.collect():
            t = rest[r["t"]]
            found |= {(t.name, t.first): r["first"], (t.name, t.last): r["last"]}
    return found


def _pairs(ranks: Sequence[int]) -> list[tuple[int, int]]:
    """Sorted distinct ranks with direct neighbours paired up."""
    out: list[tuple[int, int]] = []
    for k in sorted(set(ranks)):
        if out and out[-1][0] == out[-1][1] == k - 1:
            out[-1] = (k - 1, k)
        else:
            out.append((k, k))
    return out


class _Target:
    """Search state of one rank (or two neighbours) of one expression."""

    def __init__(self, name: str, first: int, last: int, count: int):
        self.name, self.first, self.last = name, first, last
        self.lo = self.hi = None
        self.low = self.high = None
        self.below, self.inside = 0, count
        self.margin = 3.0 / SKETCH

    def closed(self) -> bool:
        return self.lo is not None and self.lo == self.hi

    def open(self, small: int) -> bool:
        return self.inside > small and not self.closed() and self.margin < 1.0

    def near(self) -> tuple[float, float]:
        a, b = (self.first - self.below) / self.inside, (self.last - self.below) / self.inside
        return max(0.0, a - self.margin), min(1.0, b + self.margin)

    def bracket(self, exprs: Mapping[str, Column]) -> Column:
        x = exprs[self.name]
        cond = x.isNotNull()
        if self.lo is not None:
            cond = cond & (x >= F.lit(self.lo)) & (x <= F.lit(self.hi))
        return F.when(cond, x)

    def narrow(self, less: int, mid: int) -> None:
        holds = less <= self.first and self.last < less + mid
        if holds and (mid < self.inside or self.low == self.high):
            self.lo, self.hi, self.below, self.inside = self.low, self.high, less, mid
        else:
            self.margin *= 4


def between(a: float, b: float, spot: float) -> float:
    """Linear interpolation at ``spot`` between the values at the ranks around it."""
    return a + (b - a) * (spot - math.floor(spot)) if b != a else float(a)


def quantiles(
    df: DataFrame,
    exprs: Mapping[str, Column],
    probs: Sequence[float],
    small: int = SMALL,
) -> dict[str, list[float | None]]:
    """Exact quantiles with linear interpolation, per expression; ``None`` when it has no value.

    Ranks are searched with ``order_statistics``; a bracket of few rows is ranked at once.
    """
    names = list(exprs)
    if not names:
        return {}
    counts = df.agg(*[F.count(exprs[n]).alias(f"n{i}") for i, n in enumerate(names)]).first()
    size = {n: int(counts[f"n{i}"]) for i, n in enumerate(names)}
    ranks: dict[str, list[int]] = {}
    for n in names:
        spots = [(size[n] - 1) * p for p in probs] if size[n] else []
        ranks[n] = sorted({k for s in spots for k in (math.floor(s), math.ceil(s))})
    known = order_statistics(df, exprs, ranks, size, small)
    out: dict[str, list[float | None]] = {}
    for n in names:
        vals: list[float | None] = []
        for p in probs:
            if not size[n]:
                vals.append(None)
                continue
            s = (size[n] - 1) * p
            vals.append(between(known[n, math.floor(s)], known[n, math.ceil(s)], s))
        out[n] = vals
    return out


def with_buckets(df: DataFrame, order: Sequence[str], buckets: int | None = None) -> DataFrame:
    """Cut a total order into about equally full ranges ``(_bucket, _sub)``.

    Ranges follow the first (numeric) order column. A value that alone fills more than a range
    gets a range of its own, which the second order column, if any, cuts further.
    """
    if buckets is None:
        buckets = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    buckets = max(2, buckets)
    probs = F.array(*[F.lit(i / buckets) for i in range(1, buckets)])
    main = F.col(order[0]).cast("double")
    cuts = df.agg(F.percentile_approx(main, probs, SKETCH).alias("c")).first()["c"] or [0.0]
    hot = sorted({a for a, b in zip(cuts, cuts[1:]) if a == b}) if len(order) > 1 else []
    splits = {-math.inf, *cuts, *[math.nextafter(v, math.inf) for v in hot], math.inf}
    cutter = Bucketizer(splits=sorted(splits), inputCol="_cut", outputCol="_bucket", handleInvalid="keep")
    out = cutter.transform(df.withColumn("_cut", main))
    sub = F.lit(0)
    if hot:
        second = F.col(order[1]).cast("double")
        is_hot = F.col("_cut").isin(*hot)
        rows = (
            out.where(is_hot).groupBy("_cut").agg(F.percentile_approx(second, probs, SKETCH).alias("c")).collect()
        )
        table = F.create_map(*[x for r in rows for x in (F.lit(r["_cut"]), F.array(*[F.lit(float(v)) for v in sorted(set(r["c"]))]))])
        sub = F.when(is_hot, F.size(F.filter(F.try_element_at(table, F.col("_cut")), lambda c: c <= second))).otherwise(sub)
    return out.withColumn("_sub", sub).drop("_cut")


def running_totals(
    df: DataFrame,
    order: Sequence[str],
    sums: Mapping[str, Column],
    groups: Sequence[str] = (),
    descending: bool = False,
    buckets: int | None = None,
) -> DataFrame:
    """Add cumulative sums (including the current row) in ``order``, per group if given.

    ``order[0]`` (and ``order[1]`` where ``order[0]`` has very frequent values) must be numeric.
    Rows are cut into ranges of the order, summed inside each range, and shifted by the totals
    of the ranges before. A group that holds most rows is therefore spread over all ranges.
    """
    cut = with_buckets(df, order, buckets)
    cut = cut.select("*", *[e.alias(f"_s_{n}") for n, e in sums.items()])
    spot = ["_bucket", "_sub"]

    def rank(cols: Sequence[str]) -> list[Column]:
        return [F.col(c).desc() if descending else F.col(c) for c in cols]

    upto = Window.partitionBy(*groups, *spot).orderBy(*rank(order)).rowsBetween(Window.unboundedPreceding, 0)
    local = cut.select("*", *[F.sum(f"_s_{n}").over(upto).alias(f"_l_{n}") for n in sums])
    names = [f"_g{i}" for i in range(len(groups))]
    earlier = Window.partitionBy(*names).orderBy(*rank(["_b", "_u"])).rowsBetween(Window.unboundedPreceding, -1)
    totals = cut.groupBy(
        *[F.col(g).alias(n) for g, n in zip(groups, names)], F.col("_bucket").alias("_b"), F.col("_sub").alias("_u")
    ).agg(*[F.sum(f"_s_{n}").alias(f"_t_{n}") for n in sums])
    offsets = totals.select(
        *names, "_b", "_u", *[F.coalesce(F.sum(f"_t_{n}").over(earlier), F.lit(0)).alias(f"_o_{n}") for n in sums]
    )
    on = (F.col("_bucket") == F.col("_b")) & (F.col("_sub") == F.col("_u"))
    for g, n in zip(groups, names):
        on = on & F.col(g).eqNullSafe(F.col(n))
    return local.join(offsets, on).select(
        *df.columns, *[(F.col(f"_l_{n}") + F.col(f"_o_{n}")).alias(n) for n in sums]
    )


def row_positions(
    df: DataFrame, order: Sequence[str], name: str, groups: Sequence[str] = (), first: int = 0
) -> DataFrame:
    """Dense positions in a total order, starting at ``first``."""
    out = running_totals(df, order, {name: F.lit(1).cast("long")}, groups)
    return out.withColumn(name, F.col(name) + F.lit(first - 1).cast("long"))


def trailing_rows(
    df: DataFrame,
    n: int,
    order: Sequence[str],
    aggs: Mapping[str, Column],
    groups: Sequence[str] = (),
    block_rows: int = 500_000,
) -> DataFrame:
    """Add aggregates over each row and the ``n - 1`` rows before it.

    Rows get dense positions, positions are cut into blocks, and a block borrows the last
    ``n - 1`` rows of the block before it, so a single huge group still runs in many tasks.
    """
    block_rows = max(block_rows, n)
    placed = row_positions(df, order, "_pos", groups)
    home = F.floor(F.col("_pos") / F.lit(block_rows))
    lends = F.col("_pos") % F.lit(block_rows) >= F.lit(block_rows - (n - 1))
    spread = placed.select(
        "*",
        home.alias("_home"),
        F.explode(F.when(lends, F.array(home, home + 1)).otherwise(F.array(home))).alias("_block"),
    )
    frame = Window.partitionBy(*groups, "_block").orderBy("_pos").rowsBetween(-(n - 1), 0)
    return (
        spread.select("*", *[e.over(frame).alias(k) for k, e in aggs.items()])
        .where(F.col("_block") == F.col("_home"))
        .select(*df.columns, *aggs)
    )


def _null_safe(left: str, right: str, groups: Sequence[str]) -> Column:
    on = F.lit(True)
    for g in groups:
        on = on & F.col(f"{left}.{g}").eqNullSafe(F.col(f"{right}.{g}"))
    return on


def grouped_selection(df: DataFrame, value: str, wanted: DataFrame, groups: Sequence[str]) -> DataFrame:
    """groups, rank and value: the values of each group at the 0-based ranks of ``wanted`` (groups, ``ranks`` as an array).

    Equal values of a group are counted first; the counts are added up over ranges of values, so neither a large group nor many
    groups meet in a task, and a rank is found where the running count passes it. Nulls are left out; ranks that
    a group does not have give no row.
    """
    counted = df.where(F.col(value).isNotNull()).groupBy(*groups, value).agg(F.count(F.lit(1)).alias("_n"))
    upto = running_totals(counted, [value], {"_upto": F.col("_n")}, groups)
    joined = upto.alias("u").join(wanted.alias("w"), _null_safe("u", "w", groups))
    hit = F.filter("w.ranks", lambda r: (r < F.col("u._upto")) & (r >= F.col("u._upto") - F.col("u._n")))
    return joined.select(*[F.col(f"u.{g}").alias(g) for g in groups], F.explode(hit).alias("rank"), F.col(f"u.{value}").alias(value))


def grouped_quantiles(df: DataFrame, value: str, probs: Sequence[float], names: Sequence[str], groups: Sequence[str]) -> DataFrame:
    """groups and one column a quantile, with linear interpolation; groups without a value are absent."""
    sizes = df.where(F.col(value).isNotNull()).groupBy(*groups).agg(F.count(F.lit(1)).alias("_size"))
    spots = [(F.col("_size") - 1) * F.lit(float(p)) for p in probs]
    ends = [(F.floor(s).cast("long"), F.ceil(s).cast("long")) for s in spots]
    wanted = sizes.select(*groups, "_size", F.array_distinct(F.array(*[c for pair in ends for c in pair])).alias("ranks"))
    found = grouped_selection(df, value, wanted.drop("_size"), groups)
    at = found.groupBy(*groups).agg(F.map_from_entries(F.collect_list(F.struct("rank", value))).alias("_at"))  # two ranks a quantile
    joined = at.alias("a").join(sizes.alias("s"), _null_safe("a", "s", groups)).select(*[F.col(f"a.{g}").alias(g) for g in groups], "a._at", "s._size")
    out = []
    for (low, high), spot, name in zip(ends, spots, names):
        a, b = F.element_at("_at", low), F.element_at("_at", high)
        out.append((a + (b - a) * (spot - low)).cast("double").alias(name))
    return joined.select(*groups, *out)
