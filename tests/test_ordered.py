import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from flowloom.functions import ordered
from flowloom.operators import split


@pytest.fixture(scope="module")
def numbers(spark):
    rng = random.Random(7)
    rows = [(i, rng.gauss(0, 100), float(rng.choice([1, 1, 1, 2, 3])), None if i % 3 else float(i), "hot" if i % 3 else f"g{i % 7}") for i in range(3000)]
    return spark.createDataFrame(rows, "id long, a double, b double, c double, g string").cache()


@pytest.mark.parametrize("small", [1_000_000, 50, 3])
def test_quantiles_are_exact_in_every_path(numbers, small):
    probs = [0.0, 0.001, 0.25, 0.5, 0.77, 0.999, 1.0]
    exprs = {c: F.col(c) for c in "abc"} | {"none": F.lit(None).cast("double")}
    got = ordered.quantiles(numbers, exprs, probs, small)
    rows = numbers.collect()
    for c in "abc":
        vals = sorted(r[c] for r in rows if r[c] is not None)
        for p, q in zip(probs, got[c]):
            s = (len(vals) - 1) * p
            want = vals[math.floor(s)] + (vals[math.ceil(s)] - vals[math.floor(s)]) * (s - math.floor(s))
            assert q == pytest.approx(want, abs=1e-9), (c, p)
    assert got["none"] == [None] * len(probs)


@pytest.mark.parametrize("buckets", [2, 7, 100])
def test_running_totals(numbers, buckets):
    out = ordered.running_totals(numbers, ["id"], {"s": F.lit(1).cast("long"), "t": F.col("id")}, ["g"], buckets=buckets)
    seen = {}
    for r in sorted(out.collect(), key=lambda r: r["id"]):
        n, t = seen.get(r["g"], (0, 0))
        seen[r["g"]] = (n + 1, t + r["id"])
        assert (r["s"], r["t"]) == seen[r["g"]]
    down = ordered.running_totals(numbers, ["id"], {"s": F.lit(1).cast("long")}, descending=True, buckets=buckets)
    assert all(r["s"] == 3000 - r["id"] for r in down.collect())


def test_running_totals_keep_null_groups(spark):
    df = spark.createDataFrame([(1, None), (2, None), (3, "x")], "id long, g string")
    out = ordered.running_totals(df, ["id"], {"s": F.lit(1).cast("long")}, ["g"])
    assert sorted((r["id"], r["s"]) for r in out.collect()) == [(1, 1), (2, 2), (3, 1)]


@pytest.mark.parametrize("block", [5, 13, 10_000])
def test_trailing_rows(numbers, block):
    out = ordered.trailing_rows(numbers, 5, ["id"], {"m": F.max("a"), "k": F.count(F.lit(1))}, ["g"], block_rows=block)
    rows = sorted(out.collect(), key=lambda r: r["id"])
    assert len(rows) == 3000
    past = {}
    for r in rows:
        w = past.setdefault(r["g"], [])
        w.append(r["a"])
        assert (r["m"], r["k"]) == (max(w[-5:]), min(len(w), 5))


@pytest.mark.parametrize("descending", [False, True])
def test_running_totals_split_a_frequent_value(spark, descending):
    """Two thirds of the rows share one order value; the second column cuts them further."""
    df = spark.createDataFrame([(5 if i % 3 else i, i) for i in range(900)], "t long, id long")
    cut = ordered.with_buckets(df, ["t", "id"], 20)
    assert cut.groupBy("_bucket", "_sub").count().agg(F.max("count")).first()[0] < 120
    out = ordered.running_totals(df, ["t", "id"], {"s": F.lit(1).cast("long")}, descending=descending, buckets=20)
    rows = sorted(out.collect(), key=lambda r: (r["t"], r["id"]), reverse=descending)
    assert [r["s"] for r in rows] == list(range(1, 901))


def test_grouped_selection_and_quantiles(spark):
    rng = random.Random(12)
    made = {None: [rng.randrange(40) / 4 for _ in range(301)], "a": [rng.random() for _ in range(2000)], "b": [3.5], "c": [1.0, 2.0], "same": [7.0] * 90}
    rows = [(k, v) for k, vs in made.items() for v in vs] + [("a", None), ("none", None)]
    df = spark.createDataFrame(rows, "g string, v double").repartition(5)
    wanted = spark.createDataFrame([(k, [0, len(vs) // 2, len(vs) - 1, len(vs)]) for k, vs in made.items()], "g string, ranks array<long>")
    got = {(r.g, r.rank): r.v for r in ordered.grouped_selection(df, "v", wanted, ["g"]).collect()}
    assert got == {(k, i): sorted(vs)[i] for k, vs in made.items() for i in {0, len(vs) // 2, len(vs) - 1}}
    probs = (0.0, 0.25, 0.5, 0.99)
    found = {r.g: tuple(r)[1:] for r in ordered.grouped_quantiles(df, "v", probs, ("a", "b", "c", "d"), ["g"]).collect()}
    assert set(found) == set(made)
    for k, vs in made.items():
        assert np.allclose(found[k], np.quantile(vs, probs), rtol=1e-12)


def test_a_split_of_many_strata(spark):
    df = spark.range(6000).select(F.col("id").alias("k"), F.when(F.col("id") % 7 == 0, None).otherwise(F.col("id") % 500).alias("s"), F.lit("x").alias("split"))
    out = split.stratified_split(df, ["k"], "s", 0.2, 0.1)
    assert out.columns == ["k", "s", "split"]
    counts = {r.split: r["count"] for r in out.groupBy("split").count().collect()}
    assert counts == {"test": 1200, "val": 600, "train": 4200}
    per = out.groupBy("s").agg(F.count("*").alias("n"), F.count_if(F.col("split") == "test").alias("t")).collect()
    assert len(per) == 501 and all(abs(r.t - 0.2 * r.n) < 1 for r in per)
    assert split.stratified_split(df.limit(0), ["k"], "s").count() == 0
