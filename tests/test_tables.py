import math
import random

import pytest
from pyspark.sql import functions as F

from flowloom.functions import ordered
from flowloom.operators import audit, clean, columns, evaluate, labels, scale, split
from flowloom.plans.views import view

INF, NAN = math.inf, math.nan


def frame(spark, *values):
    return spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i long, x double")


def xs(df):
    return [r["x"] for r in df.orderBy("i").collect()]


@pytest.mark.parametrize("how,want", [("nan", [None, 1.0, 3.0, None]), ("clip", [3.0, 1.0, 3.0, 1.0]), ("median", [2.0, 1.0, 3.0, 2.0])])
def test_infinities(spark, how, want):
    assert xs(clean.replace_infinities(frame(spark, INF, 1.0, 3.0, -INF), ["x"], how)) == want


@pytest.mark.parametrize("how", ["clip", "median"])
def test_column_of_infinities_stays(spark, how):
    assert xs(clean.replace_infinities(frame(spark, INF, -INF, None), ["x"], how)) == [INF, -INF, None]


@pytest.mark.parametrize("how,want", [("median", [2.0, 1.0, 2.0, 6.0]), ("mean", [3.0, 1.0, 2.0, 6.0]), ("zero", [0.0, 1.0, 2.0, 6.0]), ("drop", [1.0, 2.0, 6.0])])
def test_missing(spark, how, want):
    assert xs(clean.fill_missing(clean.nan_to_null(frame(spark, NAN, 1.0, 2.0, 6.0)), ["x"], how)) == want


def test_empty_and_constant_columns(spark):
    df = frame(spark, None, None)
    assert xs(clean.fill_missing(df, ["x"], "median")) == [0.0, 0.0]
    const = frame(spark, 5.0, 5.0)
    assert clean.clip_bounds(const, ["x"], 0.001, 0.999) == {}
    for kind in scale.KINDS:
        assert xs(scale.apply_scaler(const, scale.fit_scaler(const, ["x"], kind))) == [0.0, 0.0]


def test_rules_are_checked(spark):
    df = frame(spark, 1.0)
    for call in (lambda: clean.fill_missing(df, ["x"], "?"), lambda: clean.replace_infinities(df, ["x"], "?"), lambda: scale.fit_scaler(df, ["x"], "?"),
                 lambda: scale.apply_scaler(df, None), lambda: split.temporal_split(df)):
        with pytest.raises(ValueError):
            call()
    with pytest.raises(KeyError, match="zz"):
        columns.require_columns(df, ["X", "zz"])
    assert columns.require_columns(df, ["X", "i"]) == ["x", "i"]


def test_label_rules(spark):
    texts = ["", "BENIGN", "default", " web attack xss", "Web Attack XSS", "dos hulk!", "Mystery", "DDoS", "dos"]
    df = labels.with_labels(spark.createDataFrame([(t,) for t in texts], "label string"))
    got = {t: (r["label_binary"], r["label_multiclass"]) for t, r in zip(texts, df.collect())}
    # An empty text is part of every name; "dos" is part of the first name that holds it.
    assert got == {"": (1, 0), "BENIGN": (0, 0), "default": (1, 15), " web attack xss": (1, 15), "Web Attack XSS": (1, 9),
                   "dos hulk!": (1, 5), "Mystery": (1, 15), "DDoS": (1, 14), "dos": (1, 3)}


def test_truth_sources(spark):
    binary = spark.createDataFrame([("2", "x"), ("0.9", "x"), (None, "x"), ("a", "x")], "Label_Binary string, Label string")
    df, source = labels.with_ground_truth(binary)
    assert source == "Label_Binary" and [r["y_true"] for r in df.collect()] == [1, 0, 0, 0]
    numeric = spark.createDataFrame([("1",), ("0",), ("0.5",)], "Class string")
    df, source = labels.with_ground_truth(numeric)
    assert source == "Class" and [r["y_true"] for r in df.collect()] == [1, 0, 1]
    text = spark.createDataFrame([(" normal. ",), ("DDoS",), (None,)], "label string")
    assert [r["y_true"] for r in labels.with_ground_truth(text)[0].collect()] == [0, 1, 1]
    assert labels.with_ground_truth(spark.range(1))[1] is None


def test_keep_first_prefers_the_first_file(spark):
    rows = [(1, NAN, "b.csv"), (1, NAN, "a.csv"), (2, 0.0, "c.csv"), (2, -0.0, "d.csv")]
    df = clean.keep_first(spark.createDataFrame(rows, "k long, v double, _source_file string"))
    assert sorted((r["k"], r["_source_file"]) for r in df.collect()) == [(1, "a.csv"), (2, "c.csv")]


def test_split_sizes_are_exact(spark, sf_dir):
    df = view(spark, sf_dir, "labelled")
    out = split.stratified_split(df, ["flow_key"])
    n = df.count()
    sizes = {r["split"]: r["count"] for r in out.groupBy("split").count().collect()}
    assert sizes["test"] == math.ceil(n * 0.15) and sum(sizes.values()) == n
    assert out.groupBy("flow_key").agg(F.count_distinct("split").alias("s")).where("s > 1").count() == 0
    ratios = [r[1] for r in out.groupBy("split").agg(F.avg("label_binary")).collect()]
    assert max(ratios) - min(ratios) < 0.002


def test_split_of_tiny_strata(spark):
    df = spark.createDataFrame([(str(i), int(i == 0)) for i in range(10)], "k string, label_binary int")
    out = split.stratified_split(df, ["k"])
    assert out.count() == 10 and out.where("split = 'test'").count() == 2


def test_samples(spark, sf_dir):
    df = view(spark, sf_dir, "labelled")
    assert split.sample_rows(df, 10, ["flow_key"]).count() == 10
    assert split.sample_rows(df, 10**9, ["flow_key"]).count() == df.count()
    assert split.sample_rows(df, 100, ["flow_key"], small=5).count() == 100
    attacks = split.sample_positives(df, 20, "label_binary", ["flow_key"])
    assert attacks.count() == 20 and attacks.where("label_binary = 0").count() == 0
    assert split.shuffled(df, ["flow_key"]).count() == df.count()


def test_metrics_of_degenerate_input(spark):
    df = spark.createDataFrame([(0, 0, 0.2), (0, 1, 0.9)], "y_true int, prediction int, probability double")
    m = evaluate.binary_metrics(df).first()
    assert (m["precision"], m["recall"], m["f1"], m["accuracy"]) == (0.0, 0.0, 0.0, 0.5)
    a = evaluate.ranking_metrics(df).first()
    assert (a["roc_auc"], a["pr_auc"]) == (0.0, 0.0)
    hist = {r["bin"]: r["count"] for r in evaluate.probability_histogram(df.withColumn("probability", F.lit(1.0))).collect()}
    assert hist[9] == 2 and len(hist) == 10


def test_wide_histogram_and_issues(spark, sf_dir):
    df = view(spark, sf_dir, "flows_raw")
    per = audit.histograms(df, ["bytes_s"], 30).agg(F.sum("count")).first()[0]
    assert per == df.where("isnotnull(bytes_s) and not isnan(bytes_s) and abs(bytes_s) < double('Infinity')").count()
    clean_df = clean.clean(df, clean.CleanRules(copy_mark="_1"))
    assert audit.missing_values(clean_df.drop("label")).count() == audit.infinities(clean_df).count() == 0


def test_samples_are_exact_when_keys_repeat(spark):
    df = spark.range(100).select((F.col("id") % 5).alias("k"), "id", F.lit(1).alias("label_binary"))
    for n in (3, 10, 20, 33):
        assert split.sample_rows(df, n, ["k"]).count() == n
        assert split.sample_positives(df.union(df), n, "label_binary", ["k"]).count() == n


def test_curves_keep_missing_groups_and_end_points(spark):
    df = spark.createDataFrame([(None, 1, 0.9), (None, 0, 0.2), ("a", 1, 0.5)], "g string, y_true int, probability double")
    got = evaluate.curve_points(df, groups=["g"]).collect()
    assert sum(r["g"] is None for r in got) == 3 and sum(r["g"] == "a" for r in got) == 2
    ends = [r for r in got if r["threshold"] == float("inf")]
    assert len(ends) == 2 and all((r["fpr"], r["tpr"], r["precision"]) == (0.0, 0.0, 1.0) for r in ends)


def test_one_search_finds_what_filling_and_clipping_find(spark):
    rnd = random.Random(8)
    shapes = {
        "even": lambda i: float(i * 7 % 100) if i < 100 else None,
        "odd": lambda i: float(i * 7 % 101) if i < 101 else None,
        "sparse": lambda i: float(i) if i % 60 == 0 else None,
        "ties": lambda i: float(rnd.randrange(3)),
        "one": lambda i: 5.0 if i == 3 else None,
        "nothing": lambda i: None,
        "full": lambda i: rnd.gauss(0, 1),
        "nan": lambda i: math.nan if i % 5 == 0 else float(i),
    }
    df = spark.createDataFrame([tuple(f(i) for f in shapes.values()) for i in range(300)], ", ".join(f"`{c}` double" for c in shapes))
    df, cols = clean.nan_to_null(df), list(shapes)
    for lower, upper in ((0.001, 0.999), (0.1, 0.62), (0.3, 0.9)):
        fill, bounds = clean.median_and_bounds(df, cols, lower, upper)
        assert fill == {c: v[0] for c, v in ordered.quantiles(df, {c: F.col(c) for c in cols}, [0.5]).items()}
        assert bounds == clean.clip_bounds(clean.fill_missing(df, cols, "median"), cols, lower, upper)
    assert clean.median_and_bounds(df.limit(0), cols, 0.1, 0.9) == (dict.fromkeys(cols), {})
    assert clean.median_and_bounds(df, [], 0.1, 0.9) == ({}, {})
