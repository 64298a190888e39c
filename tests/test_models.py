import pytest
from pyspark.sql import functions as F

from flowloom.operators import models
from flowloom.plans.model_plans import SMALL, _parts

SPECS = [SMALL["m1_random_forest"], SMALL["m3_network"]]


@pytest.fixture(scope="module")
def parts(spark, sf_dir):
    return _parts(spark, sf_dir)


def test_sweep_save_load_and_ensemble(spark, parts, tmp_path):
    splits, contract = parts
    results, fitted = models.sweep(SPECS, splits, contract, "y_true")
    rows = results.collect()
    assert [r["name"] for r in rows] == [r["name"] for r in sorted(rows, key=lambda r: (-r["val_f1"], r["name"]))]
    assert all(0 <= r[m] <= 1 for r in rows for m in ("val_f1", "test_f1", "val_roc_auc", "test_pr_auc"))
    name, best = models.best_model(results, fitted)
    path = models.save(best, str(tmp_path / "best"))
    again = models.predict(models.load(path), splits["test"]).select("vec_id", "probability").orderBy("vec_id").collect()
    assert again == models.predict(best, splits["test"]).select("vec_id", "probability").orderBy("vec_id").collect()

    members = [fitted["RF"], fitted["NN"]]
    models.save_ensemble(members, [3.0, 1.0], str(tmp_path / "ens"))
    loaded, weights = models.load_ensemble(str(tmp_path / "ens"))
    assert weights == [0.75, 0.25]
    soft = {r["vec_id"]: r for r in models.ensemble(loaded, splits["test"], weights).collect()}
    single = [{r["vec_id"]: r["probability"] for r in models.predict(m, splits["test"]).collect()} for m in members]
    for k, r in soft.items():
        p = 0.75 * single[0][k] + 0.25 * single[1][k]
        assert r["probability"] == pytest.approx(p)
        assert r["prediction"] == int(p > 1 - p)
    hard = {r["vec_id"]: r["prediction"] for r in models.ensemble([*members, members[0]], splits["test"], voting="hard").collect()}
    assert hard == {r["vec_id"]: r["prediction"] for r in models.predict(members[0], splits["test"], 0.5 + 1e-12).collect()}
    info = models.describe(fitted["RF"], contract)
    assert (info["model_type"], info["n_estimators"], info["max_depth"]) == ("RandomForestClassificationModel", 20, 5)
    imp = models.importances(fitted["RF"], contract)
    assert imp.count() == len(contract)
    assert imp.agg(F.sum("importance")).first()[0] == pytest.approx(1.0)


def test_multiclass_forest_and_one_vs_rest(spark, parts, sf_dir):
    from flowloom.plans.views import table
    from pyspark.ml.functions import array_to_vector

    df = table(spark, sf_dir, "embeddings").select(array_to_vector(F.col("embedding").cast("array<double>")).alias("features"), (F.col("label") % 3).cast("int").alias("y"))
    contract = parts[1]
    forest = models.fit(models.ModelSpec("RF", "forest", {"numTrees": 5, "maxDepth": 3}, True), df, contract, "y")
    assert len(models.probabilities(forest, df).first()["probabilities"]) == 3
    boosted = models.fit(models.ModelSpec("G", "boosted", {"maxIter": 2, "maxDepth": 2}), df, contract, "y")
    assert {r[0] for r in boosted.transform(df).select("prediction").distinct().collect()} <= {0.0, 1.0, 2.0}
    for model in (forest, boosted):
        native = [int(r[0]) for r in model.transform(df).select("prediction").collect()]
        got = models.predict(model, df).collect()
        assert [r["prediction"] for r in got] == native
        for r in got:
            assert sum(r["probabilities"]) == pytest.approx(1.0) and r["probability"] == pytest.approx(1 - r["probabilities"][0])
            assert r["is_attack"] == (r["prediction"] != 0)


def test_scaler_travels_with_the_model(spark, sf_dir, tmp_path):
    from flowloom.operators import scale
    from flowloom.plans.views import view

    df, cols = view(spark, sf_dir, "labelled"), ["fwd_len", "bytes_s", "iat_mean"]
    params = scale.fit_scaler(df, cols, "standard")
    spec = models.ModelSpec("NN", "network", {"hidden": [4], "maxIter": 5})
    inside = models.fit(spec, df, cols, "label_binary", classes=2, scaler=params)
    outside = models.fit(spec, scale.apply_scaler(df, params), cols, "label_binary", classes=2)
    inside = models.load(models.save(inside, str(tmp_path / "m")))
    a = models.predict(inside, df)
    b = models.predict(outside, scale.apply_scaler(df, params))
    assert "fwd_len__scaled" not in a.columns
    pick = ("flow_key", "probability")
    assert sorted(map(tuple, a.select(*pick).collect())) == sorted(map(tuple, b.select(*pick).collect()))


def test_boosted_trees_stop_on_validation_rows(spark, sf_dir):
    from flowloom.plans.views import view

    rows = view(spark, sf_dir, "labelled").withColumn("noise", (F.xxhash64("flow_key") % 2 != 0).cast("int"))
    train, val = rows.where("_day = 'Monday'"), rows.where("_day = 'Friday'")
    spec = models.ModelSpec("G", "boosted", {"maxIter": 15, "maxDepth": 3}, True)
    model = models.fit(spec, train, ["fwd_len", "bytes_s"], "noise", classes=2, validation=val)
    assert len(model.stages[-1].trees) < 15
    assert models.predict(model, val).count() == val.count()


def test_permutation_importances_agree_with_a_plain_exchange(spark, sf_dir):
    from flowloom.plans.views import view

    cols = ["fwd_len", "bytes_s", "iat_mean"]
    df = view(spark, sf_dir, "labelled").withColumn("y", (F.col("fwd_len") > 25).cast("int")).select("flow_key", "y", *cols)
    net = models.fit(models.ModelSpec("NN", "network", {"hidden": [4], "maxIter": 30}), df, cols, "y", classes=2)
    tree = models.fit(models.ModelSpec("RF", "forest", {"numTrees": 3, "maxDepth": 2}), df, cols, "y", classes=2)
    rows = df.select("*", F.xxhash64(F.lit(7), "flow_key").alias("h")).orderBy("h").collect()
    n = len(rows)
    for model in (net, tree):
        got = {r["feature"]: r["importance"] for r in models.permutation_importances(model, df, cols, "y", ["flow_key"], seed=7).collect()}
        plain = []
        for k in range(len(cols) + 1):
            for i, r in enumerate(rows):
                cells = [rows[i - 1][c] if j + 1 == k else r[c] for j, c in enumerate(cols)]
                plain.append((k, r["y"], *cells))
        scored = models.predict(model, spark.createDataFrame(plain, ["k", "y", *cols])).where("prediction = y").groupBy("k").count().collect()
        hits = {r["k"]: r["count"] for r in scored}
        assert got == {c: pytest.approx((hits[0] - hits[j + 1]) / n) for j, c in enumerate(cols)}
    assert got["fwd_len"] > 0.2 and got["iat_mean"] == 0
    with pytest.raises(ValueError, match="permutation"):
        models.importances(net, cols)
    none = models.permutation_importances(tree, df.where("false"), cols, "y", ["flow_key"]).collect()
    assert [r["importance"] for r in none] == [None] * 3


def test_one_vs_rest_takes_weights_and_has_importances(spark):
    rows = [(float(i % 10), float(i % 3), 0 if i % 10 < 8 else i % 10 - 7) for i in range(300)]
    df = spark.createDataFrame(rows, "a double, b double, y int")
    spec = models.ModelSpec("G", "boosted", {"maxIter": 2, "maxDepth": 2}, True)
    model = models.fit(spec, df, ["a", "b"], "y")
    assert models.estimator(spec, "y", 2, 3).getWeightCol() == models.WEIGHT
    found = {r["feature"]: r["importance"] for r in models.importances(model, ["a", "b"]).collect()}
    assert sum(found.values()) == pytest.approx(1.0) and found["a"] > found["b"]


def test_majority_counts_inside_the_row(spark):
    from flowloom.operators import score

    df = spark.createDataFrame([([2, 1, 2],), ([3, 1],), ([None, 4],), ([],), (None,)], "v array<int>")
    assert [r[0] for r in df.select(score.majority(F.col("v"))).collect()] == [2, 1, 4, None, None]
