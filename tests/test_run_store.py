import pytest

from flowloom.sources import run_store


def _rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_changes_switch_as_a_whole(spark, tmp_path):
    store = str(tmp_path / "store")
    with pytest.raises(FileNotFoundError, match="nothing was written"):
        run_store.read(spark, store, "runs")
    runs = spark.createDataFrame([(i, "running", None) for i in range(20)], "run_id long, status string, f1 double")
    alerts = spark.createDataFrame([(i % 20, i) for i in range(200)] + [(3, i) for i in range(1000, 1500)], "run_id long, flow_index long")
    run_store.append(store, "runs", runs)
    run_store.append(store, "alerts", alerts)
    before = run_store.read(spark, store, "alerts")
    assert before.count() == 700
    run_store.update_runs(store, spark.createDataFrame([(3, "completed", 0.5), (4, None, 0.25), (99, "new", None)], "run_id long, status string, f1 double"))
    got = {r["run_id"]: (r["status"], r["f1"]) for r in run_store.read(spark, store, "runs").collect()}
    assert len(got) == 21 and got[3] == ("completed", 0.5) and got[4] == ("running", 0.25) and got[99] == ("new", None) and got[5] == ("running", None)

    version = run_store.delete_runs(store, spark.createDataFrame([(3,), (7,), (12345,), (3,)], "run_id long"))
    assert {r["run_id"] for r in run_store.read(spark, store, "runs").collect()} == set(got) - {3, 7}
    assert run_store.read(spark, store, "alerts").count() == 200 - 20
    # Who has begun to read, or asks for the version before, sees all that was there.
    assert before.count() == 700 and run_store.read(spark, store, "runs", version - 1).count() == 21

    assert run_store.remove_unused(spark, store) > 0
    assert run_store.read(spark, store, "alerts").count() == 180
    assert run_store._names(spark, f"{store}/versions") == [str(version)]


def test_only_touched_buckets_are_written(spark, tmp_path):
    store = str(tmp_path / "store")
    run_store.append(store, "runs", spark.range(500).selectExpr("id as run_id", "'x' as status"))
    a = run_store._version(spark, store)[1]["runs"]["folders"]
    run_store.update_runs(store, spark.createDataFrame([(5, "y")], "run_id long, status string"))
    b = run_store._version(spark, store)[1]["runs"]["folders"]
    assert sum(a[k] != b[k] for k in a) == 1 and set(a) == set(b)


def test_lost_race_columns_nulls_and_empty_changes(spark, tmp_path):
    store = str(tmp_path / "store")
    run_store.append(store, "runs", spark.createDataFrame([(1, "a"), (None, "n")], "run_id long, status string"))
    run_store.append(store, "runs", spark.createDataFrame([(2, "b", 7)], "run_id long, status string, extra int"))
    assert _rows(run_store.read(spark, store, "runs")) == sorted([(1, "a", None), (None, "n", None), (2, "b", 7)], key=repr)
    with pytest.raises(ValueError, match="status"):
        run_store.append(store, "runs", spark.createDataFrame([(1, 5)], "run_id long, status int"))
    number, content = run_store._version(spark, store)
    with pytest.raises(RuntimeError, match="another writer"):
        run_store._commit(spark, store, number, content)
    run_store.update_runs(store, spark.createDataFrame([(None, "m")], "run_id long, status string"))
    run_store.delete_runs(store, spark.createDataFrame([], "run_id long"))
    assert _rows(run_store.read(spark, store, "runs")) == sorted([(1, "a", None), (None, "m", None), (2, "b", 7)], key=repr)
    run_store.delete_runs(store, spark.createDataFrame([(1,), (2,)], "run_id long"))
    assert _rows(run_store.read(spark, store, "runs")) == [(None, "m", None)]
