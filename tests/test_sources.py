import hashlib
import json

import pytest
from pyspark.sql import functions as F

from flowloom.operators import audit, columns, evaluate, runs, scale, score, split
from flowloom.plans.views import view
from flowloom.sources import csv_files, stores

HEADER = "Flow ID, Source IP,Flow Bytes/s, Fwd Header Length,Fwd Header Length, Label"


@pytest.fixture
def raw(tmp_path):
    folder = tmp_path / "raw"
    folder.mkdir()
    (folder / "Monday-WorkingHours.csv").write_bytes(
        (HEADER + "\nf1,1.1.1.1,Infinity,3,3,BENIGN\nf2,1.1.1.1,NaN,4,4,Web Attack – XSS\n").encode())
    (folder / "Thursday-Morning.csv").write_bytes(
        (HEADER + "\nf3,2.2.2.2,7.5,5,5,Web Attack ").encode() + b"\x96" + b" XSS\nf4,,,6,6,\n")
    (folder / "capture.csv").write_bytes(("Flow ID,Label,Extra\nf5,caf".encode() + b"\xe9\x81" + b",1\n"))
    return str(folder)


def test_profile_and_manifest(spark, raw):
    rows = {r["filename"]: r for r in csv_files.manifest(spark, f"{raw}/*.csv").collect()}
    assert {k: (r["row_count"], r["encoding"], r["day"], r["column_mismatch"]) for k, r in rows.items()} == {
        "Monday-WorkingHours.csv": (2, "utf-8", "Monday", False),
        "Thursday-Morning.csv": (2, "cp1252", "Thursday", False),
        "capture.csv": (1, "latin-1", "Unknown", True),
    }
    assert rows["Monday-WorkingHours.csv"]["columns"][1] == "Source IP"
    total = csv_files.manifest_totals(csv_files.manifest(spark, f"{raw}/*.csv")).first()
    assert (total["total_files"], total["total_rows"], total["mismatched_files"]) == (3, 5, 1)


def test_equal_files_share_a_hash(spark, raw):
    a = csv_files.profile_files(spark, f"{raw}/Monday*.csv").first()["hash"]
    assert a == csv_files.profile_files(spark, f"{raw}/Monday*.csv").first()["hash"]
    assert a != csv_files.profile_files(spark, f"{raw}/Thursday*.csv").first()["hash"]
    got = csv_files.content_hashes(spark, f"{raw}/Monday*.csv").first()["hash"]
    with open(f"{raw}/Monday-WorkingHours.csv", "rb") as f:
        assert got == hashlib.sha256(f.read()).hexdigest()


def test_read_mixed_encodings(spark, raw):
    df = csv_files.read_flow_csv(spark, raw)
    rows = {r["Flow ID"]: r for r in df.collect()}
    assert len(rows) == 5
    assert rows["f2"]["Label"] == rows["f3"]["Label"] == "Web Attack – XSS"
    assert rows["f5"]["Label"] == "café\x81"
    assert rows["f1"]["Flow Bytes/s"] == float("inf")
    assert rows["f4"]["Label"] is None and rows["f4"]["_day"] == "Thursday"
    assert rows["f5"]["Extra"] == 1.0 and rows["f1"]["Extra"] is None
    assert "Fwd Header Length.1" in df.columns
    assert "Fwd Header Length.1" not in csv_files.without_copies(df).columns
    plain, names = columns.plain_names(csv_files.without_copies(df))
    assert names["flow_bytes_per_s"] == "Flow Bytes/s" and plain.count() == 5


def test_missing_inputs_are_named(spark, tmp_path):
    with pytest.raises(FileNotFoundError):
        csv_files.read_flow_csv(spark, str(tmp_path / "none"))
    with pytest.raises(FileNotFoundError, match="ingestion"):
        stores.read_bronze(spark, str(tmp_path / "none"))


def test_header_checks():
    assert audit.repeated_names(["a", " a", "b"]) == {"repeated": ["a"], "similar": []}
    assert audit.repeated_names(["Fwd Header Length", "Fwd Header Length.1"])["similar"]


def test_bronze_and_submitted(spark, sf_dir, tmp_path):
    df = spark.range(50).select(F.col("id").alias(" id "), F.lit("x").alias("Label"))
    path = stores.write_bronze(df, str(tmp_path / "bronze"))
    assert stores.read_bronze(spark, path).count() == 50
    assert csv_files.load_submitted(spark, path, 7).count() == 7
    assert csv_files.load_submitted(spark, path).columns == ["id", "Label"]
    (tmp_path / "x.csv").write_bytes(b" a ,b\n1,\xff\n")
    assert csv_files.load_submitted(spark, str(tmp_path / "x.csv")).columns == ["a", "b"]


def test_processed_and_splits(spark, sf_dir, tmp_path):
    df = split.stratified_split(view(spark, sf_dir, "labelled"), ["flow_key"])
    params = scale.fit_scaler(df, ["fwd_len"], "robust")
    out = stores.write_processed(df, {"feature_columns": ["fwd_len"]}, {"binary": {"BENIGN": 0}}, scale.params_frame(spark, params), str(tmp_path / "p"))
    assert stores.read_document(spark, out["schema"]) == {"feature_columns": ["fwd_len"]}
    assert scale.params_from_frame(spark.read.parquet(out["preprocessor"])) == params
    stores.write_splits(df, str(tmp_path / "s"), {"strategy": "stratified"})
    back = stores.read_splits(spark, str(tmp_path / "s"))
    assert set(back) == {"train", "val", "test"}
    assert sum(d.count() for d in back.values()) == df.count()
    plan = back["val"]._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(split" in plan
    meta = spark.read.json(str(tmp_path / "s" / "split_metadata"))
    assert meta.where("kind = 'all'").agg(F.sum("rows")).first()[0] == df.count()


def _results(spark, sf_dir):
    df = score.decide(view(spark, sf_dir, "scored").drop("class_name"))
    return df.withColumns({
        "timestamp": F.col("ts_us"), "src_port": F.lit(1), "protocol": F.lit(6), "duration": F.lit(1.23456), "packets": F.lit(2), "bytes": F.lit(80)})


def test_result_files_append(spark, sf_dir, tmp_path):
    df = _results(spark, sf_dir).limit(20).withColumn("nested", F.array(F.lit(1)))
    path = str(tmp_path / "r")
    stores.write_csv_rows(df, path)
    stores.write_csv_rows(df, path, append=True)
    back = spark.read.csv(path, header=True)
    assert back.count() == 40 and "nested" not in back.columns
    stores.write_json_rows(df, str(tmp_path / "j"))
    stores.write_json_rows(df, str(tmp_path / "j"), append=True)
    assert stores.read_json_rows(spark, str(tmp_path / "j")).count() == 40


def test_stream_writes_flows_and_attacks(spark, sf_dir, tmp_path):
    src = str(tmp_path / "in")
    _results(spark, sf_dir).write.parquet(src)
    stream = spark.readStream.schema(spark.read.parquet(src).schema).parquet(src)
    sink = stores.flow_sinks(str(tmp_path / "flows"), str(tmp_path / "attacks"), str(tmp_path / "log"))
    q = stream.writeStream.foreachBatch(sink).trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "cp")).start()
    q.awaitTermination(120)
    flows = spark.read.csv(str(tmp_path / "flows"), header=True)
    attacks = spark.read.csv(str(tmp_path / "attacks"), header=True)
    assert flows.count() == 1000 and flows.first()["duration"] == "1.2346"
    assert [c for c in flows.columns if c != "batch"] == list(score.FLOW_FILE_COLUMNS)
    assert attacks.count() == flows.where("is_attack = 'true'").count() == spark.read.text(str(tmp_path / "log")).count()
    assert "ATTACK: 10." in spark.read.text(str(tmp_path / "log")).first()["value"]


def test_sessions(spark, tmp_path):
    for i in range(25):
        d = tmp_path / f"2026{i:02d}"
        d.mkdir()
        (d / "stats.json").write_text(json.dumps({"start_time": f"t{i}", "runtime_seconds": i + 0.5, "total_flows": i}, indent=2))
    rows = stores.list_sessions(spark, str(tmp_path / "*" / "stats.json")).collect()
    assert len(rows) == 20 and rows[0]["id"] == "202624"
    assert (rows[0]["runtime"], rows[0]["flows"], rows[0]["attacks"]) == (24, 24, 0)


def test_alert_store(spark, sf_dir, tmp_path):
    path = str(tmp_path / "alerts")
    stores.append_alerts(spark.createDataFrame([(1, 5), (2, None)], "run_id int, flow_index int"), path)
    stores.append_alerts(spark.createDataFrame([(2, 9, 0.7, True)], "run_id int, flow_index int, probability double, is_correct boolean"), path)
    df = spark.read.parquet(path)
    assert df.count() == 3
    assert df.where("flow_index = 0").first()["prediction"] == 1
    stores.delete_alerts(spark, path, [1], str(tmp_path / "kept"))
    assert {r["run_id"] for r in spark.read.parquet(str(tmp_path / "kept")).collect()} == {2}


def test_reports_and_models(spark, sf_dir, tmp_path):
    df = _results(spark, sf_dir)
    report = evaluate.final_report(df)
    stores.write_json_rows(report, str(tmp_path / "report"))
    assert stores.read_json(spark, str(tmp_path / "report")).first()["total_flows"] == 1000
    assert evaluate.report_text(report).count() == 16
    stores.write_json_rows(audit.issues(view(spark, sf_dir, "flows_raw")), str(tmp_path / "audit"))
    results = spark.createDataFrame([("b", 0.9, 0.81234, 0.7), ("a", 0.95, 0.9, 0.8)], "name string, val_f1 double, test_f1 double, test_roc_auc double")
    stores.write_experiments(results, str(tmp_path / "exp"))
    stores.write_csv_rows(spark.createDataFrame([(f"f{i}", float(i)) for i in range(15)], "feature string, importance double"), str(tmp_path / "imp"))
    card, top = stores.model_card(spark, str(tmp_path / "exp"), str(tmp_path / "imp"), "b")
    assert card.first()["test_f1"] == 0.8123
    assert [r["feature"] for r in top.collect()][:2] == ["f14", "f13"] and top.count() == 10


def test_alert_defaults_leave_given_values(spark):
    df = runs.with_alert_defaults(spark.createDataFrame([(3, None)], "flow_index int, probability double"))
    r = df.first()
    assert (r["flow_index"], r["probability"], r["prediction"], r["true_label"]) == (3, 0.0, 1, None)
