import os
import subprocess
import sys

import pytest
from pyspark.sql import functions as F

from flowloom.functions import lineage
from flowloom.operators import models, scale, workflow
from flowloom.plans.views import view

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def test_scaler_sees_training_rows_only(spark, sf_dir):
    raw = view(spark, sf_dir, "flows_raw").drop("flow_ts")
    ready = workflow.run_pipeline(raw, ["l_orderkey", "l_linenumber"], scaler="standard")
    assert {"fwd_len", "bytes_s", "iat_mean"} <= set(ready.features) and "l_orderkey" not in ready.features
    row = ready.splits["train"].agg(F.avg("fwd_len"), F.stddev_pop("fwd_len"), F.avg("bytes_s")).first()
    assert row[0] == pytest.approx(0, abs=1e-9) and row[1] == pytest.approx(1) and row[2] == pytest.approx(0, abs=1e-9)
    assert abs(ready.splits["test"].agg(F.avg("fwd_len")).first()[0]) > 1e-6
    sizes = {k: df.count() for k, df in ready.splits.items()}
    assert abs(sizes["test"] - 0.15 * sum(sizes.values())) < 3 and ready.findings.count() > 0

    model = models.fit(models.ModelSpec("RF", "forest", {"numTrees": 3, "maxDepth": 3}), ready.splits["train"], ready.features, "label_binary", classes=2)
    scored, report = workflow.score_and_report(model, ready.splits["test"])
    got = report.first()
    assert got["total_flows"] == sizes["test"] == scored.count() and 0 <= got["f1"] <= 1
    _, bare = workflow.score_and_report(model, ready.splits["test"].select(*ready.features))
    assert "f1" not in bare.columns and bare.first()["total_flows"] == sizes["test"]
    assert scale.params_from_frame(scale.params_frame(spark, ready.scaler)) == ready.scaler


def test_queries_run_without_a_checkpoint_folder(tmp_path):
    """A stock session: an empty configuration folder, no setting of ours."""
    code = """
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[2]").config("spark.sql.shuffle.partitions", "2").config("spark.ui.enabled", "false").getOrCreate()
assert spark.conf.get("spark.checkpoint.dir", None) is None
import __spark_entry__ as e
from flowloom.functions import lineage
for name in ("p15_random_split", "a30_a31_roc_pr_area", "st5_burst_alerts", "w4_w5_snapshots"):
    assert e.queries()[name](spark, "/root/testdata/sf0.001").count() > (name != "st5_burst_alerts") - 1, name
lineage.clear(spark)
"""
    conf = tmp_path / "conf"
    conf.mkdir()
    env = os.environ | {"SPARK_CONF_DIR": str(conf), "PYTHONPATH": ROOT}
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=300)
    assert done.returncode == 0, done.stderr[-1500:]
    left = [f for f in (tmp_path / "spark-warehouse").rglob("*.parquet")]
    assert not left


def test_a_cluster_must_name_a_shared_folder():
    assert lineage._warehouse_dir("file:/w", "local[8]") == lineage._warehouse_dir("file:/w/", "local") == "file:/w/_cuts"
    assert lineage._warehouse_dir("hdfs://n/w/", "yarn") == "hdfs://n/w/_cuts"
    for warehouse in ("file:/w", "/w"):
        for master in ("spark://h:7077", "local-cluster[2,1,1024]"):
            with pytest.raises(ValueError, match="spark.checkpoint.dir"):
                lineage._warehouse_dir(warehouse, master)
