import pytest
from pyspark.sql import functions as F

from flowloom.operators import alerts, flows, live
from flowloom.operators import models, score
from flowloom.operators.features import FEATURES, flow_features
from flowloom.plans.views import view
from flowloom.sources import stores
from flowloom.streaming import packet_flows as ps

KEY = flows.FLOW_KEY


@pytest.fixture(scope="module")
def packet_files(spark, sf_dir, tmp_path_factory):
    """Packets in three files by time, then a late sentinel packet that closes every flow."""
    folder = tmp_path_factory.mktemp("packets") / "in"
    packets = view(spark, sf_dir, "packets")
    cuts = packets.approxQuantile("ts_us", [0.33, 0.66], 0.0)
    lo, hi = cuts
    parts = [packets.where(F.col("ts_us") <= lo), packets.where((F.col("ts_us") > lo) & (F.col("ts_us") <= hi)), packets.where(F.col("ts_us") > hi)]
    last = packets.agg(F.max("ts_us").alias("m")).first()["m"]
    sentinel = packets.limit(1).withColumns({
        "ts_us": F.lit(last + 3_600_000_000), "packet_id": F.lit(-1).cast("long"), "src_ip": F.lit("0.0.0.1"), "dst_ip": F.lit("0.0.0.2")})
    for p in [*parts, sentinel]:
        p.coalesce(1).write.mode("append").parquet(str(folder))
    return str(folder)


def run(spark, df, mode, name, tmp_path):
    q = df.writeStream.outputMode(mode).format("memory").queryName(name).trigger(availableNow=True).option(
        "checkpointLocation", str(tmp_path / name)).start()
    q.awaitTermination(240)
    assert q.exception() is None
    return spark.table(name)


def rows(df, *cols):
    return sorted(tuple(r) for r in df.select(*cols).collect())


def test_flow_stream_equals_batch(spark, sf_dir, packet_files, tmp_path):
    stream = ps.flow_stream(ps.packet_stream(spark, packet_files, max_files=1))
    got = run(spark, stream, "append", "flows_out", tmp_path).where("src_ip <> '0.0.0.1'")
    want = flows.flow_moments(view(spark, sf_dir, "packets"))
    cols = [*KEY, "start_us", "end_us", "fwd_n", "bwd_n", "fwd_bytes", "bwd_gap_sq", "fwd_gap_min", "bwd_gap_max", "fwd_gap_sum", "fwd_gap_n", "psh_count"]
    assert rows(got, *cols) == rows(want, *cols)
    features = flow_features(got)
    assert len(features.columns) == len(KEY) + 1 + 77
    assert features.count() == want.count()


def test_active_flow_stream_equals_batch(spark, sf_dir, packet_files, tmp_path):
    stream = ps.active_flow_stream(ps.packet_stream(spark, packet_files, max_files=1), min_packets=2)
    got = run(spark, stream, "append", "active_out", tmp_path).where("src_ip <> '0.0.0.1'")
    want = live.active_snapshots(view(spark, sf_dir, "packets"), min_packets=2)
    cols = [*KEY, "tick", "total_packets", "total_bytes", "start_us", "last_us"]
    assert rows(got, *cols) == rows(want, *cols)
    assert got.count() > 0


def test_replayed_packets_count_once(spark, packet_files, tmp_path):
    both = ps.packet_stream(spark, packet_files)
    once = ps.once_per_packet(both.unionByName(both))
    out = run(spark, ps.packet_totals(once, "1 hour"), "append", "totals_out", tmp_path)
    # The window that holds the sentinel stays open.
    assert out.agg(F.sum("packets")).first()[0] == 1000


def test_windows_over_finished_flows(spark, sf_dir, packet_files, tmp_path):
    stream = ps.flow_stream(ps.packet_stream(spark, packet_files, max_files=1))
    out = run(spark, ps.attack_windows(stream, "10 minutes", F.col("dst_port") == 80), "append", "windows_out", tmp_path)
    total = flows.flow_moments(view(spark, sf_dir, "packets")).count()
    assert 0 < out.agg(F.sum("flows")).first()[0] <= total


def _attack_files(spark, sf_dir, folder):
    """Three files of attacks; every tenth attack comes one file late, within the watermark. The last file ends all."""
    df = view(spark, sf_dir, "packets").select((F.col("packet_id") % 3).alias("run_id"), "packet_id", "ts_us")
    span = df.approxQuantile("ts_us", [0.33, 0.66], 0.0)
    part = F.when(F.col("ts_us") <= span[0], 0).when(F.col("ts_us") <= span[1], 1).otherwise(2)
    late = (F.col("packet_id") % 10 == 0).cast("int")
    placed = df.withColumn("part", F.least(part + late, F.lit(2)))
    for i in range(3):
        placed.where(F.col("part") == i).drop("part").coalesce(1).write.mode("append").parquet(folder)
    end = df.agg(F.max("ts_us")).first()[0] + 7_200_000_000
    spark.createDataFrame([(99, -1, end)], "run_id long, packet_id long, ts_us long").coalesce(1).write.mode("append").parquet(folder)
    return df


def _source(spark, folder):
    raw = spark.readStream.schema("run_id long, packet_id long, ts_us long").option("maxFilesPerTrigger", 1).parquet(folder)
    return ps.with_event_time(raw, "1 hour")


def test_alert_and_admission_streams_equal_batch(spark, sf_dir, tmp_path):
    folder = str(tmp_path / "attacks")
    df = _attack_files(spark, sf_dir, folder)
    fired = run(spark, ps.burst_alert_stream(_source(spark, folder), "run_id", threshold=5), "append", "alerts_out", tmp_path)
    want = alerts.burst_alerts(df, ["run_id"], threshold=5)
    assert rows(fired, "run_id", "ts_us", "attack_count", "severity") == rows(want, "run_id", "ts_us", "attack_count", "severity")
    assert fired.count() > 1
    passed = run(spark, ps.admission_stream(_source(spark, folder), "run_id", 2, 20_000_000, ["packet_id"]), "append", "passed_out", tmp_path)
    want = alerts.admit(df, 2, 20_000_000, ["packet_id"], ["run_id"])
    assert rows(passed, "run_id", "packet_id") == rows(want, "run_id", "packet_id")


def test_live_scoring_equals_batch_scoring(spark, sf_dir, packet_files, tmp_path):
    moments = flows.flow_moments(view(spark, sf_dir, "packets"))
    train = flow_features(moments).withColumn("y", (F.col("destination_port") == 80).cast("int"))
    contract = [f for f in FEATURES if f != "destination_port"]
    model = models.fit(models.ModelSpec("RF", "forest", {"numTrees": 5, "maxDepth": 3}, True), train, contract, "y", classes=2)
    stream = ps.scored_flows(ps.flow_stream(ps.packet_stream(spark, packet_files, max_files=1)), model, contract)
    q = stream.writeStream.foreachBatch(stores.flow_sinks(str(tmp_path / "flows"), str(tmp_path / "attacks"))).trigger(
        availableNow=True).option("checkpointLocation", str(tmp_path / "live")).start()
    q.awaitTermination(240)
    assert q.exception() is None
    got = spark.read.csv(str(tmp_path / "flows"), header=True, inferSchema=True).where("src_ip <> '0.0.0.1'")
    want = score.flow_file_rows(ps.scored_flows(moments, model, contract))
    cols = ["src_ip", "src_port", "timestamp", "packets", "bytes", "prediction", "is_attack"]
    assert rows(got, *cols) == rows(want, *cols)
    attacks = spark.read.csv(str(tmp_path / "attacks"), header=True)
    assert attacks.count() == got.where("is_attack").count() > 0


def _late_files(spark, sf_dir, folder):
    """Three files of packets; every tenth packet comes one file late. A last packet ends all."""
    df = view(spark, sf_dir, "packets")
    span = df.approxQuantile("ts_us", [0.33, 0.66], 0.0)
    part = F.when(F.col("ts_us") <= span[0], 0).when(F.col("ts_us") <= span[1], 1).otherwise(2)
    placed = df.withColumn("part", F.least(part + (F.col("packet_id") % 10 == 0).cast("int"), F.lit(2)))
    end = df.agg(F.max("ts_us")).first()[0] + 200_000_000_000
    sentinel = df.limit(1).withColumns({"ts_us": F.lit(end), "packet_id": F.lit(-1).cast("long"), "src_ip": F.lit("0.0.0.1"), "dst_ip": F.lit("0.0.0.2")})
    for p in [*[placed.where(F.col("part") == i).drop("part") for i in range(3)], sentinel]:
        p.coalesce(1).write.mode("append").parquet(folder)
    return df


def test_late_packets_take_their_place(spark, sf_dir, tmp_path):
    folder = str(tmp_path / "late")
    df = _late_files(spark, sf_dir, folder)
    packets = ps.packet_stream(spark, folder, max_files=1, watermark="12 hours")
    got = run(spark, ps.flow_stream(packets), "append", "late_flows", tmp_path).where("src_ip <> '0.0.0.1'")
    want = flows.flow_moments(df)
    cols = [c for c in want.columns if c != "session"]
    assert set(cols) < set(got.columns)
    assert rows(got, *cols) == rows(want, *cols)
    got = run(spark, ps.active_flow_stream(packets, min_packets=2), "append", "late_active", tmp_path).where("src_ip <> '0.0.0.1'")
    want = live.active_snapshots(df, min_packets=2)
    cols = [*KEY, "tick", "total_packets", "total_bytes", "start_us", "last_us"]
    assert rows(got, *cols) == rows(want, *cols)


def test_flow_state_does_not_grow_with_packets():
    row = {c: 1 for c in (*ps._ADDED, *ps._LEAST, *ps._MOST, *ps._SQUARES)}
    flow, size = None, set()
    for k in range(50):
        flow, new = ps._extended(flow, row | {"first_us": k * 1000, "last_us": k * 1000 + 5, "fwd_first": k * 1000, "fwd_last": k * 1000 + 5}, 10_000)
        size.add(len(flow))
        assert new == (k == 0)
    assert len(size) == 1 and flow["fwd_n"] == 50 and flow["fwd_gap_max"] == 995 and flow["start_us"] == 0 and flow["end_us"] == 49_005
    assert ps._extended(flow, row | {"first_us": 99_999, "last_us": 100_000}, 10_000)[1]


def test_live_totals_run_on(spark, sf_dir, packet_files, tmp_path):
    events = ps.flow_events(ps.packet_stream(spark, packet_files, max_files=1))
    out = run(spark, ps.live_totals(events, "1 hour", F.col("dst_port") == 80), "append", "live_totals_out", tmp_path).orderBy("window").collect()
    moments = flows.flow_moments(view(spark, sf_dir, "packets"))
    assert sum(r.packets for r in out) == out[-1].total_packets == 1000
    assert [r.total_packets for r in out] == [sum(x.packets for x in out[: i + 1]) for i in range(len(out))]
    done, attacks = moments.count(), moments.where("dst_port = 80").count()
    # The last window with the sentinel stays open, and with it flows that end in it.
    assert 0 < out[-1].total_flows <= done and out[-1].total_attacks <= attacks
    assert all(r.active_flows >= 0 for r in out) and out[-1].total_flows + out[-1].active_flows == done
    assert out[-1].attack_rate == out[-1].total_attacks / out[-1].total_flows


def test_live_metrics_run_on(spark, sf_dir, tmp_path):
    scored = view(spark, sf_dir, "scored").select("ts_us", "y_true", (F.col("probability") >= 0.5).cast("int").alias("prediction"), "latency_ms")
    folder = str(tmp_path / "scored")
    cut = scored.approxQuantile("ts_us", [0.5], 0.0)[0]
    end = scored.agg(F.max("ts_us")).first()[0] + 10 * 86_400_000_000
    scored.where(F.col("ts_us") <= cut).coalesce(1).write.parquet(folder)
    scored.where(F.col("ts_us") > cut).coalesce(1).write.mode("append").parquet(folder)
    scored.limit(1).withColumn("ts_us", F.lit(end)).coalesce(1).write.mode("append").parquet(folder)
    raw = spark.readStream.schema(scored.schema).option("maxFilesPerTrigger", 1).parquet(folder)
    out = run(spark, ps.live_metrics(ps.with_event_time(raw, "1 hour"), "1 day"), "append", "live_metrics_out", tmp_path).orderBy("window").collect()
    table = scored.toPandas()
    day = 86_400_000_000
    assert len(out) == len(set(table.ts_us // day))
    for r, tick in zip(out, sorted(set(table.ts_us // day))):
        so_far = table[table.ts_us // day <= tick]
        assert r.flows == len(so_far) and r.new_flows == (table.ts_us // day == tick).sum()
        assert r.true_positives == ((so_far.y_true == 1) & (so_far.prediction == 1)).sum()
        for p, name in ((0.5, "p50_ms"), (0.95, "p95_ms"), (0.99, "p99_ms")):
            exact = so_far.latency_ms.quantile(p, interpolation="lower")
            assert abs(r[name] - exact) <= 0.011 * exact + 1e-9
    # The same operator over a table.
    batch = ps.live_metrics(scored.withColumn("ts", F.timestamp_micros("ts_us")), "1 day").orderBy("window").collect()
    assert [tuple(r) for r in batch] == [tuple(r) for r in out]
