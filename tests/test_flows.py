import pytest
from pyspark.sql import functions as F

from flowloom.operators import features, flows
from flowloom.plans.views import view

COLS = "packet_id long, ts_us long, src_ip string, src_port int, dst_ip string, dst_port int, protocol int, length int, payload_length int, flags int"


def packets(spark, *rows):
    """(ts_us, src, dst) triples as packets of 100 bytes with 40 bytes of header."""
    port = {"a": 10}
    full = [(i, t, s, port.get(s, 20), d, port.get(d, 20), 6, 100, 60, 0) for i, (t, s, d) in enumerate(rows)]
    return spark.createDataFrame(full, COLS)


def moments(spark, *rows, **kw):
    return flows.flow_moments(packets(spark, *rows), **kw).orderBy("session").collect()


S = 1_000_000


@pytest.mark.parametrize("gap,count", [(120 * S, 1), (120 * S + 1, 2)])
def test_gap_at_and_over_the_timeout(spark, gap, count):
    assert len(moments(spark, (0, "a", "b"), (gap, "b", "a"))) == count


def test_single_packet(spark):
    df = flows.flow_moments(packets(spark, (5 * S, "a", "b")))
    t = flows.flow_table(df).first()
    assert (t["duration"], t["packets_per_second"], t["bytes_per_second"]) == (0.0, 0.0, 0.0)
    f = features.flow_features(df).first()
    assert f["flow_duration"] == pytest.approx(1e-4)
    assert f["flow_bytes_per_s"] == 100 / 1e-10
    assert f["flow_iat_std"] == f["packet_length_std"] == f["bwd_packet_length_max"] == f["down_up_ratio"] == 0.0


def test_only_backward_and_equal_endpoints(spark):
    f = features.flow_features(flows.flow_moments(packets(spark, (0, "b", "a"), (S, "b", "a")))).first()
    assert (f["total_fwd_packets"], f["total_backward_packets"], f["down_up_ratio"]) == (0.0, 2.0, 0.0)
    same = spark.createDataFrame([(0, 0, "a", 10, "a", 10, 6, 100, 60, 0)], COLS)
    assert flows.with_flow_key(same).first()["is_fwd"] is False


def test_addresses_compare_as_text(spark):
    r = flows.with_flow_key(packets(spark, (0, "192.168.1.9", "192.168.1.10"))).first()
    assert (r["src_ip"], r["is_fwd"]) == ("192.168.1.10", False)


def test_arrival_order_does_not_matter(spark):
    a = moments(spark, (3 * S, "a", "b"), (1 * S, "a", "b"), (2 * S, "a", "b"))[0]
    assert (a["fwd_gap_min"], a["fwd_gap_max"], a["fwd_gap_sum"], a["fwd_gap_n"]) == (S, S, 2 * S, 2)
    f = features.flow_features(flows.flow_moments(packets(spark, (0, "a", "b"), (S, "a", "b"), (2 * S, "a", "b")))).first()
    assert f["fwd_iat_std"] == 0.0


def _everything(df):
    return sorted(map(tuple, df.select(sorted(df.columns)).collect()), key=repr)


@pytest.mark.parametrize("slice_us,pre", [(1_000, False), (1_000_000, True), (120_000_000, False), (10_000_000, True)])
def test_slicing_never_changes_flows(spark, sf_dir, slice_us, pre):
    df = view(spark, sf_dir, "packets")
    # Half of all packets share one 5-tuple, and many of those share a time stamp.
    hot = df.withColumns({"src_ip": F.lit("a"), "dst_ip": F.lit("b"), "src_port": F.lit(1), "dst_port": F.lit(2), "protocol": F.lit(6),
                          "ts_us": F.col("ts_us") - F.col("ts_us") % 500_000})
    both = df.unionByName(hot)
    assert _everything(flows.flow_moments(both, slice_us=slice_us, preaggregate=pre)) == _everything(flows.flow_moments(both))


def test_flow_invariants(spark, sf_dir):
    df = view(spark, sf_dir, "packets")
    t = flows.flow_table(flows.flow_moments(df)).agg(F.sum("total_packets"), F.sum("total_bytes")).first()
    p = df.agg(F.count("*"), F.sum("length")).first()
    assert tuple(t) == tuple(p)


def test_packets_without_a_port_keep_their_gaps(spark, sf_dir):
    df = view(spark, sf_dir, "packets").limit(60).withColumns({"src_port": F.lit(None).cast("int"), "src_ip": F.lit("a"), "dst_ip": F.lit("b"), "dst_port": F.lit(2), "protocol": F.lit(6)})
    out = flows.with_interarrival(df)
    assert out.count() == 60
    gaps = out.groupBy("session", "is_fwd").agg(F.sum("iat_us").alias("g"), (F.max("ts_us") - F.min("ts_us")).alias("span")).collect()
    assert all((r["g"] or 0) == r["span"] for r in gaps)


def test_long_time_outs(spark, sf_dir):
    df = view(spark, sf_dir, "packets")
    hour = flows.flow_moments(df, timeout_us=7_200_000_000)
    assert hour.count() < flows.flow_moments(df).count()
    assert hour.where("fwd_gap_sq < 0 or bwd_gap_sq < 0").count() == 0


def test_feature_contract():
    assert len(features.FEATURE_NAMES) == len(set(features.FEATURES)) == 77


def test_published_sample_flow(spark):
    """Ten forward packets of 150 bytes and eight backward ones of 1 500 in 1.5 s."""
    fwd = [(i * 100_000, "10.0.0.1", 1, "8.8.8.8", 443, 6, 150, 110, 0) for i in range(10)]
    bwd = [(i * 150_000 + 450_000, "8.8.8.8", 443, "10.0.0.1", 1, 6, 1500, 1460, 0) for i in range(8)]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate([*fwd, *bwd])], COLS)
    f = features.flow_features(flows.flow_moments(df)).first()
    want = {
        "destination_port": 443, "flow_duration": 1.5e6, "total_length_of_fwd_packets": 1500, "total_length_of_bwd_packets": 12000,
        "fwd_iat_mean": 1e5, "bwd_iat_mean": 1.5e5, "fwd_iat_std": 0, "flow_bytes_per_s": 9000, "flow_packets_per_s": 12,
        "down_up_ratio": 0.8, "average_packet_size": 750, "avg_bwd_segment_size": 1500, "min_packet_length": 150,
        "fwd_iat_total": 9e5, "bwd_iat_total": 1.05e6, "flow_iat_max": 1.5e5, "flow_iat_min": 1e5, "fwd_header_length": 400,
    }
    assert {k: pytest.approx(f[k]) for k in want} == want
    lengths = [150] * 10 + [1500] * 8
    mean = sum(lengths) / 18
    assert f["packet_length_variance"] == pytest.approx(sum((x - mean) ** 2 for x in lengths) / 18)


def test_interarrival_with_shared_time_stamps(spark, sf_dir):
    """A 5-tuple with most packets and few distinct times agrees with a plain walk through its packets."""
    df = view(spark, sf_dir, "packets").withColumns({
        "src_ip": F.lit("a"), "dst_ip": F.lit("b"), "src_port": F.lit(1), "dst_port": F.lit(2), "protocol": F.lit(6),
        "ts_us": F.col("ts_us") - F.col("ts_us") % 40_000_000})
    got = {r["packet_id"]: (r["session"], r["iat_us"]) for r in flows.with_interarrival(df).collect()}
    last = prev = None
    session = 0
    rows = sorted(df.collect(), key=lambda r: (r["ts_us"], r["packet_id"]))
    for r in rows:
        if last is None or r["ts_us"] - last > 120_000_000:
            session, prev = session + 1, None
        last = r["ts_us"]
        assert got[r["packet_id"]] == (session, None if prev is None else r["ts_us"] - prev)
        prev = r["ts_us"]
    assert len(got) == len(rows)
