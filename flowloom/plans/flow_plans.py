"""Packet and flow queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from flowloom.operators import features, flows
from flowloom.plans.registry import register, rounded
from flowloom.plans.views import cte, table, view

KEY = "src_ip, src_port, dst_ip, dst_port, protocol"

# Canonical endpoints, flow number and per-direction gaps, as window SQL.
FLOW_CTE = cte("packets") + """,
keyed as (
  select packet_id, ts_us, length, payload_length, flags, protocol,
         (src_ip, src_port) < (dst_ip, dst_port) as is_fwd,
         case when (src_ip, src_port) < (dst_ip, dst_port) then src_ip else dst_ip end as src_ip,
         case when (src_ip, src_port) < (dst_ip, dst_port) then src_port else dst_port end as src_port,
         case when (src_ip, src_port) < (dst_ip, dst_port) then dst_ip else src_ip end as dst_ip,
         case when (src_ip, src_port) < (dst_ip, dst_port) then dst_port else src_port end as dst_port
  from packets),
marked as (
  select *, case when ts_us - lag(ts_us) over (partition by src_ip, src_port, dst_ip, dst_port, protocol
                                               order by ts_us, packet_id) <= 120000000 then 0 else 1 end as starts
  from keyed),
sessions as (
  select *, cast(sum(starts) over (partition by src_ip, src_port, dst_ip, dst_port, protocol
                                   order by ts_us, packet_id rows unbounded preceding) as bigint) as session
  from marked),
gaps as (
  select *, ts_us - lag(ts_us) over (partition by src_ip, src_port, dst_ip, dst_port, protocol, session, is_fwd
                                     order by ts_us, packet_id) as iat_us
  from sessions)
"""


def _moments(spark, sf_dir):
    return flows.flow_moments(view(spark, sf_dir, "packets"))


@register(
    "f5_tcp_flags",
    cte("packets")
    + """select packet_id, (flags & 1) <> 0 as fin, (flags & 2) <> 0 as syn, (flags & 4) <> 0 as rst,
    (flags & 8) <> 0 as psh, (flags & 16) <> 0 as ack, (flags & 32) <> 0 as urg, (flags & 64) <> 0 as ece,
    (flags & 128) <> 0 as cwr from packets""",
)
def f5(spark, sf_dir):
    df = flows.with_tcp_flags(view(spark, sf_dir, "packets"))
    return df.select("packet_id", *[f.lower() for f in flows.TCP_FLAGS])


@register("f6_flow_key", FLOW_CTE + f"select packet_id, {KEY}, is_fwd from keyed")
def f6(spark, sf_dir):
    df = flows.with_flow_key(view(spark, sf_dir, "packets"))
    return df.select("packet_id", *flows.FLOW_KEY, "is_fwd")


@register("w1_interarrival", FLOW_CTE + f"select packet_id, {KEY}, session, is_fwd, iat_us from gaps")
def w1(spark, sf_dir):
    df = flows.with_interarrival(view(spark, sf_dir, "packets"))
    return df.select("packet_id", *flows.FLOW_KEY, "session", "is_fwd", "iat_us")


@register(
    "w2_sessions",
    FLOW_CTE + f"""select {KEY}, session, min(ts_us) as start_us, max(ts_us) as end_us, count(*) as packets
    from sessions group by all""",
)
def w2(spark, sf_dir):
    return _moments(spark, sf_dir).select(
        *flows.FLOW_KEY, "session", "start_us", "end_us", (F.col("fwd_n") + F.col("bwd_n")).alias("packets")
    )


_DUR = "(max(ts_us) - min(ts_us)) / 1000000.0::double"


def _cnt(cond):
    return f"count(*) filter (where {cond})"


def _sum(expr, cond):
    return f"cast(coalesce(sum({expr}) filter (where {cond}), 0) as bigint)"


_FLAG_SQL = ", ".join(
    f"{_cnt(f'(flags & {bit}) <> 0')} as {name.lower()}_count" for name, bit in flows.TCP_FLAGS.items()
)
_FLOW_SQL = (
    FLOW_CTE
    + f""", flow as (select {KEY}, session, min(ts_us) as timestamp_us, max(ts_us) as last_us, {_DUR} as duration,
 {_cnt('is_fwd')} as total_fwd_packets, {_cnt('not is_fwd')} as total_bwd_packets,
 {_sum('length', 'is_fwd')} as total_fwd_bytes, {_sum('length', 'not is_fwd')} as total_bwd_bytes,
 {_sum('payload_length', 'is_fwd')} as fwd_payload_bytes, {_sum('payload_length', 'not is_fwd')} as bwd_payload_bytes,
 {_cnt('is_fwd and (flags & 8) <> 0')} as fwd_psh_flags, {_cnt('not is_fwd and (flags & 8) <> 0')} as bwd_psh_flags,
 {_cnt('is_fwd and (flags & 32) <> 0')} as fwd_urg_flags, {_cnt('not is_fwd and (flags & 32) <> 0')} as bwd_urg_flags,
 {_FLAG_SQL},
 {_sum('length - payload_length', 'is_fwd')} as fwd_header_length,
 {_sum('length - payload_length', 'not is_fwd')} as bwd_header_length,
 count(*) as total_packets, cast(sum(length) as bigint) as total_bytes
 from sessions group by all)
"""
)


@register(
    "a37_flow_aggregate",
    _FLOW_SQL
    + """select * exclude (duration), round(duration, 6) as duration,
    round(case when duration > 0 then total_packets / duration else 0 end, 6) as packets_per_second,
    round(case when duration > 0 then total_bytes / duration else 0 end, 6) as bytes_per_second from flow""",
)
def a37(spark, sf_dir):
    return rounded(flows.flow_table(_moments(spark, sf_dir)))


def _coal(expr):
    return f"coalesce(cast({expr} as double), 0.0)"


def _feature_sql() -> str:
    """Check SQL for the features: straight aggregates over packets and their gaps."""
    parts = {
        "destination_port": "cast(dst_port as double)",
        "flow_duration": f"greatest({_DUR}, 1e-10) * 1e6",
        "total_fwd_packets": f"cast({_cnt('is_fwd')} as double)",
        "total_backward_packets": f"cast({_cnt('not is_fwd')} as double)",
        "total_length_of_fwd_packets": _coal("sum(length) filter (where is_fwd)"),
        "total_length_of_bwd_packets": _coal("sum(length) filter (where not is_fwd)"),
        "flow_bytes_per_s": f"sum(length) / greatest({_DUR}, 1e-10)",
        "flow_packets_per_s": f"count(*) / greatest({_DUR}, 1e-10)",
        "flow_iat_mean": _coal("avg(iat_us)"),
        "flow_iat_std": _coal("stddev_pop(iat_us)"),
        "flow_iat_max": _coal("max(iat_us)"),
        "flow_iat_min": _coal("min(iat_us)"),
        "min_packet_length": "cast(min(length) as double)",
        "max_packet_length": "cast(max(length) as double)",
        "packet_length_mean": "avg(length)",
        "packet_length_std": "stddev_pop(length)",
        "packet_length_variance": "var_pop(length)",
        "cwe_flag_count": f"cast({_cnt('(flags & 128) <> 0')} as double)",
        "down_up_ratio": f"coalesce({_cnt('not is_fwd')} / nullif({_cnt('is_fwd')}, 0)::double, 0.0)",
        "average_packet_size": "avg(length)",
        "init_win_bytes_forward": "0.0::double",
        "init_win_bytes_backward": "0.0::double",
        "act_data_pkt_fwd": "case when coalesce(sum(payload_length) filter (where is_fwd), 0) > 0 then 1.0::double else 0.0::double end",
        "min_seg_size_forward": _coal("min(length) filter (where is_fwd)"),
    }
    for f in ("FIN", "SYN", "RST", "PSH", "ACK", "URG", "ECE"):
        parts[f"{f.lower()}_flag_count"] = f"cast({_cnt(f'(flags & {flows.TCP_FLAGS[f]}) <> 0')} as double)"
    for d, cond in (("fwd", "is_fwd"), ("bwd", "not is_fwd")):
        w = f"filter (where {cond})"
        for m, fn in (("max", "max"), ("min", "min"), ("mean", "avg"), ("std", "stddev_pop")):
            parts[f"{d}_packet_length_{m}"] = _coal(f"{fn}(length) {w}")
            parts[f"{d}_iat_{m}"] = _coal(f"{fn}(iat_us) {w}")
        parts[f"{d}_iat_total"] = _coal(f"sum(iat_us) {w}")
        for f, bit in (("psh", 8), ("urg", 32)):
            parts[f"{d}_{f}_flags"] = f"cast({_cnt(f'{cond} and (flags & {bit}) <> 0')} as double)"
        parts[f"{d}_header_length"] = _coal(f"sum(length - payload_length) {w}")
        parts[f"{d}_packets_per_s"] = f"{_cnt(cond)} / greatest({_DUR}, 1e-10)"
        parts[f"avg_{d}_segment_size"] = _coal(f"avg(length) {w}")
        parts[f"subflow_{d}_packets"] = f"cast({_cnt(cond)} as double)"
        parts[f"subflow_{d}_bytes"] = _coal(f"sum(length) {w}")
        for b in ("bytes_bulk", "packets_bulk", "bulk_rate"):
            parts[f"{d}_avg_{b}"] = "0.0::double"
    for s in ("active", "idle"):
        for m in ("mean", "std", "max", "min"):
            parts[f"{s}_{m}"] = "0.0::double"
    cols = ", ".join(f"round({parts[name]}, 4) as {name}" for name in features.FEATURES)
    return FLOW_CTE + f"select {KEY}, session, {cols} from gaps group by all"


@register("a38_flow_features", _feature_sql())
def a38(spark, sf_dir):
    return rounded(features.flow_features(_moments(spark, sf_dir)), 4)


_CONTRACT = ["total_fwd_packets", "no_such_feature", "total_bwd_bytes", "duration"]


@register(
    "p23_feature_vector",
    _FLOW_SQL
    + f"""select {KEY}, session, total_fwd_packets::double as v0, 0.0::double as v1, total_bwd_bytes::double as v2,
    round(duration, 6) as v3 from flow""",
)
def p23(spark, sf_dir):
    df = features.feature_vector(flows.flow_table(_moments(spark, sf_dir)), _CONTRACT, "v")
    return rounded(df.select(*flows.FLOW_KEY, "session", *[F.col("v")[i].alias(f"v{i}") for i in range(4)]))


@register(
    "p27_busy_flows",
    _FLOW_SQL + f"select {KEY}, session, total_packets, total_bytes from flow where total_packets >= 5",
)
def p27(spark, sf_dir):
    df = flows.flow_table(_moments(spark, sf_dir)).where("total_packets >= 5")
    return df.select(*flows.FLOW_KEY, "session", "total_packets", "total_bytes")


@register(
    "o5_oldest_flow",
    FLOW_CTE
    + f"""select {KEY}, session, max(ts_us) as last_us from sessions group by all
    order by last_us, {KEY}, session limit 1""",
)
def o5(spark, sf_dir):
    return flows.oldest_flow(_moments(spark, sf_dir))


# Whole vectors, one-element vectors and empty ones, to meet every branch.
_VEC_SQL = """select vec_id, case vec_id % 3 when 0 then []::double[] when 1 then embedding[1:1]::double[]
  else embedding::double[] end as v from embeddings"""


@register(
    "f14_safe_stats",
    f"""select vec_id, round(coalesce(list_avg(v), 0), 6) as mean,
    case when len(v) > 1 then round(list_stddev_pop(v), 6) else 0 end as std,
    case when len(v) > 1 then round(list_var_pop(v), 6) else 0 end as var,
    coalesce(round(list_max(v), 6), 0) as max, coalesce(round(list_min(v), 6), 0) as min,
    coalesce(round(list_sum(v), 6), 0) as sum from ({_VEC_SQL})""",
)
def f14(spark, sf_dir):
    v = F.col("embedding").cast("array<double>")
    cut = F.when(F.col("vec_id") % 3 == 0, F.slice(v, 1, 0)).when(F.col("vec_id") % 3 == 1, F.slice(v, 1, 1))
    df = table(spark, sf_dir, "embeddings").select("vec_id", cut.otherwise(v).alias("v"))
    return rounded(df.select("vec_id", *[e.alias(k) for k, e in features.safe_stats("v").items()]))
