"""Address, protocol, text and location queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from flowloom.functions import net, text
from flowloom.operators import flows, geo, live
from flowloom.operators.evaluate import safe_div
from flowloom.operators.labels import day_of_file
from flowloom.plans.flow_plans import FLOW_CTE, KEY
from flowloom.plans.registry import register
from flowloom.plans.views import cte, table, view

PK = cte("packets")
_IP_SQL = """, ips as (select packet_id, case when packet_id % 5 = 0 then src_ip || '.9' when packet_id % 7 = 0 then '300.1.2.' || (packet_id % 256)
  when packet_id % 11 = 0 then (packet_id % 256) || '.' || (packet_id % 200) || '.7.1' when packet_id % 13 = 0 then '172.' || (packet_id % 40) || '.0.1' else src_ip end as ip from packets),
  num as (select *, case when regexp_full_match(ip, '(25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])([.](25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])){3}') then
    split_part(ip, '.', 1)::bigint * 16777216 + split_part(ip, '.', 2)::bigint * 65536 + split_part(ip, '.', 3)::bigint * 256 + split_part(ip, '.', 4)::bigint end as n from ips)"""


def _ips(spark, sf_dir):
    i = F.col("packet_id")
    ip = (
        F.when(i % 5 == 0, F.concat("src_ip", F.lit(".9")))
        .when(i % 7 == 0, F.concat(F.lit("300.1.2."), (i % 256).cast("string")))
        .when(i % 11 == 0, F.concat((i % 256).cast("string"), F.lit("."), (i % 200).cast("string"), F.lit(".7.1")))
        .when(i % 13 == 0, F.concat(F.lit("172."), (i % 40).cast("string"), F.lit(".0.1")))
        .otherwise(F.col("src_ip"))
    )
    return view(spark, sf_dir, "packets").select("packet_id", ip.alias("ip"))


@register("f1_protocol_name", PK + "select packet_id, case p when 1 then 'ICMP' when 6 then 'TCP' when 17 then 'UDP' when 41 then 'IPv6' when 47 then 'GRE' when 50 then 'ESP' when 51 then 'AH' when 58 then 'ICMPv6' when 89 then 'OSPF' when 132 then 'SCTP' else 'Proto-' || p end as name from (select packet_id, protocol + packet_id % 50 as p from packets)")
def f1(spark, sf_dir):
    p = (F.col("protocol") + F.col("packet_id") % 50).cast("int")
    return view(spark, sf_dir, "packets").select("packet_id", net.protocol_name(p).alias("name"))


_SIZE = "(event_id * event_id * event_id * 7)"


def _size():
    """The same number as a decimal: a long is too short for it from a million events on."""
    i = F.col("event_id").cast("decimal(38,0)")
    return i * i * i * F.lit(7)


@register("f2_format_bytes", f"""select event_id, case when b < 1024 then format('{{:.1f}} B', b) when b / 1024 < 1024 then format('{{:.1f}} KB', b / 1024)
  when b / 1048576 < 1024 then format('{{:.1f}} MB', b / 1048576) when b / 1073741824 < 1024 then format('{{:.1f}} GB', b / 1073741824)
  when b / 1099511627776 < 1024 then format('{{:.1f}} TB', b / 1099511627776) else format('{{:.1f}} PB', b / 1125899906842624) end as size
  from (select event_id, ({_SIZE} + 0.33)::double as b from events)""")
def f2(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", text.format_bytes(_size().cast("double") + 0.33).alias("size"))


@register("f3_format_duration", """select event_id, case when s < 0.001 then format('{:.1f}μs', s * 1e6) when s < 1 then format('{:.1f}ms', s * 1e3) when s < 60 then format('{:.1f}s', s)
  when s < 3600 then format('{:.1f}m', s / 60) else format('{:.1f}h', s / 3600) end as t from (select event_id, ((event_id * event_id % 100003) * 0.137 + 0.0123)::double / pow(10, event_id % 5)  as s from events)""")
def f3(spark, sf_dir):
    i = F.col("event_id")
    s = (((i * i) % 100003) * F.lit(0.137).cast("decimal(4,3)") + F.lit(0.0123).cast("decimal(5,4)")).cast("double") / F.pow(F.lit(10.0), i % 5)
    return table(spark, sf_dir, "events").select("event_id", text.format_duration(s).alias("t"))


@register("f4_f15_format_time", PK + "select packet_id, strftime(make_timestamp(ts_us), '%Y-%m-%d %H:%M:%S') as t, strftime(make_timestamp(ts_us), '%Y-%m-%dT%H:%M:%S.%f') as iso from packets")
def f4(spark, sf_dir):
    return view(spark, sf_dir, "packets").select("packet_id", text.format_time(F.col("ts_us")).alias("t"), text.iso_time(F.col("ts_us")).alias("iso"))


@register("f7_f8_f9_addresses", PK + _IP_SQL + """select packet_id, ip, n is not null as valid, n as number, coalesce((n between 0 and 16777215 or n between 167772160 and 184549375
  or n between 2130706432 and 2147483647 or n between 2851995648 and 2852061183 or n between 2886729728 and 2887778303 or n between 3221225472 and 3221225727
  or n between 3221225984 and 3221226239 or n between 3232235520 and 3232301055 or n between 3323068416 and 3323199487 or n between 3325256704 and 3325256959
  or n between 3405803776 and 3405804031 or n between 4026531840 and 4294967295) and n not in (3221225481, 3221225482), false) as private from num""")
def f7(spark, sf_dir):
    ip = F.col("ip")
    return _ips(spark, sf_dir).select("packet_id", "ip", net.is_ip(ip).alias("valid"), net.ipv4_to_long(ip).alias("number"), net.is_private_ip(ip).alias("private"))


@register("f11_file_weekday", "select strftime(l_shipdate, '%Y-%m-%d') as shipped, dayname(l_shipdate) as day from (select distinct l_shipdate from lineitem)")
def f11(spark, sf_dir):
    df = table(spark, sf_dir, "lineitem").select("l_shipdate").distinct()
    return df.select(F.date_format("l_shipdate", "yyyy-MM-dd").alias("shipped"), day_of_file(F.concat(F.date_format("l_shipdate", "EEEE"), F.lit("-hours.csv"))).alias("day"))


@register("f12_thousands", f"select event_id, format('{{:,}}', {_SIZE}) as n from events")
def f12(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", text.format_number(_size()).alias("n"))


@register("f13_safe_divide", "select l_orderkey, l_linenumber, round(case when l_discount > 0 then l_tax / l_discount else 0 end, 6) as q from lineitem")
def f13(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.round(safe_div(F.col("l_tax"), F.col("l_discount")), 6).alias("q"))


@register("f16_json_field", "select event_id, cast(json_extract(props, '$.k') as int) as k from events")
def f16(spark, sf_dir):
    parsed = F.from_json("props", "k int")
    return table(spark, sf_dir, "events").select("event_id", parsed["k"].alias("k"))


@register("f17_fold_tokens", "select event_id, upper(trim(t)) as token, upper(trim(t)) in ('VIEW', 'CLICK') as hit from (select event_id, case when event_id % 2 = 0 then ' ' || event_type || ' ' else event_type end as t from events)")
def f17(spark, sf_dir):
    raw = F.when(F.col("event_id") % 2 == 0, F.concat(F.lit(" "), "event_type", F.lit(" "))).otherwise(F.col("event_type"))
    token = F.upper(F.trim(raw))
    return table(spark, sf_dir, "events").select("event_id", token.alias("token"), token.isin("VIEW", "CLICK").alias("hit"))


# Uneven pieces of 10.0.0.0/14 with a gap, one per nation: widths follow the nation key.
_CIDR = "(select 167772160 + n_nationkey * 10000 as start_ip, 167772160 + n_nationkey * 10000 + 9999 - (n_nationkey % 3) * 4000 as end_ip, n_name as country from nation)"


def _ranges(spark, sf_dir):
    k = F.col("n_nationkey").cast("long")
    start = F.lit(167772160) + k * 10000
    return table(spark, sf_dir, "nation").select(start.alias("start_ip"), (start + 9999 - (k % 3) * 4000).alias("end_ip"), F.col("n_name").alias("country"))


@register("j6_locate_addresses", PK + f""", a as (select distinct '10.' || (l_partkey % 4) || '.' || (l_suppkey % 256) || '.' || (l_orderkey % 256) as ip from lineitem),
  n as (select *, split_part(ip, '.', 1)::bigint * 16777216 + split_part(ip, '.', 2)::bigint * 65536 + split_part(ip, '.', 3)::bigint * 256 + split_part(ip, '.', 4)::bigint as n from a)
  select ip, country from n left join {_CIDR} c on n between start_ip and end_ip""")
def j6(spark, sf_dir):
    ip = F.concat_ws(".", F.lit("10"), F.col("l_partkey") % 4, F.col("l_suppkey") % 256, F.col("l_orderkey") % 256)
    return geo.locate(table(spark, sf_dir, "lineitem").select(ip.alias("ip")), "ip", _ranges(spark, sf_dir))


@register("j6_packet_locations", PK + f"""select packet_id, src_ip, country from packets left join {_CIDR} c on
  split_part(src_ip, '.', 1)::bigint * 16777216 + split_part(src_ip, '.', 2)::bigint * 65536 + split_part(src_ip, '.', 3)::bigint * 256 + split_part(src_ip, '.', 4)::bigint between start_ip and end_ip""")
def j6b(spark, sf_dir):
    df = geo.with_location(view(spark, sf_dir, "packets").select("packet_id", "src_ip"), "src_ip", _ranges(spark, sf_dir))
    return df.select("packet_id", "src_ip", "country")


@register("j6_nested_ranges", PK + """, a as (select distinct '10.' || (l_partkey % 4) || '.' || (l_suppkey % 256) || '.' || (l_orderkey % 256) as ip from lineitem),
  n as (select *, split_part(ip, '.', 1)::bigint * 16777216 + split_part(ip, '.', 2)::bigint * 65536 + split_part(ip, '.', 3)::bigint * 256 + split_part(ip, '.', 4)::bigint as n from a),
  c as (select 167772160 + (n_nationkey % 10) * 20000 as start_ip, 167772160 + (n_nationkey % 10) * 20000 + 90000 // (1 + n_nationkey // 5) as end_ip, n_name as country from nation),
  h as (select ip, country, row_number() over (partition by ip order by start_ip desc, end_ip, country desc) as k from n join c on n between start_ip and end_ip)
  select ip, country from a left join h using (ip) where coalesce(k, 1) = 1""")
def j6_nested(spark, sf_dir):
    """Ranges that overlap and nest: the innermost decides."""
    ip = F.concat_ws(".", F.lit("10"), F.col("l_partkey") % 4, F.col("l_suppkey") % 256, F.col("l_orderkey") % 256)
    k = F.col("n_nationkey").cast("long")
    start = F.lit(167772160) + (k % 10) * 20000
    size = F.floor(F.lit(90000) / (F.floor(k / 5) + 1))
    ranges = table(spark, sf_dir, "nation").select(start.alias("start_ip"), (start + size).alias("end_ip"), F.col("n_name").alias("country"))
    return geo.locate(table(spark, sf_dir, "lineitem").select(ip.alias("ip")), "ip", ranges)


@register("j6_ipv6_locations", """with a as (select distinct l_suppkey % 128 as g, l_partkey as p from lineitem), c as (select n_nationkey * 4 as lo, n_nationkey * 4 + 6 as hi, n_name as country from nation),
  h as (select g, p, arg_max(country, lo) as country from a join c on g between lo and hi group by g, p)
  select '2001:db8:' || lower(to_hex(g)) || '::' || lower(right(to_hex(p), 4)) as ip, any_value(country) as country from a left join h using (g, p) group by 1""")
def j6_v6(spark, sf_dir):
    """IPv6 addresses in overlapping ranges of site numbers, given as texts."""
    site, host = F.lower(F.hex(F.col("l_suppkey") % 128)), F.lower(F.hex("l_partkey"))
    ip = F.concat(F.lit("2001:DB8:"), F.upper(site), F.lit("::"), F.right(host, F.lit(4)))
    k = F.col("n_nationkey") * 4
    ranges = table(spark, sf_dir, "nation").select(
        F.concat(F.lit("2001:db8:"), F.hex(k), F.lit("::")).alias("start_ip"),
        F.concat(F.lit("2001:db8:"), F.hex(k + 6), F.lit(":ffff:ffff:ffff:ffff:ffff")).alias("end_ip"), F.col("n_name").alias("country"))
    found = geo.locate(table(spark, sf_dir, "lineitem").select(ip.alias("ip")), "ip", ranges)
    return found.withColumn("ip", F.lower("ip"))


@register("st3_active_snapshots", FLOW_CTE + f""", ext as (select {KEY}, session, min(ts_us) // 5000000 + 1 as a, (max(ts_us) + 120000000) // 5000000 as z from sessions group by all),
  ticks as (select {KEY}, session, unnest(range(a, z + 1)) as tick from ext)
  select t.src_ip, t.src_port, t.dst_ip, t.dst_port, t.protocol, t.session, tick, count(*) as total_packets, sum(length)::bigint as total_bytes, min(ts_us) as start_us, max(ts_us) as last_us
  from ticks t join sessions s using ({KEY}, session) where s.ts_us < tick * 5000000 group by all having count(*) >= 5 and tick * 5000000 - max(ts_us) <= 120000000""")
def st3(spark, sf_dir):
    return live.active_snapshots(view(spark, sf_dir, "packets"))
