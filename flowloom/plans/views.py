"""Network-flow views over the star-schema tables, one definition for both SQL dialects.

Each view is a SQL template; the tokens in braces are the few expressions that Spark and the
checking engine spell differently.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from flowloom.session import prepare_session

EPOCH_US = 1704067200000000

SPARK_TOKENS = {
    "us": "unix_micros(cast(ts as timestamp))",
    "k": "cast(get_json_object(props, '$.k') as int)",
    "div": f"(us - {EPOCH_US}) div 1000",
    "inf": "double('Infinity')",
    "nan": "double('NaN')",
    "dow": "cast(pmod(datediff(l_shipdate, date'1995-01-01'), 7) as int)",
    "thousand": "1000.0D",
    "idiv": "div",
}
DUCK_TOKENS = {
    "us": "epoch_us(ts)",
    "k": "cast(json_extract(props, '$.k') as int)",
    "div": f"(us - {EPOCH_US}) // 1000",
    "inf": "'inf'::double",
    "nan": "'nan'::double",
    "dow": "(date_diff('day', date '1995-01-01', cast(l_shipdate as date)) % 7)",
    "thousand": "1000.0::double",
    "idiv": "//",
}

VIEWS = {
    # One packet per event; thirty days compressed a thousandfold so a 120 s time-out matters.
    "packets": """
        select event_id as packet_id,
               1704067200000000 + {div} as ts_us,
               case when event_id % 3 = 0 then svr else cli end as src_ip,
               case when event_id % 3 = 0 then cli else svr end as dst_ip,
               case when event_id % 3 = 0 then sport else cport end as src_port,
               case when event_id % 3 = 0 then cport else sport end as dst_port,
               case when event_type = 'signup' then 17 else 6 end as protocol,
               40 + vlen as length, vlen as payload_length, flags
        from (select event_id, event_type, us, cast(floor(value) as int) as vlen, k as flags,
                     concat('10.', cast(user_id % 4 as varchar(9)), '.',
                            cast(cast((user_id - user_id % 256) / 256 as int) % 256 as varchar(9)),
                            '.', cast(user_id % 256 as varchar(9))) as cli,
                     concat('192.168.1.', cast(k % 2 as varchar(9))) as svr,
                     cast(1024 + user_id % 60000 as int) as cport,
                     case when k % 2 = 0 then 80 else 443 end as sport
              from (select event_id, event_type, user_id, value, {us} as us, {k} as k from {events}) r) e""",
    # Dirty labelled flows: nulls, infinities, copies (half of them in the file of the next day), a doubled column, untidy labels.
    "flows_raw": """
        select l_orderkey, l_linenumber, l_shipdate as flow_ts,
               concat(dy, '-WorkingHours.csv') as _source_file, dy as _day,
               l_quantity as fwd_len, l_quantity as fwd_len_1,
               case when l_orderkey % 97 = 0 then {inf} when l_orderkey % 89 = 0 then -{inf}
                    when l_orderkey % 83 = 0 then {nan} when l_orderkey % 79 = 0 then null
                    else l_extendedprice end as bytes_s,
               l_discount as iat_mean, l_tax as down_up, cast(5.0 as double) as const_col,
               case l_orderkey % 11 when 0 then ' DoS Hulk' when 1 then 'Web Attack - XSS' when 2 then 'PortScan '
                    when 3 then null when 4 then 'DoS Slowloris variant' when 5 then 'Mystery'
                    else 'BENIGN' end as label
        from (select *, case ({dow} + moved) % 7 when 0 then 'Sunday' when 1 then 'Monday' when 2 then 'Tuesday'
                         when 3 then 'Wednesday' when 4 then 'Thursday' when 5 then 'Friday'
                         else 'Saturday' end as dy
              from (select *, 0 as moved from {lineitem} union all
                    select *, case when l_orderkey % 100 = 0 then 1 else 0 end as moved from {lineitem} where l_orderkey % 50 = 0) u) v""",
    # Labelled flows for splitting: every lineitem row once, with a unique textual key.
    "labelled": """
        select concat(cast(l_orderkey as varchar(20)), '-', cast(l_linenumber as varchar(20)), '-',
                      cast(l_partkey as varchar(20)), '-', cast(l_suppkey as varchar(20)), '-',
                      cast(cast(round(l_extendedprice * 100) as bigint) as varchar(20))) as flow_key,
               case {dow} when 0 then 'Sunday' when 1 then 'Monday' when 2 then 'Tuesday'
                    when 3 then 'Wednesday' when 4 then 'Thursday' when 5 then 'Friday'
                    else 'Saturday' end as _day,
               case when l_orderkey % 11 in (0, 1, 2, 4, 5) then 1 else 0 end as label_binary,
               cast(l_orderkey % 6 as int) as label_multiclass,
               l_quantity as fwd_len, l_extendedprice as bytes_s, l_discount as iat_mean
        from {lineitem}""",
    # Model scores with truth.
    "scored": """
        select event_id as flow_index, user_id % 5 as run_id, {us} as ts_us,
               ((event_id * 7919) % 1000) / {thousand} as probability,
               ((event_id * 104729) % 1000) / {thousand} as p2,
               ((event_id * 1299709) % 1000) / {thousand} as p3,
               case when (event_id * 7919) % 1000 + (event_id * 31) % 400 >= 700 then 1 else 0 end as y_true,
               cast((event_id * 31) % 4 as int) as y_class, cast((event_id * 17) % 4 as int) as pred_class,
               value as latency_ms,
               concat('10.', cast(user_id % 4 as varchar(9)), '.0.', cast(user_id % 256 as varchar(9))) as src_ip,
               concat('192.168.1.', cast(user_id % 7 as varchar(9))) as dst_ip,
               cast(case when user_id % 2 = 0 then 80 else 443 end as int) as dst_port,
               event_type as class_name
        from {events}""",
}
_TABLE_TOKENS = ("events", "lineitem")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One driver table."""
    prepare_session(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of ``VIEWS`` as a lazy DataFrame."""
    prepare_session(spark)
    tables = {t: f"parquet.`{sf_dir}/{t}.parquet`" for t in _TABLE_TOKENS}
    return spark.sql(VIEWS[name].format(**SPARK_TOKENS, **tables))


def cte(*names: str) -> str:
    """``with`` clause that defines the named views for the checking engine."""
    tables = {t: t for t in _TABLE_TOKENS}
    parts = [f"{n} as ({VIEWS[n].format(**DUCK_TOKENS, **tables)})" for n in names]
    return "with " + ",\n".join(parts)
