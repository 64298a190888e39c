"""Cleaning, labelling, scaling, audit and split queries on flow tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from flowloom.functions.hashing import hash_order_sql
from flowloom.functions.lineage import cut
from flowloom.operators import audit, clean, columns, labels, scale, split
from flowloom.plans.registry import register, rounded
from flowloom.plans.views import cte, table, view

RAW = cte("flows_raw")
ALL = "l_orderkey, l_linenumber, flow_ts, _source_file, _day, fwd_len, fwd_len_1, bytes_s, iat_mean, down_up, const_col, label"
PLAIN = "l_orderkey, l_linenumber, flow_ts, fwd_len, fwd_len_1, bytes_s, iat_mean, down_up, const_col, label"
NUM = ("fwd_len", "bytes_s", "iat_mean", "down_up", "const_col")
COPY = "fwd_len_1"
# Keys that make a row recognisable in results.
ID = "l_orderkey, l_linenumber"

FIN = "case when isfinite({0}) then {0} end"
NN = "case when not isnan({0}) then {0} end"


def _raw(spark, sf_dir):
    return view(spark, sf_dir, "flows_raw")


def _first(spark, sf_dir):
    """Labelled rows without NaN and without copies: the input of the later cleaning steps."""
    return clean.keep_first(clean.drop_unlabelled(clean.nan_to_null(_raw(spark, sf_dir)), "label")).drop(COPY)


def _kept(spark, sf_dir):
    """These rows written once, for steps that search statistics in several passes and then change the rows."""
    return cut(_first(spark, sf_dir))


_FIRST_SQL = RAW + f""", dedup as (select l_orderkey, l_linenumber, flow_ts, fwd_len, iat_mean, down_up, const_col, label,
  {NN.format('bytes_s')} as bytes_s, min(_source_file) as _source_file, min(_day) as _day
  from flows_raw where label is not null group by all)"""


def _agg_rows(df, cols):
    """Exact per-column digest: count, nulls, sum and extremes rounded."""
    cells = [F.struct(F.lit(c).alias("feature"), F.count(c).alias("filled"), F.round(F.sum(c), 2).alias("total"),
                      F.round(F.min(c), 4).alias("low"), F.round(F.max(c), 4).alias("high")) for c in cols]
    return df.agg(F.array(*cells).alias("r")).select(F.explode("r").alias("r")).select("r.*")


@register("p1_strip_names", "select r_regionkey as \"region key\", r_name as \"region name\" from region")
def p1(spark, sf_dir):
    df = table(spark, sf_dir, "region").select(F.col("r_regionkey").alias(" region key"), F.col("r_name").alias("region name "))
    return columns.strip_names(df)


@register("p2_source_day", RAW + """select _source_file, case when contains(lower(_source_file), 'monday') then 'Monday'
  when contains(lower(_source_file), 'tuesday') then 'Tuesday' when contains(lower(_source_file), 'wednesday') then 'Wednesday'
  when contains(lower(_source_file), 'thursday') then 'Thursday' when contains(lower(_source_file), 'friday') then 'Friday'
  when contains(lower(_source_file), 'saturday') then 'Saturday' when contains(lower(_source_file), 'sunday') then 'Sunday'
  else 'Unknown' end as day, count(*) as "rows" from (
  select case when l_orderkey % 7 = 0 then 'capture.csv' else _source_file end as _source_file from flows_raw) group by all""")
def p2(spark, sf_dir):
    name = F.when(F.col("l_orderkey") % 7 == 0, "capture.csv").otherwise(F.col("_source_file"))
    df = _raw(spark, sf_dir).select(name.alias("_source_file"))
    return df.withColumn("day", labels.day_of_file(F.col("_source_file"))).groupBy("_source_file", "day").agg(
        F.count(F.lit(1)).alias("rows"))


@register("p3_drop_unlabelled", RAW + f"select {ID}, label, count(*) as copies from flows_raw where label is not null group by all")
def p3(spark, sf_dir):
    df = clean.drop_unlabelled(_raw(spark, sf_dir), "label")
    return df.groupBy("l_orderkey", "l_linenumber", "label").agg(F.count(F.lit(1)).alias("copies"))


@register("p4_drop_copied_columns", RAW + f"select * exclude (flow_ts, {COPY}, bytes_s) from flows_raw")
def p4(spark, sf_dir):
    return columns.drop_copied_columns(_raw(spark, sf_dir), "_1").drop("flow_ts", "bytes_s")


_P5 = _FIRST_SQL + """, s as (select max(bytes_s) filter (where isfinite(bytes_s)) as hi,
   min(bytes_s) filter (where isfinite(bytes_s)) as lo,
   quantile_cont(bytes_s, 0.5) filter (where isfinite(bytes_s)) as md from dedup)"""


def _p5(strategy, pos, neg):
    sql = _P5 + f"""select {ID}, fwd_len, round(case when bytes_s = 'inf'::double then {pos}
      when bytes_s = -('inf'::double) then {neg} else bytes_s end, 4) as bytes_s from dedup, s"""

    @register(f"p5_infinities_{strategy}", sql)
    def run(spark, sf_dir):
        df = clean.replace_infinities((_first if strategy == "nan" else _kept)(spark, sf_dir), NUM, strategy)
        return rounded(df.select("l_orderkey", "l_linenumber", "fwd_len", "bytes_s"), 4)


_p5("nan", "null", "null")
_p5("clip", "hi", "lo")
_p5("median", "md", "md")


def _p6(strategy, fill):
    sql = _FIRST_SQL + f""", f as (select * exclude (bytes_s), case when isfinite(bytes_s) then bytes_s end as bytes_s from dedup),
      s as (select quantile_cont(bytes_s, 0.5) as md, avg(bytes_s) as mn from f)
      select {ID}, fwd_len, round({fill}, 4) as bytes_s from f, s"""
    if strategy == "drop":
        sql += " where bytes_s is not null"

    @register(f"p6_missing_{strategy}", sql)
    def run(spark, sf_dir):
        rows = (_kept if strategy in ("median", "mean") else _first)(spark, sf_dir)
        df = clean.replace_infinities(rows, NUM, "nan")
        df = clean.fill_missing(df, NUM, strategy)
        return rounded(df.select("l_orderkey", "l_linenumber", "fwd_len", "bytes_s"), 4)


_p6("median", "coalesce(bytes_s, md)")
_p6("mean", "coalesce(bytes_s, mn)")
_p6("zero", "coalesce(bytes_s, 0)")
_p6("drop", "bytes_s")

_CLEAN_SQL = _FIRST_SQL + """, nn as (select * exclude (bytes_s), case when isfinite(bytes_s) then bytes_s end as bytes_s from dedup),
  md as (select quantile_cont(bytes_s, 0.5) as m from nn),
  filled as (select * exclude (bytes_s), coalesce(bytes_s, m) as bytes_s from nn, md),
  bounds as (select """ + ", ".join(
    f"quantile_cont({c}, 0.001) as {c}_lo, quantile_cont({c}, 0.999) as {c}_hi" for c in NUM
) + """ from filled),
  cleaned as (select l_orderkey, l_linenumber, flow_ts, _source_file, _day, label, """ + ", ".join(
    f"case when {c}_lo < {c}_hi then least(greatest({c}, {c}_lo), {c}_hi) else {c} end as {c}" for c in NUM
) + " from filled, bounds)"


def _filled(spark, sf_dir):
    df = clean.replace_infinities(_kept(spark, sf_dir), NUM, "nan")
    return clean.fill_missing(df, NUM, "median")


@register("p7_clip_outliers", _CLEAN_SQL + f"select {ID}, " + ", ".join(f"round({c}, 6) as {c}" for c in NUM) + " from cleaned")
def p7(spark, sf_dir):
    df = _filled(spark, sf_dir)
    out = clean.clip_outliers(df, clean.clip_bounds(df, NUM, 0.001, 0.999))
    return rounded(out.select("l_orderkey", "l_linenumber", *NUM))


@register("p7_clipped_counts", _CLEAN_SQL + " union all ".join(
    f"select '{c}' as feature, round(any_value({c}_lo), 6) as lower, round(any_value({c}_hi), 6) as upper, count(*) filter (where {c} < {c}_lo or {c} > {c}_hi) as clipped from filled, bounds having any_value({c}_lo) < any_value({c}_hi)"
    for c in NUM))
def p7_counts(spark, sf_dir):
    df = _filled(spark, sf_dir)
    return rounded(clean.count_clipped(df, clean.clip_bounds(df, NUM, 0.001, 0.999)))


@register("p7_clean_chain", _CLEAN_SQL + f"""select {ID}, label, _day, """ + ", ".join(f"round({c}, 6) as {c}" for c in NUM) + " from cleaned")
def clean_chain(spark, sf_dir):
    # Keys are not features here, so they travel as text through the numeric rules.
    df = _raw(spark, sf_dir).withColumns({k: F.col(k).cast("string") for k in ("l_orderkey", "l_linenumber")})
    out = clean.clean(df, clean.CleanRules(copy_mark="_1"))
    return rounded(out.select(F.col("l_orderkey").cast("long"), F.col("l_linenumber").cast("int"), "label", "_day", *NUM))


_CHOSEN = ("fwd_len", "bytes_s", "iat_mean", "down_up", "const_col")


@register("p8_choose_features", RAW + " union all ".join(
    f"select '{c}' as feature, count({c}) as filled from flows_raw" for c in _CHOSEN))
def p8(spark, sf_dir):
    df = _raw(spark, sf_dir)
    chosen = columns.choose_features(df, "label", ids=("l_orderkey", "l_linenumber", "flow_ts"), mark="_1")["feature_columns"]
    cells = [F.struct(F.lit(c).alias("feature"), F.count(c).alias("filled")) for c in chosen]
    return df.agg(F.array(*cells).alias("r")).select(F.explode("r").alias("r")).select("r.*")


_FIX_SQL = "case trim(label) " + " ".join(f"when '{a}' then '{b}'" for a, b in labels.LABEL_FIXES.items()) + " else trim(label) end"
_EXACT = " ".join(f"when '{k}' then {v}" for k, v in labels.CLASS_NUMBERS.items())
_PART = " ".join(f"when contains(lower(label), '{k.lower()}') or contains('{k.lower()}', lower(label)) then {v}" for k, v in labels.CLASS_NUMBERS.items())
_CLASS_SQL = f"coalesce(case label {_EXACT} end, case {_PART} else 15 end)"
LABELLED_SQL = RAW + f""", fixed as (select * exclude (label), {_FIX_SQL} as label from flows_raw where label is not null),
  classed as (select *, case when label = 'BENIGN' then 0 else 1 end as label_binary, {_CLASS_SQL} as label_multiclass from fixed)"""


def _labelled(spark, sf_dir):
    return labels.with_labels(clean.drop_unlabelled(_raw(spark, sf_dir), "label"))


@register("p9_normalise_labels", LABELLED_SQL + "select label, count(*) as \"rows\" from fixed group by all")
def p9(spark, sf_dir):
    df = clean.drop_unlabelled(_raw(spark, sf_dir), "label").withColumn("label", labels.normalise_label("label"))
    return df.groupBy("label").agg(F.count(F.lit(1)).alias("rows"))


@register("p10_p11_class_labels", LABELLED_SQL + f"select {ID}, label, label_binary, label_multiclass from classed")
def p10(spark, sf_dir):
    return _labelled(spark, sf_dir).select("l_orderkey", "l_linenumber", "label", "label_binary", "label_multiclass")


@register("a39_distinct_classes", LABELLED_SQL + "select count(distinct label) as labels, count(distinct label_multiclass) as classes from classed")
def a39(spark, sf_dir):
    return _labelled(spark, sf_dir).groupBy("label", "label_multiclass").count().agg(
        F.count_distinct("label").alias("labels"), F.count_distinct("label_multiclass").alias("classes"))


@register("a40_unknown_classes", LABELLED_SQL + """, u as (select label, count(*) as "rows" from classed where label_multiclass = 15 group by all)
  select * from (select * from u order by "rows" desc, label limit 5) union all select null as label, coalesce(cast(sum("rows") as bigint), 0) from u""")
def a40(spark, sf_dir):
    return labels.unknown_labels(_labelled(spark, sf_dir))


@register("u5_unique_labels", RAW + "select distinct label from flows_raw")
def u5(spark, sf_dir):
    return _raw(spark, sf_dir).select("label").distinct()


@register("j3_label_dimension", LABELLED_SQL + ", dim(label, code) as (values " + ", ".join(f"('{k}', {v})" for k, v in labels.CLASS_NUMBERS.items()) + """)
  select label, coalesce(code, -1) as code, count(*) as "rows" from fixed left join dim using (label) group by all""")
def j3(spark, sf_dir):
    """Class numbers from the table of classes; texts are counted before they are joined."""
    df = clean.drop_unlabelled(_raw(spark, sf_dir), "label")
    per = df.groupBy(labels.normalise_label("label").alias("label")).agg(F.count(F.lit(1)).alias("rows"))
    return per.join(labels.class_table(spark), "label", "left").select("label", F.coalesce("code", F.lit(-1)).alias("code"), "rows")


@register("p12_zero_bad_cells", RAW + f"select {ID}, " + ", ".join(f"coalesce({FIN.format(c)}, 0) as {c}" for c in NUM) + " from flows_raw")
def p12(spark, sf_dir):
    return clean.zero_bad_cells(_raw(spark, sf_dir), NUM).select("l_orderkey", "l_linenumber", *NUM)


_SC = ("fwd_len", "bytes_s", "iat_mean", "down_up", "const_col")
_SCALE_BASE = RAW + f", z as (select {ID}, fwd_len, iat_mean, down_up, const_col, coalesce({FIN.format('bytes_s')}, 0) as bytes_s from flows_raw)"


def _p13(kind, a, b):
    stats = ", ".join(f"{a.format(c)} as {c}_a, {b.format(c)} as {c}_b" for c in _SC)
    cells = ", ".join(f"round(({c} - {c}_a) / case when {c}_b = 0 then 1 else {c}_b end, 6) as {c}" for c in _SC)
    sql = _SCALE_BASE + f", s as materialized (select {stats} from z) select {ID}, {cells} from z, s"

    @register(f"p13_scale_{kind}", sql)
    def run(spark, sf_dir):
        df = clean.zero_bad_cells(_raw(spark, sf_dir), _SC)
        out = scale.apply_scaler(df, scale.fit_scaler(df, _SC, kind))
        return rounded(out.select("l_orderkey", "l_linenumber", *_SC))


_p13("standard", "avg({0})", "stddev_pop({0})")
_p13("robust", "quantile_cont({0}, 0.5)", "quantile_cont({0}, 0.75) - quantile_cont({0}, 0.25)")
_p13("minmax", "min({0})", "max({0}) - min({0})")


_LIVE = ("fwd_len", "bytes_s", "iat_mean")


@register("p13d_scale_new_data", cte("labelled") + ", s as (select " + ", ".join(f"avg({c}) as {c}_a, stddev_pop({c}) as {c}_b" for c in _LIVE)
          + " from labelled where _day = 'Monday') select flow_key, " + ", ".join(f"round(({c} - {c}_a) / {c}_b, 6) as {c}" for c in _LIVE)
          + " from labelled, s where _day = 'Friday'")
def p13d(spark, sf_dir):
    df = view(spark, sf_dir, "labelled")
    params = scale.fit_scaler(df.where("_day = 'Monday'"), _LIVE, "standard")
    stored = scale.params_from_frame(scale.params_frame(spark, params))
    return rounded(scale.apply_scaler(df.where("_day = 'Friday'"), stored).select("flow_key", *_LIVE))


@register("p18_require_columns", "select l_orderkey as \"L_ORDERKEY\", l_quantity as qty from lineitem")
def p18(spark, sf_dir):
    df = table(spark, sf_dir, "lineitem")
    a, b = columns.require_columns(df, ["L_ORDERKEY", "l_quantity"])
    return df.select(F.col(a).alias("L_ORDERKEY"), F.col(b).alias("qty"))


@register("p19_ground_truth", RAW + f"""select {ID}, case when upper(trim(coalesce(label, 'nan'))) in
  ('BENIGN','NORMAL','NORMAL.','NORMAL TRAFFIC','0','0.0') then 0 else 1 end as y_true from flows_raw""")
def p19(spark, sf_dir):
    df, _ = labels.with_ground_truth(_raw(spark, sf_dir))
    return df.select("l_orderkey", "l_linenumber", "y_true")


@register("p20_coerce_features", RAW + f"select {ID}, " + ", ".join(
    f"coalesce(case when isfinite(try_cast({c} as double)) then try_cast({c} as double) end, 0.0) as {c}" for c in NUM) + f""" from (
  select {ID}, """ + ", ".join(f"case when l_linenumber = 3 then 'n/a' else cast({c} as varchar) end as {c}" for c in NUM) + " from flows_raw)")
def p20(spark, sf_dir):
    texts = [F.when(F.col("l_linenumber") == 3, "n/a").otherwise(F.col(c).cast("string")).alias(c) for c in NUM]
    df = _raw(spark, sf_dir).select("l_orderkey", "l_linenumber", *texts)
    return clean.coerce_features(df, NUM)


@register("p21_bound_live_cells", RAW + f"select {ID}, " + ", ".join(
    f"""case when {c} is null or isnan({c}) then 0 when {c} = 'inf'::double then 1e10 when {c} = -('inf'::double) then -1e10
  else least(greatest({c}, -1e15), 1e15) end as {c}""" for c in NUM) + " from flows_raw")
def p21(spark, sf_dir):
    return clean.bound_live_cells(_raw(spark, sf_dir), NUM).select("l_orderkey", "l_linenumber", *NUM)


@register("p28_flat_columns", "select vec_id, label from embeddings")
def p28(spark, sf_dir):
    return columns.flat_columns(table(spark, sf_dir, "embeddings"))


@register("u1_union_columns", """select event_id as id, event_type as kind, null::double as price from events
  union all select l_orderkey, null, l_extendedprice from lineitem""")
def u1(spark, sf_dir):
    a = table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), F.col("event_type").alias("kind"))
    b = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("id"), F.col("l_extendedprice").alias("price"))
    return a.unionByName(b, allowMissingColumns=True)


@register("u2_keep_first", RAW + f"""select {ID}, fwd_len, iat_mean, label, round({NN.format('bytes_s')}, 4) as bytes_s, min(_day) as _day from flows_raw
  where label is not null group by l_orderkey, l_linenumber, flow_ts, fwd_len, iat_mean, down_up, const_col, label, bytes_s""")
def u2(spark, sf_dir):
    return rounded(_first(spark, sf_dir).select("l_orderkey", "l_linenumber", "fwd_len", "iat_mean", "label", "bytes_s", "_day"), 4)


@register("a1_a2_basic_stats", RAW + """select dtype, columns, (select count(*) from flows_raw) as total_rows, 12 as total_columns
  from (values ('bigint', 1), ('double', 6), ('int', 1), ('string', 3), ('timestamp_ntz', 1)) t(dtype, columns)""")
def a1(spark, sf_dir):
    return audit.basic_stats(_raw(spark, sf_dir))


def _miss(c):
    return f"({c} is null or isnan({c}))" if c in NUM or c == COPY else f"{c} is null"


_COLS = [c.strip() for c in ALL.split(",")]


@register("a3_missing_values", RAW + "select * from (" + " union all ".join(
    f"""select '{c}' as "column", count(*) filter (where {_miss(c)}) as "count",
    round(100.0 * count(*) filter (where {_miss(c)}) / count(*), 4) as percent from flows_raw""" for c in _COLS) + """) where "count" > 0""")
def a3(spark, sf_dir):
    return audit.missing_values(_raw(spark, sf_dir))


_NUMERIC_ALL = ["l_orderkey", "l_linenumber", "fwd_len", "fwd_len_1", "bytes_s", "iat_mean", "down_up", "const_col"]


@register("a4_infinities", RAW + """select * from (select 'bytes_s' as "column", count(*) filter (where bytes_s = 'inf'::double) as positive_inf,
  count(*) filter (where bytes_s = -('inf'::double)) as negative_inf, count(*) filter (where isinf(bytes_s)) as total,
  round(100.0 * count(*) filter (where isinf(bytes_s)) / count(*), 4) as percent from flows_raw) where total > 0""")
def a4(spark, sf_dir):
    return audit.infinities(_raw(spark, sf_dir))


@register("a5_duplicates", RAW + f"""select count(*) as total_rows,
  count(*) - (select count(*) from (select distinct {ALL} from flows_raw)) as full_duplicates,
  count(*) - (select count(*) from (select distinct {PLAIN} from flows_raw)) as without_meta from flows_raw""")
def a5(spark, sf_dir):
    return audit.duplicate_rows(_raw(spark, sf_dir))


@register("a6_label_distribution", RAW + """select * from (select label, count(*) as "count",
  round(100.0 * count(*) / sum(count(*)) over (), 2) as percent from flows_raw group by label) where label is not null""")
def a6(spark, sf_dir):
    return audit.label_distribution(_raw(spark, sf_dir), "label")


_EXT = " union all ".join(
    f"""select '{c}' as "column", min(x) as min, max(x) as max, quantile_cont(x, 0.01) as q01, quantile_cont(x, 0.99) as q99
    from (select {FIN.format(c + '::double')} as x from flows_raw)""" for c in _NUMERIC_ALL)


@register("a7_extreme_columns", RAW + f"""select "column", min, max, round(q01, 6) as q01, round(q99, 6) as q99,
  max > q99 * 100 or (q01 <> 0 and min < q01 * 100) as extreme from ({_EXT})""")
def a7(spark, sf_dir):
    return rounded(audit.extreme_columns(_raw(spark, sf_dir)))


@register("a7c_issues", RAW + f""", e as (select * from ({_EXT}) where max > q99 * 100 or (q01 <> 0 and min < q01 * 100)),
  d as (select count(*) as n, count(*) - (select count(*) from (select distinct {ALL} from flows_raw)) as k from flows_raw)
  select * from (
  select 1 as ord, case when n > 0 then printf('Found %d columns with NaN values', n) end as issue from (select """ + " + ".join(
    f"(count(*) filter (where {_miss(c)}) > 0)::int" for c in _COLS) + """ as n from flows_raw)
  union all select 2, case when n > 0 then printf('Found %d columns with Inf values', n) end from (select (count(*) filter (where isinf(bytes_s)) > 0)::int as n from flows_raw)
  union all select 3, case when k > 0 then format('Found {:,} duplicate rows ({:.1f}%)', k, 100.0::double * k / n) end from d
  union all select 5, case when count(*) > 0 then 'Columns with extreme outliers: ' || array_to_string(list_sort(list("column"))[1:5], ', ') end from e
  ) where issue is not null""")
def a7c(spark, sf_dir):
    return audit.issues(_raw(spark, sf_dir))


_STATS = " union all ".join(
    f"""select '{c}' as feature, 'double' as dtype, min(x) as min, max(x) as max, round(avg(x), 6) as mean, round(stddev_samp(x), 6) as std,
    round(quantile_cont(x, 0.5), 6) as median, round(quantile_cont(x, 0.01), 6) as q01, round(quantile_cont(x, 0.99), 6) as q99,
    count(*) filter (where {_miss(c)}) as null_count, count(*) filter (where isinf({c})) as inf_count
    from (select {c}, {FIN.format(c)} as x from flows_raw)""" for c in NUM)


@register("a8_feature_stats", RAW + _STATS)
def a8(spark, sf_dir):
    return rounded(audit.feature_stats(_raw(spark, sf_dir), NUM))


@register("a9_weekday_traffic", RAW + """select _day as day, list_position(['Monday','Tuesday','Wednesday','Thursday','Friday','Saturday','Sunday'], _day) as day_ord,
  count(*) filter (where label = 'BENIGN') as benign, count(*) filter (where label <> 'BENIGN') as attack
  from flows_raw where label is not null group by all""")
def a9(spark, sf_dir):
    return audit.weekday_traffic(_raw(spark, sf_dir), "label")


def _corr_sql(src, cols):
    fin = FIN.format
    return " union all ".join(
        f"select '{a}' as a, '{b}' as b, round(case when isfinite(r) then r end, 6) as corr from (select corr({fin(a)}, {fin(b)}) as r from {src})"
        for i, a in enumerate(cols) for b in cols[i:])


_CORR = list(NUM)


@register("a10_correlations", RAW + _corr_sql("flows_raw", _CORR))
def a10(spark, sf_dir):
    return rounded(audit.correlations(_raw(spark, sf_dir), _CORR))


@register("a10_correlations_top2", _corr_sql("lineitem", ["l_extendedprice", "l_quantity"]))
def a10_top(spark, sf_dir):
    cols = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
    return rounded(audit.correlations(table(spark, sf_dir, "lineitem"), cols, k=2))


_HIST = list(NUM)


@register("a11_histograms", RAW + " union all ".join(
    f"""select '{c}' as feature, bin, round(lo + (hi - lo) / 30 * bin, 4) as bin_start, count(*) as "count" from (
     select case when hi > lo then least(floor((least(greatest(x, lo), hi) - lo) / ((hi - lo) / 30)), 29)::int else 0 end as bin, lo, hi from
       (select {FIN.format(c)} as x from flows_raw), (select quantile_cont({FIN.format(c)}, 0.01) as lo, quantile_cont({FIN.format(c)}, 0.99) as hi from flows_raw)
     where x is not null) group by all""" for c in _HIST))
def a11(spark, sf_dir):
    return rounded(audit.histograms(_raw(spark, sf_dir), _HIST), 4)


@register("o1_sort_counts", RAW + "select label, count(*) as n from flows_raw group by all")
def o1(spark, sf_dir):
    return _raw(spark, sf_dir).groupBy("label").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "label")


@register("o2_top_variance", RAW + f"""select feature, round(v, 4) as variance from ({' union all '.join(
    f"select '{c}' as feature, var_samp(l_{c}) as v from lineitem" for c in ('quantity', 'extendedprice', 'discount', 'tax'))}) order by v desc limit 2""")
def o2(spark, sf_dir):
    df = table(spark, sf_dir, "lineitem")
    cols = ("quantity", "extendedprice", "discount", "tax")
    best = [c.removeprefix("l_") for c in audit.top_variance(df, [f"l_{c}" for c in cols], 2)]
    cells = [F.struct(F.lit(c).alias("feature"), F.var_samp(f"l_{c}").alias("variance")) for c in best]
    return rounded(df.agg(F.array(*cells).alias("r")).select(F.explode("r").alias("r")).select("r.*"), 4)


@register("o4_first_rows", "select event_id, value from events order by event_id limit 50")
def o4(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", "value").orderBy("event_id").limit(50)


# ---- splits ---------------------------------------------------------------------------------

LAB = cte("labelled")
_TEMPORAL_SQL = LAB + """, sp as (select *, case when _day in ('Monday','Tuesday','Wednesday') then 'train'
  when _day = 'Thursday' then 'val' when _day = 'Friday' then 'test' end as split from labelled)"""


@register("p14_temporal_split", _TEMPORAL_SQL + "select flow_key, _day, split from sp where split is not null")
def p14(spark, sf_dir):
    return split.temporal_split(view(spark, sf_dir, "labelled")).select("flow_key", "_day", "split")


@register("j4_day_membership", _TEMPORAL_SQL + "select flow_key from sp where split = 'train'")
def j4(spark, sf_dir):
    return split.temporal_split(view(spark, sf_dir, "labelled")).where("split = 'train'").select("flow_key")


def split_sql(stratum: str) -> str:
    h = hash_order_sql("flow_key")
    return LAB + f""", c as (select {stratum} as s, count(*) as n from labelled group by all),
  e as (select s, n, ceil((select sum(n) from c) * 0.15) * n / sum(n) over () as x from c),
  tk as (select s, n, floor(x) + (row_number() over (order by x - floor(x) desc, s) <= (select ceil(sum(n) * 0.15) - sum(floor(x)) from e))::int as k from e),
  l as (select s, n - k as n, k from tk),
  e2 as (select s, k, ceil((select sum(n) from l) * 0.15 / 0.85) * n / sum(n) over () as x from l),
  vk as (select s, k, floor(x) + (row_number() over (order by x - floor(x) desc, s) <= (select ceil((select sum(n) from l) * 0.15 / 0.85) - sum(floor(x)) from e2))::int as v from e2),
  r as (select *, {stratum} as s, row_number() over (partition by {stratum} order by {h}) as rn from labelled),
  sp as (select r.*, case when rn <= k then 'test' when rn <= k + v then 'val' else 'train' end as split from r join vk using (s)) """


def _stratified(spark, sf_dir, stratum="label_binary"):
    return split.stratified_split(view(spark, sf_dir, "labelled"), ["flow_key"], stratum)


@register("p15_stratified_split", split_sql("label_binary") + "select flow_key, label_binary, split from sp")
def p15(spark, sf_dir):
    return _stratified(spark, sf_dir).select("flow_key", "label_binary", "split")


@register("p15_multiclass_split", split_sql("label_multiclass") + "select flow_key, label_multiclass, split from sp")
def p15m(spark, sf_dir):
    return _stratified(spark, sf_dir, "label_multiclass").select("flow_key", "label_multiclass", "split")


@register("p15_random_split", split_sql("0") + "select flow_key, split from sp")
def p15r(spark, sf_dir):
    return _stratified(spark, sf_dir, None).select("flow_key", "split")


@register("p16_sample_fraction", LAB + f"select flow_key from labelled where {hash_order_sql('flow_key')} < cast(0.1 * pow(16, 13) as bigint)")
def p16(spark, sf_dir):
    return split.sample_fraction(view(spark, sf_dir, "labelled"), 0.1, ["flow_key"]).select("flow_key")


@register("p16_sample_rows", LAB + f"select flow_key from labelled order by {hash_order_sql('flow_key')} limit 1000")
def p16n(spark, sf_dir):
    return split.sample_rows(view(spark, sf_dir, "labelled"), 1000, ["flow_key"]).select("flow_key")


@register("p17_sample_attacks", LAB + f"select flow_key, label_binary from labelled where label_binary = 1 order by {hash_order_sql('flow_key')} limit 100")
def p17(spark, sf_dir):
    return split.sample_positives(view(spark, sf_dir, "labelled"), 100, "label_binary", ["flow_key"]).select("flow_key", "label_binary")


@register("a12_split_summary", split_sql("label_binary") + """select split, count(*) as "rows", round(100.0 * count(*) / sum(count(*)) over (), 6) as percent,
  count(*) filter (where label_binary = 0) as benign, count(*) filter (where label_binary = 1) as attack,
  round(100.0 * count(*) filter (where label_binary = 0) / count(*), 6) as benign_percent,
  round(100.0 * count(*) filter (where label_binary = 1) / count(*), 6) as attack_percent,
  count(distinct label_multiclass) as classes from sp group by split""")
def a12(spark, sf_dir):
    return rounded(split.split_summary(_stratified(spark, sf_dir)))


@register("a13_split_balance", _TEMPORAL_SQL + """, q as (select split, avg((label_binary = 1)::int) as r from sp where split is not null group by split)
  select round(max(r) - min(r), 6) as max_diff, case when max(r) - min(r) < 0.05 then 'balanced' when max(r) - min(r) < 0.15 then 'minor' else 'significant' end as verdict from q""")
def a13(spark, sf_dir):
    return rounded(split.split_balance(split.temporal_split(view(spark, sf_dir, "labelled"))))


@register("a14_split_distributions", split_sql("label_binary") + """select split, 'all' as kind, null::int as label, count(*) as "rows" from sp group by split
  union all select split, 'binary', label_binary, count(*) from sp group by split, label_binary
  union all select split, 'multiclass', label_multiclass, count(*) from sp group by split, label_multiclass""")
def a14(spark, sf_dir):
    return split.split_distributions(_stratified(spark, sf_dir))
