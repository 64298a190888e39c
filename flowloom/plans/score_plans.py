"""Scoring, evaluation, monitoring, alert and run-store queries."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from flowloom.functions.lineage import session_dir
from flowloom.operators import alerts, evaluate, flows, monitor, runs, score
from flowloom.plans.flow_plans import FLOW_CTE
from flowloom.plans.registry import register, rounded
from flowloom.plans.views import cte, table, view
from flowloom.sources import run_store
from flowloom.streaming import packet_flows

SC = cte("scored") + """, dec as (select *, (probability >= 0.5)::int as prediction, probability >= 0.5 as is_attack,
  case when probability >= 0.5 then probability else 1 - probability end as confidence from scored)
"""


def _dec(spark, sf_dir):
    df = view(spark, sf_dir, "scored").withColumnRenamed("class_name", "event_type")
    return score.decide(df)


def _div(a, b):
    return f"coalesce(({a})::double / nullif({b}, 0), 0.0)"


_CELLS = """count(*) filter (where y_true = 1 and prediction = 1) as true_positives,
  count(*) filter (where y_true <> 1 and prediction = 1) as false_positives,
  count(*) filter (where y_true <> 1 and prediction <> 1) as true_negatives,
  count(*) filter (where y_true = 1 and prediction <> 1) as false_negatives"""


def metrics_sql(src, digits=6, extra=""):
    """Scores from a table that has the four confusion columns."""
    p, r = _div("true_positives", "true_positives + false_positives"), _div("true_positives", "true_positives + false_negatives")
    acc = _div("true_positives + true_negatives", "true_positives + true_negatives + false_positives + false_negatives")
    spec = _div("true_negatives", "true_negatives + false_positives")
    return f"""select {extra} true_positives, false_positives, true_negatives, false_negatives, round(p, {digits}) as precision,
      round(r, {digits}) as recall, round({_div('2 * p * r', 'p + r')}, {digits}) as f1, round(acc, {digits}) as accuracy,
      round(spec, {digits}) as specificity from (select *, {p} as p, {r} as r, {acc} as acc, {spec} as spec from {src})"""


@register("p22_f10_threshold", SC + """select flow_index, probability, prediction, is_attack,
  case when is_attack then 'ATTACK' else 'BENIGN' end as class_name, round(confidence, 6) as confidence from dec""")
def p22(spark, sf_dir):
    return rounded(_dec(spark, sf_dir).select("flow_index", "probability", "prediction", "is_attack", "class_name", "confidence"))


@register("p24_recent_attacks", SC + "select flow_index, ts_us from dec where is_attack order by ts_us desc limit 100")
def p24(spark, sf_dir):
    return monitor.last_rows(_dec(spark, sf_dir).where("is_attack"), 100).select("flow_index", "ts_us")


@register("p29_result_rows", SC + """select ts_us as timestamp, src_ip, 0 as src_port, dst_ip, dst_port, 6 as protocol, 1 as packets,
  40 as bytes, is_attack, round(confidence, 6) as confidence, case when is_attack then 'ATTACK' else 'BENIGN' end as class_name from dec""")
def p29(spark, sf_dir):
    df = _dec(spark, sf_dir).withColumns({
        "timestamp": F.col("ts_us"), "src_port": F.lit(0), "protocol": F.lit(6), "packets": F.lit(1), "bytes": F.lit(40)})
    return rounded(score.result_rows(df))


def _file_rows(spark, sf_dir):
    return _dec(spark, sf_dir).withColumns({
        "timestamp": F.col("ts_us"), "src_port": F.lit(0), "protocol": F.lit(6), "packets": F.lit(1), "bytes": F.lit(40), "duration": F.col("latency_ms")})


_FILE = "ts_us as timestamp, src_ip, 0 as src_port, dst_ip, dst_port, 6 as protocol, printf('%.4f', latency_ms) as duration, 1 as packets, 40 as bytes,"


@register("s13_flow_file_rows", SC + f"select {_FILE} prediction, case when is_attack then 'ATTACK' else 'BENIGN' end as class_name, is_attack, printf('%.4f', confidence) as confidence from dec")
def s13(spark, sf_dir):
    return score.flow_file_rows(_file_rows(spark, sf_dir))


@register("s14_attack_file_rows", SC + f"select {_FILE} printf('%.4f', confidence) as confidence, probability from dec where is_attack")
def s14(spark, sf_dir):
    return score.attack_file_rows(_file_rows(spark, sf_dir))


@register("s14_attack_lines", SC + """select '[' || ts_us || '] ATTACK: ' || src_ip || ':0 -> ' || dst_ip || ':' || dst_port || printf(' (%.1f%%)', confidence * 100) as value
  from dec where is_attack""")
def s14_lines(spark, sf_dir):
    return score.attack_log_lines(_file_rows(spark, sf_dir))


# Both sides add the same products in the same order, so ties agree to the last bit.
_VOTE3 = "(probability * 0.5::double + p2 * 0.3::double + p3 * 0.2::double)"
_AGAINST3 = "((1 - probability) * 0.5::double + (1 - p2) * 0.3::double + (1 - p3) * 0.2::double)"


@register("m6_soft_vote", SC + f"""select flow_index, round({_VOTE3}, 6) as p_attack, case when {_VOTE3} > {_AGAINST3} then 1 else 0 end as vote from scored""")
def m6(spark, sf_dir):
    cols = [F.col(c) for c in ("probability", "p2", "p3")]
    mean, best = score.soft_vote([[1 - c, c] for c in cols], [5, 3, 2])
    return rounded(view(spark, sf_dir, "scored").select("flow_index", mean[1].alias("p_attack"), best.alias("vote")))


_VOTES = SC + """, long as (select flow_index, unnest([(probability >= 0.5)::int, (p2 >= 0.5)::int, (p3 >= 0.5)::int, y_class]) as prediction from scored),
  cnt as (select flow_index, prediction, count(*) as n from long group by all)"""


@register("m7_hard_vote", _VOTES + """select flow_index, prediction from (select *, row_number() over (partition by flow_index order by n desc, prediction) as rn from cnt) where rn = 1""")
def m7(spark, sf_dir):
    df = view(spark, sf_dir, "scored")
    votes = F.array(*[(F.col(c) >= 0.5).cast("int") for c in ("probability", "p2", "p3")], F.col("y_class"))
    return score.hard_vote(df.select("flow_index", F.explode(votes).alias("prediction")), "flow_index")


@register("m7_majority", _VOTES + """select flow_index, prediction from (select *, row_number() over (partition by flow_index order by n desc, prediction) as rn from cnt) where rn = 1""")
def m7_row(spark, sf_dir):
    """Votes of one row are counted inside the row."""
    votes = F.array(*[(F.col(c) >= 0.5).cast("int") for c in ("probability", "p2", "p3")], F.col("y_class"))
    return view(spark, sf_dir, "scored").select("flow_index", score.majority(votes).alias("prediction"))


_MODELS = {"a": "probability", "b": "p2", "c": "p3"}
_LONG = SC + """, m as (select flow_index, y_true, unnest(['a','b','c']) as model, unnest([probability, p2, p3]) as probability from scored)"""


@register("m8_model_rows", _LONG + "select flow_index, model, probability from m")
def m8(spark, sf_dir):
    return score.model_rows(view(spark, sf_dir, "scored"), "flow_index", _MODELS)


def _per_model(spark, sf_dir):
    df = view(spark, sf_dir, "scored")
    cells = [F.struct(F.lit(n).alias("model"), F.col(c).alias("probability")) for n, c in _MODELS.items()]
    long = df.select("y_true", F.explode(F.array(*cells)).alias("m")).select("y_true", "m.*")
    return score.decide(long)


_COMPARE = _LONG + f""", d as (select *, (probability >= 0.5)::int as prediction from m), c as (select model, {_CELLS} from d group by model),
  s as ({metrics_sql('c', 6, 'model,')})"""


@register("m12_compare_models", _COMPARE + "select * from s")
def m12(spark, sf_dir):
    return rounded(evaluate.binary_metrics(_per_model(spark, sf_dir), groups=["model"]).orderBy(F.desc("f1"), "model"))


@register("o7_top_models", _COMPARE + "select model, f1 from s order by f1 desc, model limit 2")
def o7(spark, sf_dir):
    df = evaluate.binary_metrics(_per_model(spark, sf_dir), groups=["model"])
    return rounded(df.select("model", "f1").orderBy(F.desc("f1"), "model").limit(2))


@register("a16_confusion", SC + f"select {_CELLS} from dec")
def a16(spark, sf_dir):
    return evaluate.confusion(_dec(spark, sf_dir))


@register("a17_a18_binary_metrics", SC + f", c as (select {_CELLS} from dec) {metrics_sql('c')}")
def a17(spark, sf_dir):
    return rounded(evaluate.binary_metrics(_dec(spark, sf_dir)))


_Q = ", ".join(f"round(quantile_cont(latency_ms, {q}), {{d}}) as {n}_ms" for n, q in (("p50", 0.5), ("p95", 0.95), ("p99", 0.99)))


@register("a19_latency", SC + "select " + _Q.replace("{d}", "6") + ", round(avg(latency_ms), 6) as mean_ms, round(max(latency_ms), 6) as max_ms from scored")
def a19(spark, sf_dir):
    return rounded(evaluate.latency_summary(view(spark, sf_dir, "scored")))


@register("a20_final_report", SC + f""", c as (select count(*) as total_flows, sum(prediction)::bigint as total_alerts,
   (max(ts_us) - min(ts_us)) / 1e6 as s, {_CELLS}, {_Q.replace('{d}', '2')}, round(avg(latency_ms), 2) as mean_ms, round(max(latency_ms), 2) as max_ms from dec),
   m as ({metrics_sql('c', 4, 'total_flows, total_alerts, s, p50_ms, p95_ms, p99_ms, mean_ms, max_ms,')})
   select * exclude (s, specificity), round(s, 2) as elapsed_seconds, round(total_flows / s, 1) as throughput_flows_per_sec from m""")
def a20(spark, sf_dir):
    return evaluate.final_report(_dec(spark, sf_dir))


@register("s24_report_text", SC + f""", c as (select count(*) as total_flows, sum(prediction)::bigint as total_alerts,
   (max(ts_us) - min(ts_us)) / 1e6 as s, {_CELLS}, {_Q.replace('{d}', '2')}, round(avg(latency_ms), 2) as mean_ms, round(max(latency_ms), 2) as max_ms from dec),
   m as ({metrics_sql('c', 4, 'total_flows, total_alerts, s, p50_ms, p95_ms, p99_ms, mean_ms, max_ms,')}),
   t as (select ['RUN REPORT', format('Total Flows Processed: {{:,}}', total_flows), format('Total Alerts Generated: {{:,}}', total_alerts),
     format('Elapsed Time: {{:.2f}} seconds', round(s, 2)), format('Throughput: {{:.0f}} flows/sec', round(total_flows / s, 1)),
     format('Precision: {{:.4f}}', precision), format('Recall: {{:.4f}}', recall), format('F1: {{:.4f}}', f1), format('Accuracy: {{:.4f}}', accuracy),
     format('Actual Benign: {{:,}} benign, {{:,}} attack', true_negatives, false_positives),
     format('Actual Attack: {{:,}} benign, {{:,}} attack', false_negatives, true_positives),
     format('p50 latency: {{:.2f}} ms', p50_ms), format('p95 latency: {{:.2f}} ms', p95_ms), format('p99 latency: {{:.2f}} ms', p99_ms),
     format('mean latency: {{:.2f}} ms', mean_ms), format('max latency: {{:.2f}} ms', max_ms)] as l from m)
   select unnest(range(16))::int as line, unnest(l) as text from t""")
def s24(spark, sf_dir):
    return evaluate.report_text(evaluate.final_report(_dec(spark, sf_dir)))


@register("a21_scoring_summary", SC + """select count(*) as total_flows, count(*) filter (where prediction = 0) as benign_count,
  count(*) filter (where prediction = 1) as attack_count, round(avg(prediction) * 100, 6) as attack_rate, round(avg(confidence) * 100, 6) as avg_confidence from dec""")
def a21(spark, sf_dir):
    return rounded(evaluate.scoring_summary(_dec(spark, sf_dir)))


@register("a22_probability_histogram", SC + """select b as bin, round(b / 10.0::double, 1) as bin_start, count(flow_index) as "count"
  from range(10) r(b) left join scored on least(floor(probability * 10), 9)::bigint = b group by all""")
def a22(spark, sf_dir):
    return evaluate.probability_histogram(view(spark, sf_dir, "scored"))


@register("a23_analyzer_counters", SC + """select count(*) as total_predictions, count(*) filter (where prediction = 0) as benign_count,
  count(*) filter (where prediction = 1) as attack_count, round(avg(1 - prediction), 6) as benign_rate, round(avg(prediction), 6) as attack_rate from dec""")
def a23(spark, sf_dir):
    return rounded(evaluate.analyzer_counters(_dec(spark, sf_dir)))


# ---- multiclass and ranking metrics -----------------------------------------------------------

_CLS = """, cl as (select distinct c from (select y_class as c from scored union all select pred_class from scored)),
  pc as (select c as class, count(*) filter (where y_class = c) as support, count(*) filter (where pred_class = c) as claimed,
     count(*) filter (where y_class = c and pred_class = c) as hit from scored, cl group by c),
  ps as (select *, coalesce(hit::double / nullif(claimed, 0), 0) as precision, coalesce(hit::double / nullif(support, 0), 0) as recall from pc),
  pf as (select *, coalesce(2 * precision * recall / nullif(precision + recall, 0), 0) as f1 from ps)"""


@register("a16_class_table", SC + "select y_class as y_true, pred_class as y_pred, count(*) as n from scored group by all")
def a16k(spark, sf_dir):
    return evaluate.class_table(view(spark, sf_dir, "scored"), "y_class", "pred_class")


@register("a29_multiclass_metrics", SC + _CLS + " select round(sum(hit) / sum(support)::double, 6) as accuracy, " + ", ".join(
    f"round(avg({c}), 6) as {c}_macro, round(sum({c} * support) / sum(support), 6) as {c}_weighted" for c in ("precision", "recall", "f1")) + " from pf")
def a29(spark, sf_dir):
    return rounded(evaluate.multiclass_metrics(view(spark, sf_dir, "scored"), "y_class", "pred_class"))


@register("a29_document_labels", """with x as (select quality as y_class, toxic as pred_class from labels), scored as (select * from x)""" + _CLS + " select round(sum(hit) / sum(support)::double, 6) as accuracy, " + ", ".join(
    f"round(avg({c}), 6) as {c}_macro, round(sum({c} * support) / sum(support), 6) as {c}_weighted" for c in ("precision", "recall", "f1")) + " from pf")
def a29_labels(spark, sf_dir):
    return rounded(evaluate.multiclass_metrics(table(spark, sf_dir, "labels"), "quality", "toxic"))


@register("a33_classification_report", SC + _CLS + """ select class::varchar as label, round(precision, 6) as precision, round(recall, 6) as recall, round(f1, 6) as f1, support::double as support from pf
  union all select 'accuracy', a, a, a, a from (select round(sum(hit) / sum(support)::double, 6) as a from pf)
  union all select 'macro avg', round(avg(precision), 6), round(avg(recall), 6), round(avg(f1), 6), sum(support)::double from pf
  union all select 'weighted avg', round(sum(precision * support) / sum(support), 6), round(sum(recall * support) / sum(support), 6), round(sum(f1 * support) / sum(support), 6), sum(support)::double from pf""")
def a33(spark, sf_dir):
    return rounded(evaluate.classification_report(view(spark, sf_dir, "scored"), "y_class", "pred_class"))


@register("a35_normalised_confusion", SC + """, c as (select y_class as y_true, pred_class as y_pred, count(*) as n from scored group by all)
  select *, round(n / sum(n) over (partition by y_true), 6) as share from c""")
def a35(spark, sf_dir):
    return rounded(evaluate.normalised_confusion(view(spark, sf_dir, "scored"), "y_class", "pred_class"))


def _steps(src, truth, sc, group=""):
    g, part = (f"{group}, ", f"partition by {group} ") if group else ("", "")
    return f""", g as (select {g}{sc} as s, count(*) filter (where {truth} = 1) as pos, count(*) filter (where {truth} <> 1) as neg from {src} group by all),
    st as (select *, sum(pos) over ({part}order by s desc) as tp, sum(neg) over ({part}order by s desc) as fp,
           sum(pos) over ({part[:-1]}) as p, sum(neg) over ({part[:-1]}) as n from g),
    ar as (select {g} sum(pos)::bigint as positives, sum(neg)::bigint as negatives,
       case when any_value(p) > 0 and any_value(n) > 0 then sum(neg * (tp - pos + pos / 2.0::double)) / (any_value(p)::double * any_value(n)) else 0.0 end as roc,
       case when any_value(p) > 0 and any_value(n) > 0 then sum(pos * (tp::double / (tp + fp))) / any_value(p) else 0.0 end as ap from st {'group by ' + group if group else ''})"""


@register("a30_a31_roc_pr_area", SC + _steps("scored", "y_true", "probability") + "select positives, negatives, round(roc, 6) as roc_auc, round(ap, 6) as pr_auc from ar")
def a30(spark, sf_dir):
    return rounded(evaluate.ranking_metrics(view(spark, sf_dir, "scored")))


@register("a30_area_per_run", SC + _steps("scored", "y_true", "probability", "run_id") + "select run_id, positives, negatives, round(roc, 6) as roc_auc, round(ap, 6) as pr_auc from ar")
def a30_runs(spark, sf_dir):
    return rounded(evaluate.ranking_metrics(view(spark, sf_dir, "scored"), groups=["run_id"]))


_OVR = SC + """, x as (select unnest([0, 1, 2, 3]) as class, unnest([(y_class = 0)::int, (y_class = 1)::int, (y_class = 2)::int, (y_class = 3)::int]) as hit,
   unnest([probability, p2, p3, 1 - probability]) as sc from scored)"""


@register("a32_roc_auc_ovr", _OVR + _steps("x", "hit", "sc", "class") + "select round(sum(roc * positives) / sum(positives), 6) as roc_auc_ovr from ar")
def a32(spark, sf_dir):
    df = view(spark, sf_dir, "scored").withColumn("p4", 1 - F.col("probability"))
    return rounded(evaluate.roc_auc_ovr(df, "y_class", {0: "probability", 1: "p2", 2: "p3", 3: "p4"}))


_POINTS = "s as threshold, round(fp::double / n, 9) as fpr, round(tp::double / p, 9) as tpr, round(tp::double / (tp + fp), 9) as precision, round(p::double / (p + n), 9) as baseline from st"


@register("a34_curve_points", SC + _steps("scored", "y_true", "probability") + "select " + _POINTS + " union all select 'inf'::double, 0, 0, 1, round(any_value(p)::double / any_value(p + n), 9) from st")
def a34(spark, sf_dir):
    return rounded(evaluate.curve_points(view(spark, sf_dir, "scored")), 9, skip=("threshold",))


@register("a34_multi_curve_points", _LONG + _steps("m", "y_true", "probability", "model") + "select model, " + _POINTS + " union all select model, 'inf'::double, 0, 0, 1, round(any_value(p)::double / any_value(p + n), 9) from st group by model")
def a34m(spark, sf_dir):
    return rounded(evaluate.curve_points(_per_model(spark, sf_dir), groups=["model"]), 9, skip=("threshold",))


@register("a36_class_weights", SC + "select y_class, count(*) as n, round(sum(count(*)) over () / (count(*) over () * count(*)), 6) as weight from scored group by y_class")
def a36(spark, sf_dir):
    return rounded(evaluate.class_weights(view(spark, sf_dir, "scored"), "y_class"))


@register("a36_positive_weight", SC + "select round(count(*) filter (where y_true = 0)::double / count(*) filter (where y_true = 1), 6) as scale_pos_weight from scored")
def a36b(spark, sf_dir):
    return rounded(evaluate.positive_weight(view(spark, sf_dir, "scored"), "y_true"))


# ---- monitoring -------------------------------------------------------------------------------


@register("w3_alert_ids", SC + "select run_id, row_number() over (partition by run_id order by flow_index) as id, flow_index, y_true = 1 as is_correct from scored where probability >= 0.5")
def w3(spark, sf_dir):
    return runs.numbered_alerts(view(spark, sf_dir, "scored")).select("run_id", "id", "flow_index", "is_correct")


_HOUR = 3_600_000_000
_SNAP = SC + f""", t as (select run_id, ts_us // {_HOUR} as tick, count(*) as flows, sum(prediction) as alerts, {_CELLS}, quantile_cont(latency_ms, [0.5, 0.95, 0.99]) as q from dec group by all),
  c as (select run_id, tick, flows, alerts, q, coalesce(tick - lag(tick) over (partition by run_id order by tick), 1) * 3600.0::double as secs, """ + ", ".join(
    f"cast(sum({a}) over (partition by run_id order by tick) as bigint) as {b}" for a, b in (
        ("flows", "flows_processed"), ("alerts", "alerts_generated"), *[(k, k) for k in ("true_positives", "false_positives", "true_negatives", "false_negatives")])
) + " from t), m as (" + metrics_sql("c", 6, "run_id, tick, flows_processed, alerts_generated, round(flows / secs, 9) as flows_per_second, round(alerts / secs, 9) as alerts_per_second, round(q[1], 6) as p50_ms, round(q[2], 6) as p95_ms, round(q[3], 6) as p99_ms,") + """)
  select * exclude (specificity) from m"""


@register("w4_w5_snapshots", _SNAP)
def w4(spark, sf_dir):
    df = monitor.snapshots(_dec(spark, sf_dir), _HOUR, ["run_id"], latency="latency_ms")
    fast = {c: F.round(c, 9) for c in ("flows_per_second", "alerts_per_second")}
    return rounded(df.withColumns(fast), 6, skip=tuple(fast))


_RUNNING = ("flows", "alerts", "true_positives", "false_positives", "true_negatives", "false_negatives")
_LATENCY_CLASS = "case when latency_ms > 0 then ceil(ln(latency_ms) / ln(1.01))::int when latency_ms <= 0 then -1073741824 end"
_LIVE = SC + f""", t as (select ts_us // {_HOUR} as tick, count(*) as flows, sum(prediction)::bigint as alerts, {_CELLS} from dec group by all),
  r as (select tick, {', '.join(f'{c} as new_{c}, sum({c}) over (order by tick)::bigint as {c}' for c in _RUNNING)} from t),
  h as (select ts_us // {_HOUR} as tick, {_LATENCY_CLASS} as class, count(*) as n from dec group by all having class is not null),
  u as (select t.tick, h.class, sum(h.n) as n from t join h on h.tick <= t.tick group by all),
  v as (select tick, class, sum(n) over (partition by tick order by class) as upto, sum(n) over (partition by tick) as total from u),
  q as (select tick, {', '.join(f'min(class) filter (where upto > {p} * (total - 1)) as c{n}' for p, n in ((0.5, 50), (0.95, 95), (0.99, 99)))} from v group by tick),
  m as ({metrics_sql('r', 6, 'tick, flows, alerts, ' + ', '.join(f'new_{c}' for c in _RUNNING) + ',')})
  select m.*, {', '.join(f'case when c{n} = -1073741824 then 0.0::double else round(pow(1.01, c{n} - 0.5), 6) end as p{n}_ms' for n in (50, 95, 99))} from m join q using (tick)"""


@register("st7_live_metrics", _LIVE)
def st7(spark, sf_dir):
    per = packet_flows.live_metrics(_dec(spark, sf_dir).withColumn("ts", F.timestamp_micros("ts_us")), "1 hour")
    tick = F.floor(F.unix_micros("window.start") / F.lit(_HOUR)).alias("tick")
    return rounded(per.select(tick, *[c for c in per.columns if c != "window"]))


@register("w6_moving_stats", SC + """select flow_index, round(avg(latency_ms) over w, 8) as mean, min(latency_ms) over w as min, max(latency_ms) over w as max,
  round(coalesce(stddev_samp(latency_ms) over w, 0), 8) as std from scored window w as (partition by class_name order by ts_us, flow_index rows 99 preceding)""")
def w6(spark, sf_dir):
    df = monitor.moving_stats(view(spark, sf_dir, "scored"), "latency_ms", 100, ["ts_us", "flow_index"], ["class_name"])
    return rounded(df.select("flow_index", "mean", "min", "max", "std"), 8, skip=("min", "max"))


@register("w7_recent_attack_rate", SC + "select flow_index, round(avg(prediction) over (order by ts_us, flow_index rows 99 preceding), 9) as recent_attack_rate from dec")
def w7(spark, sf_dir):
    df = monitor.recent_attack_rate(_dec(spark, sf_dir), 100, ["ts_us", "flow_index"])
    return rounded(df.select("flow_index", "recent_attack_rate"), 9)


# Attack times compressed a thousandfold, as in the packet view, so windows of seconds fill up.
_ATT = SC + """, att as (select run_id, flow_index, 1704067200000000 + (ts_us - 1704067200000000) // 1000 as ts_us, src_ip, dst_ip, class_name from dec where is_attack),
  w as (select *, count(*) over (partition by run_id order by ts_us range between 59999999 preceding and current row) as recent from att)"""


def _attacks(spark, sf_dir):
    fast = F.lit(1704067200000000) + F.floor((F.col("ts_us") - F.lit(1704067200000000)) / F.lit(1000))
    df = view(spark, sf_dir, "scored").where("probability >= 0.5")
    return df.select("run_id", "flow_index", fast.alias("ts_us"), "src_ip", "dst_ip", "class_name")


@register("w8_w11_recent_attacks", _ATT + """select run_id, ts_us, count(*) as attacks, max(recent) as recent,
  case when max(recent) >= 50 then 'critical' when max(recent) >= 20 then 'high' when max(recent) >= 10 then 'medium' else 'low' end as severity
  from w group by run_id, ts_us""")
def w8(spark, sf_dir):
    df = alerts.recent_attacks(_attacks(spark, sf_dir), groups=["run_id"])
    return df.withColumn("severity", alerts.severity(F.col("recent")))


_FIRE = _ATT.replace("with scored", "with recursive scored", 1) + """, nth as (select *, recent - count(*) over (partition by run_id, ts_us) + row_number() over (partition by run_id, ts_us order by flow_index) as upto from w),
  cand as (select run_id, ts_us, min(upto) as recent from nth where upto >= 10 group by all),
  chain as (select run_id, min(ts_us) as ts_us from cand group by run_id
    union all select c.run_id, (select min(d.ts_us) from cand d where d.run_id = c.run_id and d.ts_us > c.ts_us + 300000000) from chain c
    where (select min(d.ts_us) from cand d where d.run_id = c.run_id and d.ts_us > c.ts_us + 300000000) is not null),
  fired as (select run_id, ts_us, recent as attack_count from chain join cand using (run_id, ts_us))"""


@register("st5_burst_alerts", _FIRE + """select *, case when attack_count >= 50 then 'critical' when attack_count >= 20 then 'high' when attack_count >= 10 then 'medium' else 'low' end as severity from fired""")
def st5(spark, sf_dir):
    return alerts.burst_alerts(_attacks(spark, sf_dir), ["run_id"]).drop("at_once")


@register("a25_alert_breakdown", _FIRE + """, ins as (select a.run_id, f.ts_us as alert_us, a.ts_us, unnest(['attack_types','top_sources','top_targets']) as kind,
    unnest([a.class_name, a.src_ip, a.dst_ip]) as value from nth a join fired f on a.run_id = f.run_id and a.ts_us <= f.ts_us and a.ts_us > f.ts_us - 60000000
    where a.ts_us < f.ts_us or a.upto <= f.attack_count),
  cnt as (select run_id, alert_us, kind, value, count(*) as "count", min(ts_us) as first from ins group by all),
  rk as (select *, row_number() over (partition by run_id, alert_us, kind order by "count" desc, first, value)::int as rank from cnt)
  select * exclude (first) from rk where rank <= 5 or kind = 'attack_types'""")
def a25(spark, sf_dir):
    att = _attacks(spark, sf_dir)
    fired = alerts.burst_alerts(att, ["run_id"])
    keys = {"attack_types": "class_name", "top_sources": "src_ip", "top_targets": "dst_ip"}
    return alerts.alert_breakdown(att, fired, keys, ["flow_index"], ["run_id"], top={"top_sources": 5, "top_targets": 5})


_WALK = _ATT.replace("with scored", "with recursive scored", 1) + """, ev as (select run_id, flow_index, ts_us, row_number() over (partition by run_id order by ts_us, flow_index) as rn from att),
  walk as (select run_id, flow_index, ts_us, rn, true as ok, [ts_us] as passed from ev where rn = 1
    union all select run_id, flow_index, ts_us, rn, ok, case when ok then list_append(passed, ts_us)[-5:] else passed end from (
      select e.*, w.passed, len(list_filter(w.passed, lambda x: x >= e.ts_us - 10000000)) < 5 as ok
      from walk w join ev e on e.run_id = w.run_id and e.rn = w.rn + 1))
  select run_id, flow_index, ts_us from walk where ok"""


@register("st6_admission_limit", _WALK)
def st6(spark, sf_dir):
    """At most five admitted attacks per run in ten seconds."""
    return alerts.admit(_attacks(spark, sf_dir), 5, 10_000_000, ["flow_index"], ["run_id"]).select("run_id", "flow_index", "ts_us")


_DAY = 86_400_000_000


@register("w9_attack_timeline", SC + f""", t as (select ts_us // {_DAY} as tick, count(*) as f, sum(prediction) as a from dec group by all)
  select tick, cast(sum(f) over (order by tick) as bigint) as flows_total, cast(sum(a) over (order by tick) as bigint) as attacks_total,
  round(100.0::double * sum(a) over (order by tick) / sum(f) over (order by tick), 6) as attack_rate from t""")
def w9(spark, sf_dir):
    return rounded(monitor.attack_timeline(_dec(spark, sf_dir), _DAY))


@register("w10_batch_numbers", SC + "select flow_index, (row_number() over (order by flow_index) - 1) // 100 as batch_id from scored")
def w10(spark, sf_dir):
    return monitor.with_batch_number(view(spark, sf_dir, "scored"), 100, ["flow_index"]).select("flow_index", "batch_id")


@register("a24_session_stats", SC + """, p as (select count(*) as n, (max(ts_us) - min(ts_us)) / 1e6 as s from scored)
  select any_value(s) as runtime_seconds, any_value(n) as total_packets, count(*) as total_flows, sum(prediction)::bigint as total_attacks,
  round(avg(prediction), 6) as attack_rate, round(any_value(n / s), 6) as packets_per_second from dec, p""")
def a24(spark, sf_dir):
    df = _dec(spark, sf_dir)
    return rounded(monitor.session_stats(df.select("ts_us"), df))


@register("st9_live_totals", FLOW_CTE + """, fl as (select min(ts_us) as a, max(ts_us) as z, bool_or(dst_port = 80 or src_port = 80) as attack from sessions
    group by src_ip, src_port, dst_ip, dst_port, protocol, session),
  t as (select ts_us // 1000000 as tick, 1 as p, 0 as f, 0 as k, 0 as o from packets union all select a // 1000000, 0, 1, attack::int, 1 from fl
    union all select (z + 120000000) // 1000000 + 1, 0, 0, 0, -1 from fl),
  s as (select tick, sum(p) as p, sum(f) as f, sum(k) as k, sum(o) as o from t group by tick),
  c as (select tick, p::bigint as packets, cast(sum(p) over w as bigint) as total_packets, p / 1.0::double as packets_per_sec, cast(sum(f) over w as bigint) as total_flows,
    cast(sum(k) over w as bigint) as total_attacks, cast(sum(o) over w as bigint) as active_flows from s window w as (order by tick))
  select *, round(total_attacks / greatest(total_flows, 1)::double, 9) as attack_rate from c""")
def st9(spark, sf_dir):
    packets = view(spark, sf_dir, "packets")
    finished = flows.flow_moments(packets).withColumn("is_attack", (F.col("src_port") == 80) | (F.col("dst_port") == 80))
    return rounded(monitor.live_totals(packets, finished, 1_000_000), 9)


@register("a26_top_sources_ports", SC + """select 'src_ip' as key, * from (select src_ip as value, count(*) as "count" from dec where is_attack group by all order by 2 desc, 1 limit 10)
  union all select 'dst_port', * from (select dst_port::varchar as value, count(*) as "count" from dec where is_attack group by all order by 2 desc, 1 limit 10)""")
def a26(spark, sf_dir):
    return monitor.top_values(_dec(spark, sf_dir).where("is_attack"), {"src_ip": F.col("src_ip"), "dst_port": F.col("dst_port")})


@register("a28_named_counters", SC + "select class_name as name, sum(prediction)::bigint as value from dec group by all")
def a28(spark, sf_dir):
    return monitor.named_counters(_dec(spark, sf_dir), "event_type", F.col("prediction"))


@register("o3_last_per_run", SC + "select run_id, flow_index from (select *, row_number() over (partition by run_id order by ts_us desc) as rn from scored) where rn <= 20")
def o3(spark, sf_dir):
    return monitor.last_rows(view(spark, sf_dir, "scored"), 20, groups=["run_id"]).select("run_id", "flow_index")


# ---- runs and alerts --------------------------------------------------------------------------

_ALERTS = SC + """, alerts as (select run_id, row_number() over (partition by run_id order by flow_index) as id, flow_index, ts_us, probability,
   y_true as true_label, y_true = 1 as is_correct from scored where probability >= 0.5),
  runs as (select run_id, min(ts_us) as started_us, max(ts_us) as finished_us, count(*) as total_flows from scored group by run_id)"""


def _alerts(spark, sf_dir):
    return runs.numbered_alerts(view(spark, sf_dir, "scored"))


def _runs(spark, sf_dir):
    return view(spark, sf_dir, "scored").groupBy("run_id").agg(
        F.min("ts_us").alias("started_us"), F.max("ts_us").alias("finished_us"), F.count(F.lit(1)).alias("total_flows"))


@register("p25_o6_alert_page", _ALERTS + "select id, flow_index from alerts where run_id = 1 and not is_correct order by id limit 100 offset 50")
def p25(spark, sf_dir):
    return runs.alert_page(_alerts(spark, sf_dir), 1, 100, 50, only_incorrect=True).select("id", "flow_index")


@register("p26_point_lookup", "select event_id, event_type, value from events where event_id = 17")
def p26(spark, sf_dir):
    return table(spark, sf_dir, "events").where("event_id = 17").select("event_id", "event_type", "value")


@register("a27_alert_counts", _ALERTS + "select run_id, count(*) as alerts from alerts group by all")
def a27(spark, sf_dir):
    return runs.count_alerts(view(spark, sf_dir, "scored").where("probability >= 0.5"))


@register("j1_flag_alerts", _ALERTS + "select flow_index, flow_index in (select flow_index from alerts) as is_attack from scored")
def j1(spark, sf_dir):
    df = view(spark, sf_dir, "scored")
    return runs.flag_alerts(df.select("flow_index"), df.where("probability >= 0.5"))


@register("j2_runs_alerts", _ALERTS + "select run_id, total_flows, flow_index from (select * from runs union all select r_regionkey + 99, 0, 0, 0 from region) r left join (select run_id, flow_index from alerts) a using (run_id)")
def j2(spark, sf_dir):
    idle = table(spark, sf_dir, "region").select(
        (F.col("r_regionkey") + 99).cast("long").alias("run_id"), *[F.lit(0).cast("long").alias(c) for c in ("started_us", "finished_us", "total_flows")])
    every = _runs(spark, sf_dir).unionByName(idle)
    found = view(spark, sf_dir, "scored").where("probability >= 0.5").select("run_id", "flow_index")
    return runs.runs_with_alerts(every, found).select("run_id", "total_flows", "flow_index")


@register("j5_join_predictions", SC + "select flow_index, y_true, probability, p2 from scored")
def j5(spark, sf_dir):
    """Truth and scores from separate tables meet by key, never by position."""
    df = view(spark, sf_dir, "scored")
    return df.select("flow_index", "y_true", "probability").join(df.select("flow_index", "p2"), "flow_index")


_LOG = SC + """, log as (select run_id, flow_index as seq, ts_us as logged_us, case when flow_index % 50 = 0 then 'completed' when flow_index % 3 = 0 then 'running' end as status,
  case when flow_index % 7 = 0 then latency_ms end as latency_p50, case when flow_index % 11 = 0 then probability end as f1 from scored)"""


@register("s19_current_runs", _LOG + """select run_id, min(logged_us) as started_us, max(logged_us) filter (where status = 'completed') as finished_us,
  arg_max(status, seq) filter (where status is not null) as status, arg_max(latency_p50, seq) filter (where latency_p50 is not null) as latency_p50,
  arg_max(f1, seq) filter (where f1 is not null) as f1 from log group by run_id""")
def s19(spark, sf_dir):
    i = F.col("flow_index")
    log = view(spark, sf_dir, "scored").select(
        "run_id", i.alias("seq"), F.col("ts_us").alias("logged_us"),
        F.when(i % 50 == 0, "completed").when(i % 3 == 0, "running").alias("status"),
        F.when(i % 7 == 0, F.col("latency_ms")).alias("latency_p50"), F.when(i % 11 == 0, F.col("probability")).alias("f1"))
    return runs.current_runs(log)


@register("s21_delete_runs", _ALERTS + "select run_id, count(*) as alerts from alerts where run_id not in (2, 4) group by all")
def s21(spark, sf_dir):
    every = _runs(spark, sf_dir)
    found = view(spark, sf_dir, "scored").where("probability >= 0.5")
    _, kept = runs.delete_runs(every, found, every.where("run_id in (2, 4)"))
    return runs.count_alerts(kept)


_STORED = _ALERTS + """, kept as (select run_id, started_us, case when run_id % 2 = 1 then 'completed' else 'running' end as status,
  case when run_id % 2 = 1 then total_flows end as total_flows from runs where run_id <> 2 union all select 77, null, 'completed', 0)"""


def _store(spark, sf_dir):
    """A store after two appends, an update with one unknown run and a deletion."""
    store, every = f"{session_dir(spark)}/store-{uuid.uuid4().hex}", _runs(spark, sf_dir)
    run_store.append(store, "runs", every.select("run_id", "started_us", F.lit("running").alias("status")))
    run_store.append(store, "alerts", _alerts(spark, sf_dir))
    done = every.where("run_id % 2 = 1").select("run_id", F.lit("completed").alias("status"), "total_flows")
    late = spark.range(77, 78).select(F.col("id").alias("run_id"), F.lit("completed").alias("status"), F.lit(0).cast("long").alias("total_flows"))
    run_store.update_runs(store, done.unionByName(late))
    run_store.delete_runs(store, every.where("run_id = 2"))
    return store


@register("s19_s21_stored_runs", _STORED + "select run_id, started_us, status, total_flows from kept")
def s21_runs(spark, sf_dir):
    return run_store.read(spark, _store(spark, sf_dir), "runs")


@register("s20_s21_stored_alerts", _STORED + "select run_id, id, flow_index, round(probability, 6) as probability, true_label, is_correct from alerts where run_id <> 2")
def s21_alerts(spark, sf_dir):
    df = run_store.read(spark, _store(spark, sf_dir), "alerts")
    return rounded(df.select("run_id", "id", "flow_index", "probability", "true_label", "is_correct"))


@register("o2_newest_runs", _ALERTS + "select run_id, started_us from runs order by started_us desc, run_id desc limit 3")
def o2_runs(spark, sf_dir):
    return runs.newest_runs(_runs(spark, sf_dir), 3).select("run_id", "started_us")


@register("j7_feature_join", "select 'l_' || f as feature, v as mean, w as top from (select unnest(['quantity', 'discount']) as f, unnest([round(avg(l_quantity), 6), round(avg(l_discount), 6)]) as v, unnest([max(l_quantity), max(l_discount)]) as w from lineitem)")
def j7(spark, sf_dir):
    """Two small per-feature tables joined by feature name."""
    df, cols = table(spark, sf_dir, "lineitem"), ("l_quantity", "l_discount")

    def per(fn, name):
        cells = [F.struct(F.lit(c).alias("feature"), fn(c).alias(name)) for c in cols]
        return df.agg(F.array(*cells).alias("r")).select(F.explode("r").alias("r")).select("r.*")

    return rounded(per(F.avg, "mean").join(per(F.max, "top"), "feature"))
