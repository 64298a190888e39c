"""Physical plans of the registered queries: no pair-wise joins, narrow scans, few shuffles."""

import re

import pytest

from flowloom.plans.catalog import ORACLES, QUERIES

TRAINING = tuple(n for n in QUERIES if re.match(r"m(1|2|3|4|5|9|10)_", n) and not n.endswith("_one_split"))


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def exchanges(text: str) -> int:
    return len(re.findall(r"Exchange (?:hash|range)partitioning", text))


@pytest.fixture(scope="module")
def plans(spark, sf_dir):
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        return {n: plan(q(spark, sf_dir)) for n, q in QUERIES.items() if n not in TRAINING}
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")


def test_no_pairwise_joins(plans):
    bad = [n for n, p in plans.items() if "CartesianProduct" in p or "BroadcastNestedLoopJoin" in p]
    assert bad == []


def test_python_only_in_the_sequential_folds(plans):
    python = {n for n, p in plans.items() if "InPandas" in p or "PythonUDF" in p or "ArrowEvalPython" in p}
    assert python <= {"st5_burst_alerts", "st6_admission_limit", "a25_alert_breakdown"}


def test_flows_take_two_shuffles(plans):
    # Packets by slice, slices by 5-tuple.
    for name in ("a37_flow_aggregate", "a38_flow_features"):
        assert exchanges(plans[name]) == 2, plans[name]


def test_filters_and_columns_reach_the_scan(plans):
    p = plans["p26_point_lookup"]
    assert "EqualTo(event_id,17)" in p and "ReadSchema: struct<event_id:bigint,event_type:string,value:double>" in p
    # Both probability and truth derive from the key, so nothing else is read.
    assert "ReadSchema: struct<event_id:bigint>" in plans["a16_confusion"]


def test_plain_aggregates_take_one_shuffle(plans):
    for name in ("a6_label_distribution", "a16_class_table", "a27_alert_counts", "s19_current_runs", "u2_keep_first", "u5_unique_labels"):
        assert exchanges(plans[name]) == 1, name


def test_windows_over_everything_only_see_small_tables(plans):
    """A window without keys collects its input in one task; only per-class or per-bucket tables may do so."""
    allowed = {"a6_label_distribution", "a12_split_summary", "a36_class_weights"}
    single = {n for n, p in plans.items() if re.search(r"Window [^\n]*windowspecdefinition\((specifiedwindowframe|(?:_b#\d+ (?:ASC|DESC)))", p)}
    totals = {n for n in single if "_t_" in plans[n]}
    assert single - totals <= allowed


def test_every_claimed_check_exists():
    assert set(ORACLES) <= set(QUERIES)
    unchecked = set(QUERIES) - set(ORACLES)
    assert unchecked == set(TRAINING)


@pytest.mark.parametrize("name", ["p5_infinities_clip", "p5_infinities_median", "p6_missing_mean", "p6_missing_median", "p7_clip_outliers", "p7_clipped_counts"])
def test_rows_without_copies_are_made_once(plans, name):
    """Several passes read these rows; the plan that is left reads them as a table and shuffles nothing."""
    assert exchanges(plans[name]) == 0
