import random

import pytest
from pyspark.sql import functions as F

from flowloom.operators import alerts, chunked, runs

S = 1_000_000


def frame(spark, seconds, run=0):
    return spark.createDataFrame([(run, i, int(t * S)) for i, t in enumerate(seconds)], "run_id long, flow_index long, ts_us long")


def test_cooldown(spark):
    burst = [i * 0.1 for i in range(10)]
    start = burst[-1]
    second, third = [start + 299 - 0.9 + b for b in burst], [start + 301 + 70 + b for b in burst]
    fired = alerts.burst_alerts(frame(spark, [*burst, *second, *third]), ["run_id"]).orderBy("ts_us").collect()
    assert [(r["ts_us"], r["attack_count"], r["severity"]) for r in fired] == [
        (int(start * S), 10, "medium"), (int(third[-1] * S), 10, "medium")]


def test_attack_of_exactly_one_window_ago_is_not_counted(spark):
    rows = {r["ts_us"]: r["recent"] for r in alerts.recent_attacks(frame(spark, [0, 60, 60.5])).collect()}
    assert rows == {0: 1, 60 * S: 1, 60_500_000: 2}


@pytest.mark.parametrize("now", [True, False])
def test_trailing_sums_against_brute_force(spark, now):
    rng = random.Random(5)
    rows = [(g, t, rng.randrange(1, 9)) for g in (None, 1) for t in rng.sample(range(-900, 900), 500)] + [(1, None, 3)]
    df = spark.createDataFrame(rows, "g long, ts_us long, n long")
    got = {(r.g, r.ts_us): r.total or 0 for r in alerts.trailing_sums(df, 40, {"total": "n"}, ["g"], now).collect()}
    rows.pop()  # without a time
    assert got == {(g, t): sum(n for h, u, n in rows if h == g and (t - 40 < u <= t if now else t - 40 <= u < t)) for g, t, _ in rows}


def test_no_window_slides_over_the_attacks(spark):
    """A sliding frame is added up anew for every row: its time grows with the square of the rate."""
    plan = alerts.recent_attacks(frame(spark, range(5)), groups=["run_id"])._jdf.queryExecution().executedPlan().toString()
    assert "specifiedwindowframe(RangeFrame, unboundedpreceding$(), currentrow$())" in plan and plan.count("specifiedwindowframe") == 1


def _brute(times, threshold, window, cooldown):
    out, last, times = [], None, sorted(times)
    for i, t in enumerate(times):
        n = sum(1 for x in times[: i + 1] if t - window < x)
        if n >= threshold and (last is None or t - last > cooldown):
            out.append((t, n))
            last = t
    return out


def test_bursts_against_brute_force(spark):
    rng = random.Random(3)
    rows = [(g, i, rng.randrange(0, 4000) * S // 2) for g in (0, 1) for i in range(700)]
    df = spark.createDataFrame(rows, "run_id long, flow_index long, ts_us long")
    got = alerts.burst_alerts(df, ["run_id"], 8, 30 * S, 100 * S).collect()
    for g in (0, 1):
        times = [t for k, _, t in rows if k == g]
        assert sorted((r["ts_us"], r["attack_count"]) for r in got if r["run_id"] == g) == _brute(times, 8, 30 * S, 100 * S)


@pytest.mark.parametrize("limit,window", [(1, 3 * S), (4, 10 * S), (50, S)])
def test_admission_against_brute_force(spark, limit, window):
    rng = random.Random(limit)
    rows = [(g, i, rng.randrange(0, 900) * S // 4) for g in (0, 1) for i in range(500)]
    df = spark.createDataFrame(rows, "run_id long, flow_index long, ts_us long")
    got = {(r["run_id"], r["flow_index"]) for r in alerts.admit(df, limit, window, ["flow_index"], ["run_id"]).collect()}
    want = set()
    for g in (0, 1):
        passed = []
        for _, i, t in sorted((r for r in rows if r[0] == g), key=lambda r: (r[2], r[1])):
            if sum(1 for p in passed if p >= t - window) < limit:
                passed.append(t)
                want.add((g, i))
    assert got == want


def test_equal_times_count_one_by_one(spark):
    df = frame(spark, [i * 0.1 for i in range(9)] + [5.0] * 30)
    (one,) = alerts.burst_alerts(df, ["run_id"]).collect()
    assert (one["ts_us"], one["attack_count"], one["severity"], one["at_once"]) == (5 * S, 10, "medium", 1)
    kinds = df.withColumn("kind", F.concat(F.lit("k"), F.col("flow_index") % 7))
    found = alerts.alert_breakdown(kinds, alerts.burst_alerts(df, ["run_id"]), {"all": "kind", "few": "kind"}, ["flow_index"], ["run_id"], top={"few": 2}).collect()
    assert sum(r["count"] for r in found if r["kind"] == "all") == 10
    assert sum(r["kind"] == "all" for r in found) == 7 and sum(r["kind"] == "few" for r in found) == 2


def test_missing_and_large_keys(spark):
    rows = [(k, i, i * S) for k in (None, 2**53, 2**53 + 1) for i in range(30)]
    df = spark.createDataFrame(rows, "run_id long, flow_index long, ts_us long")
    fired = alerts.burst_alerts(df, ["run_id"])
    assert sorted((r["run_id"] or 0, r["ts_us"]) for r in fired.collect()) == [(0, 9 * S), (2**53, 9 * S), (2**53 + 1, 9 * S)]
    kinds = alerts.alert_breakdown(df.withColumn("kind", F.lit("x")), fired, {"k": "kind"}, ["flow_index"], ["run_id"])
    assert sorted((r["run_id"] or 0, r["count"]) for r in kinds.collect()) == [(0, 10), (2**53, 10), (2**53 + 1, 10)]
    passed = alerts.admit(df, 2, 40 * S, ["flow_index"], ["run_id"])
    assert sorted((r["run_id"] or 0, r["flow_index"]) for r in passed.collect()) == [(k, i) for k in (0, 2**53, 2**53 + 1) for i in (0, 1)]


def test_counts_have_no_top(spark):
    df = spark.range(12_000).select(F.lit(0).alias("run_id"), F.col("id").alias("flow_index"), F.col("id").alias("ts_us"))
    assert alerts.recent_attacks(df).agg(F.max("recent")).first()[0] == 12_000


def test_without_groups(spark):
    assert alerts.burst_alerts(frame(spark, [i * 0.5 for i in range(30)])).count() == 1
    assert alerts.admit(frame(spark, [0, 0.1, 0.2]), 2, S, ["flow_index"]).count() == 2


def test_deleting_a_run_takes_its_alerts(spark):
    r = spark.createDataFrame([(1,), (2,)], "run_id long")
    a = frame(spark, [1, 2], 1).unionByName(frame(spark, [3], 2))
    left, kept = runs.delete_runs(r, a, r.where("run_id = 1"))
    assert [x["run_id"] for x in left.collect()] == [2] and kept.count() == 1
    page = runs.alert_page(a.withColumns({"id": F.col("flow_index"), "is_correct": F.lit(False)}), 1, 1, 1, only_incorrect=True)
    assert [x["flow_index"] for x in page.collect()] == [1]


def _chain(times, pause):
    out = []
    for t in sorted(times):
        if not out or t - out[-1] > pause:
            out.append(t)
    return out


@pytest.mark.parametrize("fan", [2, 3, 16])
def test_cooldown_in_chunks_against_brute_force(spark, fan):
    rng = random.Random(fan)
    made = {
        None: rng.sample(range(-5000, 5000), 900),
        "sparse": [rng.randrange(0, 40) + 700 * k for k in range(-9, 9)],
        "even": list(range(0, 6000, 7)),
        "exact": [k * 50 for k in range(-40, 60)] + [k * 51 for k in range(40)],
        "gaps": [a + rng.randrange(0, 60) for a in (0, 95, 1700, 1760, 4000) for _ in range(30)],
        "one": [123],
    }
    rows = [(k, t) for k, times in made.items() for t in set(times)]
    got = chunked.cooldown(spark.createDataFrame(rows, "who string, ts_us long"), 50, ["who"], fan=fan).collect()
    for k, times in made.items():
        assert sorted(r["ts_us"] for r in got if r["who"] == k) == _chain(times, 50), k


def test_a_day_long_flood_of_one_key_is_spread(spark):
    """No gap in a day: alerts by a walk over all candidates, and no task that gets more than a node."""
    day = spark.range(0, 86_400_000, 250).select(F.lit(7).alias("run_id"), F.col("id").alias("flow_index"), (F.col("id") * 1000 + F.col("id") % 977).alias("ts_us"))
    fired = alerts.burst_alerts(day, ["run_id"])
    times = [k * 1000 + k % 977 for k in range(0, 86_400_000, 250)]
    assert sorted(r["ts_us"] for r in fired.collect()) == _chain(times[9:], alerts.COOLDOWN_US)
    plan = fired._jdf.queryExecution().executedPlan().toString()
    assert "episode" not in plan


@pytest.mark.parametrize("limit,window,chunk", [(1, 10, 11), (5, 30, 40), (5, 30, 31), (3, 100, 130)])
def test_admission_in_chunks_against_brute_force(spark, limit, window, chunk):
    rng = random.Random(limit * window)
    made = {
        None: [rng.randrange(-900, 900) for _ in range(700)],
        "even": list(range(0, 1500, 2)),
        "bursts": [a + rng.randrange(0, 9) for a in range(0, 3000, 37) for _ in range(7)],
        "pauses": [a + rng.randrange(0, 60) for a in (0, 400, 430, 2000) for _ in range(40)],
        "one": [5],
    }
    rows = [(k, i, t) for k, times in made.items() for i, t in enumerate(times)]
    df = spark.createDataFrame(rows, "who string, n long, ts_us long")
    got = chunked.handed_on(df, limit, window, ["n"], ["who"], chunk=chunk)
    assert got.columns == df.columns
    got = {(r["who"], r["n"]) for r in got.collect()}
    for k, times in made.items():
        passed, want = [], set()
        for t, i in sorted((t, i) for i, t in enumerate(times)):
            if sum(p >= t - window for p in passed) < limit:
                passed.append(t)
                want.add((k, i))
        assert {g for g in got if g[0] == k} == want, k


def test_chunks_of_nothing(spark):
    none = spark.createDataFrame([], "who string, n long, ts_us long")
    assert chunked.cooldown(none.select("who", "ts_us"), 5, ["who"]).count() == 0
    assert chunked.handed_on(none, 2, 5, ["n"], ["who"]).count() == 0
