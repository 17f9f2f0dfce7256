"""Order-dependent jobs against plain Python folds."""

import random
import statistics
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from orgloom.functions import fixed_values as V
from orgloom.operators import alerts as AL
from orgloom.operators import metrics as M


def fold(samples, rules):
    fired, last = set(), {}
    for us, row in sorted(samples):
        for name, cond, _, minutes in rules:
            if eval(cond.replace(" = ", " == "), {}, row) and (name not in last or us - last[name] >= minutes * 60 * AL.US):
                last[name] = us
                fired.add((name, us))
    return fired


def health(n, seed, gap):
    rnd, t, rows = random.Random(seed), 1_700_000_000 * AL.US, []
    for _ in range(n):
        t += rnd.choice(gap) * AL.US
        rows.append((t, dict(cpu_usage=rnd.uniform(0, 100), memory_usage=rnd.uniform(0, 100), error_count=rnd.randint(0, 14),
                             response_time=rnd.uniform(0, 8), active_agents=rnd.randint(0, 3))))
    return rows


def frame(spark, rows):
    df = spark.createDataFrame([(us, r["cpu_usage"], r["memory_usage"], r["error_count"], r["response_time"], r["active_agents"]) for us, r in rows],
                               "us long, cpu_usage double, memory_usage double, error_count int, response_time double, active_agents int")
    return df.withColumn("ts", F.timestamp_micros("us").cast("timestamp_ntz")).drop("us")


@pytest.mark.parametrize("gap, slice_minutes", [([1, 2, 7], 11), ([30, 60, 301], 60), ([20], 1440), ([3000, 9000], 60)])
def test_alert_log_equals_fold(spark, gap, slice_minutes):
    rows = health(1500, slice_minutes, gap)
    got = {(r.rule, r.us) for r in AL.alert_log(frame(spark, rows), slice_minutes=slice_minutes).collect()}
    assert got == fold(rows, V.ALERT_RULES)


@pytest.mark.parametrize("gap, parts", [([1, 2, 7], (2, 3)), ([200, 400, 5000], (3, 2, 2)), ([30, 60, 301], ()), ([3600, 9000], (4,))])
def test_periods_of_periods(spark, gap, parts):
    rows = health(1200, 17, gap)
    got = {(r.rule, r.us) for r in AL.alert_log(frame(spark, rows), slice_minutes=11, parts=parts).collect()}
    assert got == fold(rows, V.ALERT_RULES)


def test_composed_maps_stay_small():
    """Dense hits: the map of a day is no larger than its first cooldown asks for."""
    import pandas as pd

    step, cooldown, hour = 36_000, 300 * AL.US, 3600 * AL.US
    slices = []
    for h in range(24):
        us = range(h * hour, (h + 1) * hour, step)
        slices.append(AL._slice_exits(pd.DataFrame({"rule": 1, "us": us, "cooldown_us": cooldown, "slice_start": h * hour})))
    day = AL._compose(pd.concat(slices).assign(period=0))
    assert len(day) <= len(slices[0]) + 1
    for blocked in (-5, 0, 17_000_000, 299_999_999, 300 * AL.US):
        last, t = None, max(0, -(-blocked // step) * step)
        while t < 24 * hour:
            last, t = t, -(-(t + cooldown) // step) * step
        i = day["upto"].to_numpy().searchsorted(blocked)
        assert int(day["exit_us"].iloc[i]) == last


def test_alert_log_carries_the_last_fire(spark):
    rows = health(600, 5, [10, 45])
    first, second = rows[:300], rows[300:]
    a = AL.alert_log(frame(spark, first))
    carried = a.groupBy("rule").agg(F.max("us").alias("last_us"))
    got = {(r.rule, r.us) for r in a.collect()} | {(r.rule, r.us) for r in AL.alert_log(frame(spark, second), carried=carried).collect()}
    assert got == fold(rows, V.ALERT_RULES)


def test_slice_must_exceed_cooldowns(spark):
    with pytest.raises(ValueError):
        AL.alert_log(frame(spark, health(3, 1, [1])), slice_minutes=5)


def test_running_mean(spark):
    rnd = random.Random(3)
    start = datetime(2024, 1, 1)
    rows = [(i, rnd.choice(["a", "a", "a", "b"]), start + timedelta(minutes=rnd.randint(0, 9000)), rnd.choice([0.0, rnd.random()])) for i in range(2000)]
    df = spark.createDataFrame(rows, "event_id long, k string, t timestamp_ntz, v double")
    want = {}
    for key in "ab":
        mean = 0.0
        for n, (_, _, _, v) in enumerate(sorted((r for r in rows if r[1] == key), key=lambda r: (r[2], r[0])), 1):
            mean = (mean * (n - 1) + v) / n if v > 0 else mean
        want[key] = mean
    got = {r.k: r.running_mean for r in M.running_mean(df, "k", "v", ["t", "event_id"], "t").collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 2e-6 for k in want)


def test_exact_medians(spark):
    rnd = random.Random(4)
    rows = [("hot", rnd.gauss(50, 20), 1.0) for _ in range(3001)] + [("even", float(i), 2.0) for i in range(1, 101)] + [("tail", 10.0 ** rnd.randint(0, 12) + rnd.random(), 1.0) for _ in range(20000)] + [("one", 7.5, 0.0), ("same", 3.0, 3.0), ("same", 3.0, 3.0)]
    df = spark.createDataFrame(rows, "k string, v double, w double")
    got = {r.k: (r.v, r.w) for r in M.exact_medians(df, "k", ["v", "w"], cells=16).collect()}
    for key in ("hot", "tail", "even", "one", "same"):
        positive = [v for k, v, _ in rows if k == key and v > 0]
        assert got[key][0] == pytest.approx(statistics.median(positive), rel=1e-12)
    assert got["one"][1] is None
