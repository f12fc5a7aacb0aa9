"""Time operators against brute force, with one key that holds most rows and edges on slice borders."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from millpond.operators import timelines

START = datetime(2024, 1, 1)


def skewed_events(n, seed, step_ms=20_000):
    """Two thirds of the rows belong to key 0; gaps hit the idle limit and the hour borders exactly."""
    rng = random.Random(seed)
    t, rows = 0, []
    for i in range(n):
        t += rng.choice([0, 1, 1000, 59_999, 60_000, 60_001, step_ms, 3_600_000])
        rows.append((i, 0 if rng.random() < 0.67 else rng.randint(1, 3), START + timedelta(milliseconds=t), rng.choice("abc")))
    return rows


def frame(spark, rows):
    return spark.createDataFrame(rows, "id long, k long, ts timestamp_ntz, kind string")


def ms(t):
    return round((t - datetime(1970, 1, 1)) / timedelta(milliseconds=1))


@pytest.mark.parametrize("seed", [1, 2, 3])
@pytest.mark.parametrize("slice_ms", [60_000, 3_600_000])
def test_idle_sessions(spark, as_rows, seed, slice_ms):
    rows = skewed_events(400, seed)
    want = []
    for k in {r[1] for r in rows}:
        times = sorted(ms(r[2]) for r in rows if r[1] == k)
        start = prev = times[0]
        count = 0
        for t in times:
            if t - prev >= 60_000:
                want.append((k, start, prev, count))
                start, count = t, 0
            prev, count = t, count + 1
        want.append((k, start, prev, count))
    got = timelines.idle_sessions(frame(spark, rows), ["k"], "ts", slice_ms=slice_ms)
    assert as_rows(got) == sorted(want, key=repr)


def test_a_gap_of_exactly_the_limit_closes(spark):
    at = lambda *s: [(i, 1, START + timedelta(milliseconds=x), "a") for i, x in enumerate(s)]
    assert timelines.idle_sessions(frame(spark, at(0, 59_999)), ["k"], "ts").count() == 1
    assert timelines.idle_sessions(frame(spark, at(0, 60_000)), ["k"], "ts").count() == 2


def test_as_of_join_keeps_rows_without_key_or_time(spark):
    left = spark.createDataFrame([(1, None, START), (2, 1, None), (3, 1, START)], "id long, k long, ts timestamp_ntz")
    right = spark.createDataFrame([(None, START, 7), (1, None, 8), (1, START, 9)], "k long, ts timestamp_ntz, v long")
    got = timelines.as_of_join(left, right, ["k"], "ts", ["v"])
    assert {r.id: r.v for r in got.collect()} == {1: None, 2: None, 3: 9}


def test_sessions_ignore_rows_without_key_or_time(spark):
    df = frame(spark, [(1, None, START, "a"), (2, 1, None, "a"), (3, 1, START, "a")])
    assert [tuple(r)[0] for r in timelines.idle_sessions(df, ["k"], "ts").collect()] == [1]


@pytest.mark.parametrize("unit", ["minute", "hour", "day"])
def test_as_of_join(spark, unit):
    rows = skewed_events(300, 7)
    left = [r for r in rows if r[3] != "a"]
    right = [r for r in rows if r[3] == "a"]
    want = {}
    for r in left:
        before = [x for x in right if x[1] == r[1] and x[2] <= r[2]]
        best = max(before, key=lambda x: (x[2], x[0]), default=None)
        want[r[0]] = (best[2], best[0]) if best else (None, None)
    got = timelines.as_of_join(
        frame(spark, left), frame(spark, right).select("k", "ts", F.col("id").alias("right_id")), ["k"], "ts", ["right_id"], unit)
    assert {r.id: (r.as_of_ts, r.right_id) for r in got.collect()} == want


@pytest.mark.parametrize("slice_seconds", [1, 60, 86_400])
def test_counts_before(spark, slice_seconds):
    rows = skewed_events(300, 11)
    want = {
        r[0]: sum(1 for x in rows if x[3] == "b" and x[1] == r[1] and timedelta(0) <= r[2] - x[2] <= timedelta(seconds=120))
        for r in rows if r[3] == "a"
    }
    kind = F.col("kind")
    got = timelines.counts_before(frame(spark, rows), ["k"], "ts", kind == "b", kind == "a", 120, slice_seconds)
    assert {r.id: r.rows_before for r in got.collect()} == want


def test_running_total_and_change(spark):
    df = spark.createDataFrame(
        [(1, START, 10.0), (1, START, 5.0), (1, START + timedelta(days=8), 1.0), (2, START, 7.0)], "k long, ts timestamp_ntz, v double")
    got = [tuple(r)[2:] for r in timelines.running_total(df, ["k"], "ts", F.col("v")).orderBy("k", "period").collect()]
    assert got == [(15.0, 15.0), (1.0, 16.0), (7.0, 7.0)]
    got = [tuple(r)[2:] for r in timelines.period_change(df, ["k"], "ts", F.col("v")).orderBy("k", "period").collect()]
    assert got == [(15.0, None, None), (1.0, 15.0, -14.0), (7.0, None, None)]


def test_share_of_nothing_is_null(spark):
    df = spark.createDataFrame([(START, "a", 0.0), (START, "b", 0.0)], "ts timestamp_ntz, c string, v double")
    assert {r.percentage for r in timelines.share_per_period(df, "ts", "c", F.col("v")).collect()} == {None}
