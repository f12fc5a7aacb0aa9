"""Joins of intervals, sketches that are kept, and the repairs of as-of joins and pies."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from millpond.operators import charts, conversations, search, sketches, timelines
from millpond.streaming import sessions

SPAN = "k string, id long, start_ms long, end_ms long"


def brute(a, b):
    return sorted((x[1], y[1]) for x in a for y in b if None not in (*x, *y) and x[0] == y[0] and x[2] <= y[3] and y[2] <= x[3] and x[2] <= x[3] and y[2] <= y[3])


def test_overlaps_equal_all_pairs(spark):
    r = random.Random(4)
    lengths = [0, 1, 59_999, 60_000, 60_001, 500_000, 4_000_000, 10**9, 10**15]

    def some(n, first):
        out = []
        for i in range(n):
            start = r.choice([0, r.randrange(-10**6, 10**6), r.randrange(10**9), 60_000 * r.randrange(50)])
            out.append((r.choice(["hot"] * 4 + ["a", "b"]), first + i, start, start + r.choice(lengths)))
        return out + [(None, first + 900, 0, 5), ("a", first + 901, None, 5), ("a", first + 902, 5, None), ("a", first + 903, 9, 3), out[0]]

    a, b = some(150, 0), some(120, 1000)
    left, right = spark.createDataFrame(a, SPAN), spark.createDataFrame(b, SPAN)
    met = timelines.overlaps(left, right, ["k"], "start_ms", "end_ms")
    assert sorted((x.left.id, x.right.id) for x in met.collect()) == brute(a, b)
    plan = met._jdf.queryExecution().executedPlan().toString()
    assert "Cartesian" not in plan and "NestedLoop" not in plan
    assert timelines.overlaps(left.limit(0), right, ["k"], "start_ms", "end_ms").count() == 0


def test_rows_that_can_find_nothing_go_round_the_window(spark):
    at = lambda m: datetime(2024, 1, 1, 0, m)
    left = spark.createDataFrame([("a", at(5), 1), ("a", None, 2), (None, at(5), 3), ("a", at(1), 4)], "k string, ts timestamp_ntz, id int")
    right = spark.createDataFrame([("a", at(2), 10), ("a", None, 11), (None, at(1), 12)], "k string, ts timestamp_ntz, v int")
    got = {r.id: (r.as_of_ts, r.v) for r in timelines.as_of_join(left, right, ["k"], "ts", ["v"]).collect()}
    assert got == {1: (at(2), 10), 2: (None, None), 3: (None, None), 4: (None, None)}


@pytest.mark.parametrize("seqs", [[0, 0, 0, 0, 0, 0], [None] * 6, [0, 1, 2, 3, 3, 3]])
def test_pie_with_repeated_or_null_numbers(spark, seqs):
    values = [(s, n, v) for s, n, v in zip(seqs, ["x", "x", "x", "y", "z", "z"], [5.0, 5.0, 5.0, 3.0, 1.0, 1.0])]
    df = spark.createDataFrame(values, "seq int, name string, value double")
    got = charts.pie_slices(df, "name", "value", "seq", slices=3).collect()
    assert sum(r.value for r in got) == 20.0 and [r.value for r in got] == [5.0, 5.0, 10.0] and got[-1].name == "Other"


def test_daily_sketches_are_stored_once_and_merged_for_any_period(spark, tmp_path):
    start = datetime(2024, 3, 1)
    rows = [(start + timedelta(hours=i % 240), i % 3, i % 500 if i % 4 else 7, float(i % 1000)) for i in range(20_000)]
    df = spark.createDataFrame([*rows, (None, 0, 1, 1.0), (start, 0, None, None)], "ts timestamp_ntz, kind int, user int, value double")
    path = str(tmp_path / "sketches")
    sketches.refresh(df.where("ts < '2024-03-06'"), "ts", ["kind"], "user", "value", path)
    old = {p.name: {f.name for f in p.glob("*.parquet")} for p in (tmp_path / "sketches").glob("day=*")}
    sketches.refresh(df, "ts", ["kind"], "user", "value", path)
    new = {p.name: {f.name for f in p.glob("*.parquet")} for p in (tmp_path / "sketches").glob("day=*")}
    assert len(old) == 5 and len(new) == 10 and all(new[d] == old[d] for d in old)
    got = sketches.merged(sketches.stored_days(spark, path), []).first()
    assert got.rows == 20_001 and abs(got.users - 375) <= 0.05 * 375 and got.busiest[0].item == 7
    assert abs(got.median - 500) <= 1000 * sketches.RANK_ERROR and abs(got.p95 - 950) <= 1000 * sketches.RANK_ERROR
    one = sketches.merged(sketches.stored_days(spark, path).where("day = '2024-03-02'"), ["kind"]).collect()
    assert len(one) == 3


def test_a_page_of_any_size_with_the_number_found(spark):
    df = spark.createDataFrame([(i, f"name {i:03d}", "word", f"p{i % 2}") for i in range(60)], "id long, name string, description string, package string")
    page = search.search_packages(df, "word", ["p0", "p1"], "package", "name", "description", "id", limit=7).collect()
    assert len(page) == 7 and {r.total_found for r in page} == {60} and [r.name for r in page] == [f"name {i:03d}" for i in range(0, 14, 2)]
    assert search.search_packages(df, "nothing", ["p0"], "package", "name", "description", "id").collect() == []


def test_sessions_of_a_busy_key_need_the_local_merge(spark):
    stream = spark.readStream.format("rate").load().select(F.lit(1).alias("k"), F.col("timestamp").alias("ts"))
    spark.conf.set(sessions.LOCAL_MERGE, "false")
    try:
        with pytest.raises(ValueError, match="mergeSessions|local.partition"):
            sessions.closed_sessions(stream, ["k"], "ts", "1 minute")
    finally:
        spark.conf.set(sessions.LOCAL_MERGE, "true")


def test_one_long_session_as_a_text_and_in_parts(spark):
    df = spark.range(10_000).select(F.lit(1).alias("s"), "id", F.concat(F.col("id"), F.lit(" ")).alias("t"))
    want = "".join(f"{i} " for i in range(10_000))
    assert conversations.assemble(df, "s", "id", "t").first().text == want
    parts = conversations.assemble(df, "s", "id", "t", parts=True).orderBy("part").collect()
    assert len(parts) == 3 and "".join(r.text for r in parts) == want
