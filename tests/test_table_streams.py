"""Queries over streams of given tables, in sessions and table layouts of others."""

import shutil
from datetime import datetime, timedelta

import pytest

from millpond.operators import timelines
from millpond.plans import streams
from millpond.streaming import sessions

START = datetime(2024, 1, 1)
EVENTS = "event_id long, ts timestamp_ntz, user_id long, event_type string"


def events(spark):
    rows = [(i, START + timedelta(seconds=17 * i), i % 3, "ab"[i % 2]) for i in range(400)]
    return spark.createDataFrame([*rows, (900, START + timedelta(days=1), 9, "a")], EVENTS)


def test_sessions_of_a_session_without_the_local_merge(spark, tmp_path, as_rows):
    df = events(spark)
    df.write.parquet(str(tmp_path / "events.parquet"))
    spark.conf.set(sessions.LOCAL_MERGE, "false")
    try:
        got = as_rows(streams.streamed_sessions(spark, str(tmp_path)))
    finally:
        spark.conf.set(sessions.LOCAL_MERGE, "true")
    assert got == as_rows(timelines.idle_sessions(df, ["user_id"], "ts").where("user_id < 9")) and len(got) == 3


@pytest.mark.parametrize("layout", ["folder", "file"])
def test_a_table_is_a_folder_or_a_file(spark, tmp_path, as_rows, layout):
    talks = spark.createDataFrame([(c, t, "user" if t % 3 else "assistant", f"{c} {t}") for c in range(5) for t in range(1, 8)], "conv_id long, turn int, role string, text string")
    for name, df in (("conversations", talks), ("events", events(spark))):
        df.repartition(3).write.parquet(str(tmp_path / "folder" / f"{name}.parquet"))
        df.coalesce(1).write.parquet(str(tmp_path / "one" / name))
        (tmp_path / "file").mkdir(exist_ok=True)
        shutil.copy(next((tmp_path / "one" / name).glob("part-*")), tmp_path / "file" / f"{name}.parquet")
    got = streams.streamed_until_end(spark, str(tmp_path / layout))
    assert as_rows(got, "conv_id", "turn", "text") == [(c, t, f"{c} {t}") for c in range(5) for t in (1, 2)]
    hours = streams.streamed_hourly_counts(spark, str(tmp_path / layout))
    assert sum(r.rows for r in hours.collect()) == 400
