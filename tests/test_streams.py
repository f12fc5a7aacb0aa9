from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millpond.operators import conversations, timelines
from millpond.streaming import loads, sessions

START = datetime(2024, 1, 1)
EVENTS = "id long, k long, ts timestamp_ntz"


def land(spark, folder, n, rows, schema=EVENTS):
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{folder}/part={n}")


def stream(spark, folder, schema=EVENTS, files=1):
    return loads.file_stream(spark, f"{folder}/*", T.StructType.fromDDL(schema), files_per_batch=files)


def test_load_resumes_and_repeats_change_nothing(spark, keyed_table, tmp_path, as_rows):
    folder, checkpoint = str(tmp_path / "in"), str(tmp_path / "cp")
    schema = "id long, v string, seq int"
    table = keyed_table("id long, v string, seq int", ["id"])
    log = keyed_table(loads.LOG_SCHEMA, ["run", "batch"], name="load_log")
    run = lambda: loads.upsert_stream(stream(spark, folder, schema), table, checkpoint, seq=["seq"], log=log, run="r1").awaitTermination()
    land(spark, folder, 1, [(1, "a", 1), (2, "a", 1), (1, "b", 2)], schema)
    land(spark, folder, 2, [(2, "c", 3)], schema)
    run()
    assert as_rows(table.read(), "id", "v") == [(1, "b"), (2, "c")]
    land(spark, folder, 3, [(3, "d", 1), (1, "e", 3)], schema)
    run()
    run()
    assert as_rows(table.read(), "id", "v") == [(1, "e"), (2, "c"), (3, "d")]
    assert as_rows(log.read(), "rows_written") == [(1,), (2,), (2,)]
    # All batches once more, as after a lost checkpoint.
    loads.upsert_stream(stream(spark, folder, schema), table, str(tmp_path / "cp2"), seq=["seq"], log=log, run="r1").awaitTermination()
    assert as_rows(table.read(), "id", "v") == [(1, "e"), (2, "c"), (3, "d")]
    assert log.read().agg(F.sum("rows_written")).first()[0] == 5


def test_a_load_cut_off_by_its_budget_goes_on_later(spark, keyed_table, tmp_path, as_rows):
    schema = "id long, v string"
    table = keyed_table("id long, v string", ["id"])
    for n in range(4):
        land(spark, str(tmp_path / "in"), n, [(n, "x")], schema)
    start = lambda: loads.upsert_stream(stream(spark, str(tmp_path / "in"), schema), table, str(tmp_path / "cp"))
    assert loads.run_within(start(), 0.01) is False
    assert loads.run_within(start(), 120) is True
    assert as_rows(table.read(), "id") == [(0,), (1,), (2,), (3,)]


def test_stream_applies_deletes(spark, keyed_table, tmp_path, as_rows):
    schema = "id long, v string, op string, seq int"
    table = keyed_table("id long, v string", ["id"])
    land(spark, str(tmp_path / "in"), 1, [(1, "a", "added", 1), (2, "b", "added", 1)], schema)
    land(spark, str(tmp_path / "in"), 2, [(1, None, "removed", 2)], schema)
    loads.upsert_stream(stream(spark, str(tmp_path / "in"), schema), table, str(tmp_path / "cp"), seq=["seq"], op="op").awaitTermination()
    assert as_rows(table.read()) == [(2, "b")]


def events(*ms):
    return [(i, 1, START + timedelta(milliseconds=m)) for i, m in enumerate(ms)]


def run_to_files(spark, df, tmp_path):
    query = loads.write_files(df, str(tmp_path / "out"), str(tmp_path / "cp"))
    query.awaitTermination()
    return spark.read.schema(df.schema).parquet(str(tmp_path / "out")), query


@pytest.mark.parametrize("gap, count", [(59_999, 1), (60_000, 2), (60_001, 2)])
def test_idle_edge_is_the_same_in_stream_and_batch(spark, tmp_path, as_rows, gap, count):
    rows = events(0, gap, 10_000_000)
    land(spark, str(tmp_path / "in"), 1, rows)
    out, _ = run_to_files(spark, sessions.closed_sessions(stream(spark, str(tmp_path / "in")), ["k"], "ts", "1 minute"), tmp_path)
    assert out.count() == count
    batch = timelines.idle_sessions(spark.createDataFrame(rows, EVENTS), ["k"], "ts")
    newest = batch.agg(F.max("session_end_ms")).scalar()
    assert as_rows(out) == as_rows(batch.filter(F.col("session_end_ms") < newest))


def test_sessions_over_several_batches(spark, tmp_path, as_rows):
    base = [m * 20_000 for m in range(30)] + [1_000_000 + m * 1000 for m in range(20)] + [9_000_000]
    rows = events(*base)
    for n in range(3):
        land(spark, str(tmp_path / "in"), n, rows[n * 17 : (n + 1) * 17])
    df = sessions.closed_sessions(stream(spark, str(tmp_path / "in")), ["k"], "ts", "10 minutes")
    progress = loads.ProgressLog(spark)
    out, query = run_to_files(spark, df, tmp_path)
    spark.streams.removeListener(progress)
    batch = timelines.idle_sessions(spark.createDataFrame(rows, EVENTS), ["k"], "ts")
    assert as_rows(out) == as_rows(batch.filter("rows > 1"))
    assert sum(r[2] for r in progress.of(query)) == len(rows)


def test_repeats_are_dropped(spark, tmp_path):
    rows = events(0, 1000, 2000)
    land(spark, str(tmp_path / "in"), 1, rows + rows[:2])
    land(spark, str(tmp_path / "in"), 2, rows[2:] + [(9, 1, START)])
    source = stream(spark, str(tmp_path / "in")).withColumn("ts", F.col("ts").cast("timestamp"))
    out, _ = run_to_files(spark, loads.without_repeats(source, ["id"], "ts", "1 hour"), tmp_path)
    assert sorted(r.id for r in out.collect()) == [0, 1, 2, 9]


CHUNKS = "s string, seq long, kind string, text string"


def test_end_mark_cuts_later_chunks(spark, keyed_table, tmp_path, as_rows):
    first = [("a", 1, "stream-chunk", "He"), ("a", 3, "stream-end", None), ("a", 2, "stream-chunk", "llo"), ("b", 1, "stream-chunk", "x")]
    second = [("a", 4, "stream-chunk", "late"), ("b", 2, "stream-chunk", "y"), ("b", 4, "stream-chunk", "no"), ("b", 3, "stream-end", None)]
    land(spark, str(tmp_path / "in"), 1, first, CHUNKS)
    land(spark, str(tmp_path / "in"), 2, second, CHUNKS)
    ends = keyed_table("s string, end_seq long", ["s"], name="ends")
    out = str(tmp_path / "out")
    sessions.cut_at_end(stream(spark, str(tmp_path / "in"), CHUNKS), "s", "seq", "kind", ends, out, str(tmp_path / "cp")).awaitTermination()
    streamed = spark.read.parquet(out)
    want = [("a", 1, "He"), ("a", 2, "llo"), ("b", 1, "x"), ("b", 2, "y")]
    assert as_rows(streamed, "s", "seq", "text") == want
    batch = conversations.until_end(spark.createDataFrame(first + second, CHUNKS), "s", "seq", "kind")
    assert as_rows(batch, "s", "seq", "text") == want
    whole = conversations.assemble(batch, "s", "seq", "text")
    assert as_rows(whole, "s", "text") == [("a", "Hello"), ("b", "xy")]


def test_positions(spark):
    df = spark.createDataFrame([(1,), (2,), (3,)], "seq long")
    assert df.filter(conversations.after_position(F.col("seq"), "0")).count() == 3
    assert df.filter(conversations.after_position(F.col("seq"), 2)).count() == 1


def test_last_and_first_messages(spark):
    df = spark.createDataFrame(
        [(1, 0, "user", "a"), (1, 1, "assistant", "b"), (1, 2, "user", "c"), (2, 0, "system", "d")], "c long, turn long, role string, text string")
    last = lambda role: {r[0]: r[1] for r in conversations.last_message(df, "c", "turn", "role", "text", role).collect()}
    assert last("assistant") == {1: "b", 2: None} and last("user") == {1: "c", 2: None}
    assert {r.c: r.prompt for r in conversations.last_prompt(df, "c", "turn", "role", "text").collect()} == {1: "c", 2: ""}
    assert {r[0]: r[1] for r in conversations.first_message(df, "c", "turn", "role", "text", "user").collect()} == {1: "a", 2: None}


def test_a_long_session_is_one_text(spark):
    rows = [("a", n, str(n % 10)) for n in range(5000)] + [("b", 0, "x")]
    df = spark.createDataFrame(rows, "s string, seq int, text string").repartition(7)
    got = {r.s: (r.text, r.pieces) for r in conversations.assemble(df, "s", "seq", "text").collect()}
    assert got == {"a": ("".join(str(n % 10) for n in range(5000)), 5000), "b": ("x", 1)}
    assert df.filter(conversations.after_position(F.col("seq"), 0)).count() == 4999
