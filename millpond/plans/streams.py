"""Streaming jobs run to the end of the given tables; their results are read back from the shared folder."""

from pyspark.sql import functions as F
from pyspark.sql import types as T

from millpond.operators.tables import KeyedTable
from millpond.plans import plan, read_parquet
from millpond.plans.analysis import SESSIONS_SQL
from millpond.plans.conversations import CHUNKS_UNTIL_END, chunk_log
from millpond.session import new_folder
from millpond.streaming import loads, sessions


def _stream(spark, sf, name):
    """A table as a stream, whether it is one file or a folder of files of any name.

    The braces make the path a pattern: a stream takes a path without one for a folder.
    """
    schema = read_parquet(spark, sf, name).schema
    return loads.file_stream(spark, f"{sf}/{{{name}}}.parquet", schema, glob="*")


def _finish(query):
    query.awaitTermination()
    return query


def _run_to_files(spark, stream, label):
    folder = new_folder(spark, label)
    _finish(loads.write_files(stream, f"{folder}/rows", f"{folder}/checkpoint"))
    return spark.read.schema(stream.schema).parquet(f"{folder}/rows")


def _table(spark, label, keys, schema):
    folder = new_folder(spark, label)
    return KeyedTable(spark, f"demo_{folder.rsplit('-', 1)[1]}.{label}", folder, keys, buckets=4).create(schema), folder


@plan(
    "streamed_sessions", "Z5 T15",
    f"""SELECT * FROM ({SESSIONS_SQL.format(by="user_id", gap=60_000)})
        WHERE session_end_ms + 59999 <= (SELECT epoch_us(max(ts)) // 1000 FROM events) - 600000""",
)
def streamed_sessions(spark, sf):
    """Sessions the watermark, ten minutes behind the newest event, has closed."""
    # A query brings the setting along, as it does the time zone; callers of the operator choose for themselves.
    spark.conf.set(sessions.LOCAL_MERGE, "true")
    return _run_to_files(spark, sessions.closed_sessions(_stream(spark, sf, "events"), ["user_id"], "ts", "10 minutes"), "sessions")


@plan(
    "streamed_hourly_counts", "Z9",
    """SELECT * FROM (SELECT CAST(date_trunc('hour', ts) AS TIMESTAMP) AS window_start,
         CAST(date_trunc('hour', ts) AS TIMESTAMP) + INTERVAL 1 HOUR AS window_end, event_type, count(*) AS rows FROM events GROUP BY 1, 2, 3)
       WHERE window_end <= (SELECT max(ts) FROM events) - INTERVAL 10 MINUTE""",
)
def streamed_hourly_counts(spark, sf):
    counts = sessions.closed_windows(_stream(spark, sf, "events"), "ts", ["event_type"], "1 hour", "10 minutes")
    return _run_to_files(spark, counts, "hours")


@plan(
    "streamed_upsert", "Z1 Z2 K15",
    """SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber
         ORDER BY l_shipdate DESC, l_partkey DESC, l_suppkey DESC) AS rn FROM lineitem) WHERE rn = 1""",
)
def streamed_upsert(spark, sf):
    """A resumable load of files into a keyed table, batch by batch; the file with the newest rows comes first."""
    lines = read_parquet(spark, sf, "lineitem")
    table, folder = _table(spark, "lineitem", ["l_orderkey", "l_linenumber"], lines.schema)
    for n, years in enumerate(("l_shipdate >= '1997-01-01'", "l_shipdate < '1995-01-01'", "l_shipdate >= '1995-01-01' AND l_shipdate < '1997-01-01'")):
        lines.where(years).write.mode("append").parquet(f"{folder}/in/{n}")
    for n in range(3):
        # One run for each folder, so that later rows are stored before earlier ones arrive.
        stream = loads.file_stream(spark, f"{folder}/in/{n}", lines.schema)
        _finish(loads.upsert_stream(stream, table, f"{folder}/checkpoint-{n}", seq=["l_shipdate", "l_partkey", "l_suppkey"]))
    return table.read()


@plan(
    "streamed_load_log", "Z3 A7",
    "SELECT 'events' AS run, CAST(0 AS BIGINT) AS batch, count(*) AS rows_written FROM events",
)
def streamed_load_log(spark, sf):
    stream = _stream(spark, sf, "events")
    table, folder = _table(spark, "events", ["event_id"], stream.schema)
    log, _ = _table(spark, "load_log", ["run", "batch"], loads.LOG_SCHEMA)
    _finish(loads.upsert_stream(stream, table, f"{folder}/checkpoint", log=log, run="events"))
    return log.read()


def _into_tables(spark, sf):
    """The events of three types, each in a table of its own, from one stream; and the log of all tags."""
    events = read_parquet(spark, sf, "events")
    made = {name: _table(spark, name, ["event_id"], events.schema) for name in ("signup", "purchase", "view")}
    log, folder = _table(spark, "tag_log", ["run", "batch", "tag"], loads.TAG_LOG)
    tables = {name: table for name, (table, _) in made.items()}
    _finish(loads.upsert_many(_stream(spark, sf, "events"), "event_type", tables, f"{folder}/batches", f"{folder}/checkpoint", seq={n: ["ts"] for n in tables}, log=log, run="events"))
    return tables, log


@plan(
    "streamed_into_tables", "K15 S17 Z1",
    "SELECT event_type AS loaded_into, event_id, user_id, value FROM events WHERE event_type IN ('signup', 'purchase', 'view')",
)
def streamed_into_tables(spark, sf):
    tables, _ = _into_tables(spark, sf)
    parts = [t.read().select(F.lit(name).alias("loaded_into"), "event_id", "user_id", "value") for name, t in tables.items()]
    return parts[0].unionAll(parts[1]).unionAll(parts[2])


@plan(
    "streamed_tag_log", "K15 S17",
    "SELECT event_type AS tag, count(*) AS rows, event_type IN ('signup', 'purchase', 'view') AS declared FROM events GROUP BY 1",
)
def streamed_tag_log(spark, sf):
    _, log = _into_tables(spark, sf)
    return log.read().groupBy("tag", "declared").agg(F.sum("rows").alias("rows"))


@plan(
    "streamed_without_repeats", "Z8",
    "SELECT event_id, user_id, ts FROM events",
)
def streamed_without_repeats(spark, sf):
    """Every event comes twice; the second one is dropped inside the watermark."""
    events = _stream(spark, sf, "events").select("event_id", "user_id", F.col("ts").cast("timestamp").alias("ts"))
    twice = events.select("*", F.explode(F.array(F.lit(1), F.lit(2))).alias("copy")).drop("copy")
    once = loads.without_repeats(twice, ["event_id"], "ts", "1 hour")
    return _run_to_files(spark, once, "once").withColumn("ts", F.col("ts").cast("timestamp_ntz"))


@plan("streamed_until_end", "Z6", CHUNKS_UNTIL_END)
def streamed_until_end(spark, sf):
    stream = chunk_log(_stream(spark, sf, "conversations"))
    ends, folder = _table(
        spark, "ends", ["conv_id"], T.StructType.fromDDL("conv_id long, end_seq long"))
    _finish(sessions.cut_at_end(stream, "conv_id", "turn", "kind", ends, f"{folder}/rows", f"{folder}/checkpoint"))
    return spark.read.parquet(f"{folder}/rows").select("conv_id", "turn", "text")
