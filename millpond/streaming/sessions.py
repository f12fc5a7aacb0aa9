"""Sessions and rollups over an event stream."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millpond.operators.conversations import END_OF_STREAM
from millpond.operators.tables import KeyedTable
from millpond.operators.timelines import IDLE_MS, epoch_ms


LOCAL_MERGE = "spark.sql.streaming.sessionWindow.merge.sessions.in.local.partition"


def closed_sessions(stream: DataFrame, by: list[str], ts: str, late_by: str, idle_ms: int = IDLE_MS) -> DataFrame:
    """Sessions that can get no more rows: idle for at least ``idle_ms``, and the watermark has passed.

    A session window also joins rows exactly its gap apart, hence the millisecond less on cut times. Rows of a busy key
    have to be joined inside each task before they are shuffled; a session that does not say so is an error.
    """
    if stream.sparkSession.conf.get(LOCAL_MERGE) != "true":
        raise ValueError(f"set {LOCAL_MERGE} to true, as build_session does")
    cut = F.timestamp_millis(epoch_ms(ts))
    events = stream.select(*by, cut.alias("_ts")).withWatermark("_ts", late_by)
    return (
        events.groupBy(*by, F.session_window("_ts", f"{idle_ms - 1} milliseconds"))
        .agg(F.min("_ts").alias("_first"), F.max("_ts").alias("_last"), F.count("*").alias("rows"))
        .select(
            *by,
            F.unix_millis("_first").alias("session_start_ms"),
            F.unix_millis("_last").alias("session_end_ms"),
            "rows",
        )
    )


def closed_windows(stream: DataFrame, ts: str, by: list[str], size: str, late_by: str, slide: str | None = None) -> DataFrame:
    """Counts of windows the watermark has passed."""
    events = stream.select(F.col(ts).cast("timestamp").alias("_ts"), *by).withWatermark("_ts", late_by)
    return (
        events.groupBy(F.window("_ts", size, slide or size), *by)
        .agg(F.count("*").alias("rows"))
        .select(
            F.col("window.start").cast("timestamp_ntz").alias("window_start"),
            F.col("window.end").cast("timestamp_ntz").alias("window_end"),
            *by,
            "rows",
        )
    )


def cut_at_end(stream: DataFrame, session: str, seq: str, kind: str, ends: KeyedTable, path: str, checkpoint: str):
    """Write the chunks of each session up to its end mark; what comes after the mark is dropped.

    End marks seen so far are a keyed table with one row per session. Each batch is cut by a join, so one busy
    session is spread over tasks. A batch has its own folder, and a repeat replaces it.
    """

    def cut(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        batch_ends = batch.filter(F.col(kind) == END_OF_STREAM).groupBy(session).agg(F.min(seq).alias("end_seq"))
        known = ends.read().unionByName(batch_ends).groupBy(session).agg(F.min("end_seq").alias("end_seq"))
        ends.upsert(known.join(batch_ends.select(session), session, "left_semi"))
        chunks = batch.filter(F.col(kind) != END_OF_STREAM).join(ends.read(), session, "left")
        open_chunks = chunks.filter(F.col("end_seq").isNull() | (F.col(seq) < F.col("end_seq"))).drop("end_seq")
        open_chunks.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")
        spark.catalog.refreshByPath(path)

    return (
        stream.writeStream.foreachBatch(cut)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
