"""Resumable loads of files into keyed tables."""

from __future__ import annotations

import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQueryListener

from millpond.operators.tables import KeyedTable


def file_stream(
    spark: SparkSession, folder: str, schema: T.StructType, glob: str = "*.parquet",
    file_format: str = "parquet", files_per_batch: int = 1000,
) -> DataFrame:
    """New files of a folder as a stream; a batch takes at most ``files_per_batch`` files."""
    return (
        spark.readStream.format(file_format)
        .schema(schema)
        .option("pathGlobFilter", glob)
        .option("maxFilesPerTrigger", files_per_batch)
        .load(folder)
    )


def upsert_stream(
    stream: DataFrame, table: KeyedTable, checkpoint: str, seq: list[str] | None = None, op: str | None = None,
    log: KeyedTable | None = None, run: str = "run",
):
    """Load what is there and stop. Every micro-batch is merged by key.

    The checkpoint keeps the position: a run that is cut off goes on with the batch it was in, and merging a
    batch twice changes nothing. The log row of a batch is keyed by (run, batch), so a repeat replaces it;
    it is written after the data.
    """

    def merge(batch: DataFrame, batch_id: int) -> None:
        done = table.upsert(batch, seq=seq, op=op, label=f"batch-{batch_id}")
        if log is not None:
            log.upsert(batch.sparkSession.createDataFrame([(run, batch_id, done.rows)], LOG_SCHEMA))

    return (
        stream.writeStream.foreachBatch(merge)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def upsert_many(
    stream: DataFrame, tag: str, tables: dict[str, KeyedTable], path: str, checkpoint: str,
    seq: dict[str, list[str]] | None = None, op: str | None = None, log: KeyedTable | None = None, run: str = "run",
):
    """Load one stream of several resources into a table each, and stop when all that is there is read.

    A batch is read once and written partitioned by its tag; each declared resource is merged from its partition. A table
    takes a batch together with the batch's number, so a repeat after a crash skips the tables that had it. ``log`` gets the
    rows of every tag, also of those no table is declared for; it is written last.
    """

    def merge(batch: DataFrame, batch_id: int) -> None:
        spark, folder = batch.sparkSession, f"{path}/batch={batch_id}"
        batch.withColumn("_tag", F.coalesce(F.col(tag).cast("string"), F.lit(""))).write.mode("overwrite").partitionBy("_tag").parquet(folder)
        schema = T.StructType([*batch.schema.fields, T.StructField("_tag", T.StringType())])
        rows = spark.read.schema(schema).parquet(folder)
        for name, table in tables.items():
            own = rows.where(F.col("_tag") == name).drop("_tag")
            table.upsert(own, seq=(seq or {}).get(name), op=op, label=f"batch-{batch_id}", batch=(run, batch_id))
        if log is not None:
            counts = rows.groupBy(F.col("_tag").alias("tag")).agg(F.count("*").alias("rows"))
            counts = counts.select(F.lit(run).alias("run"), F.lit(batch_id).cast("long").alias("batch"), "tag", "rows", F.col("tag").isin(*tables).alias("declared"))
            log.upsert(counts)

    return (
        stream.writeStream.foreachBatch(merge)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


TAG_LOG = T.StructType().add("run", "string").add("batch", "long").add("tag", "string").add("rows", "long").add("declared", "boolean")
LOG_SCHEMA = T.StructType().add("run", "string").add("batch", "long").add("rows_written", "long")


def run_within(query, seconds: float) -> bool:
    """Let a load run for a time budget. True when it is done; else it stops after its current batch and the next
    run goes on from the checkpoint."""
    if query.awaitTermination(seconds):
        return True
    # The batch under way is waited for, so that every run gets on by one batch at least.
    before = _last_batch(query)
    while query.isActive and _last_batch(query) == before:
        time.sleep(0.05)
    if not query.isActive:
        query.awaitTermination()
        return True
    query.stop()
    return False


def _last_batch(query) -> int:
    return query.lastProgress["batchId"] if query.lastProgress else -1


class ProgressLog(StreamingQueryListener):
    """Run id, batch and input rows of every batch of the queries of a session, from the start on.

    A query itself only remembers its last hundred batches.
    """

    def __init__(self, spark: SparkSession):
        self.rows: list[tuple[str, int, int]] = []
        spark.streams.addListener(self)

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        p = event.progress
        self.rows.append((str(p.runId), int(p.batchId), int(p.numInputRows)))

    def of(self, query) -> list[tuple[str, int, int]]:
        return sorted(r for r in self.rows if r[0] == str(query.runId))


def without_repeats(stream: DataFrame, key: list[str], ts: str, late_by: str) -> DataFrame:
    """Records sent again within the lateness are dropped; state is bounded by the watermark."""
    return stream.withWatermark(ts, late_by).dropDuplicatesWithinWatermark(key)


def write_files(stream: DataFrame, path: str, checkpoint: str):
    """Append the finished rows of a stream to a folder of Parquet files, then stop."""
    return (
        stream.writeStream.format("parquet")
        .option("path", path)
        .option("checkpointLocation", checkpoint)
        .outputMode("append")
        .trigger(availableNow=True)
        .start()
    )
