"""What several operators of this subpackage need: reading a table, storing a step, cutting batches."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millpond.session import new_folder

SLICE_BYTES = 4 << 20  # text that a Python task holds decoded at once, besides a single longer row


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def stored(df: DataFrame, label: str) -> DataFrame:
    """Write a step to the shared folder and read it again: later uses neither repeat it nor depend on its executors."""
    path = new_folder(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def slices(batches: Iterator, column: str, limit: int = SLICE_BYTES) -> Iterator:
    """Arrow batches cut so that the texts of one slice take about ``limit`` bytes, or are a single row."""
    import pyarrow.compute as pc

    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        start = held = 0
        for i, size in enumerate(sizes):
            if held and held + size > limit:
                yield batch.slice(start, i - start)
                start, held = i, 0
            held += int(size)
        if start < batch.num_rows:
            yield batch.slice(start)


def text_or_empty(column: str = "text"):
    return F.coalesce(F.col(column), F.lit(""))


def held_out(doc_id: str = "doc_id"):
    """Rows whose crc32 of the id, as text, leaves 1 on division by 3 are kept from training. A null id is not."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 3 == 1, F.lit(False))
