"""What is in a table: columns, types, time columns, row and null counts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Time columns looked for when none is configured, in order.
COMMON_TIME_COLUMNS = ("updated_at", "modified_at", "created_at", "inserted_at")
TIMESTAMPS = (T.TimestampType, T.TimestampNTZType)
SHOWN_COLUMNS = 10


def time_columns(schema: T.StructType) -> list[str]:
    return [f.name for f in schema.fields if isinstance(f.dataType, (*TIMESTAMPS, T.DateType))]


def detect_time_column(schema: T.StructType) -> str | None:
    types = {f.name: f.dataType for f in schema.fields}
    for name in COMMON_TIME_COLUMNS:
        if isinstance(types.get(name), TIMESTAMPS):
            return name
    return None


def union_all(frames: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), frames)


def table_profile(df: DataFrame, name: str, key: str | None = None) -> DataFrame:
    """One row. The count reads only file footers of a columnar table."""
    return df.agg(F.count("*").alias("record_count")).select(
        F.lit(name).alias("resource"),
        F.lit(len(df.columns)).alias("column_count"),
        F.lit(", ".join(df.columns)).alias("columns"),
        F.lit(", ".join(time_columns(df.schema))).alias("timestamp_columns"),
        F.lit(key).cast("string").alias("primary_key"),
        "record_count",
    )


def profile_text(profile: DataFrame) -> DataFrame:
    """The profile as a few lines of text: column count, first names, time columns, row count."""
    names = F.split("columns", ", ")
    shown = F.array_join(F.slice(names, 1, SHOWN_COLUMNS), ", ")
    more = F.when(F.col("column_count") > SHOWN_COLUMNS, "...").otherwise("")
    lines = [
        F.concat(F.lit("Resource: "), "resource"),
        F.concat(F.lit("Columns ("), F.col("column_count").cast("string"), F.lit("): "), shown, more),
        F.when(
            F.col("timestamp_columns") != "", F.concat(F.lit("Timestamp columns: "), "timestamp_columns")
        ),
        F.concat(F.lit("Record count: "), F.format_number("record_count", 0)),
    ]
    return profile.select("resource", F.concat_ws("\n", *lines).alias("profile"))


def column_profile(df: DataFrame, approx: bool = False) -> DataFrame:
    """One row per column with its null count, all columns in one pass over the table."""
    names = df.columns
    measures = [F.count_if(F.col(c).isNull()).alias(f"n{i}") for i, c in enumerate(names)]
    if approx:
        measures += [F.approx_count_distinct(c).alias(f"d{i}") for i, c in enumerate(names)]
    one = df.agg(F.count("*").alias("rows"), *measures)
    entries = []
    for i, f in enumerate(df.schema.fields):
        parts = [F.lit(f.name).alias("column"), F.lit(f.dataType.simpleString()).alias("type"),
                 F.col("rows"), F.col(f"n{i}").alias("null_count")]
        if approx:
            parts.append(F.col(f"d{i}").alias("approx_distinct"))
        entries.append(F.struct(*parts))
    return one.select(F.explode(F.array(*entries)).alias("p")).select("p.*")
