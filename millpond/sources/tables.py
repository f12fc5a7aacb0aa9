"""Full and incremental table scans."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millpond.model import Resource
from millpond.operators.profiles import detect_time_column
from millpond.operators.status import LOOK_BACK, moment


def read_parquet(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def jdbc_options(
    url: str, table: str, split_column: str | None = None, bounds: tuple | None = None, splits: int = 1,
    fetch_size: int = 10_000, **extra: str,
) -> dict[str, str]:
    """Options of a JDBC read. With a split column the table is read by ranges in parallel."""
    options = {"url": url, "dbtable": table, "fetchsize": str(fetch_size), "pushDownPredicate": "true", **extra}
    if split_column:
        if not bounds:
            raise ValueError("a split column needs its lower and upper bound")
        options |= {
            "partitionColumn": split_column,
            "lowerBound": str(bounds[0]),
            "upperBound": str(bounds[1]),
            "numPartitions": str(splits),
        }
    return options


def read_jdbc(spark: SparkSession, **options) -> DataFrame:
    return spark.read.format("jdbc").options(**jdbc_options(**options)).load()


def sync_column(schema: T.StructType, resource: Resource) -> str | None:
    """The column that tells new rows: the configured update time, else creation time, else a known name."""
    return resource.updated_at or resource.created_at or detect_time_column(schema)


def incremental(
    df: DataFrame, resource: Resource, since: datetime | None,
    overlap: timedelta = timedelta(0), with_undated: bool = False,
) -> DataFrame:
    """Rows newer than the high-water mark; everything without a mark or a time column.

    The bound is a literal, so JDBC and Parquet scans skip what is older. ``overlap`` reads a stretch before
    the mark again, for rows that were committed late; ``with_undated`` adds rows without a time. Both are
    safe because loads are keyed.
    """
    column = sync_column(df.schema, resource)
    if since is None or column is None:
        return df
    newer = F.col(column) > moment(since - overlap)
    return df.filter(newer | F.col(column).isNull()) if with_undated else df.filter(newer)


def first_load(df: DataFrame, ts: str, as_of: datetime, look_back: timedelta = LOOK_BACK) -> DataFrame:
    """What a first load covers: rows of the look-back time before ``as_of``."""
    return df.filter(F.col(ts) >= moment(as_of - look_back))
