"""Small helpers shared by the column functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def as_column(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


def bucket_of(keys, buckets: int) -> Column:
    """Stable bucket number of a key, the same on every run and cluster."""
    return F.pmod(F.xxhash64(*[as_column(k) for k in keys]), F.lit(buckets)).cast("int")
