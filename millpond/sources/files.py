"""File listings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def any_case(pattern: str) -> str:
    """The glob with each letter in both cases; what stands in brackets is left as it is."""
    out, bracket = [], False
    for c in pattern:
        bracket = (bracket or c == "[") and c != "]"
        out.append(f"[{c.lower()}{c.upper()}]" if c.isalpha() and not bracket else c)
    return "".join(out)


def find_files(
    spark: SparkSession, folder: str, pattern: str, limit: int | None = None, ignore_case: bool = True
) -> DataFrame:
    """Files below a folder by glob, with their size. Contents are not read."""
    files = (
        spark.read.format("binaryFile")
        .option("pathGlobFilter", any_case(pattern) if ignore_case else pattern)
        .option("recursiveFileLookup", "true")
        .load(folder)
        .select(F.element_at(F.split("path", "/"), -1).alias("file"), "path", F.col("length").alias("bytes"))
    )
    found = files.orderBy("path")
    return found.limit(limit) if limit else found
