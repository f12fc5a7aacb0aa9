"""Connector catalogs: defaults, precedence, conflicts, search and validation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millpond.operators.keyed import first_per_key


def with_status(configs: DataFrame, status: DataFrame, key: str, defaults: dict) -> DataFrame:
    """Every config with its status; missing values take the defaults.

    Small status tables are broadcast by the optimizer from their size, large ones shuffled.
    """
    joined = configs.join(status, key, "left")
    return joined.withColumns(
        {c: F.coalesce(F.col(c), F.lit(v)) for c, v in defaults.items() if v is not None}
    )


def with_precedence(bundled: DataFrame, stored: DataFrame, key: str, seq: str) -> DataFrame:
    """Bundled entries win over stored ones; among bundled ones the later wins."""
    both = bundled.withColumn("_rank", F.lit(0)).unionByName(stored.withColumn("_rank", F.lit(1)))
    return first_per_key(both, [key], [F.col("_rank"), F.col(seq).desc()]).drop("_rank")


def conflicts(existing: DataFrame, incoming: DataFrame, keys: list[str]) -> DataFrame:
    """Incoming rows whose key exists already; an append needs this to be empty."""
    return incoming.join(existing.select(*keys), keys, "left_semi")


def unknown(candidates: DataFrame, known: DataFrame, keys: list[str]) -> DataFrame:
    """Candidates not known yet under all of the keys."""
    return candidates.join(known.select(*keys), keys, "left_anti")


def first_broken_rule(name: Column, description: Column, resources: Column) -> Column:
    """Message of the first rule a connector config breaks, NULL when it is valid.

    ``resources`` is ``array<string>`` of resource names. The messages are fixed values.
    """
    blank = lambda c: c.isNull() | (c == "")
    unnamed = F.filter(
        F.transform(resources, lambda r, i: F.when(blank(r), i)), lambda i: i.isNotNull()
    )
    return (
        F.when(blank(name), "Missing required field: name")
        .when(blank(description), "Missing required field: description")
        .when(
            resources.isNull() | (F.size(resources) == 0),
            "Missing or invalid required field: resources (must be a non-empty array)",
        )
        .when(
            F.size(unnamed) > 0,
            F.concat(
                F.lit("Invalid resource at index "),
                F.element_at(unnamed, 1).cast("string"),
                F.lit(": missing required field 'name'"),
            ),
        )
    )


def valid_score(score: Column, low: float, high: float) -> Column:
    return score.isNotNull() & ~F.isnan(score) & score.between(low, high)


def score_gate(df: DataFrame, score: str, low: float, high: float, threshold: float) -> DataFrame:
    """Scores inside the range, with whether they pass."""
    value = F.col(score).cast("double")
    return df.filter(valid_score(value, low, high)).withColumn("passes", value >= threshold)


def outcome_summary(df: DataFrame, **conditions: Column) -> DataFrame:
    """One row of counts: all rows, and those per condition, in one pass."""
    return df.agg(F.count("*").alias("total"), *[F.count_if(c).alias(n) for n, c in conditions.items()])


def lowest_key_column(constraints: DataFrame, key_columns: DataFrame, on: list[str], ordinal: str) -> DataFrame:
    """First column of each constraint by position."""
    return first_per_key(constraints.join(key_columns, on, "inner"), on, [F.col(ordinal)])
