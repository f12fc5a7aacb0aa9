"""Reports: chart blocks of a text, the results they need, and the finished bundle."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millpond.functions.text import CHART_SCHEMA, chart_blocks

_CORRUPT = "_corrupt"


def report_charts(reports: DataFrame, id_col: str, text: str) -> DataFrame:
    """One row per chart block. A block that is no JSON is marked, it does not fail the job."""
    schema = T.StructType.fromDDL(f"{CHART_SCHEMA}, {_CORRUPT} string")
    blocks = reports.select(id_col, F.posexplode(chart_blocks(text)).alias("position", "block"))
    parsed = blocks.withColumn(
        "c", F.from_json("block", schema, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": _CORRUPT})
    )
    return parsed.select(
        id_col,
        "position",
        F.col("c.type").alias("type"),
        F.col("c.dataQueryName").alias("query_name"),
        F.col("c.keyColumnName").alias("key_column"),
        F.col("c.seriesColumnNames").alias("series_columns"),
        F.col(f"c.{_CORRUPT}").isNotNull().alias("is_invalid"),
    )


def missing_queries(charts: DataFrame, results: DataFrame) -> DataFrame:
    """Names that charts use and no result has; each once."""
    wanted = charts.filter("NOT is_invalid").select("query_name").distinct()
    return wanted.join(results.select("query_name").distinct(), "query_name", "left_anti")


def bind_charts(charts: DataFrame, results: DataFrame) -> DataFrame:
    """Charts with the result of their query; ``results`` has one row per name."""
    return charts.filter("NOT is_invalid").join(results, "query_name", "inner")


def match_statements(statements: DataFrame, specs: DataFrame, id_col: str) -> DataFrame:
    """The named query each executed statement belongs to.

    Equal text wins; else the first query whose name occurs in the statement, word by word. Both are equi-joins: runs
    of words are taken from the statement, as long as the longest name.
    """
    exact = statements.join(specs.select(F.col("query").alias("statement"), "name"), "statement").select(
        id_col, "name", F.lit(0).alias("_rank")
    )
    words = lambda text: F.regexp_extract_all(text, F.lit(r"(\w+)"), F.lit(1))
    names = specs.select("name", F.array_join(words("name"), " ").alias("phrase"), F.size(words("name")).alias("n")).filter("n > 0")
    # The different lengths of names, each one pass over the words of a statement.
    lengths = sorted(r.n for r in names.select("n").distinct().collect())
    said = statements.select(id_col, words("statement").alias("w"))

    def runs_of(n: int):
        starts = F.sequence(F.lit(1), F.greatest(F.size("w") - n + 1, F.lit(1)))
        return F.transform(starts, lambda i: F.array_join(F.slice("w", i, n), " "))

    runs = [runs_of(n) for n in lengths]
    phrases = said.select(id_col, F.explode(F.array_distinct(F.concat(F.array().cast("array<string>"), *runs))).alias("phrase"))
    named = phrases.join(names, "phrase").select(id_col, "name", F.lit(1).alias("_rank"))
    best = exact.unionByName(named).groupBy(id_col).agg(F.min(F.struct("_rank", "name")).alias("best"))
    return best.select(id_col, F.col("best.name").alias("name"))


def result_records(df: DataFrame, query_name: str) -> DataFrame:
    """A query result as rows ``(query_name, record)``; results of any size stay rows of a table."""
    return df.select(F.lit(query_name).alias("query_name"), F.to_json(F.struct("*")).alias("record"))
