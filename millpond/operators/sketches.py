"""Sketches that are kept: one accumulator row per day and group, merged on request for any period."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

LOG2_REGISTERS, K, TRACKED = 12, 400, 1000
DISTINCT_ERROR = 0.05  # three standard errors of 2^12 registers (1.04 / 2^6 each)
RANK_ERROR = 0.02  # of quantiles, as a share of the rows, with 99 % confidence for K


def daily(rows: DataFrame, ts: str, by: list[str], item: str, value: str) -> DataFrame:
    """Per day and group: rows, distinct items, quantiles of the value and frequent items, as binary accumulators.

    NULL items and values are not counted. Partial aggregation keeps what is shuffled to one accumulator a task and group.
    """
    return rows.where(F.col(ts).isNotNull()).groupBy(F.to_date(ts).alias("day"), *by).agg(
        F.count("*").alias("rows"),
        F.hll_sketch_agg(item, LOG2_REGISTERS).alias("items"),
        F.kll_sketch_agg_double(F.col(value).cast("double"), K).alias("quantiles"),
        F.expr(f"approx_top_k_accumulate(`{item}`, {TRACKED})").alias("frequent"),
    )


def stored_days(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def refresh(rows: DataFrame, ts: str, by: list[str], item: str, value: str, path: str) -> None:
    """Store the days that have more rows than when they were last stored; other days are not sketched again.

    A day is a partition and is replaced as a whole, so a repeat after a crash gives the same table.
    """
    spark = rows.sparkSession
    counts = rows.where(F.col(ts).isNotNull()).groupBy(F.to_date(ts).alias("day")).agg(F.count("*").alias("now"))
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    if folder.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).exists(folder):
        had = stored_days(spark, path).groupBy("day").agg(F.sum("rows").alias("had"))
        counts = counts.join(had, "day", "left").where(F.col("had").isNull() | (F.col("had") != F.col("now")))
    # One value for each new day.
    days = [r.day for r in counts.select("day").collect()]
    if days:
        new = rows.where(F.to_date(ts).isin(days))
        daily(new, ts, by, item, value).hint("rebalance", "day").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("day").parquet(path)


def merged(days: DataFrame, by: list, busiest: int = 3) -> DataFrame:
    """Figures of any grouping of stored days: rows, users, median, p95 and the ``busiest`` items with their counts.

    Only items that are surely frequent are listed: where many have nearly the same count there may be none.
    """
    held = days.groupBy(*by).agg(
        F.sum("rows").alias("rows"), F.hll_union_agg("items").alias("_items"), F.kll_merge_agg_double("quantiles").alias("_quantiles"),
        F.expr(f"approx_top_k_combine(frequent, {TRACKED})").alias("_frequent"))
    quantile = lambda q: F.kll_sketch_get_quantile_double("_quantiles", F.lit(q))
    return held.withColumns({
        "users": F.hll_sketch_estimate("_items"), "median": quantile(0.5), "p95": quantile(0.95),
        "busiest": F.expr(f"approx_top_k_estimate(_frequent, {busiest})"),
    }).drop("_items", "_quantiles", "_frequent")
