"""Chart data: slices with an "Other" part, sorted series, axis range and labels."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millpond.functions.dates import axis_pattern, epoch_ms_to_datetime, parse_datetime
from millpond.functions.numbers import label_or_item, number_or_zero, numeric_share, parse_number, y_range_top
from millpond.model import ChartSpec

# Ten slices; a key counts as numeric from this share of numeric rows on.
PIE_SLICES = 10
NUMERIC_SHARE = 0.8


def pie_slices(df: DataFrame, key: str, value: str, seq: str, slices: int = PIE_SLICES) -> DataFrame:
    """Largest values as slices, all others summed as "Other". ``seq`` numbers the rows from 0; it may repeat or be NULL.

    The top part is a distributed top-k. The rest is one aggregate beside the top rows (fewer than
    ``slices``, broadcast), less as many rows as the top took of equal ones; a rest of a single row keeps its own name.
    """
    rows = df.select(
        F.col(seq).alias("_seq"), label_or_item(key, seq).alias("name"), number_or_zero(value).alias("value")
    )
    top = rows.orderBy(F.col("value").desc(), "_seq", "name").limit(slices - 1)
    taken = top.groupBy(F.struct("_seq", "name", "value").alias("_top")).agg(F.count("*").alias("_taken"))
    same = [F.col(c).eqNullSafe(F.col(f"_top.{c}")) for c in ("_seq", "name", "value")]
    groups = rows.join(F.broadcast(taken), same, "left").groupBy("_top", "_taken").agg(
        F.count("*").alias("_n"), F.min("name").alias("name"), F.sum("value").alias("value")
    )
    left = F.col("_n") - F.coalesce("_taken", F.lit(0))
    rest = groups.select(left.alias("_n"), "name", F.when(F.col("_taken").isNull(), F.col("value")).otherwise(left * F.col("_top.value")).alias("value"))
    rest = rest.filter("_n > 0").agg(F.coalesce(F.sum("_n"), F.lit(0)).alias("_n"), F.min("name").alias("_name"), F.sum("value").alias("value"))
    other = rest.filter("_n > 0").select(
        F.when(F.col("_n") == 1, F.col("_name")).otherwise("Other").alias("name"), "value"
    )
    return top.select("name", "value").unionByName(other)


def y_range(df: DataFrame, series: list[str]) -> DataFrame:
    return df.agg(y_range_top(*series).alias("y_max")).select(F.lit(0).cast("long").alias("y_min"), "y_max")


def default_series(columns: list[str], key: str) -> list[str]:
    rest = [c for c in columns if c != key]
    if not rest:
        raise ValueError(f"no column besides the key {key}; columns: {', '.join(columns)}")
    return rest[:1]


def sort_key(df: DataFrame, key: str):
    """How a chart orders its keys: dates and numbers by value; text by number when at least 80 % of it is
    numeric, by time when at least 80 % of it are dates, else NULL, which leaves the order of the rows. The test
    on text is a subquery of the same plan, nothing is collected."""
    data_type = df.schema[key].dataType
    if isinstance(data_type, (T.DateType, T.TimestampType, T.TimestampNTZType, T.NumericType)):
        return F.col(key)
    numbers = df.agg(numeric_share(key)).scalar()
    dates = df.agg(F.avg(F.when(parse_datetime(key).isNotNull(), 1.0).otherwise(0.0))).scalar()
    as_time = F.unix_micros(parse_datetime(key).cast("timestamp")).cast("double")
    return F.when(numbers >= NUMERIC_SHARE, parse_number(key)).when(dates >= NUMERIC_SHARE, as_time)


def chart_series(df: DataFrame, spec: ChartSpec, seq: str | None = None) -> DataFrame:
    """Key and series columns in drawing order."""
    if spec.kind() == "pie":
        raise ValueError("a pie chart is prepared by pie_slices")
    series = list(spec.series) or default_series([c for c in df.columns if c != seq], spec.key)
    order = [sort_key(df, spec.key).asc_nulls_last(), *([F.col(seq)] if seq else [])]
    return df.orderBy(*order).select(spec.key, *series)


def axis_labels(df: DataFrame, key: str) -> DataFrame:
    """The rows with a label for each key: times in the one pattern that fits the whole axis, all else as text.

    Text and whole numbers count as times where they can be read as such.
    """
    data_type = df.schema[key].dataType
    if isinstance(data_type, T.StringType):
        ts = parse_datetime(key)
    elif isinstance(data_type, T.LongType):
        ts = epoch_ms_to_datetime(key)
    elif isinstance(data_type, (T.DateType, T.TimestampType, T.TimestampNTZType)):
        ts = F.col(key)
    else:
        return df.withColumn("label", F.col(key).cast("string"))
    pattern = df.agg(axis_pattern(ts)).scalar()
    label = (
        F.when(pattern == "h:mm a", F.date_format(ts, "h:mm a"))
        .when(pattern == "MMM d, h:mm a", F.date_format(ts, "MMM d, h:mm a"))
        .when(pattern == "MMM d, yyyy", F.date_format(ts, "MMM d, yyyy"))
        .otherwise(F.date_format(ts, "MMM d"))
    )
    return df.withColumn("label", F.coalesce(label, F.col(key).cast("string")))
