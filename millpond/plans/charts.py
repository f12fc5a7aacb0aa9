"""Chart frames."""

from pyspark.sql import functions as F

from millpond.functions.dates import axis_pattern
from millpond.model import ChartSpec
from millpond.operators import charts
from millpond.plans import plan, read_parquet


def _brand_values(spark, sf):
    part = read_parquet(spark, sf, "part").select(F.col("p_partkey").alias("l_partkey"), "p_brand")
    items = read_parquet(spark, sf, "lineitem").select("l_partkey", "l_extendedprice")
    sums = items.groupBy("l_partkey").agg(F.sum("l_extendedprice").alias("v"))
    return sums.join(part, "l_partkey").groupBy("p_brand").agg(F.round(F.sum("v"), 2).alias("value"))


@plan(
    "brand_pie", "C1 A8 L4",
    """WITH b AS (SELECT p_brand AS name, round(sum(l_extendedprice), 2) AS value FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1),
       r AS (SELECT *, row_number() OVER (ORDER BY value DESC, CAST(split_part(name, '#', 2) AS BIGINT)) AS rn FROM b)
       SELECT CASE WHEN rn < 10 THEN name ELSE 'Other' END AS name, round(sum(value), 2) AS value FROM r GROUP BY 1""",
)
def brand_pie(spark, sf):
    values = _brand_values(spark, sf).withColumn("seq", F.substring_index("p_brand", "#", -1).cast("long"))
    slices = charts.pie_slices(values, "p_brand", "value", "seq")
    return slices.withColumn("value", F.round("value", 2))


@plan("type_pie", "C1", "SELECT p_type AS name, CAST(count(*) AS DOUBLE) AS value FROM part GROUP BY 1")
def type_pie(spark, sf):
    # Six types fit; none is folded into "Other".
    counts = read_parquet(spark, sf, "part").groupBy("p_type").agg(F.count("*").alias("n"))
    return charts.pie_slices(counts.withColumn("seq", F.xxhash64("p_type")), "p_type", "n", "seq")


@plan(
    "part_pie", "C1 E5",
    """WITH r AS (SELECT *, row_number() OVER (ORDER BY value DESC, seq) AS rn FROM (
         SELECT p_partkey AS seq, CASE WHEN p_size < 10 THEN 'Item ' || (p_partkey + 1) ELSE p_name END AS name,
           CASE WHEN p_type = 'PROMO' THEN 0.0 ELSE p_retailprice END AS value FROM part))
       SELECT name, value FROM r WHERE rn < 10
       UNION ALL SELECT 'Other', round(sum(value), 2) FROM r WHERE rn >= 10""",
)
def part_pie(spark, sf):
    """Every part a slice: most of the table goes into "Other"."""
    rows = read_parquet(spark, sf, "part").select(
        F.col("p_partkey").alias("seq"),
        F.when(F.col("p_size") >= 10, F.col("p_name")).alias("name"),
        F.when(F.col("p_type") != "PROMO", F.col("p_retailprice")).alias("value"))
    slices = charts.pie_slices(rows, "name", "value", "seq")
    return slices.withColumn("value", F.when(F.col("name") == "Other", F.round("value", 2)).otherwise(F.col("value")))


@plan(
    "order_value_range", "C2 A5",
    """SELECT CAST(0 AS BIGINT) AS y_min, CAST(ceil(greatest(max(o_totalprice), max(o_custkey)) * 1.1) AS BIGINT) AS y_max FROM orders""",
)
def order_value_range(spark, sf):
    return charts.y_range(read_parquet(spark, sf, "orders"), ["o_totalprice", "o_custkey"])


@plan("empty_value_range", "C2", "SELECT CAST(0 AS BIGINT) AS y_min, CAST(100 AS BIGINT) AS y_max FROM (SELECT count(*) FROM orders)")
def empty_value_range(spark, sf):
    return charts.y_range(read_parquet(spark, sf, "orders"), ["o_orderpriority"])


@plan(
    "monthly_series", "C4 C3 L3",
    """SELECT CAST(date_trunc('month', o_orderdate) AS TIMESTAMP) AS month,
         round(sum(o_totalprice) FILTER (WHERE o_orderstatus = 'F'), 2) AS "F",
         round(sum(o_totalprice) FILTER (WHERE o_orderstatus = 'O'), 2) AS "O"
       FROM orders GROUP BY 1 ORDER BY 1""",
)
def monthly_series(spark, sf):
    month = F.date_trunc("month", "o_orderdate").cast("timestamp_ntz").alias("month")
    wide = read_parquet(spark, sf, "orders").groupBy(month).pivot("o_orderstatus", ["F", "O", "P"]).agg(
        F.round(F.sum("o_totalprice"), 2))
    return charts.chart_series(wide, ChartSpec("line", "monthly", "month", ("F", "O")))


@plan(
    "default_series", "C3 C4",
    "SELECT o_orderpriority, count(*) AS orders FROM orders GROUP BY 1",
)
def default_series(spark, sf):
    counts = read_parquet(spark, sf, "orders").groupBy("o_orderpriority").agg(
        F.count("*").alias("orders"), F.sum("o_totalprice").alias("total"))
    # A scatter chart is drawn as bars; without declared series the first other column is shown.
    return charts.chart_series(counts, ChartSpec("scatter", "by_priority", "o_orderpriority"), seq="o_orderpriority")


@plan(
    "numeric_text_keys", "L3 A9",
    """SELECT key, sort_key FROM (SELECT CASE WHEN event_type = 'error' AND user_id < 10 THEN 'none' ELSE CAST(user_id AS VARCHAR) END AS key,
         CASE WHEN event_type = 'error' AND user_id < 10 THEN NULL ELSE CAST(user_id AS DOUBLE) END AS sort_key FROM events)
       ORDER BY sort_key""",
)
def numeric_text_keys(spark, sf):
    """Text keys, nearly all numbers: ordered as numbers, not as text."""
    none = (F.col("event_type") == "error") & (F.col("user_id") < 10)
    keys = read_parquet(spark, sf, "events").select(
        "event_id", F.when(none, "none").otherwise(F.col("user_id").cast("string")).alias("key"))
    return keys.select("key", charts.sort_key(keys, "key").alias("sort_key")).orderBy("sort_key")


@plan(
    "text_keys_in_input_order", "L3",
    "SELECT event_type AS key, value FROM events ORDER BY event_id",
)
def text_keys_in_input_order(spark, sf):
    keys = read_parquet(spark, sf, "events").select("event_id", F.col("event_type").alias("key"), "value")
    return charts.chart_series(keys, ChartSpec("bar", "events", "key", ("value",)), seq="event_id")


@plan(
    "axis_patterns", "A10 C5",
    """SELECT 'orders' AS axis, 'MMM d, yyyy' AS pattern FROM (SELECT count(*) FROM orders)
       UNION ALL SELECT 'last year', 'MMM d' FROM (SELECT count(*) FROM orders)
       UNION ALL SELECT 'events', 'MMM d, h:mm a' FROM (SELECT count(*) FROM events)
       UNION ALL SELECT 'first day', 'h:mm a' FROM (SELECT count(*) FROM events)""",
)
def axis_patterns(spark, sf):
    from millpond.operators.profiles import union_all

    orders, events = read_parquet(spark, sf, "orders"), read_parquet(spark, sf, "events")
    day = events.agg(F.min("ts").cast("date")).scalar()
    axes = {
        "orders": (orders, "o_orderdate"),
        "last year": (orders.filter("o_orderdate >= timestamp_ntz'2001-01-01'"), "o_orderdate"),
        "events": (events, "ts"),
        "first day": (events.filter(F.col("ts").cast("date") == day), "ts"),
    }
    return union_all([df.agg(axis_pattern(c).alias("pattern")).select(F.lit(n).alias("axis"), "pattern") for n, (df, c) in axes.items()])


@plan(
    "axis_pattern_per_type", "A10",
    "SELECT event_type, 'MMM d, h:mm a' AS pattern FROM events GROUP BY 1",
)
def axis_pattern_per_type(spark, sf):
    return read_parquet(spark, sf, "events").groupBy("event_type").agg(axis_pattern("ts").alias("pattern"))


@plan(
    "labelled_time_axis", "C5",
    "SELECT o_orderkey, strftime(o_orderdate, '%b %-d, %Y') AS label FROM orders",
)
def labelled_time_axis(spark, sf):
    orders = read_parquet(spark, sf, "orders").select("o_orderkey", "o_orderdate")
    return charts.axis_labels(orders, "o_orderdate").select("o_orderkey", "label")


@plan(
    "labelled_event_axis", "C5",
    "SELECT event_id, strftime(ts, '%b %-d, %-I:%M %p') AS label FROM events",
)
def labelled_event_axis(spark, sf):
    events = read_parquet(spark, sf, "events").select("event_id", "ts")
    return charts.axis_labels(events, "ts").select("event_id", "label")
