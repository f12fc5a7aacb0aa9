"""Aggregates, shares, trends and windows: the questions a data lake is asked."""

from datetime import datetime

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from millpond.functions.dates import in_range
from millpond.functions.numbers import numeric_share
from millpond.functions.text import words
from millpond.operators import catalogs, sketches, timelines
from millpond.plans import plan, read_parquet
from millpond.session import new_folder

AS_OF = datetime(2001, 8, 1)
REVENUE = "l_extendedprice * (1 - l_discount)"


@plan("distinct_packages", "A3", "SELECT DISTINCT source, lang FROM documents ORDER BY 1, 2")
def distinct_packages(spark, sf):
    return read_parquet(spark, sf, "documents").select("source", "lang").distinct().orderBy("source", "lang")


@plan(
    "all_keywords", "A4",
    """SELECT DISTINCT keyword FROM (SELECT unnest(regexp_split_to_array(lower(text), '[^a-z0-9]+')) AS keyword FROM documents)
       WHERE keyword <> '' ORDER BY 1""",
)
def all_keywords(spark, sf):
    found = read_parquet(spark, sf, "documents").select(F.explode(words("text")).alias("keyword"))
    return found.filter("keyword <> ''").distinct().orderBy("keyword")


@plan(
    "tick_summary", "A6 F7",
    """SELECT count(*) AS total, count(*) FILTER (WHERE o_orderstatus = 'F' OR o_orderdate <= TIMESTAMP '2000-08-01') AS triggered,
         count(*) FILTER (WHERE o_orderstatus <> 'F' AND o_orderdate > TIMESTAMP '2000-08-01') AS skipped
       FROM orders WHERE o_orderpriority <> '5-LOW'""",
)
def tick_summary(spark, sf):
    from millpond.operators.status import due

    enabled = read_parquet(spark, sf, "orders").filter("o_orderpriority <> '5-LOW'")
    is_due = due(F.lit(True), F.when(F.col("o_orderstatus") != "F", F.col("o_orderdate")), datetime(2000, 8, 1))
    return catalogs.outcome_summary(enabled, triggered=is_due, skipped=~is_due)


@plan(
    "numeric_columns", "A9",
    """SELECT CAST(1.0 AS DOUBLE) AS value, CAST(0.0 AS DOUBLE) AS event_type, round(avg(CASE WHEN event_type = 'error' THEN 0.0 ELSE 1.0 END), 6) AS mixed FROM events""",
)
def numeric_columns(spark, sf):
    mixed = F.when(F.col("event_type") == "error", "failed").otherwise(F.col("value").cast("string"))
    return read_parquet(spark, sf, "events").agg(
        numeric_share(F.col("value").cast("string")).alias("value"), numeric_share("event_type").alias("event_type"),
        F.round(numeric_share(mixed), 6).alias("mixed"))


@plan(
    "top_senders", "A11 L4",
    "SELECT user_id, count(*) AS messages FROM events GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10",
)
def top_senders(spark, sf):
    return read_parquet(spark, sf, "events").groupBy("user_id").agg(F.count("*").alias("messages")).orderBy(
        F.col("messages").desc(), "user_id").limit(10)


@plan(
    "meetings_per_week", "A11",
    "SELECT CAST(date_trunc('week', ts) AS TIMESTAMP) AS week, event_type, count(*) AS meetings FROM events GROUP BY 1, 2",
)
def meetings_per_week(spark, sf):
    week = F.date_trunc("week", "ts").cast("timestamp_ntz").alias("week")
    return read_parquet(spark, sf, "events").groupBy(week, "event_type").agg(F.count("*").alias("meetings"))


@plan(
    "spend_per_month", "A11",
    """SELECT CAST(date_trunc('month', l_shipdate) AS TIMESTAMP) AS month, round(sum(l_extendedprice * (1 - l_discount)), 4) AS spent,
         count(*) AS items FROM lineitem GROUP BY 1""",
)
def spend_per_month(spark, sf):
    month = F.date_trunc("month", "l_shipdate").cast("timestamp_ntz").alias("month")
    return read_parquet(spark, sf, "lineitem").groupBy(month).agg(
        F.round(F.sum(F.expr(REVENUE)), 4).alias("spent"), F.count("*").alias("items"))


@plan(
    "category_share_per_month", "A12",
    """SELECT period, p_brand, round(amount, 2) AS amount, round(amount * 100 / sum(amount) OVER (PARTITION BY period), 4) AS percentage FROM (
         SELECT CAST(date_trunc('month', l_shipdate) AS TIMESTAMP) AS period, p_brand, sum(l_extendedprice) AS amount
         FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2)""",
)
def category_share_per_month(spark, sf):
    items = read_parquet(spark, sf, "lineitem").select("l_partkey", "l_shipdate", "l_extendedprice")
    part = read_parquet(spark, sf, "part").select(F.col("p_partkey").alias("l_partkey"), "p_brand")
    shares = timelines.share_per_period(items.join(part, "l_partkey"), "l_shipdate", "p_brand", F.col("l_extendedprice"))
    return shares.select("period", "p_brand", F.round("amount", 2).alias("amount"), F.round("percentage", 4).alias("percentage"))


@plan(
    "flags_cube", "A13",
    """SELECT l_returnflag, l_linestatus, count(*) AS items, CAST(sum(l_quantity) AS DOUBLE) AS quantity FROM lineitem
       GROUP BY CUBE (l_returnflag, l_linestatus)""",
)
def flags_cube(spark, sf):
    return read_parquet(spark, sf, "lineitem").cube("l_returnflag", "l_linestatus").agg(
        F.count("*").alias("items"), F.sum("l_quantity").alias("quantity"))


@plan(
    "shipping_rollup", "A13",
    """SELECT l_returnflag, CAST(year(l_shipdate) AS INTEGER) AS ship_year, count(*) AS items FROM lineitem GROUP BY ROLLUP (1, 2)""",
)
def shipping_rollup(spark, sf):
    items = read_parquet(spark, sf, "lineitem").select("l_returnflag", F.year("l_shipdate").alias("ship_year"))
    return items.rollup("l_returnflag", "ship_year").agg(F.count("*").alias("items"))


@plan(
    "grouping_sets", "A13",
    """SELECT o_orderstatus, o_orderpriority, count(*) AS orders FROM orders
       GROUP BY GROUPING SETS ((o_orderstatus), (o_orderpriority), ())""",
)
def grouping_sets(spark, sf):
    orders = read_parquet(spark, sf, "orders")
    sets = [[F.col("o_orderstatus")], [F.col("o_orderpriority")], []]
    return orders.groupingSets(sets, "o_orderstatus", "o_orderpriority").agg(F.count("*").alias("orders"))


@plan(
    "distinct_buyers", "A13",
    """SELECT o_orderstatus, count(DISTINCT o_custkey) AS buyers, count(DISTINCT o_orderpriority) AS priorities FROM orders GROUP BY 1""",
)
def distinct_buyers(spark, sf):
    return read_parquet(spark, sf, "orders").groupBy("o_orderstatus").agg(
        F.countDistinct("o_custkey").alias("buyers"), F.countDistinct("o_orderpriority").alias("priorities"))


@plan("approximate_measures", "A14")
def approximate_measures(spark, sf):
    return read_parquet(spark, sf, "events").groupBy("event_type").agg(
        F.approx_count_distinct("user_id").alias("users"),
        F.percentile_approx("value", [0.5, 0.95]).alias("quantiles"),
        F.expr("approx_top_k(user_id, 3)").alias("busiest"))


@plan(
    "kept_sketches", "A14",
    """SELECT event_type, month, count(*) AS rows, count(DISTINCT user_id) AS users, true AS users_near, true AS median_near,
         true AS p95_near, true AS busiest_near
       FROM (SELECT *, CAST(date_trunc('month', ts) AS TIMESTAMP) AS month FROM events) GROUP BY 1, 2""",
)
def kept_sketches(spark, sf):
    """Monthly figures from daily sketches that were stored day by day, each with whether it lies in its stated bound."""
    events = read_parquet(spark, sf, "events")
    path = new_folder(spark, "sketches")
    half = F.expr("timestampadd(DAY, 15, date_trunc('month', ts))").cast("timestamp_ntz")
    # A first load, a second one that brings new days, and a repeat that finds nothing new.
    sketches.refresh(events.where(F.col("ts") < half), "ts", ["event_type"], "user_id", "value", path)
    sketches.refresh(events, "ts", ["event_type"], "user_id", "value", path)
    sketches.refresh(events, "ts", ["event_type"], "user_id", "value", path)
    month = F.date_trunc("month", "day").cast("timestamp_ntz").alias("month")
    figures = sketches.merged(sketches.stored_days(spark, path), ["event_type", month])
    rows = events.withColumn("month", F.date_trunc("month", "ts").cast("timestamp_ntz"))
    exact = rows.groupBy("event_type", "month").agg(F.countDistinct("user_id").alias("exact_users"))
    busy = rows.groupBy("event_type", "month", "user_id").agg(F.count("*").alias("n")).groupBy("event_type", "month").agg(F.max("n").alias("most"))
    ranks = rows.join(figures.select("event_type", "month", "median", "p95"), ["event_type", "month"]).groupBy("event_type", "month").agg(
        F.count("value").alias("n"), *[F.sum((F.col("value") < F.col(q)).cast("long")).alias(f"{q}_below") for q in ("median", "p95")],
        *[F.sum((F.col("value") <= F.col(q)).cast("long")).alias(f"{q}_upto") for q in ("median", "p95")])
    joined = figures.join(exact, ["event_type", "month"]).join(ranks, ["event_type", "month"]).join(busy, ["event_type", "month"])

    def near(q: str, share: float):
        slack = F.col("n") * sketches.RANK_ERROR + 1
        return ((F.col(f"{q}_below") <= F.col("n") * share + slack) & (F.col(f"{q}_upto") >= F.col("n") * share - slack)).alias(f"{q}_near")

    return joined.select(
        "event_type", "month", "rows", F.col("exact_users").alias("users"),
        (F.abs(F.col("users") - F.col("exact_users")) <= sketches.DISTINCT_ERROR * F.col("exact_users") + 1).alias("users_near"),
        near("median", 0.5), near("p95", 0.95),
        # Where no item is surely frequent none is listed; that is near if the busiest one is below the bound.
        (F.coalesce(F.get("busiest", F.lit(0))["count"], F.lit(0)) >= F.col("most") - F.col("rows") / sketches.TRACKED * 4).alias("busiest_near"))


@plan(
    "net_worth_over_year", "W6",
    """SELECT * FROM (SELECT o_orderpriority, period, round(amount, 2) AS amount,
         round(sum(amount) OVER (PARTITION BY o_orderpriority ORDER BY period), 2) AS running_total FROM (
           SELECT o_orderpriority, CAST(date_trunc('day', o_orderdate) AS TIMESTAMP) AS period, sum(o_totalprice) AS amount FROM orders GROUP BY 1, 2))
       WHERE period > TIMESTAMP '2000-08-01' AND period <= TIMESTAMP '2001-08-01'""",
)
def net_worth_over_year(spark, sf):
    """The balance of the last year: earlier days count into the opening balance but are not shown."""
    orders = read_parquet(spark, sf, "orders")
    totals = timelines.running_total(orders, ["o_orderpriority"], "o_orderdate", F.col("o_totalprice"))
    return totals.filter(in_range("period", "1Y", AS_OF)).select(
        "o_orderpriority", "period", F.round("amount", 2).alias("amount"), F.round("running_total", 2).alias("running_total"))


@plan(
    "net_worth_all_time", "W6",
    """SELECT o_orderstatus, period, round(amount, 2) AS amount,
         round(sum(amount) OVER (PARTITION BY o_orderstatus ORDER BY period), 2) AS running_total FROM (
           SELECT o_orderstatus, CAST(date_trunc('month', o_orderdate) AS TIMESTAMP) AS period, sum(o_totalprice) AS amount FROM orders GROUP BY 1, 2)""",
)
def net_worth_all_time(spark, sf):
    orders = read_parquet(spark, sf, "orders").filter(in_range("o_orderdate", "All", AS_OF))
    totals = timelines.running_total(orders, ["o_orderstatus"], "o_orderdate", F.col("o_totalprice"), "month")
    return totals.withColumns({"amount": F.round("amount", 2), "running_total": F.round("running_total", 2)})


TREND_SQL = """
SELECT period, round(amount, 2) AS amount, round(previous, 2) AS previous, round(amount - previous, 2) AS change FROM (
  SELECT period, amount, lag(amount) OVER (ORDER BY period) AS previous FROM (
    SELECT CAST(date_trunc('week', o_orderdate) AS TIMESTAMP) AS period, sum(o_totalprice) AS amount FROM orders
    WHERE {0} GROUP BY 1))"""


@plan(
    "weekly_change_per_status", "W7",
    """SELECT o_orderstatus, period, round(amount, 2) AS amount, round(previous, 2) AS previous, round(amount - previous, 2) AS change FROM (
         SELECT *, lag(amount) OVER (PARTITION BY o_orderstatus ORDER BY period) AS previous FROM (
           SELECT o_orderstatus, CAST(date_trunc('week', o_orderdate) AS TIMESTAMP) AS period, sum(o_totalprice) AS amount FROM orders GROUP BY 1, 2))""",
)
def weekly_change_per_status(spark, sf):
    trend = timelines.period_change(read_parquet(spark, sf, "orders"), ["o_orderstatus"], "o_orderdate", F.col("o_totalprice"))
    return trend.withColumns({c: F.round(c, 2) for c in ("amount", "previous", "change")})


@plan(
    "ranked_months", "W8",
    """SELECT o_orderpriority, month, spent, rank() OVER w AS rank, dense_rank() OVER w AS dense_rank, ntile(4) OVER w AS quartile,
         round(cume_dist() OVER w, 6) AS cume_dist FROM (
         SELECT o_orderpriority, CAST(date_trunc('month', o_orderdate) AS TIMESTAMP) AS month, round(sum(o_totalprice), 2) AS spent FROM orders GROUP BY 1, 2)
       WINDOW w AS (PARTITION BY o_orderpriority ORDER BY spent DESC, month)""",
)
def ranked_months(spark, sf):
    """Ranks over sums, so that a window sees one row per month however many orders there are."""
    month = F.date_trunc("month", "o_orderdate").cast("timestamp_ntz").alias("month")
    spent = read_parquet(spark, sf, "orders").groupBy("o_orderpriority", month).agg(
        F.round(F.sum("o_totalprice"), 2).alias("spent"))
    w = W.partitionBy("o_orderpriority").orderBy(F.col("spent").desc(), "month")
    return spent.select(
        "o_orderpriority", "month", "spent", F.rank().over(w).cast("long").alias("rank"),
        F.dense_rank().over(w).cast("long").alias("dense_rank"), F.ntile(4).over(w).cast("long").alias("quartile"),
        F.round(F.cume_dist().over(w), 6).alias("cume_dist"))


SESSIONS_SQL = """
WITH m AS (SELECT {by}, epoch_us(ts) // 1000 AS t FROM events),
g AS (SELECT *, CASE WHEN t - lag(t) OVER (PARTITION BY {by} ORDER BY t) < {gap} THEN 0 ELSE 1 END AS new FROM m),
s AS (SELECT *, sum(new) OVER (PARTITION BY {by} ORDER BY t ROWS UNBOUNDED PRECEDING) AS n FROM g)
SELECT {by}, min(t) AS session_start_ms, max(t) AS session_end_ms, count(*) AS rows FROM s GROUP BY {by}, n"""


@plan("idle_sessions_per_user", "Z5", SESSIONS_SQL.format(by="user_id", gap=60_000))
def idle_sessions_per_user(spark, sf):
    return timelines.idle_sessions(read_parquet(spark, sf, "events"), ["user_id"], "ts")


@plan("day_long_sessions", "Z5", SESSIONS_SQL.format(by="user_id", gap=43_200_000))
def day_long_sessions(spark, sf):
    return timelines.idle_sessions(read_parquet(spark, sf, "events"), ["user_id"], "ts", idle_ms=43_200_000)


@plan("idle_sessions_per_type", "Z5", SESSIONS_SQL.format(by="event_type", gap=600_000))
def idle_sessions_per_type(spark, sf):
    """Few, very busy keys: each is still spread over its hours."""
    return timelines.idle_sessions(read_parquet(spark, sf, "events"), ["event_type"], "ts", idle_ms=600_000)


@plan(
    "hourly_windows", "Z9",
    """SELECT CAST(date_trunc('hour', ts) AS TIMESTAMP) AS window_start, CAST(date_trunc('hour', ts) AS TIMESTAMP) + INTERVAL 1 HOUR AS window_end,
         event_type, count(*) AS rows FROM events GROUP BY 1, 2, 3""",
)
def hourly_windows(spark, sf):
    return timelines.windowed_counts(read_parquet(spark, sf, "events"), "ts", ["event_type"], "1 hour")


@plan(
    "sliding_days", "Z9",
    """SELECT w AS window_start, w + INTERVAL 1 DAY AS window_end, event_type, count(*) AS rows FROM (
         SELECT event_type, unnest([h, h - INTERVAL 6 HOUR, h - INTERVAL 12 HOUR, h - INTERVAL 18 HOUR]) AS w FROM (
           SELECT event_type, time_bucket(INTERVAL 6 HOUR, ts, TIMESTAMP '2024-01-01') AS h FROM events)) GROUP BY 1, 2, 3""",
)
def sliding_days(spark, sf):
    return timelines.windowed_counts(read_parquet(spark, sf, "events"), "ts", ["event_type"], "1 day", "6 hours")
