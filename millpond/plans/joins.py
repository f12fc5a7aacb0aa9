"""Joins of catalogs, status and facts."""

from pyspark.sql import functions as F

from millpond.operators import catalogs, keyed, reports, status, timelines
from millpond.plans import plan, read_parquet


@plan(
    "customers_with_last_order", "J1 W5",
    """SELECT c_custkey, c_name, o_orderkey, o_orderdate, o_orderstatus FROM customer LEFT JOIN (
         SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS rn
           FROM orders) WHERE rn = 1) ON c_custkey = o_custkey""",
)
def customers_with_last_order(spark, sf):
    orders = read_parquet(spark, sf, "orders").select(
        F.col("o_custkey").alias("c_custkey"), "o_orderkey", "o_orderdate", "o_orderstatus")
    last = status.latest_job(orders, "c_custkey", "o_orderdate", "o_orderkey")
    return read_parquet(spark, sf, "customer").select("c_custkey", "c_name").join(last, "c_custkey", "left")


@plan(
    "latest_order_per_customer", "W5 L1",
    """SELECT o_custkey, o_orderkey, o_orderdate FROM (
         SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS rn FROM orders) WHERE rn = 1""",
)
def latest_order_per_customer(spark, sf):
    orders = read_parquet(spark, sf, "orders").select("o_custkey", "o_orderkey", "o_orderdate")
    return status.latest_job(orders, "o_custkey", "o_orderdate", "o_orderkey")


@plan(
    "connector_list_with_defaults", "J2",
    """SELECT doc_id, source, coalesce(is_connected, false) AS is_connected, coalesce(loads, 0) AS loads, quality
       FROM documents LEFT JOIN (SELECT doc_id, true AS is_connected, count(*) AS loads, max(quality) AS quality
         FROM labels GROUP BY 1) USING (doc_id)""",
)
def connector_list_with_defaults(spark, sf):
    """Labels cover some documents only; the others get the defaults."""
    state = (
        read_parquet(spark, sf, "labels").groupBy("doc_id")
        .agg(F.lit(True).alias("is_connected"), F.count("*").alias("loads"), F.max("quality").alias("quality"))
    )
    return catalogs.with_status(
        read_parquet(spark, sf, "documents").select("doc_id", "source"), state, "doc_id",
        {"is_connected": False, "loads": 0, "quality": None},
    )


@plan(
    "first_key_column", "J4 T4",
    """SELECT l_orderkey, o_orderstatus, min(l_linenumber) AS l_linenumber FROM orders JOIN lineitem ON o_orderkey = l_orderkey
       GROUP BY 1, 2""",
)
def first_key_column(spark, sf):
    constraints = read_parquet(spark, sf, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_orderstatus")
    columns = read_parquet(spark, sf, "lineitem").select("l_orderkey", "l_linenumber")
    return catalogs.lowest_key_column(constraints, columns, ["l_orderkey"], "l_linenumber")


@plan(
    "lineitem_orders_customer", "J5",
    """SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, o_orderdate, c_name
       FROM lineitem LEFT JOIN orders ON l_orderkey = o_orderkey LEFT JOIN customer ON o_custkey = c_custkey""",
)
def lineitem_orders_customer(spark, sf):
    items = read_parquet(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    orders = read_parquet(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    customer = read_parquet(spark, sf, "customer").select("c_custkey", "c_name")
    # Orders get their customer first: that join is far smaller than one on line items.
    named = orders.join(customer, F.col("o_custkey") == F.col("c_custkey"), "left")
    return items.join(named, F.col("l_orderkey") == F.col("o_orderkey"), "left").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "o_orderdate", "c_name")


@plan(
    "documents_not_indexed", "J6 T17",
    """SELECT 'doc ' || d.doc_id AS name, source AS package, lang AS version FROM documents d
       WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)""",
)
def documents_not_indexed(spark, sf):
    docs = read_parquet(spark, sf, "documents")
    named = lambda d: d.select(
        F.concat(F.lit("doc "), F.col("doc_id").cast("string")).alias("name"), F.col("source").alias("package"),
        F.col("lang").alias("version"))
    known = docs.join(read_parquet(spark, sf, "labels").select("doc_id"), "doc_id", "left_semi")
    return catalogs.unknown(named(docs), named(known), ["name", "package", "version"])


@plan("customer_by_key", "J9", "SELECT * FROM customer WHERE c_custkey = 42 OR c_name = 'Customer#000000007'")
def customer_by_key(spark, sf):
    return read_parquet(spark, sf, "customer").filter("c_custkey = 42 OR c_name = 'Customer#000000007'")


@plan(
    "orders_of_chosen_customers", "J10",
    """SELECT * FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING' AND c_acctbal > 5000)""",
)
def orders_of_chosen_customers(spark, sf):
    chosen = read_parquet(spark, sf, "customer").filter("c_mktsegment = 'BUILDING' AND c_acctbal > 5000")
    orders = read_parquet(spark, sf, "orders")
    return orders.join(chosen.select(F.col("c_custkey").alias("o_custkey")), "o_custkey", "left_semi").select(*orders.columns)


@plan(
    "revenue_by_nation", "J11",
    """SELECT n_name, r_name, round(sum(l_extendedprice * (1 - l_discount)), 4) AS revenue, count(*) AS items
       FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
       JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
       GROUP BY 1, 2""",
)
def revenue_by_nation(spark, sf):
    items = read_parquet(spark, sf, "lineitem")
    orders = read_parquet(spark, sf, "orders")
    # Revenue is summed per order before the other tables are joined, so those joins see orders, not items.
    per_order = items.groupBy("l_orderkey").agg(
        F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("revenue"), F.count("*").alias("items"))
    joined = (
        per_order.join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
        .join(read_parquet(spark, sf, "customer"), F.col("o_custkey") == F.col("c_custkey"))
        .join(read_parquet(spark, sf, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
        .join(read_parquet(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    )
    return joined.groupBy("n_name", "r_name").agg(
        F.round(F.sum("revenue"), 4).alias("revenue"), F.sum("items").alias("items"))


@plan(
    "purchase_before_error", "J12",
    """SELECT e.event_id, e.user_id, e.ts, p.ts AS as_of_ts, p.value, p.event_id AS purchase_id
       FROM (SELECT * FROM events WHERE event_type = 'error') e
       ASOF LEFT JOIN (SELECT * FROM events WHERE event_type = 'purchase') p ON e.user_id = p.user_id AND e.ts >= p.ts""",
)
def purchase_before_error(spark, sf):
    events = read_parquet(spark, sf, "events")
    errors = events.filter("event_type = 'error'").select("event_id", "user_id", "ts")
    purchases = events.filter("event_type = 'purchase'").select("user_id", "ts", "value", F.col("event_id").alias("purchase_id"))
    return timelines.as_of_join(errors, purchases, ["user_id"], "ts", ["value", "purchase_id"])


@plan(
    "clicks_before_purchase", "J12",
    """SELECT p.event_id, p.user_id, p.ts, CAST(coalesce((SELECT count(*) FROM events c WHERE c.user_id = p.user_id
         AND c.event_type = 'click' AND c.ts BETWEEN p.ts - INTERVAL 6 HOUR AND p.ts), 0) AS BIGINT) AS rows_before
       FROM events p WHERE p.event_type = 'purchase'""",
)
def clicks_before_purchase(spark, sf):
    events = read_parquet(spark, sf, "events").select("event_id", "user_id", "ts", "event_type")
    kind = F.col("event_type")
    return timelines.counts_before(events, ["user_id"], "ts", kind == "click", kind == "purchase", 6 * 3600).drop("event_type")


CHART = (
    "'# ' || source || E'\\n\\n```chart\\n{\"type\":\"line\",\"dataQueryName\":\"' || lang || "
    "'\",\"keyColumnName\":\"day\",\"seriesColumnNames\":[\"n\"]}\\n```\\n\\n' || text"
)


def reports_with_charts(spark, sf):
    """One report per document: a heading, a chart block that names the query of the language, the text.
    Documents of one source carry a broken block as well."""
    block = F.concat(
        F.lit('# '), F.col("source"), F.lit('\n\n```chart\n{"type":"line","dataQueryName":"'), F.col("lang"),
        F.lit('","keyColumnName":"day","seriesColumnNames":["n"]}\n```\n\n'), F.col("text"))
    broken = F.when(F.col("source") == "src1", F.lit('\n```chart\n{"type": line\n```\n')).otherwise("")
    return read_parquet(spark, sf, "documents").select("doc_id", F.concat(block, broken).alias("report"))


@plan(
    "chart_blocks_of_reports", "E7 J7",
    """SELECT doc_id, 0 AS position, 'line' AS type, lang AS query_name, 'day' AS key_column, 'n' AS series, false AS is_invalid FROM documents
       UNION ALL SELECT doc_id, 1, NULL, NULL, NULL, NULL, true FROM documents WHERE source = 'src1'""",
)
def chart_blocks_of_reports(spark, sf):
    charts = reports.report_charts(reports_with_charts(spark, sf), "doc_id", "report")
    return charts.withColumn("series", F.array_join("series_columns", ",")).drop("series_columns").withColumn(
        "series", F.when(~F.col("is_invalid"), F.col("series")))


def _results(spark, sf):
    """Query results that exist already: one per language of the documents that have a label of quality."""
    labelled = read_parquet(spark, sf, "labels").filter("quality = 1").select("doc_id")
    docs = read_parquet(spark, sf, "documents").join(labelled, "doc_id", "left_semi").filter("lang <> 'es'")
    return docs.groupBy(F.col("lang").alias("query_name")).agg(F.count("*").alias("result_rows"))


_RESULTS = """(SELECT lang AS query_name, count(*) AS result_rows FROM documents WHERE lang <> 'es'
  AND doc_id IN (SELECT doc_id FROM labels WHERE quality = 1) GROUP BY 1)"""


@plan(
    "charts_bound_to_results", "J7 C6",
    f"SELECT d.doc_id, query_name, result_rows FROM documents d JOIN {_RESULTS} r ON d.lang = r.query_name",
)
def charts_bound_to_results(spark, sf):
    charts = reports.report_charts(reports_with_charts(spark, sf), "doc_id", "report")
    return reports.bind_charts(charts, _results(spark, sf)).select("doc_id", "query_name", "result_rows")


@plan(
    "chart_queries_to_run", "J7",
    f"SELECT DISTINCT lang AS query_name FROM documents WHERE lang NOT IN (SELECT query_name FROM {_RESULTS})",
)
def chart_queries_to_run(spark, sf):
    charts = reports.report_charts(reports_with_charts(spark, sf), "doc_id", "report")
    return reports.missing_queries(charts, _results(spark, sf))


@plan(
    "statements_matched_to_queries", "J8 T19",
    """SELECT doc_id, CASE WHEN lang = 'en' THEN 'by_language' ELSE source END AS name FROM documents""",
)
def statements_matched_to_queries(spark, sf):
    """Statements that are a named query's exact text, or mention a query's name as a word."""
    docs = read_parquet(spark, sf, "documents")
    exact = "SELECT lang, count(*) FROM documents GROUP BY lang"
    statements = docs.select(
        "doc_id",
        F.when(F.col("lang") == "en", F.lit(exact)).otherwise(F.concat(F.lit("SELECT n FROM "), "source", F.lit(" ORDER BY n"))).alias("statement"))
    specs = docs.select(F.col("source").alias("name")).distinct().select(
        "name", F.concat(F.lit("SELECT * FROM other_"), "name").alias("query"))
    named = docs.filter(f"lang = 'en'").select(F.lit("by_language").alias("name"), F.lit(exact).alias("query")).distinct()
    return reports.match_statements(statements, specs.unionByName(named), "doc_id")


@plan(
    "first_message_per_role", "W1",
    """SELECT conv_id, role, turn, text FROM (SELECT *, row_number() OVER (PARTITION BY conv_id, role ORDER BY turn) AS rn
       FROM conversations) WHERE rn = 1""",
)
def first_message_per_role(spark, sf):
    messages = read_parquet(spark, sf, "conversations").select("conv_id", "role", "turn", "text")
    return keyed.first_per_key(messages, ["conv_id", "role"], [F.col("turn")])


@plan(
    "sessions_during_outages", "J12",
    """WITH s AS (
         SELECT event_type, user_id, epoch_us(min(ts)) // 1000 AS start_ms, epoch_us(max(ts)) // 1000 AS end_ms
         FROM (SELECT *, date_trunc('day', ts) AS day FROM events) GROUP BY event_type, user_id, day),
       o AS (SELECT event_type, event_id, epoch_us(ts) // 1000 - 600000 AS start_ms,
               epoch_us(ts) // 1000 + CAST(CASE WHEN event_id % 7 = 0 THEN 86400000 WHEN event_id % 3 = 0 THEN 7200000 ELSE 5000 END AS BIGINT) AS end_ms
             FROM events WHERE value > 190)
       SELECT o.event_type, o.event_id, count(*) AS spans, CAST(sum(least(s.end_ms, o.end_ms) - greatest(s.start_ms, o.start_ms)) AS BIGINT) AS shared_ms
       FROM s JOIN o ON s.event_type = o.event_type AND s.start_ms <= o.end_ms AND o.start_ms <= s.end_ms GROUP BY 1, 2""",
)
def sessions_during_outages(spark, sf):
    """Days of activity of users that overlap outages of seconds, hours or a day, of the same type of event."""
    events = read_parquet(spark, sf, "events")
    ms = F.unix_millis(F.col("ts").cast("timestamp"))
    active = events.groupBy("event_type", "user_id", F.date_trunc("day", "ts").alias("day")).agg(F.min(ms).alias("start_ms"), F.max(ms).alias("end_ms"))
    lasting = F.when(F.col("event_id") % 7 == 0, 86_400_000).when(F.col("event_id") % 3 == 0, 7_200_000).otherwise(5_000)
    outages = events.where("value > 190").select("event_type", "event_id", (ms - 600_000).alias("start_ms"), (ms + lasting).alias("end_ms"))
    met = timelines.overlaps(active.drop("day"), outages, ["event_type"], "start_ms", "end_ms", totals=True)
    return met.groupBy(F.col("right.event_type").alias("event_type"), F.col("right.event_id").alias("event_id")).agg(F.sum("pairs").alias("spans"), F.sum("shared_ms").alias("shared_ms"))
