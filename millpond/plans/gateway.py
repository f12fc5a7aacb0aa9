"""SQL with parameters, named queries and report bundles over the given tables."""

from datetime import datetime

from pyspark.sql import functions as F

from millpond.functions.dates import period_bounds
from millpond.model import ChartSpec, QuerySpec
from millpond.operators import charts, gateway, keyed, timelines
from millpond.operators.status import moment
from millpond.operators.tables import KeyedTable
from millpond.plans import plan, read_parquet
from millpond.plans.analysis import TREND_SQL
from millpond.session import new_folder

AS_OF = datetime(2001, 8, 1)


def _views(spark, sf, *names):
    for name in names:
        read_parquet(spark, sf, name).createOrReplaceTempView(name)


@plan(
    "sql_with_parameters", "G1",
    """SELECT o_orderstatus, count(*) AS orders FROM orders WHERE o_orderdate >= TIMESTAMP '2000-01-01' AND o_totalprice > 100000 GROUP BY 1""",
)
def sql_with_parameters(spark, sf):
    _views(spark, sf, "orders")
    return gateway.run_sql(
        spark,
        "SELECT o_orderstatus, count(*) AS orders FROM orders WHERE o_orderdate >= ? AND o_totalprice > ? GROUP BY 1",
        [datetime(2000, 1, 1), 100000.0],
    )


BY_SEGMENT = "SELECT c_mktsegment AS segment, count(*) AS customers, round(sum(c_acctbal), 2) AS balance FROM customer GROUP BY c_mktsegment"
BY_STATUS = "SELECT o_orderstatus AS status, count(*) AS orders FROM orders GROUP BY o_orderstatus"


def registry(spark, sf):
    _views(spark, sf, "customer", "orders")
    queries = gateway.QueryRegistry(spark)
    queries.register("demo", [QuerySpec("customers by segment", BY_SEGMENT), QuerySpec("orders_by_status", BY_STATUS)])
    return queries


@plan("named_query", "G3", BY_SEGMENT)
def named_query(spark, sf):
    return registry(spark, sf).run("demo", "customers by segment")


@plan("named_query_as_method", "G4", BY_STATUS)
def named_query_as_method(spark, sf):
    return registry(spark, sf).proxy("demo").ordersByStatus()


@plan(
    "report_bundle_records", "C6",
    f"""SELECT 'orders_by_status' AS query_name, '{{"status":"' || status || '","orders":' || orders || '}}' AS record FROM ({BY_STATUS})
        UNION ALL SELECT 'large orders', '{{"o_orderkey":' || o_orderkey || ',"o_custkey":' || o_custkey || '}}' FROM orders WHERE o_totalprice > 400000""",
)
def report_bundle_records(spark, sf):
    queries = registry(spark, sf)
    queries.register("report", [
        QuerySpec("orders_by_status", BY_STATUS),
        QuerySpec("large orders", "SELECT o_orderkey, o_custkey FROM orders WHERE o_totalprice > 400000"),
    ])
    # A chart may name a query twice; it runs once.
    return queries.bundle("report", ["orders_by_status", "large orders", "orders_by_status"])


@plan(
    "report_store", "K18",
    "SELECT doc_id AS id, source AS query_name, text FROM documents WHERE lang <> 'es'",
)
def report_store(spark, sf):
    """Reports saved and fetched by id; those in one language are deleted again."""
    reports = read_parquet(spark, sf, "documents").select(
        F.col("doc_id").alias("id"), F.col("source").alias("query_name"), "text", "lang")
    folder = new_folder(spark, "reports")
    store = KeyedTable(spark, f"demo_{folder.rsplit('-', 1)[1]}.report_bundle", folder, ["id"], buckets=4)
    store.create(reports.drop("lang").schema)
    store.upsert(reports)
    store.upsert(reports.filter("lang = 'es'").withColumn("op", F.lit(keyed.REMOVED)), op="op")
    return store.read()


@plan(
    "sql_function", "Y2",
    "SELECT l_returnflag, round(sum(l_extendedprice * (1 - l_discount)), 4) AS revenue FROM lineitem GROUP BY 1",
)
def sql_function(spark, sf):
    """A function of the user, written in SQL: it is inlined into the plan, no Python runs."""
    _views(spark, sf, "lineitem")
    spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION net_price(price DOUBLE, discount DOUBLE) RETURNS DOUBLE RETURN price * (1 - discount)")
    return gateway.run_sql(
        spark, "SELECT l_returnflag, round(sum(net_price(l_extendedprice, l_discount)), 4) AS revenue FROM lineitem GROUP BY 1")


_QUARTER = "o_orderdate >= TIMESTAMP '2001-04-01' AND o_orderdate < TIMESTAMP '2001-07-01'"


@plan("spending_trend", "S14 K3 K4 W7 C4 E15", TREND_SQL.format(_QUARTER))
def spending_trend(spark, sf):
    """What is my spending trend over the past quarter? One row per week, with the change to the week before."""
    start, end = period_bounds("past quarter", AS_OF)
    day = F.col("o_orderdate")
    recent = read_parquet(spark, sf, "orders").filter((day >= moment(start)) & (day < moment(end)))
    clean = keyed.latest_per_key(keyed.with_key(recent, ["o_orderkey"]), ["o_orderkey"], ["o_orderdate"])
    trend = timelines.period_change(clean, [], "o_orderdate", F.col("o_totalprice"))
    rounded = trend.withColumns({c: F.round(c, 2) for c in ("amount", "previous", "change")})
    return charts.chart_series(rounded, ChartSpec("line", "trend", "period", ("amount", "previous", "change")))
