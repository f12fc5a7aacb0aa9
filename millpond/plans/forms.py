"""Written forms, quoted and terminated statements, zone offsets, and listings with their status."""

from datetime import datetime

from pyspark.sql import functions as F

from millpond.functions import dates
from millpond.operators import gateway, reports, status, tables
from millpond.operators.tables import KeyedTable, disconnect
from millpond.plans import plan, read_parquet
from millpond.plans.gateway import _views
from millpond.plans.loading import event_pages
from millpond.session import new_folder
from millpond.sources import feeds


@plan(
    "mail_dates", "E3 K5 K8",
    """SELECT o_orderkey, o_orderdate AS stored,
         CASE WHEN o_orderpriority = '1-URGENT' THEN o_orderdate - INTERVAL 9 HOUR ELSE o_orderdate END AS instant FROM orders""",
)
def mail_dates(spark, sf):
    """Dates as mail headers, forms with 12-hour times and slashed forms write them; stored without, read with the zone."""
    d, p = F.col("o_orderdate"), F.col("o_orderpriority")
    # Day names are spelt by hand: the day of the week says nothing new and is not checked.
    written = (
        F.when(p == "1-URGENT", F.concat(F.lit("Tue, "), F.date_format(d, "dd MMM yyyy HH:mm:ss"), F.lit(" +0900")))
        .when(p == "2-HIGH", F.concat(F.lit("Fri, "), F.date_format(d, "d MMM yyyy HH:mm:ss"), F.lit(" GMT")))
        .when(p == "3-MEDIUM", F.date_format(d, "MMM d, yyyy h:mm a"))
        .when(p == "4-NOT SPECIFIED", F.date_format(d, "M/d/yyyy h:mm a"))
        .otherwise(F.date_format(d, "yyyy/MM/dd HH:mm:ss"))
    )
    orders = read_parquet(spark, sf, "orders").select("o_orderkey", written.alias("written"))
    return orders.select("o_orderkey", dates.clean_timestamp("written").alias("stored"), dates.parse_datetime("written").alias("instant"))


@plan(
    "statements_with_spaced_names", "J8",
    "SELECT DISTINCT c_custkey, 'customers by ' || lower(c_mktsegment) || ' segment' AS name FROM customer",
)
def statements_with_spaced_names(spark, sf):
    customers = read_parquet(spark, sf, "customer")
    phrase = F.concat(F.lit("customers by "), F.lower("c_mktsegment"), F.lit(" segment"))
    statements = customers.select("c_custkey", F.concat(F.lit("-- "), phrase, F.lit("\nSELECT 1")).alias("statement"))
    specs = customers.select(phrase.alias("name"), F.concat(F.lit("SELECT * FROM customer WHERE c_mktsegment = "), "c_mktsegment").alias("query")).distinct()
    return reports.match_statements(statements, specs, "c_custkey")


@plan("quoted_columns", "F1 G1", "SELECT c_custkey, c_name AS \"full name\" FROM customer WHERE c_custkey > 10")
def quoted_columns(spark, sf):
    _views(spark, sf, "customer")
    return gateway.run_sql(spark, 'SELECT "c_custkey", "c_name" AS "full name" FROM customer WHERE "c_custkey" > 10')


@plan("terminated_statement", "F1 G1", "SELECT n_name, ';--' AS mark FROM nation")
def terminated_statement(spark, sf):
    _views(spark, sf, "nation")
    return gateway.run_sql(spark, "SELECT n_name, ';--' AS mark FROM nation; -- all of them;\n /* done; */ ;")


@plan(
    "calendar_across_zones", "S10 S12 S15",
    """SELECT 'e' || event_id AS id FROM events
       WHERE ts < TIMESTAMP '2024-01-15' AND ts + INTERVAL 1 DAY >= TIMESTAMP '2024-01-10'""",
)
def calendar_across_zones(spark, sf):
    """Events written in zones from -11:00 to +14:00; the window is about instants."""
    ts, shift = F.col("ts"), F.col("event_id") % 26 - 11
    sign, hours = F.when(shift < 0, "-").otherwise("+"), F.lpad(F.abs(shift).cast("string"), 2, "0")

    def local(instant):
        moved = F.timestamp_add("HOUR", shift.cast("int"), instant)
        return F.concat(F.date_format(moved, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), sign, hours, F.lit(":00"))

    stamp = lambda c: F.struct(F.lit(None).cast("string").alias("date"), local(c).alias("dateTime"))
    pages = event_pages(read_parquet(spark, sf, "events"), [
        F.concat(F.lit("e"), F.col("event_id").cast("string")).alias("id"), F.lit("confirmed").alias("status"), F.col("event_type").alias("summary"),
        local(ts).alias("created"), local(ts + F.expr("INTERVAL 1 DAY")).alias("updated"), stamp(ts).alias("start"),
        stamp(ts + F.expr("INTERVAL 1 HOUR")).alias("end")])
    items = feeds.page_items(pages, "page", feeds.CALENDAR_ITEM)
    return feeds.calendar_events(items, datetime(2024, 1, 15), datetime(2024, 1, 10)).select("id")


@plan(
    "tables_with_status", "J3 S5 F10 G2",
    """SELECT * FROM (VALUES ('customer', 'shop'), ('nation', NULL), ('orders', 'shop')) AS t(table_name, connector),
         LATERAL (SELECT CASE table_name WHEN 'customer' THEN (SELECT count(*) FROM customer)
                                         WHEN 'orders' THEN (SELECT count(*) FROM orders) END AS rows_written)""",
)
def tables_with_status(spark, sf):
    """Keyed tables of a database, each with its owner and what its last load wrote; one was never loaded."""
    folder = new_folder(spark, "listing")
    database = f"demo_{folder.rsplit('-', 1)[1]}"
    loaded = []
    for name, key in (("customer", "c_custkey"), ("orders", "o_orderkey"), ("nation", "n_nationkey")):
        rows = read_parquet(spark, sf, name)
        made = KeyedTable(spark, f"{database}.{name}", f"{folder}/{name}", [key], buckets=2).create(rows.schema)
        if name != "nation":
            loaded.append((database, name, "shop", made.upsert(rows).rows))
    state = spark.createDataFrame(loaded, "schema_name string, table_name string, connector string, rows_written long")
    listed = tables.table_listing(spark).where(F.col("schema_name") == database)
    disconnect(spark, database)
    return status.listing_with_status(listed, state).select("table_name", "connector", "rows_written")


@plan(
    "described_table", "K13 K12",
    """SELECT 'p_name' AS column_name, 'what the maker calls it' AS comment UNION ALL SELECT 'p_size', 'in inches'
       UNION ALL SELECT '', 'parts of the shop, ' || (SELECT count(*) FROM part) || ' rows'""",
)
def described_table(spark, sf):
    """Comments of a table and its columns, which a change of a column's type keeps."""
    folder = new_folder(spark, "described")
    database = f"demo_{folder.rsplit('-', 1)[1]}"
    parts = read_parquet(spark, sf, "part").select("p_partkey", "p_name", "p_size")
    table = KeyedTable(spark, f"{database}.part", folder, ["p_partkey"], buckets=2).create(parts.schema)
    table.upsert(parts)
    table.describe(f"parts of the shop, {table.read().count()} rows", {"p_name": "what the maker calls it", "p_size": "in inches"})
    wider = parts.withColumn("p_size", F.col("p_size").cast("decimal(20,2)"))
    table.evolve(wider.schema)
    rows = [(f.name, f.metadata["comment"]) for f in table.schema().fields if f.metadata.get("comment")]
    rows.append(("", spark.catalog.getTable(table.name).description))
    disconnect(spark, database)
    return spark.createDataFrame(rows, "column_name string, comment string")
