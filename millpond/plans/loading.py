"""Scans, feeds, high-water marks and profiles."""

from datetime import datetime, timedelta

from pyspark.sql import functions as F

from millpond.model import Connector, Resource
from millpond.operators import profiles, status
from millpond.plans import plan, read_parquet
from millpond.session import new_folder
from millpond.sources import feeds, tables
from millpond.sources.connectors import ConnectorLoader

SINCE = datetime(2001, 1, 1)
AS_OF = datetime(2001, 8, 1)
EVENTS_AS_OF = datetime(2024, 1, 25)
EVENTS_SINCE = datetime(2024, 1, 10)
TABLES = {
    "region": "r_regionkey", "nation": "n_nationkey", "customer": "c_custkey", "supplier": "s_suppkey",
    "part": "p_partkey", "orders": "o_orderkey", "lineitem": None, "events": "event_id", "documents": "doc_id",
    "embeddings": "vec_id", "pages": "page_id", "benchmark": "item_id", "labels": "doc_id", "conversations": None,
}
ORDERS = Resource("orders", ("o_orderkey",), created_at="o_orderdate")


@plan("full_scan_orders", "S1", "SELECT * FROM orders")
def full_scan_orders(spark, sf):
    return read_parquet(spark, sf, "orders")


@plan(
    "incremental_orders", "S2 S3",
    "SELECT * FROM orders WHERE o_orderdate > TIMESTAMP '2001-01-01'",
)
def incremental_orders(spark, sf):
    return tables.incremental(read_parquet(spark, sf, "orders"), ORDERS, SINCE)


@plan(
    "incremental_events_detected_column", "S3 S4",
    "SELECT event_id, user_id, ts AS created_at FROM events WHERE ts > TIMESTAMP '2024-01-10'",
)
def incremental_events_detected_column(spark, sf):
    # No column is configured; created_at is found by its name and type.
    feed = read_parquet(spark, sf, "events").select("event_id", "user_id", F.col("ts").alias("created_at"))
    return tables.incremental(feed, Resource("events", ("event_id",)), EVENTS_SINCE)


@plan(
    "incremental_with_overlap", "S2",
    """SELECT o_orderkey, o_orderdate FROM (
         SELECT o_orderkey, CASE WHEN o_orderstatus = 'P' THEN NULL ELSE o_orderdate END AS o_orderdate FROM orders)
       WHERE o_orderdate > TIMESTAMP '2000-12-25' OR o_orderdate IS NULL""",
)
def incremental_with_overlap(spark, sf):
    orders = read_parquet(spark, sf, "orders").select(
        "o_orderkey", F.when(F.col("o_orderstatus") != "P", F.col("o_orderdate")).alias("o_orderdate")
    )
    return tables.incremental(orders, ORDERS, SINCE, overlap=timedelta(days=7), with_undated=True)


@plan(
    "first_load_look_back", "S14",
    "SELECT * FROM orders WHERE o_orderdate >= TIMESTAMP '2001-08-01' - INTERVAL 365 DAY",
)
def first_load_look_back(spark, sf):
    return tables.first_load(read_parquet(spark, sf, "orders"), "o_orderdate", AS_OF)


@plan(
    "high_water_mark_per_type", "S15 A5",
    """SELECT event_type, greatest(max(ts), TIMESTAMP '2024-01-30 23:30:00') AS high_water_mark
       FROM events GROUP BY event_type""",
)
def high_water_mark_per_type(spark, sf):
    return status.high_water_mark(
        read_parquet(spark, sf, "events"), "ts", datetime(2024, 1, 30, 23, 30), ["event_type"]
    )


@plan(
    "orders_loaded_in_two_steps", "S2 S14 S15 K1 K14 K20 Z1",
    """SELECT o_orderkey, o_custkey, o_orderstatus, round(o_totalprice, 2) AS o_totalprice, o_orderdate, o_orderpriority FROM orders
       WHERE o_orderdate >= TIMESTAMP '2000-07-01' - INTERVAL 365 DAY""",
)
def orders_loaded_in_two_steps(spark, sf):
    """A first load with its look-back, then one from the position it left; together they equal a full load."""
    orders = read_parquet(spark, sf, "orders")
    folder = new_folder(spark, "shop")
    shop = Connector(f"demo.{folder.rsplit('-', 1)[1]}", "Shop", "Orders of a shop", (ORDERS,))
    loader = ConnectorLoader(spark, shop, folder, buckets=4)
    until = datetime(2000, 7, 1)
    loader.load(ORDERS, orders.filter(F.col("o_orderdate") <= status.moment(until)), until, look_back=status.LOOK_BACK)
    loaded = loader.load(ORDERS, orders, AS_OF)
    return spark.table(loaded.table).drop("_bucket")


_PROFILE_ROWS = {
    "region": ("r_regionkey, r_name", 2, ""),
    "nation": ("n_nationkey, n_name, n_regionkey", 3, ""),
    "customer": ("c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment", 5, ""),
    "supplier": ("s_suppkey, s_name, s_nationkey, s_acctbal", 4, ""),
    "part": ("p_partkey, p_name, p_brand, p_type, p_size, p_retailprice", 6, ""),
    "orders": ("o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderdate, o_orderpriority", 6, "o_orderdate"),
    "lineitem": (
        "l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity, l_extendedprice, l_discount, l_tax, "
        "l_returnflag, l_linestatus, l_shipdate", 11, "l_shipdate"),
    "events": ("event_id, ts, user_id, event_type, value, props", 6, "ts"),
    "documents": ("doc_id, text, lang, source, n_chars", 5, ""),
    "embeddings": ("vec_id, embedding, label", 3, ""),
    "pages": ("page_id, url, html", 3, ""),
    "benchmark": ("item_id, text", 2, ""),
    "labels": ("doc_id, quality, toxic", 3, ""),
    "conversations": ("conv_id, turn, role, text", 4, ""),
}


def _profile_sql(name):
    columns, n, times = _PROFILE_ROWS[name]
    key = f"'{TABLES[name]}'" if TABLES[name] else "CAST(NULL AS VARCHAR)"
    return (
        f"SELECT '{name}' AS resource, CAST({n} AS INTEGER) AS column_count, '{columns}' AS columns, "
        f"'{times}' AS timestamp_columns, {key} AS primary_key, count(*) AS record_count FROM {name}"
    )


@plan("table_profiles", "S6 A1", " UNION ALL ".join(_profile_sql(t) for t in TABLES))
def table_profiles(spark, sf):
    return profiles.union_all(
        [profiles.table_profile(read_parquet(spark, sf, t), t, key) for t, key in TABLES.items()]
    )


def _profile_text_sql(name):
    columns, n, times = _PROFILE_ROWS[name]
    shown = ", ".join(columns.split(", ")[:10]) + ("..." if n > 10 else "")
    times_line = f"Timestamp columns: {times}\\n" if times else ""
    head = f"Resource: {name}\\nColumns ({n}): {shown}\\n{times_line}Record count: "
    return f"SELECT '{name}' AS resource, E'{head}' || format('{{:,}}', count(*)) AS profile FROM {name}"


@plan("table_profile_texts", "G8 L7", " UNION ALL ".join(_profile_text_sql(t) for t in TABLES))
def table_profile_texts(spark, sf):
    return profiles.profile_text(table_profiles(spark, sf))


_ORDER_TYPES = {
    "o_orderkey": "bigint", "o_custkey": "bigint", "o_orderstatus": "string", "o_totalprice": "double",
    "o_orderdate": "timestamp_ntz", "o_orderpriority": "string",
}


@plan(
    "column_profile_orders", "S6",
    " UNION ALL ".join(
        f"""SELECT '{c}' AS "column", '{t}' AS type, count(*) AS rows, count(*) - count({c}) AS null_count FROM orders"""
        for c, t in _ORDER_TYPES.items()
    ),
)
def column_profile_orders(spark, sf):
    return profiles.column_profile(read_parquet(spark, sf, "orders"))


# Landed pages are made from the events table, at most 50 events to a page.
PAGE = 50


def event_pages(events, item, page=PAGE, last_token=True):
    """Events as the pages an API would give. A page holds at most ``page`` items, so the groups are bounded."""
    number = F.floor(F.col("event_id") / page).cast("long").alias("page_no")
    grouped = events.select(number, F.struct("event_id", *item).alias("i")).groupBy("page_no").agg(
        F.array_sort(F.collect_list("i")).alias("items")
    )
    token = F.concat(F.lit("p"), (F.col("page_no") + 1).cast("string"))
    return grouped.select("page_no", F.to_json(F.struct("items", token.alias("nextPageToken"))).alias("page"))


@plan(
    "paged_feed_items", "S9 Y1",
    "SELECT event_id // 50 AS page_no, event_id, user_id, event_type, value FROM events",
)
def paged_feed_items(spark, sf):
    pages = event_pages(read_parquet(spark, sf, "events"), ["user_id", "event_type", "value"])
    return feeds.page_items(
        pages, "page", "event_id long, user_id long, event_type string, value double", keep=["page_no"]
    )


@plan(
    "page_completeness", "S16",
    "SELECT event_id // 64 AS page_no, CAST(count(*) AS INTEGER) AS items, count(*) >= 64 AS has_more FROM events GROUP BY 1",
)
def page_completeness(spark, sf):
    pages = event_pages(read_parquet(spark, sf, "events"), ["user_id"], page=64)
    return feeds.page_completeness(pages, "page", ["page_no"], full=64)


def _iso(col):
    return F.date_format(col, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")


@plan(
    "calendar_feed", "S10",
    """SELECT 'e' || event_id AS id, CASE WHEN event_type = 'error' THEN 'cancelled' ELSE 'confirmed' END AS status,
         event_type AS summary, ts AS created, ts + INTERVAL 1 DAY AS updated, ts AS start_time,
         ts + INTERVAL 1 HOUR AS end_time, event_type = 'error' AS is_deleted
       FROM events
       WHERE ts < TIMESTAMP '2024-01-25' AND ts + INTERVAL 1 HOUR > TIMESTAMP '2024-01-25' - INTERVAL 365 DAY
         AND ts + INTERVAL 1 DAY >= TIMESTAMP '2024-01-10'""",
)
def calendar_feed(spark, sf):
    ts = F.col("ts")
    stamp = lambda c: F.struct(F.lit(None).cast("string").alias("date"), _iso(c).alias("dateTime"))
    pages = event_pages(
        read_parquet(spark, sf, "events"),
        [
            F.concat(F.lit("e"), F.col("event_id").cast("string")).alias("id"),
            F.when(F.col("event_type") == "error", "cancelled").otherwise("confirmed").alias("status"),
            F.col("event_type").alias("summary"),
            _iso(ts).alias("created"),
            _iso(ts + F.expr("INTERVAL 1 DAY")).alias("updated"),
            stamp(ts).alias("start"),
            stamp(ts + F.expr("INTERVAL 1 HOUR")).alias("end"),
        ],
    )
    items = feeds.page_items(pages, "page", feeds.CALENDAR_ITEM)
    return feeds.calendar_events(items, EVENTS_AS_OF, EVENTS_SINCE)


@plan(
    "mail_feed", "S11",
    """SELECT CAST(event_id AS VARCHAR) AS id, event_type AS snippet, date_trunc('milliseconds', ts) AS received
       FROM events WHERE event_type <> 'error' AND date_trunc('milliseconds', ts) > TIMESTAMP '2024-01-10'""",
)
def mail_feed(spark, sf):
    events = read_parquet(spark, sf, "events")
    ids = events.select(F.col("event_id").cast("string").alias("id"))
    # Messages that could not be fetched are the ones of type error.
    details = events.filter("event_type <> 'error'").select(
        F.col("event_id").cast("string").alias("id"),
        F.col("event_type").alias("snippet"),
        F.unix_millis(F.col("ts").cast("timestamp")).cast("string").alias("internalDate"),
    )
    return feeds.mail_messages(ids, details, EVENTS_AS_OF, EVENTS_SINCE).select("id", "snippet", "received")


@plan(
    "channel_activity_feed", "S12 E11",
    """SELECT CAST(event_id AS VARCHAR) AS id, 'youtube#activity' AS kind, 'user ' || user_id AS title,
         event_type AS activity_type, ts AS published
       FROM events WHERE ts > TIMESTAMP '2024-01-10'""",
)
def channel_activity_feed(spark, sf):
    pages = event_pages(
        read_parquet(spark, sf, "events"),
        [
            F.col("event_id").cast("string").alias("id"),
            F.lit("youtube#activity").alias("kind"),
            F.struct(
                F.concat(F.lit("user "), F.col("user_id").cast("string")).alias("title"),
                _iso("ts").alias("publishedAt"),
                F.col("event_type").alias("type"),
            ).alias("snippet"),
        ],
    )
    return feeds.channel_activities(feeds.page_items(pages, "page", feeds.ACTIVITY_ITEM), EVENTS_AS_OF, EVENTS_SINCE)


DECLARED = ["signup", "purchase", "view"]


@plan(
    "records_per_resource", "S17 K15",
    """SELECT event_type AS resource, count(*) AS records, round(sum(value), 2) AS total FROM events
       WHERE event_type IN ('signup', 'purchase', 'view') GROUP BY 1""",
)
def records_per_resource(spark, sf):
    parts = feeds.split_by_resource(read_parquet(spark, sf, "events"), "event_type", DECLARED)
    return profiles.union_all(
        [
            rows.agg(F.count("*").alias("records"), F.round(F.sum("value"), 2).alias("total")).select(
                F.lit(name).alias("resource"), "records", "total"
            )
            for name, rows in parts.items()
        ]
    )


@plan(
    "undeclared_records", "S17",
    """SELECT event_type, count(*) AS skipped FROM events
       WHERE event_type NOT IN ('signup', 'purchase', 'view') GROUP BY 1""",
)
def undeclared_records(spark, sf):
    return feeds.undeclared(read_parquet(spark, sf, "events"), "event_type", DECLARED)


@plan(
    "records_processed_per_run", "A7 K15 Z3",
    """SELECT run, count(*) AS batches, CAST(sum(n) AS BIGINT) AS rows_written FROM (
         SELECT CAST(ts AS DATE) AS run, event_id // 100 AS batch, count(*) AS n FROM events GROUP BY 1, 2) GROUP BY 1""",
)
def records_processed_per_run(spark, sf):
    # One load run per day, its batches of at most 100 records each.
    log = (
        read_parquet(spark, sf, "events")
        .groupBy(F.to_date("ts").alias("run"), F.floor(F.col("event_id") / 100).alias("batch"))
        .agg(F.count("*").alias("rows_written"))
    )
    return status.run_totals(log, "run", "rows_written")


@plan(
    "table_freshness", "K14 F9 J3",
    """SELECT event_type AS table_name, max(ts) AS last_synced_at, count(*) AS rows_written,
         max(ts) >= TIMESTAMP '2024-01-31 00:30:00' - INTERVAL 1 HOUR AS is_fresh
       FROM events GROUP BY event_type""",
)
def table_freshness(spark, sf):
    loaded = status.table_status(read_parquet(spark, sf, "events"), "event_type", "ts")
    return loaded.withColumn("is_fresh", status.fresh("last_synced_at", datetime(2024, 1, 31, 0, 30)))
