"""Cleaning, one row per key, and keyed merges."""

from datetime import datetime

from pyspark.sql import functions as F
from pyspark.sql import types as T

from millpond.functions.dates import clean_timestamp
from millpond.functions.numbers import exact_number
from millpond.model import Connector, Resource
from millpond.operators import catalogs, keyed, naming, typed
from millpond.operators.tables import KeyedTable
from millpond.plans import plan, read_parquet
from millpond.session import new_folder
from millpond.sources import feeds
from millpond.sources.connectors import ConnectorLoader

DELTA_SQL = """
  SELECT c_custkey, c_name, c_nationkey, c_acctbal + 100 AS c_acctbal, c_mktsegment, 1 AS seq
    FROM customer WHERE c_mktsegment = 'BUILDING'
  UNION ALL
  SELECT c_custkey, c_name, c_nationkey, c_acctbal + 200, c_mktsegment, 2
    FROM customer WHERE c_mktsegment = 'BUILDING' AND c_acctbal < 0
  UNION ALL
  SELECT -1 - c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment, 1
    FROM customer WHERE c_mktsegment = 'MACHINERY'
"""


def customer_delta(customer):
    """Changed balances, some keys twice, and new customers."""
    building = customer.filter("c_mktsegment = 'BUILDING'")
    changed = building.withColumn("c_acctbal", F.col("c_acctbal") + 100).withColumn("seq", F.lit(1))
    again = building.filter("c_acctbal < 0").withColumn("c_acctbal", F.col("c_acctbal") + 200).withColumn("seq", F.lit(2))
    new = customer.filter("c_mktsegment = 'MACHINERY'").withColumn("c_custkey", -1 - F.col("c_custkey"))
    return changed.unionByName(again).unionByName(new.withColumn("seq", F.lit(1)))


UPSERT_SQL = f"""
WITH delta AS ({DELTA_SQL}),
last AS (SELECT * EXCLUDE (rn) FROM (
  SELECT *, row_number() OVER (PARTITION BY c_custkey ORDER BY seq DESC) AS rn FROM delta) WHERE rn = 1)
SELECT c_custkey, c_name, c_nationkey, round(c_acctbal, 2) AS c_acctbal, c_mktsegment FROM (
  SELECT * FROM customer WHERE c_custkey NOT IN (SELECT c_custkey FROM last)
  UNION ALL SELECT * EXCLUDE (seq) FROM last)
"""


@plan("upsert_customers", "K1 K4 Z8", UPSERT_SQL)
def upsert_customers(spark, sf):
    customer = read_parquet(spark, sf, "customer")
    merged = keyed.merge_by_key(customer, customer_delta(customer), ["c_custkey"], ["seq"])
    return merged.withColumn("c_acctbal", F.round("c_acctbal", 2))


@plan("upsert_customers_table", "K1 K4 K11 K16", UPSERT_SQL)
def upsert_customers_table(spark, sf):
    """The same merge against a stored table, run twice: the second run changes nothing."""
    customer = read_parquet(spark, sf, "customer")
    folder = new_folder(spark, "customers")
    name = f"demo_{folder.rsplit('-', 1)[1]}.customer"
    table = KeyedTable(spark, name, folder, ["c_custkey"], buckets=4).create(customer.schema)
    table.upsert(customer)
    delta = customer_delta(customer)
    table.upsert(delta, seq=["seq"])
    table.upsert(delta, seq=["seq"])
    return table.read().withColumn("c_acctbal", F.round("c_acctbal", 2))


@plan(
    "latest_lineitem_per_key", "K4",
    """SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber
         ORDER BY l_shipdate DESC, l_partkey DESC, l_suppkey DESC) AS rn FROM lineitem) WHERE rn = 1""",
)
def latest_lineitem_per_key(spark, sf):
    return keyed.latest_per_key(
        read_parquet(spark, sf, "lineitem"), ["l_orderkey", "l_linenumber"], ["l_shipdate", "l_partkey", "l_suppkey"]
    )


_NULL_KEYS = "SELECT o_orderkey, CASE WHEN o_orderpriority <> '5-LOW' THEN o_custkey END AS o_custkey, o_totalprice FROM orders"


def _orders_with_null_keys(spark, sf):
    return read_parquet(spark, sf, "orders").select(
        "o_orderkey", F.when(F.col("o_orderpriority") != "5-LOW", F.col("o_custkey")).alias("o_custkey"), "o_totalprice"
    )


@plan("rows_with_key", "K3", f"SELECT * FROM ({_NULL_KEYS}) WHERE o_custkey IS NOT NULL")
def rows_with_key(spark, sf):
    return keyed.with_key(_orders_with_null_keys(spark, sf), ["o_orderkey", "o_custkey"])


@plan(
    "rows_without_key", "K3",
    f"SELECT 'null key: o_custkey' AS reject_reason, count(*) AS rows FROM ({_NULL_KEYS}) WHERE o_custkey IS NULL",
)
def rows_without_key(spark, sf):
    rejected = keyed.without_key(_orders_with_null_keys(spark, sf), ["o_orderkey", "o_custkey"])
    return rejected.groupBy("reject_reason").agg(F.count("*").alias("rows"))


@plan(
    "sanitised_dates", "K5 K8",
    """SELECT o_orderkey, CASE o_orderpriority WHEN '5-LOW' THEN o_orderdate WHEN '4-NOT SPECIFIED' THEN o_orderdate END AS created_at
       FROM orders""",
)
def sanitised_dates(spark, sf):
    day = F.date_format("o_orderdate", "-MM-dd'T'HH:mm:ss.SSS'Z'")
    written = (
        F.when(F.col("o_orderpriority") == "1-URGENT", F.concat(F.lit("0999"), day))
        .when(F.col("o_orderpriority") == "2-HIGH", F.concat(F.lit("10000"), day))
        .when(F.col("o_orderpriority") == "3-MEDIUM", F.lit("not a date"))
        .otherwise(F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'"))
    )
    return read_parquet(spark, sf, "orders").select("o_orderkey", clean_timestamp(written).alias("created_at"))


@plan(
    "exact_numbers", "K7",
    """SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey,
         CAST(CAST(l_extendedprice AS VARCHAR) AS DECIMAL(38,10)) AS price FROM lineitem""",
)
def exact_numbers(spark, sf):
    return read_parquet(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey",
        exact_number(F.col("l_extendedprice").cast("string")).alias("price"),
    )


ORDER_SCHEMA = (
    T.StructType().add("o_orderkey", "long").add("o_custkey", "long").add("o_totalprice", "decimal(20,2)")
    .add("o_orderdate", "timestamp_ntz", True, {"comment": "when it was placed"}).add("o_note", "string")
)


def _written_orders(spark, sf):
    """Orders as text, some with junk in them."""
    orders = read_parquet(spark, sf, "orders")
    return typed.as_text(orders.select(
        "o_orderkey",
        F.when(F.col("o_orderkey") % 11 != 0, F.col("o_custkey").cast("string")).otherwise("none").alias("o_custkey"),
        F.round("o_totalprice", 2).cast("decimal(20,2)").alias("o_totalprice"),
        F.when(F.col("o_orderpriority") == "2-HIGH", "10000-01-01").when(F.col("o_orderpriority") == "3-MEDIUM", "soon")
        .otherwise(F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")).alias("o_orderdate"),
        F.col("o_orderstatus").alias("undeclared")).withColumn("o_orderkey", F.when(F.col("o_orderkey") % 13 != 0, F.col("o_orderkey"))))


_WRITTEN = """(SELECT *, o_orderkey % 13 = 0 AS keyless, o_orderkey % 11 = 0 AS bad FROM orders)"""


@plan(
    "typed_load", "K3 K5 K7 K8 K9 K13",
    f"""SELECT o_orderkey, o_custkey, CAST(round(o_totalprice, 2) AS DECIMAL(20,2)) AS o_totalprice,
         CASE WHEN o_orderpriority NOT IN ('2-HIGH', '3-MEDIUM') THEN CAST(o_orderdate AS TIMESTAMP) END AS o_orderdate,
         CAST(NULL AS VARCHAR) AS o_note FROM {_WRITTEN} WHERE NOT keyless AND NOT bad""",
)
def typed_load(spark, sf):
    """Orders written as text, typed by a declared schema and loaded; bad dates are NULL, other bad rows stay out."""
    folder = new_folder(spark, "typed")
    shop = Connector(f"typed.{folder.rsplit('-', 1)[1]}", "Shop", "Orders as text", (Resource("orders", ("o_orderkey",)),))
    loader = ConnectorLoader(spark, shop, folder, buckets=4)
    loaded = loader.load(shop.resources[0], _written_orders(spark, sf), datetime(2024, 1, 1), schema=ORDER_SCHEMA)
    return spark.table(loaded.table)


@plan(
    "typed_load_counts", "K3 K5",
    f"""SELECT count(*) FILTER (NOT keyless AND NOT bad) AS accepted, count(*) FILTER (keyless OR bad) AS rejected,
         count(*) FILTER (o_orderpriority IN ('2-HIGH', '3-MEDIUM')) AS bad_dates,
         count(*) FILTER (bad) AS bad_values, count(*) FILTER (keyless AND NOT bad) AS null_keys FROM {_WRITTEN}""",
)
def typed_load_counts(spark, sf):
    done = typed.split(_written_orders(spark, sf), ORDER_SCHEMA, ["o_orderkey"])
    why = lambda start: F.coalesce(F.sum(F.col("reject_reason").startswith(start).cast("long")), F.lit(0))
    return done.rejects.agg(
        F.lit(done.accepted).cast("long").alias("accepted"), F.lit(done.rejected).cast("long").alias("rejected"),
        F.lit(done.bad_dates).cast("long").alias("bad_dates"), why("bad value").alias("bad_values"), why("null key").alias("null_keys"))


PART_SCHEMA = (
    T.StructType().add("p_partkey", "long").add("p_name", "string").add("p_size", "long").add("p_weight", "double")
    .add("p_note", "string")
)


@plan(
    "declared_columns_only", "K9",
    """SELECT p_partkey, p_name, CAST(p_size AS BIGINT) AS p_size, CAST(NULL AS DOUBLE) AS p_weight,
         CAST(NULL AS VARCHAR) AS p_note FROM part""",
)
def declared_columns_only(spark, sf):
    return keyed.project_declared(read_parquet(spark, sf, "part"), PART_SCHEMA)


@plan(
    "evolved_part_table", "K12 U3",
    """SELECT p_partkey, p_name, CAST(p_size AS BIGINT) AS p_size, CAST(NULL AS DOUBLE) AS p_weight,
         CAST(NULL AS VARCHAR) AS p_note, p_brand, p_type, p_retailprice FROM part""",
)
def evolved_part_table(spark, sf):
    # p_size gets another type, two columns are new, and undeclared ones stay.
    part, folder = read_parquet(spark, sf, "part"), new_folder(spark, "part")
    table = KeyedTable(spark, f"demo_{folder.rsplit('-', 1)[1]}.part", folder, ["p_partkey"], buckets=4).create(part.schema)
    table.upsert(part)
    table.evolve(PART_SCHEMA)
    return table.read()


@plan(
    "nested_to_json", "K6",
    """SELECT event_id, '{"k":' || CAST(json_extract(props, '$.k') AS VARCHAR) || ',"type":"' || event_type || '"}' AS detail,
         '["' || event_type || '","' || user_id || '"]' AS tags FROM events""",
)
def nested_to_json(spark, sf):
    events = read_parquet(spark, sf, "events")
    k = F.from_json("props", "k long")["k"]
    return keyed.nested_to_json(
        events.select(
            "event_id",
            F.struct(k.alias("k"), F.col("event_type").alias("type")).alias("detail"),
            F.array("event_type", F.col("user_id").cast("string")).alias("tags"),
        )
    )


@plan(
    "reserved_column_names", "K10",
    'SELECT event_id AS id, event_type AS type_col, ts AS timestamp_col, value AS name FROM events',
)
def reserved_column_names(spark, sf):
    feed = read_parquet(spark, sf, "events").select(
        F.col("event_id").alias("id"), F.col("event_type").alias("type"), F.col("ts").alias("timestamp"),
        F.col("value").alias("name"),
    )
    return naming.rename_reserved(feed)


@plan(
    "partial_field_update", "K20",
    """SELECT c_custkey, c_name,
         CASE WHEN c_acctbal < 0 THEN 0.0 ELSE c_acctbal END AS c_acctbal,
         CASE WHEN c_mktsegment = 'BUILDING' THEN NULL ELSE c_mktsegment END AS c_mktsegment
       FROM customer""",
)
def partial_field_update(spark, sf):
    customer = read_parquet(spark, sf, "customer").select("c_custkey", "c_name", "c_acctbal", "c_mktsegment")
    balance = customer.filter("c_acctbal < 0").select(
        "c_custkey", F.lit(0.0).alias("c_acctbal"), F.lit(None).cast("string").alias("c_mktsegment"),
        F.lit(True).alias("sets_balance"), F.lit(1).alias("seq"))
    segment = customer.filter("c_mktsegment = 'BUILDING'").select(
        "c_custkey", F.lit(None).cast("double").alias("c_acctbal"), F.lit(None).cast("string").alias("c_mktsegment"),
        F.lit(False).alias("sets_balance"), F.lit(2).alias("seq"))
    return keyed.update_fields(
        customer, balance.unionByName(segment), ["c_custkey"], "seq",
        {"c_acctbal": F.col("sets_balance"), "c_mktsegment": ~F.col("sets_balance")},
    )


@plan(
    "component_upsert", "K19",
    """SELECT 'doc ' || doc_id AS name, source AS package, CASE WHEN lang = 'fr' THEN 'new: ' || text ELSE text END AS description,
         TIMESTAMP '2024-01-01' AS created_at,
         CASE WHEN lang = 'fr' THEN TIMESTAMP '2024-02-01' ELSE TIMESTAMP '2024-01-01' END AS updated_at
       FROM documents""",
)
def component_upsert(spark, sf):
    day = lambda y, m, d: F.lit(datetime(y, m, d)).cast("timestamp_ntz")
    docs = read_parquet(spark, sf, "documents").select(
        F.concat(F.lit("doc "), F.col("doc_id").cast("string")).alias("name"), F.col("source").alias("package"),
        F.col("text").alias("description"), "lang",
    )
    stored = docs.drop("lang").withColumn("created_at", day(2024, 1, 1)).withColumn("updated_at", day(2024, 1, 1))
    saved = docs.filter("lang = 'fr'").select(
        "name", "package", F.concat(F.lit("new: "), "description").alias("description"),
        day(2024, 2, 1).alias("created_at"), day(2024, 2, 1).alias("updated_at"), F.lit(1).alias("seq"))
    # The creation time is set only where the component is new, which here none is.
    known = saved.join(stored.select("name", "package"), ["name", "package"], "left_semi").withColumn("is_new", F.lit(False))
    fresh = catalogs.unknown(saved, stored, ["name", "package"]).withColumn("is_new", F.lit(True))
    return keyed.update_fields(
        stored, known.unionByName(fresh), ["name", "package"], "seq",
        {"description": F.lit(True), "created_at": F.col("is_new"), "updated_at": F.lit(True)},
    )


@plan(
    "change_feed_applied", "S13 T5",
    """WITH c AS (
         SELECT user_id, event_id, value, CASE event_type WHEN 'error' THEN 2 WHEN 'view' THEN 1 ELSE 0 END AS step,
           (event_id // 50) * 3 AS page_seq FROM events),
       last AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY page_seq + step DESC, event_id DESC) AS rn FROM c)
       SELECT CAST(user_id AS VARCHAR) AS account_id, event_id AS transaction_id, value AS amount
       FROM last WHERE rn = 1 AND step <> 2""",
)
def change_feed_applied(spark, sf):
    """A transaction feed per account: views modify, errors remove, all else adds; the last change decides."""
    item = "account_id string, transaction_id long, amount double"
    events = read_parquet(spark, sf, "events").select(
        F.floor(F.col("event_id") / 50).cast("long").alias("page_no"),
        F.when(F.col("event_type") == "error", "removed").when(F.col("event_type") == "view", "modified")
        .otherwise("added").alias("op"),
        F.struct(F.col("user_id").cast("string").alias("account_id"), F.col("event_id").alias("transaction_id"),
                 F.col("value").alias("amount")).alias("item"),
    )
    # A page has at most 50 changes.
    pages = events.groupBy("page_no").agg(
        *[F.array_sort(F.collect_list(F.when(F.col("op") == o, F.col("item")))).alias(o) for o in ("added", "modified", "removed")]
    ).select("page_no", F.to_json(F.struct("added", "modified", "removed")).alias("page"))
    changes = feeds.change_rows(pages, "page", "page_no", item)
    empty = changes.select("account_id", "transaction_id", "amount").limit(0)
    return keyed.merge_by_key(empty, changes, ["account_id"], ["change_seq", "change_pos"], op="op")


@plan(
    "accounts_of_feed", "S13",
    """SELECT CAST(c_custkey AS VARCHAR) AS account_id, c_name AS name, 'depository' AS kind, lower(c_mktsegment) AS subtype,
         CAST(c_custkey % 10000 AS VARCHAR) AS mask, 'USD' AS currency,
         CASE WHEN c_custkey % 3 <> 0 THEN CAST(round(c_acctbal, 2) AS DECIMAL(38,10)) END AS available,
         CAST(round(c_acctbal, 2) AS DECIMAL(38,10)) + CASE WHEN c_nationkey < 5 THEN 10 ELSE 0 END AS current,
         CAST(NULL AS DECIMAL(38,10)) AS credit_limit FROM customer""",
)
def accounts_of_feed(spark, sf):
    """Accounts listed once by all customers, and a second time, with a new balance, by those of five nations."""
    balance = F.round("c_acctbal", 2).cast("decimal(20,2)")
    each = read_parquet(spark, sf, "customer").select("*", F.explode(F.when(F.col("c_nationkey") < 5, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("seq"))
    account = F.struct(
        F.col("c_custkey").cast("string").alias("account_id"), F.col("c_name").alias("name"), F.lit("depository").alias("type"), F.lower("c_mktsegment").alias("subtype"),
        (F.col("c_custkey") % 10000).cast("string").alias("mask"),
        F.struct(F.when(F.col("c_custkey") % 3 != 0, balance).alias("available"), (balance + F.col("seq") * 10).alias("current"), F.lit("USD").alias("iso_currency_code")).alias("balances"))
    # A page has at most 50 accounts.
    pages = each.groupBy("seq", F.floor(F.col("c_custkey") / 50).alias("page_no")).agg(F.to_json(F.struct(F.collect_list(account).alias("accounts"))).alias("page"))
    return feeds.account_rows(pages, "page", "seq")
