"""Filters, ordering, paging and set operations."""

from datetime import datetime

from pyspark.sql import functions as F

from millpond.functions.text import contains_text
from millpond.operators import catalogs, gateway, status
from millpond.plans import plan, read_parquet

AS_OF = datetime(2001, 8, 1)


@plan(
    "row_cap_with_total", "F2 T10",
    """SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, (SELECT count(*) FROM lineitem) AS total_rows
       FROM lineitem ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey LIMIT 50""",
)
def row_cap_with_total(spark, sf):
    items = read_parquet(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"
    )
    return gateway.preview(items.orderBy("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"))


@plan(
    "substring_search_parts", "F3",
    """SELECT * FROM part WHERE contains(lower(p_name), 'ring') OR contains(lower(p_brand), 'ring')
         OR contains(lower(p_type), 'ring')""",
)
def substring_search_parts(spark, sf):
    return read_parquet(spark, sf, "part").filter(contains_text(["p_name", "p_brand", "p_type"], "RING"))


@plan(
    "documents_of_package", "F5",
    "SELECT doc_id, lang, source FROM documents WHERE source = 'src7' AND lang = 'en'",
)
def documents_of_package(spark, sf):
    return read_parquet(spark, sf, "documents").filter("source = 'src7' AND lang = 'en'").select("doc_id", "lang", "source")


@plan("unfinished_orders", "F6", "SELECT * FROM orders WHERE o_orderstatus IN ('O', 'P')")
def unfinished_orders(spark, sf):
    return read_parquet(spark, sf, "orders").filter(status.unfinished("o_orderstatus", ("O", "P")))


@plan(
    "due_schedules", "F7",
    """SELECT o_orderkey, o_orderstatus, o_orderdate FROM orders
       WHERE o_orderpriority <> '5-LOW' AND (o_orderstatus = 'F' OR o_orderdate <= TIMESTAMP '2000-08-01')""",
)
def due_schedules(spark, sf):
    orders = read_parquet(spark, sf, "orders")
    next_run = F.when(F.col("o_orderstatus") != "F", F.col("o_orderdate"))
    return orders.filter(status.due(F.col("o_orderpriority") != "5-LOW", next_run, datetime(2000, 8, 1))).select(
        "o_orderkey", "o_orderstatus", "o_orderdate"
    )


@plan(
    "stale_jobs", "F8",
    """SELECT event_id, event_type, ts FROM events
       WHERE event_type IN ('signup', 'view') AND TIMESTAMP '2024-01-15' - ts > INTERVAL 120 SECOND""",
)
def stale_jobs(spark, sf):
    stale = status.stale("event_type", "ts", datetime(2024, 1, 15), states=("signup", "view"))
    return read_parquet(spark, sf, "events").filter(stale).select("event_id", "event_type", "ts")


@plan("session_list_without_bodies", "F11", "SELECT conv_id, turn, role FROM conversations")
def session_list_without_bodies(spark, sf):
    return read_parquet(spark, sf, "conversations").select("conv_id", "turn", "role")


@plan("events_of_real_users", "F12", "SELECT * FROM events WHERE user_id <> 0")
def events_of_real_users(spark, sf):
    return read_parquet(spark, sf, "events").filter(F.col("user_id") != 0)


@plan("user_messages", "F16", "SELECT conv_id, turn, text FROM conversations WHERE role = 'user'")
def user_messages(spark, sf):
    return read_parquet(spark, sf, "conversations").filter("role = 'user'").select("conv_id", "turn", "text")


@plan(
    "score_gate", "F15",
    """SELECT doc_id, quality + toxic * 2 AS score, quality + toxic * 2 >= 1 AS passes FROM labels
       WHERE quality + toxic * 2 BETWEEN 0 AND 2""",
)
def score_gate(spark, sf):
    scored = read_parquet(spark, sf, "labels").select("doc_id", (F.col("quality") + F.col("toxic") * 2).alias("score"))
    return catalogs.score_gate(scored, "score", 0, 2, 1)


@plan(
    "config_validation", "F14",
    """SELECT doc_id, CASE
         WHEN lang = 'de' THEN 'Missing required field: name'
         WHEN source = 'src1' THEN 'Missing required field: description'
         WHEN n_chars < 200 THEN 'Missing or invalid required field: resources (must be a non-empty array)'
         WHEN lang = 'es' THEN 'Invalid resource at index 1: missing required field ''name''' END AS problem
       FROM documents""",
)
def config_validation(spark, sf):
    docs = read_parquet(spark, sf, "documents")
    second = F.when(F.col("lang") != "es", F.lit("Event")).otherwise("")
    resources = F.when(F.col("n_chars") < 200, F.array().cast("array<string>")).otherwise(F.array(F.lit("Message"), second))
    problem = catalogs.first_broken_rule(
        F.when(F.col("lang") != "de", F.col("lang")), F.when(F.col("source") == "src1", "").otherwise(F.col("source")), resources
    )
    return docs.select("doc_id", problem.alias("problem"))


@plan(
    "connected_customers", "F4",
    "SELECT doc_id, true AS is_connected FROM documents d WHERE EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)",
)
def connected_customers(spark, sf):
    """Documents that have a label, as those of a catalog whose status says so."""
    labelled = read_parquet(spark, sf, "labels").select("doc_id").distinct().withColumn("is_connected", F.lit(True))
    all_status = catalogs.with_status(
        read_parquet(spark, sf, "documents").select("doc_id"), labelled, "doc_id", {"is_connected": False})
    return all_status.filter("is_connected")


@plan("orders_newest_first", "L1", "SELECT * FROM orders ORDER BY o_orderdate DESC, o_orderkey")
def orders_newest_first(spark, sf):
    return read_parquet(spark, sf, "orders").orderBy(F.col("o_orderdate").desc(), "o_orderkey")


@plan("second_page_of_parts", "L2", "SELECT * FROM part ORDER BY p_name, p_partkey LIMIT 20 OFFSET 20")
def second_page_of_parts(spark, sf):
    return read_parquet(spark, sf, "part").orderBy("p_name", "p_partkey").offset(20).limit(20)


@plan(
    "page_after_key", "L2",
    """SELECT * FROM part WHERE p_name > 'red ring' OR (p_name = 'red ring' AND p_partkey > 100)
       ORDER BY p_name, p_partkey LIMIT 20""",
)
def page_after_key(spark, sf):
    # Deep pages: go on after the last key seen instead of counting rows again.
    after = (F.col("p_name") > "red ring") | ((F.col("p_name") == "red ring") & (F.col("p_partkey") > 100))
    return read_parquet(spark, sf, "part").filter(after).orderBy("p_name", "p_partkey").limit(20)


@plan(
    "dearest_parts", "L4",
    "SELECT * FROM part ORDER BY p_retailprice DESC, p_partkey LIMIT 10",
)
def dearest_parts(spark, sf):
    return read_parquet(spark, sf, "part").orderBy(F.col("p_retailprice").desc(), "p_partkey").limit(10)


@plan(
    "first_documents_by_package", "L5",
    "SELECT source, lang, doc_id FROM documents ORDER BY source, lang, doc_id LIMIT 10",
)
def first_documents_by_package(spark, sf):
    return read_parquet(spark, sf, "documents").orderBy("source", "lang", "doc_id").select("source", "lang", "doc_id").limit(10)


@plan(
    "combined_catalog", "U1",
    """SELECT 'customer' AS kind, c_custkey AS id, c_name AS name FROM customer
       UNION ALL SELECT 'supplier', s_suppkey, s_name FROM supplier""",
)
def combined_catalog(spark, sf):
    customers = read_parquet(spark, sf, "customer").select(
        F.lit("customer").alias("kind"), F.col("c_custkey").alias("id"), F.col("c_name").alias("name"))
    suppliers = read_parquet(spark, sf, "supplier").select(
        F.lit("supplier").alias("kind"), F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"))
    return customers.unionByName(suppliers)


@plan(
    "bundled_before_stored", "U2",
    """SELECT coalesce(s.id, c.id) AS id, coalesce(s.name, c.name) AS name FROM (
         SELECT s_nationkey AS id, max_by(s_name, s_suppkey) AS name FROM supplier GROUP BY 1) s
       FULL JOIN (SELECT c_nationkey AS id, max_by(c_name, c_custkey) AS name FROM customer GROUP BY 1
         UNION ALL SELECT 1000 + c_nationkey, max_by(c_name, c_custkey) FROM customer GROUP BY 1) c ON s.id = c.id""",
)
def bundled_before_stored(spark, sf):
    bundled = read_parquet(spark, sf, "supplier").select(
        F.col("s_nationkey").alias("id"), F.col("s_name").alias("name"), F.col("s_suppkey").alias("seq"))
    stored = read_parquet(spark, sf, "customer").select(
        F.col("c_nationkey").alias("id"), F.col("c_name").alias("name"), F.col("c_custkey").alias("seq"))
    stored = stored.unionByName(stored.withColumn("id", F.col("id") + 1000))
    return catalogs.with_precedence(bundled, stored, "id", "seq").select("id", "name")


@plan(
    "conflicting_keys", "U5",
    """SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderstatus = 'F' AND o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R')""",
)
def conflicting_keys(spark, sf):
    existing = read_parquet(spark, sf, "lineitem").filter("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey"))
    incoming = read_parquet(spark, sf, "orders").filter("o_orderstatus = 'F'").select("o_orderkey", "o_orderstatus")
    return catalogs.conflicts(existing, incoming, ["o_orderkey"])


def _buyers(spark, sf, year):
    return read_parquet(spark, sf, "orders").filter(
        f"o_orderdate >= timestamp_ntz'{year}-01-01' AND o_orderdate < timestamp_ntz'{year + 1}-01-01'"
    ).select("o_custkey")


_BUYERS = "SELECT o_custkey FROM orders WHERE o_orderdate >= TIMESTAMP '{0}-01-01' AND o_orderdate < TIMESTAMP '{1}-01-01'"


@plan("buyers_of_both_years", "U6", f"{_BUYERS.format(1999, 2000)} INTERSECT {_BUYERS.format(2000, 2001)}")
def buyers_of_both_years(spark, sf):
    return _buyers(spark, sf, 1999).intersect(_buyers(spark, sf, 2000))


@plan("lost_buyers", "U6", f"{_BUYERS.format(1999, 2000)} EXCEPT {_BUYERS.format(2000, 2001)}")
def lost_buyers(spark, sf):
    return _buyers(spark, sf, 1999).subtract(_buyers(spark, sf, 2000))


@plan("repeat_purchases_left", "U6", f"{_BUYERS.format(1999, 2000)} EXCEPT ALL {_BUYERS.format(2000, 2001)}")
def repeat_purchases_left(spark, sf):
    return _buyers(spark, sf, 1999).exceptAll(_buyers(spark, sf, 2000))
