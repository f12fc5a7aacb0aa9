"""How the queries are carried out: what is pushed down, shuffled, broadcast and kept inside the JVM."""

import io
import re
from contextlib import redirect_stdout

import pytest
from pyspark.sql import functions as F

from millpond.operators import keyed
from millpond.plans import PLANS, load_all

load_all()
WRITES = {n for n in PLANS if n.startswith("streamed_")} | {
    "upsert_customers_table", "indexed_search", "report_store", "orders_loaded_in_two_steps"
}


def explain(df):
    out = io.StringIO()
    with redirect_stdout(out):
        df.explain("formatted")
    return out.getvalue()


@pytest.mark.parametrize("name", sorted(set(PLANS) - WRITES))
def test_no_pairs_no_python_no_single_task(spark, small, name):
    text = explain(PLANS[name](spark, small))
    for bad in ("CartesianProduct", "BroadcastNestedLoopJoin", "ArrowEvalPython", "BatchEvalPython", "MapInPandas", "FlatMapGroupsInPandas"):
        assert bad not in text, f"{bad} in the plan of {name}"
    if name != "spending_trend":  # its window has the weeks of one quarter, already summed
        # A definition that starts with an ordering has no partition: one task would get every row.
        assert not re.search(r"windowspecdefinition\(\S+ (ASC|DESC)", text), f"window without a partition in {name}"


@pytest.mark.parametrize(
    "name, pushed",
    [
        ("incremental_orders", "GreaterThan(o_orderdate,2001-01-01"), ("first_load_look_back", "GreaterThanOrEqual(o_orderdate,2000-08-01"),
        ("unfinished_orders", "In(o_orderstatus, [O,P])"), ("documents_of_package", "EqualTo(source,src7)"),
        ("events_of_real_users", "Not(EqualTo(user_id,0))"), ("spend_of_past_quarter", "LessThan(o_orderdate,2001-07-01"),
        ("user_messages", "EqualTo(role,user)"), ("stale_jobs", "LessThan(ts,2024-01-14T23:58"),
    ],
)
def test_filters_reach_the_scan(spark, small, name, pushed):
    lines = [line for line in explain(PLANS[name](spark, small)).splitlines() if "PushedFilters" in line]
    assert any(pushed in line for line in lines), lines


@pytest.mark.parametrize(
    "name, columns",
    [
        ("session_list_without_bodies", "struct<conv_id:bigint,turn:bigint,role:string>"),
        ("top_senders", "struct<user_id:bigint>"), ("type_pie", "struct<p_type:string>"),
        ("meetings_per_week", "struct<ts:timestamp_ntz,event_type:string>"),
        ("table_freshness", "struct<ts:timestamp_ntz,event_type:string>"),
    ],
)
def test_only_needed_columns_are_read(spark, small, name, columns):
    assert columns in explain(PLANS[name](spark, small))


@pytest.mark.parametrize("name", ["latest_lineitem_per_key", "latest_order_per_customer", "first_message_per_role", "search_packages"])
def test_one_row_per_key_is_cut_before_the_shuffle(spark, small, name):
    text = explain(PLANS[name](spark, small))
    limits = text.split("WindowGroupLimit\n")[1:]
    assert any("Partial" in part for part in limits), text


@pytest.mark.parametrize("name", ["ranked_search", "nearest_vectors", "dearest_parts", "first_documents_by_package"])
def test_top_k_is_distributed(spark, small, name):
    assert "TakeOrderedAndProject" in explain(PLANS[name](spark, small))


@pytest.mark.parametrize("name", ["ranked_search", "nearest_vectors", "matching_lines", "report_summaries", "message_texts", "parsed_dates"])
def test_row_by_row_work_is_not_shuffled(spark, small, name):
    assert "Exchange" not in explain(PLANS[name](spark, small))


def test_merge_does_not_sort_the_base(spark):
    base = spark.range(1000).withColumn("v", F.lit(0))
    delta = spark.range(10).withColumn("v", F.lit(1)).withColumn("seq", F.lit(1))
    text = explain(keyed.merge_by_key(base, delta, ["id"], ["seq"]))
    assert "LeftAnti" in text and text.count("WindowGroupLimit\n") <= 2
