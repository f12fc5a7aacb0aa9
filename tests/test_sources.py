import json
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millpond.model import Resource
from millpond.operators import status
from millpond.sources import feeds, specs, tables
from millpond.sources.paged import SourceRegistry, paged_source

AS_OF = datetime(2024, 1, 20)


def dated(spark):
    return spark.createDataFrame(
        [(1, datetime(2023, 1, 1)), (2, datetime(2023, 1, 2)), (3, None), (4, datetime(2022, 12, 30))], "id long, updated_at timestamp_ntz")


def ids(df):
    return sorted(r.id for r in df.collect())


def test_incremental_is_strictly_newer(spark):
    since = datetime(2023, 1, 1)
    r = Resource("users")
    assert ids(tables.incremental(dated(spark), r, since)) == [2]
    assert ids(tables.incremental(dated(spark), r, None)) == [1, 2, 3, 4]
    assert ids(tables.incremental(dated(spark), r, since, with_undated=True)) == [2, 3]
    assert ids(tables.incremental(dated(spark), r, since, overlap=timedelta(days=3))) == [1, 2, 4]
    assert ids(tables.incremental(dated(spark).drop("updated_at"), r, since)) == [1, 2, 3, 4]


def test_sync_column_order():
    schema = T.StructType().add("created_at", "timestamp_ntz").add("updated_at", "timestamp_ntz").add("mine", "timestamp_ntz")
    assert tables.sync_column(schema, Resource("r", updated_at="mine", created_at="created_at")) == "mine"
    assert tables.sync_column(schema, Resource("r", created_at="created_at")) == "created_at"
    assert tables.sync_column(schema, Resource("r")) == "updated_at"
    assert tables.sync_column(T.StructType().add("x", "long"), Resource("r")) is None


def test_jdbc_options():
    options = tables.jdbc_options("jdbc:x", "public.users", "id", (0, 1000), 8, user="u")
    assert options["partitionColumn"] == "id" and options["numPartitions"] == "8" and options["user"] == "u"
    assert "partitionColumn" not in tables.jdbc_options("jdbc:x", "t")
    with pytest.raises(ValueError, match="needs its lower and upper bound"):
        tables.jdbc_options("jdbc:x", "t", "id")


def test_high_water_mark_never_goes_back(spark):
    stored = datetime(2024, 1, 1)
    mark = lambda df: status.high_water_mark(df, "updated_at", stored).first()[0]
    assert mark(dated(spark)) == stored
    assert mark(dated(spark).limit(0)) == stored
    assert status.high_water_mark(dated(spark), "updated_at").first()[0] == datetime(2023, 1, 2)


SPEC = {
    "components": {
        "schemas": {
            "Event": {"type": "object", "properties": {
                "id": {"type": "string", "description": "Identifier"}, "title": {"type": "string"},
                "createdAt": {"type": "string", "format": "date-time"}, "day": {"type": "string", "format": "date"},
                "endTimeUnspecified": {"type": "boolean"}, "sentDate": {"type": "string"}, "size": {"type": "integer"},
                "price": {"type": "number"}, "tags": {"type": "array", "items": {"type": "string"}},
                "extra": {"type": "object", "additionalProperties": {"type": "integer"}}, "any": {"type": "object"},
                "start": {"$ref": "#/components/schemas/When"}, "loop": {"$ref": "#/components/schemas/Node"}}, "required": ["id"]},
            "When": {"type": "object", "properties": {"date": {"type": "string", "format": "date"}, "zone": {"type": "string"}}},
            "Node": {"type": "object", "properties": {"next": {"$ref": "#/components/schemas/Node"}}},
            "Base": {"type": "object", "properties": {"id": {"type": "string"}}, "required": ["id"]},
            "Titled": {"title": "Pretty", "allOf": [{"$ref": "#/components/schemas/Base"}, {"properties": {"name": {"type": "string"}, "timestamp": {"type": "string", "format": "date-time"}}, "required": ["id", "name"]}]},
        }
    }
}


def test_spec_schema():
    assert specs.resource_names(SPEC) == ["Event", "When", "Node", "Base", "Titled"]
    schema = specs.resource_schema(SPEC, "Event")
    types = {f.name: f.dataType.simpleString() for f in schema.fields}
    assert types["createdAt"] == "timestamp_ntz" and types["day"] == "date" and types["size"] == "bigint"
    assert types["price"] == "decimal(38,10)" and types["tags"] == "array<string>" and types["extra"] == "map<string,bigint>"
    assert types["any"] == "variant" and types["start"] == "struct<date:date,zone:string>"
    assert types["loop"] == "struct<next:string>"  # what refers to itself is text
    assert schema["id"].metadata["comment"] == "Identifier"
    assert specs.time_columns(SPEC, "Event") == ["createdAt", "day", "sentDate"]
    assert specs.resource_schema(SPEC, "Nothing").fieldNames() == []


def test_merged_spec_keeps_base_columns():
    assert specs.resource_schema(SPEC, "Pretty").fieldNames() == ["id", "name", "timestamp"]
    assert specs.required_columns(SPEC, "Titled") == ["id", "name"]
    assert specs.time_columns(SPEC, "Titled") == ["timestamp"]


def test_pages_from_landed_files(spark, tmp_path):
    for n, (count, token) in enumerate([(3, "a"), (3, "b"), (1, None)]):
        items = [{"id": f"{n}-{i}", "kind": "x", "snippet": {"title": "t", "publishedAt": f"2024-01-1{i}T00:00:00Z"}} for i in range(count)]
        (tmp_path / f"{n}.json").write_text(json.dumps({"items": items, "nextPageToken": token}, indent=1))
    pages = spark.read.text(str(tmp_path), wholetext=True).toDF("page")
    assert feeds.page_items(pages, "page", feeds.ACTIVITY_ITEM).count() == 7
    more = feeds.page_completeness(pages, "page", [], 3).collect()
    assert sorted((r["items"], r.has_more) for r in more) == [(1, False), (3, True), (3, True)]
    recent = feeds.channel_activities(feeds.page_items(pages, "page", feeds.ACTIVITY_ITEM), AS_OF, datetime(2024, 1, 11))
    assert sorted(r.id for r in recent.collect()) == ["0-2", "1-2"]


def test_calendar_window(spark):
    def event(i, start, updated, status_="confirmed", end=None):
        return {"id": i, "status": status_, "updated": updated, "start": {"dateTime": start}, "end": {"dateTime": end or start.replace("T10", "T11")}}

    items = [
        event("old", "2022-01-01T10:00:00Z", "2024-01-19T00:00:00Z"), event("future", "2024-02-01T10:00:00Z", "2024-01-19T00:00:00Z"),
        event("now", "2024-01-10T10:00:00Z", "2024-01-19T00:00:00Z", "cancelled"), event("stale", "2024-01-10T10:00:00Z", "2024-01-01T00:00:00Z"),
        {"id": "gone", "status": "cancelled"},
        {"id": "day", "status": "confirmed", "updated": "2024-01-19T00:00:00Z", "start": {"date": "2024-01-05"}, "end": {"date": "2024-01-06"}},
    ]
    pages = spark.createDataFrame([(json.dumps({"items": items}),)], "page string")
    events = feeds.page_items(pages, "page", feeds.CALENDAR_ITEM)
    got = {r.id: r.is_deleted for r in feeds.calendar_events(events, AS_OF, datetime(2024, 1, 15)).collect()}
    assert got == {"now": True, "day": False, "gone": True}
    assert {r.id for r in feeds.calendar_events(events, AS_OF).collect()} == {"now", "day", "stale", "gone"}


def test_mail_bound_and_failed_details(spark):
    at = lambda d: str(int((d - datetime(1970, 1, 1)).total_seconds() * 1000))
    listed = spark.createDataFrame([("1",), ("2",), ("3",), (None,)], "id string")
    details = spark.createDataFrame([("1", at(datetime(2024, 1, 19))), ("2", at(datetime(2022, 1, 1)))], "id string, internalDate string")
    got = feeds.mail_messages(listed, details, AS_OF).collect()
    assert [(r.id, r.received) for r in got] == [("1", datetime(2024, 1, 19))]


def test_change_feed_order_within_a_page(spark):
    from millpond.operators.keyed import merge_by_key

    item = "id string, amount double"
    page = lambda **kw: json.dumps(kw)
    pages = spark.createDataFrame([
        (0, page(added=[{"id": "a", "amount": 1.0}, {"id": "b", "amount": 1.0}], modified=[{"id": "a", "amount": 2.0}], removed=[])),
        (1, page(added=[], modified=[], removed=[{"id": "b"}])),
    ], "seq long, page string")
    changes = feeds.change_rows(pages, "page", "seq", item)
    base = spark.createDataFrame([("c", 9.0)], "id string, amount double")
    got = merge_by_key(base, changes, ["id"], ["change_seq", "change_pos"], op="op")
    assert sorted(tuple(r) for r in got.collect()) == [("a", 2.0), ("c", 9.0)]


def test_split_and_undeclared(spark):
    df = spark.createDataFrame([("users", 1), ("users", 2), ("products", 3), ("junk", 4), (None, 5)], "resource string, id long")
    parts = feeds.split_by_resource(df, "resource", ["users", "products"])
    assert {k: v.count() for k, v in parts.items()} == {"users": 2, "products": 1}
    assert {r.resource: r.skipped for r in feeds.undeclared(df, "resource", ["users", "products"]).collect()} == {"junk": 1, None: 1}


def test_paged_source(spark):
    def fetch(context):
        size = {"a": 5, "b": 3}[context["slice"]]
        first = context["page"] * 2
        rows = [{"slice": context["slice"], "n": i, "since": context["since"]} for i in range(first, min(first + 2, size))]
        return rows, first + 2 < size

    sources = SourceRegistry(spark)
    sources.register(paged_source("numbers_api", "slice string, n long, since string", fetch, ["slice", "n", "since"]))
    sources.register(paged_source("hidden_api", "n long", fetch, ["n"]), hidden=True)
    assert sources.names() == ["numbers_api"]
    df = sources.read("numbers_api", slices='["a", "b"]', since="2024-01-01")
    assert df.rdd.getNumPartitions() == 2
    assert {r.slice: r["count"] for r in df.groupBy("slice").count().collect()} == {"a": 5, "b": 3}
    assert {r.since for r in df.select("since").distinct().collect()} == {"2024-01-01"}
    assert sources.read("hidden_api", slices='["b"]').count() == 3
    with pytest.raises(KeyError, match="unknown source"):
        sources.read("nope")


def test_catalog_operators(spark):
    from millpond.operators import catalogs

    configs = spark.createDataFrame([("a",), ("b",)], "id string")
    state = spark.createDataFrame([("a", True, None)], "id string, is_connected boolean, last string")
    got = catalogs.with_status(configs, state, "id", {"is_connected": False, "last": None}).orderBy("id").collect()
    assert [tuple(r) for r in got] == [("a", True, None), ("b", False, None)]
    bundled = spark.createDataFrame([("x", "first", 0), ("x", "second", 1)], "id string, name string, seq int")
    stored = spark.createDataFrame([("x", "stored", 5), ("y", "mine", 0)], "id string, name string, seq int")
    got = catalogs.with_precedence(bundled, stored, "id", "seq").orderBy("id").collect()
    assert [(r.id, r.name) for r in got] == [("x", "second"), ("y", "mine")]
    assert [r.id for r in catalogs.conflicts(bundled, stored, ["id"]).collect()] == ["x"]
    rules = spark.createDataFrame(
        [(None, "d", ["r"]), ("n", "", ["r"]), ("n", "d", []), ("n", "d", None), ("n", "d", ["r", ""]), ("n", "d", ["r", None]), ("n", "d", ["r"])],
        "name string, description string, resources array<string>")
    got = [r[0] for r in rules.select(catalogs.first_broken_rule(F.col("name"), F.col("description"), F.col("resources"))).collect()]
    bad = "Missing or invalid required field: resources (must be a non-empty array)"
    second = "Invalid resource at index 1: missing required field 'name'"
    assert got == ["Missing required field: name", "Missing required field: description", bad, bad, second, second, None]
    scores = spark.createDataFrame([(0.5,), (0.9,), (1.5,), (float("nan"),), (None,)], "score double")
    got = [(r.score, r.passes) for r in catalogs.score_gate(scores, "score", 0, 1, 0.7).orderBy("score").collect()]
    assert got == [(0.5, False), (0.9, True)]


def test_job_state(spark):
    t = lambda m: datetime(2024, 1, 1, 12) - timedelta(minutes=m)
    jobs = spark.createDataFrame(
        [("1", "c", "running", t(1), 100), ("2", "c", "created", t(3), 100), ("3", "c", "finished", t(9), 50), ("4", "d", "running", t(2), 7)],
        "id string, connector string, state string, updated timestamp_ntz, rows long")
    assert ids(jobs.filter(status.stale("state", "updated", t(0)))) == ["2"]
    assert [r.id for r in status.latest_job(jobs, "connector", "updated", "id").orderBy("connector").collect()] == ["1", "4"]
    assert {r.connector: r.rows_written for r in status.run_totals(jobs, "connector", "rows").collect()} == {"c": 250, "d": 7}
    pulses = spark.createDataFrame([(True, None), (True, t(1)), (True, t(0)), (True, t(-1)), (False, None)], "enabled boolean, next_run timestamp_ntz")
    assert pulses.filter(status.due("enabled", "next_run", t(0))).count() == 3


def test_accounts_of_a_transaction_feed(spark):
    from decimal import Decimal

    pages = [
        (0, '{"accounts": [{"account_id": "a", "name": "Old", "type": "depository", "subtype": "checking", "mask": "01", "balances": {"available": 1.5, "current": 100.10, "iso_currency_code": "USD"}}, {"name": "no id"}]}'),
        (1, '{"accounts": [{"account_id": "a", "name": "New", "official_name": "Official", "balances": {"current": 7, "limit": 50}}, {"account_id": "b", "balances": null}]}'),
        (2, '{"accounts": []}'), (3, "{broken"), (4, None),
    ]
    rows = {r.account_id: r for r in feeds.account_rows(spark.createDataFrame(pages, "seq int, page string"), "page", "seq").collect()}
    assert set(rows) == {"a", "b"} and rows["a"].name == "Official" and rows["a"].subtype is None
    assert rows["a"].current == Decimal(7) and rows["a"].credit_limit == Decimal(50) and rows["a"].available is None and rows["b"].current is None
