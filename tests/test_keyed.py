from datetime import datetime

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millpond.functions.dates import clean_date, clean_timestamp
from millpond.operators import keyed, naming


def test_key_is_configured_or_common():
    assert keyed.find_key(["a", "b"], ("b",)) == ["b"]
    assert keyed.find_key(["a", "b", "c"], ("b", "c")) == ["b", "c"]
    for name in ("id", "uuid", "guid"):
        assert keyed.find_key([name, "name"]) == [name]
    with pytest.raises(ValueError, match="No ID field found in schema"):
        keyed.find_key(["name", "age"])
    with pytest.raises(ValueError, match='"nope" not found'):
        keyed.find_key(["id"], ("nope",))


def test_null_keys_are_split_off(spark, as_rows):
    df = spark.createDataFrame([("1", "a"), (None, "b"), ("2", "c"), (None, "d"), ("3", "e")], "id string, name string")
    assert as_rows(keyed.with_key(df, ["id"]), "id") == [("1",), ("2",), ("3",)]
    rejected = keyed.without_key(df, ["id"])
    assert as_rows(rejected, "name", "reject_reason") == [("b", "null key: id"), ("d", "null key: id")]


def test_bad_dates_become_null(spark):
    values = [
        "2023-01-15T10:00:00.000Z", "0000-12-31T00:00:00.000Z", "0999-12-31T00:00:00.000Z", "10000-01-01T00:00:00.000Z",
        "hello", "", None, "2023-01-15T10:00:00+09:00", "2023-01-15", "10:30:00", "1000-01-01", "9999-12-31",
    ]
    df = spark.createDataFrame([(v,) for v in values], "v string")
    got = [tuple(r) for r in df.select(clean_timestamp("v"), clean_date("v")).collect()]
    ten = datetime(2023, 1, 15, 10)
    assert [g[0] for g in got] == [
        ten, None, None, None, None, None, None, ten, datetime(2023, 1, 15), None, datetime(1000, 1, 1), datetime(9999, 12, 31),
    ]
    assert got[0][1] == ten.date()


def test_one_key_twice_in_a_batch(spark, as_rows):
    base = spark.createDataFrame([(1, "old"), (2, "keep")], "id long, v string")
    delta = spark.createDataFrame([(1, "a", 1), (1, "b", 2), (3, "c", 1)], "id long, v string, seq int")
    want = [(1, "b"), (2, "keep"), (3, "c")]
    once = keyed.merge_by_key(base, delta, ["id"], ["seq"])
    assert as_rows(once) == want
    assert as_rows(keyed.merge_by_key(once, delta, ["id"], ["seq"])) == want
    shuffled = delta.orderBy(F.col("seq").desc())
    assert as_rows(keyed.merge_by_key(base, shuffled, ["id"], ["seq"])) == want


def test_without_a_sequence_the_choice_does_not_depend_on_order(spark, as_rows):
    base = spark.createDataFrame([(1, "old")], "id long, v string")
    delta = spark.createDataFrame([(1, c) for c in "abcdefgh"] + [(2, "x"), (2, "x")], "id long, v string")
    one = as_rows(keyed.merge_by_key(base, delta, ["id"]))
    assert len(one) == 2 and one == as_rows(keyed.merge_by_key(base, delta.orderBy(F.col("v").desc()).coalesce(1), ["id"]))


def test_removed_rows_are_deleted(spark, as_rows):
    base = spark.createDataFrame([(1, "a"), (2, "b")], "id long, v string")
    delta = spark.createDataFrame(
        [(1, None, "removed", 5), (2, "x", "modified", 5), (3, "y", "added", 5), (4, "z", "added", 1), (4, None, "removed", 2)],
        "id long, v string, op string, seq int")
    assert as_rows(keyed.merge_by_key(base, delta, ["id"], ["seq"], op="op")) == [(2, "x"), (3, "y")]


def test_composite_key(spark, as_rows):
    base = spark.createDataFrame([(1, 1, "a"), (1, 2, "b")], "o long, l long, v string")
    delta = spark.createDataFrame([(1, 2, "new")], "o long, l long, v string")
    assert as_rows(keyed.merge_by_key(base, delta, ["o", "l"])) == [(1, 1, "a"), (1, 2, "new")]


def test_incremental_merge_equals_full_load(spark, as_rows):
    full = spark.range(200).select("id", (F.col("id") % 7).alias("v"))
    first = full.filter("id < 150").withColumn("v", F.when(F.col("id") < 20, -1).otherwise(F.col("v")))
    second = full.filter("id < 20 OR id >= 140")
    assert as_rows(keyed.merge_by_key(first, second, ["id"])) == as_rows(full)


def test_partial_update_changes_only_given_fields(spark, as_rows):
    base = spark.createDataFrame([("a", True, 1), ("b", False, 2)], "id string, connected boolean, pos long")
    delta = spark.createDataFrame(
        [("a", "pos", None, 10, 1), ("a", "pos", None, 20, 2), ("b", "connected", None, 99, 1), ("c", "pos", None, 5, 1)],
        "id string, what string, connected boolean, pos long, seq int")
    masks = {"connected": F.col("what") == "connected", "pos": F.col("what") == "pos"}
    got = keyed.update_fields(base, delta, ["id"], "seq", masks)
    assert as_rows(got) == [("a", True, 20), ("b", None, 2), ("c", None, 5)]


def test_big_integers_survive(spark, keyed_table, as_rows):
    t = keyed_table("id long, n long", ["id"])
    t.upsert(spark.createDataFrame([(1, 2**53 + 1)], "id long, n long"))
    assert as_rows(t.read()) == [(1, 2**53 + 1)]


def test_declared_columns_only(spark):
    df = spark.createDataFrame([(1, "x", "extra")], "id long, name string, other string")
    schema = T.StructType.fromDDL("id long, name string, missing double")
    assert keyed.project_declared(df, schema).collect() == [(1, "x", None)]
    assert keyed.project_declared(df, schema).schema.simpleString() == "struct<id:bigint,name:string,missing:double>"


def test_nested_values_as_json(spark):
    df = spark.sql("SELECT 1 AS id, named_struct('a', 1, 'b', array('x')) AS s, map('k', 2) AS m, array(1, 2) AS l")
    assert tuple(keyed.nested_to_json(df).first()) == (1, '{"a":1,"b":["x"]}', '{"k":2}', "[1,2]")


def test_reserved_names(spark):
    names = ["id", "select", "from", "where", "order", "group", "name"]
    assert list(naming.safe_names(names).values()) == ["id", "select_col", "from_col", "where_col", "order_col", "group_col", "name"]
    assert list(naming.safe_names(["SELECT", "From", "where"]).values()) == ["SELECT_col", "From_col", "where_col"]
    assert naming.safe_name("end") == "end_col" and naming.safe_name("sequence") == "sequence_col"
    assert naming.safe_name("location") == "location"
    assert naming.safe_name("koi8r", reserved=frozenset({"koi8r"})) == "koi8r_col"
    assert naming.safe_name("lateral", naming.reserved_words(spark)) == "lateral_col"
    with pytest.raises(ValueError, match="both become"):
        naming.safe_names(["select", "select_col"])


def test_reserved_data_keeps_its_values(spark):
    df = spark.createDataFrame([("1", "value1"), ("2", "value2")], "id string, `select` string")
    out = naming.rename_reserved(df)
    assert out.columns == ["id", "select_col"]
    assert [r.select_col for r in out.orderBy("id").collect()] == ["value1", "value2"]


def test_schema_difference():
    old, new = T.StructType().add("a", "long").add("b", "string"), T.StructType().add("a", "double").add("c", "string")
    change = naming.schema_change(old, new)
    assert (change.added, change.retyped, change.missing) == (("c",), ("a",), ("b",))
    assert naming.schema_change(old, old).is_empty()
    assert naming.evolved_schema(old, new).fieldNames() == ["a", "c", "b"]
    assert naming.evolved_schema(old, new, allow_drop=True).fieldNames() == ["a", "c"]


def test_written_forms_of_dates(spark):
    from millpond.functions.dates import parse_datetime

    evening = datetime(2026, 12, 1, 20, 45)
    forms = [
        ("Tue, 01 Dec 2026 20:45:00 GMT", evening, evening), ("Tue, 1 Dec 2026 20:45:00 +0900", evening, datetime(2026, 12, 1, 11, 45)),
        ("Jan 5, 2024 3:04 PM", datetime(2024, 1, 5, 15, 4), datetime(2024, 1, 5, 15, 4)), ("1/5/2024 3:04 PM", datetime(2024, 1, 5, 15, 4), datetime(2024, 1, 5, 15, 4)),
        ("1/5/2024, 3:04:05 AM", datetime(2024, 1, 5, 3, 4, 5), datetime(2024, 1, 5, 3, 4, 5)), ("2024/01/05", datetime(2024, 1, 5), datetime(2024, 1, 5)),
        ("January 5, 2024 13:04:05", datetime(2024, 1, 5, 13, 4, 5), datetime(2024, 1, 5, 13, 4, 5)), ("5 May 2024", datetime(2024, 5, 5), datetime(2024, 5, 5)),
        ("20240105", None, datetime(2024, 1, 5)), ("Foo 5, 2024", None, None), ("13/45/2024", None, None), ("12345678901", None, None),
    ]
    df = spark.createDataFrame([(f,) for f, _, _ in forms], "v string")
    assert [tuple(r) for r in df.select(clean_timestamp("v"), parse_datetime("v")).collect()] == [(a, b) for _, a, b in forms]


def test_ties_of_a_sequence_do_not_depend_on_arrival(spark, as_rows):
    rows = spark.createDataFrame([(1, v, 1) for v in "abcdef"], "id long, v string, u int")
    assert as_rows(keyed.latest_per_key(rows, ["id"], ["u"])) == as_rows(keyed.latest_per_key(rows.orderBy(F.col("v").desc()).coalesce(1), ["id"], ["u"]))


def test_field_updates_add_new_keys(spark, as_rows):
    base = spark.createDataFrame([(1, "a", "x")], "id long, v string, w string")
    delta = spark.createDataFrame([(1, "b", 1), (2, "c", 1)], "id long, v string, s int")
    got = keyed.update_fields(base, delta, ["id"], "s", {"v": F.col("v").isNotNull()})
    assert as_rows(got) == [(1, "b", "x"), (2, "c", None)]
    assert "FullOuter" not in got._jdf.queryExecution().toString()
