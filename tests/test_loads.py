"""Typed loads, several tables from one stream, results kept by plan and data."""

from datetime import datetime

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millpond.model import Connector, Resource
from millpond.operators import gateway, typed
from millpond.sources.connectors import ConnectorLoader
from millpond.streaming import loads

SCHEMA = (
    T.StructType().add("id", "long").add("n", "integer", True, {"comment": "a number"}).add("at", "timestamp_ntz").add("day", "date")
    .add("tags", T.ArrayType(T.StringType())).add("detail", "string").add("ok", "boolean").add("lost", "double")
)
ROWS = [
    ("1", "5", "2024-01-02T03:04:05Z", "2024-01-02", '["a","b"]', {"x": 1}, "true"),
    ("2", "five", "2024-01-02T03:04:05Z", "2024-01-02", None, None, None),
    ("3", None, "99999-01-01", "not a day", None, None, "false"),
    (None, "1", None, None, None, None, None),
    ("x", "1", None, None, None, None, None),
    ("4", "7", None, None, "[]", {"x": None}, "maybe"),
]
TEXTS = "id string, n string, at string, day string, tags string, detail struct<x:int>, ok string"


def test_bad_values_are_rejected_and_bad_dates_are_null(spark):
    done = typed.split(spark.createDataFrame(ROWS, TEXTS).withColumn("extra", F.lit("gone")), SCHEMA, ["id"])
    assert (done.accepted, done.rejected, done.bad_dates) == (2, 4, 2)
    rows = {r.id: r for r in done.rows.collect()}
    assert done.rows.schema.names == SCHEMA.names and set(rows) == {1, 3}
    assert rows[1][1:] == (5, datetime(2024, 1, 2, 3, 4, 5), datetime(2024, 1, 2).date(), ["a", "b"], '{"x":1}', True, None)
    assert rows[3].at is None and rows[3].day is None and rows[3].ok is False
    assert sorted(r.reject_reason for r in done.rejects.collect()) == ["bad value: id", "bad value: n", "bad value: ok", "null key: id"]
    assert typed.split(spark.createDataFrame([], TEXTS), SCHEMA, ["id"]).accepted == 0


def test_a_declared_schema_reaches_the_table(spark, tmp_path):
    shop = Connector(f"typed.{tmp_path.name}", "Shop", "d", (Resource("things", ("id",)),))
    loader = ConnectorLoader(spark, shop, str(tmp_path), buckets=2)
    source = spark.createDataFrame(ROWS, TEXTS)
    first = loader.load(shop.resources[0], source, datetime(2024, 1, 1), schema=SCHEMA)
    assert (first.rows, first.rejected, first.bad_dates) == (2, 4, 2)
    table = spark.table(first.table)
    assert {c.name: c.description for c in spark.catalog.listColumns(first.table)}["n"] == "a number" and table.schema["n"].dataType == T.IntegerType()
    loader.load(shop.resources[0], source.where("id = '2'").withColumn("n", F.lit("6")), datetime(2024, 1, 2), schema=SCHEMA)
    assert sorted(r.id for r in spark.table(first.table).collect()) == [1, 2, 3]
    assert loader.rejects(shop.resources[0], SCHEMA).count() == 4
    loader.disconnect()


def test_a_batch_that_dies_between_two_tables_is_finished_by_the_next_run(spark, keyed_table, tmp_path, monkeypatch, as_rows):
    rows = spark.range(90).select("id", F.element_at(F.array(*map(F.lit, ["a", "b", "c"])), (F.col("id") % 3 + 1).cast("int")).alias("kind"))
    rows.write.parquet(str(tmp_path / "in"))
    tables = {n: keyed_table("id long, kind string", ["id"], name=f"t_{n}") for n in ("a", "b")}
    log = keyed_table(loads.TAG_LOG, ["run", "batch", "tag"], name="log")
    start = lambda: loads.upsert_many(loads.file_stream(spark, str(tmp_path / "in"), rows.schema), "kind", tables, str(tmp_path / "batches"), str(tmp_path / "checkpoint"), log=log, run="r")
    calls = []
    with monkeypatch.context() as m:
        own = type(tables["b"]).upsert

        def fails(self, *args, **how):
            calls.append(self.name)
            if self.name.endswith("t_b"):
                raise OSError("lost")
            return own(self, *args, **how)

        m.setattr(type(tables["b"]), "upsert", fails)
        with pytest.raises(Exception, match="lost"):
            start().awaitTermination()
    assert tables["a"].read().count() == 30 and tables["b"].read().count() == 0
    versions = tables["a"]._state().versions
    start().awaitTermination()
    assert tables["a"]._state().versions == versions and tables["b"].read().count() == 30
    assert sorted((r.tag, r.rows, r.declared) for r in log.read().collect()) == [("a", 30, True), ("b", 30, True), ("c", 30, False)]


def test_results_are_kept_by_meaning_and_until_the_next_load(spark, keyed_table, tmp_path):
    t = keyed_table("id long, v string", ["id"])
    t.upsert(spark.createDataFrame([(1, "a")], "id long, v string"))
    cache = gateway.ResultCache(spark)
    first = cache.run(f"SELECT id, v FROM {t.name} WHERE id > 0")
    assert cache.run(f"select  id , v\nfrom {t.name} as x where (x.id > 0) -- same") is first
    assert cache.run(f"SELECT id, v FROM {t.name} WHERE id > 1") is not first
    assert cache.run(f"SELECT id, v AS w FROM {t.name} WHERE id > 0").columns[1] == "w"
    t.upsert(spark.createDataFrame([(2, "b")], "id long, v string"))
    assert cache.run(f"SELECT id, v FROM {t.name} WHERE id > 0").count() == 2
    path = str(tmp_path / "files")
    spark.range(3).write.parquet(path)
    assert cache.run(f"SELECT * FROM parquet.`{path}`").count() == 3
    spark.range(5).write.mode("append").parquet(path)
    assert cache.run(f"SELECT * FROM parquet.`{path}`").count() == 8
