import uuid
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from millpond.model import Connector, Resource
from millpond.operators.status import LOOK_BACK
from millpond.sources.connectors import ConnectorLoader

USERS = Resource("User")
EVENTS = Resource("Event", ("id",), updated_at="updated")
T1, T2, T3 = datetime(2024, 1, 1), datetime(2024, 1, 2), datetime(2024, 1, 3)


@pytest.fixture
def loader(spark, tmp_path):
    connector = Connector(f"test.c-{uuid.uuid4().hex[:8]}", "Test", "A test", (USERS, EVENTS))
    made = ConnectorLoader(spark, connector, str(tmp_path), buckets=2)
    yield made
    made.disconnect()


def events(spark, rows):
    return spark.createDataFrame(rows, "id long, type string, updated timestamp_ntz")


def test_loads_go_on_from_the_position(spark, loader, as_rows):
    first = loader.load(EVENTS, events(spark, [(1, "a", T1), (2, "b", T2), (None, "no key", T1)]), T2)
    assert first.table == f"{loader.database}.event" and first.rows == 2 and first.high_water_mark == T2
    assert spark.table(first.table).drop("_bucket").columns == ["id", "type_col", "updated"]
    # The old row changed without a new time, so it is not seen; the new one is.
    second = loader.load(EVENTS, events(spark, [(1, "changed", T1), (2, "b", T2), (3, "c", T3)]), T3)
    assert (second.rows, second.high_water_mark) == (1, T3)
    assert as_rows(spark.table(first.table), "id", "type_col") == [(1, "a"), (2, "b"), (3, "c")]
    status = loader.table_status.read().first()
    assert (status.table_name, status.last_synced_at, status.rows_written) == ("event", T3, 1)
    # Nothing new: the position stays, the sync time moves, freshness of the table does not.
    later = datetime(2024, 1, 9)
    third = loader.load(EVENTS, events(spark, [(3, "c", T3)]), later)
    assert (third.rows, third.high_water_mark) == (0, T3)
    assert loader.table_status.read().first().last_synced_at == T3
    assert loader.sync_state.read().first().last_synced_at == later


def test_look_back_bounds_the_first_load(spark, loader):
    rows = [(1, "old", datetime(2020, 1, 1)), (2, "new", T1)]
    assert loader.load(EVENTS, events(spark, rows), T2, look_back=LOOK_BACK).rows == 1


def test_a_first_load_takes_everything(spark, loader):
    rows = [(1, "old", datetime(2020, 1, 1)), (2, "new", T1), (3, "undated", None)]
    assert loader.load(EVENTS, events(spark, rows), T2).rows == 3


def test_schema_changes_with_the_source(spark, loader, as_rows):
    loaded = loader.load(EVENTS, events(spark, [(1, "a", T1)]), T1)
    wider = events(spark, [(2, "b", T2)]).withColumn("note", F.lit("n")).drop("type")
    loader.load(EVENTS, wider, T2)
    assert as_rows(spark.table(loaded.table), "id", "type_col", "note") == [(1, "a", None), (2, None, "n")]


def test_deletes_in_a_feed(spark, loader, as_rows):
    feed = spark.createDataFrame(
        [(1, T1, 1, "added"), (2, T1, 1, "added"), (1, T2, 2, "removed")], "id long, updated timestamp_ntz, seq int, op string")
    loaded = loader.load(EVENTS, feed, T2, seq=["seq"], op="op")
    assert as_rows(spark.table(loaded.table), "id") == [(2,)]
    assert "op" not in spark.table(loaded.table).columns


def test_all_resources_and_disconnect(spark, loader):
    users = spark.createDataFrame([("u1", "Alice")], "uuid string, name string")
    got = loader.load_all({"User": users, "Event": events(spark, [(1, "a", T1)]), "Unknown": users}, T1)
    assert {g.table.split(".")[1]: g.rows for g in got} == {"user": 1, "event": 1}
    assert loader.sync_state.read().count() == 2 and loader.table_status.read().count() == 2
    loader.disconnect()
    assert not spark.catalog.databaseExists(loader.database)


def test_a_resource_needs_a_key(spark, loader):
    with pytest.raises(ValueError, match="No ID field found"):
        loader.load(USERS, spark.createDataFrame([("x",)], "name string"), T1)


def test_a_loader_keeps_the_newest_version_of_a_key(spark, tmp_path):
    from datetime import datetime

    from millpond import Connector, Resource
    from millpond.sources.connectors import ConnectorLoader

    items = Resource("items", ("id",), updated_at="changed")
    loader = ConnectorLoader(spark, Connector("newest.test", "N", "", (items,)), str(tmp_path / "lake"), buckets=2)
    rows = [(i, f"v{n}", datetime(2024, 1, 1 + n)) for i in range(20) for n in (2, 0, 1)]
    loader.load(items, spark.createDataFrame(rows, "id long, v string, changed timestamp_ntz"), datetime(2024, 2, 1))
    assert {r.v for r in spark.table("newest_test.items").collect()} == {"v2"}
    loader.disconnect()
