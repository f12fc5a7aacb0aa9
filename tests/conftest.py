import uuid

import pytest

from millpond.session import build_session

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    folder = tmp_path_factory.mktemp("millpond")
    session = build_session(
        "tests",
        "local[8]",
        **{
            "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
            "spark.sql.shuffle.partitions": "4",
            "spark.checkpoint.dir": str(folder / "shared"),
            "spark.sql.warehouse.dir": str(folder / "warehouse"),
            "spark.driver.memory": "6g",
        },
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def small():
    return SMALL


@pytest.fixture
def keyed_table(spark, tmp_path):
    """Makes keyed tables in a database of their own."""
    from millpond.operators.tables import KeyedTable, disconnect

    database = f"db_{uuid.uuid4().hex[:10]}"

    def make(schema, keys, name="t", buckets=4):
        from pyspark.sql import types as T

        if isinstance(schema, str):
            schema = T.StructType.fromDDL(schema)
        return KeyedTable(spark, f"{database}.{name}", str(tmp_path / name), keys, buckets).create(schema)

    make.database = database
    yield make
    disconnect(spark, database)


def rows(df, *columns):
    return sorted((tuple(r) for r in (df.select(*columns) if columns else df).collect()), key=repr)


@pytest.fixture
def as_rows():
    return rows
