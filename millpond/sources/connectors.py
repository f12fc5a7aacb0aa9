"""Loading the resources of a connector into keyed tables, from where the last load ended."""

from __future__ import annotations

import uuid
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from datetime import datetime, timedelta
from threading import Lock

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millpond.functions.text import schema_name, table_name
from millpond.model import Connector, Resource
from millpond.operators import typed
from millpond.operators.keyed import find_key
from millpond.operators.naming import rename_reserved, safe_name
from millpond.operators.status import high_water_mark
from millpond.operators.tables import KeyedTable, disconnect
from millpond.sources.tables import first_load, incremental, sync_column

SYNC_STATE = (
    T.StructType().add("connector", "string").add("table_name", "string").add("high_water_mark", "timestamp_ntz")
    .add("last_synced_at", "timestamp_ntz")
)
TABLE_STATUS = (
    T.StructType().add("connector", "string").add("table_name", "string").add("last_synced_at", "timestamp_ntz")
    .add("rows_written", "long")
)


@dataclass(frozen=True)
class Loaded:
    table: str
    rows: int
    high_water_mark: datetime | None
    rejected: int = 0
    bad_dates: int = 0


class ConnectorLoader:
    """Tables of one connector below ``location``; its state is two small keyed tables beside them."""

    def __init__(self, spark: SparkSession, connector: Connector, location: str, buckets: int = 16):
        self.spark, self.connector, self.buckets = spark, connector, buckets
        self.database = schema_name(connector.id)
        self.location = f"{location.rstrip('/')}/{self.database}"
        self._commit = Lock()
        self.sync_state = self._state("sync_state", SYNC_STATE)
        self.table_status = self._state("table_status", TABLE_STATUS)

    def _state(self, name: str, schema: T.StructType) -> KeyedTable:
        keys = ["connector", "table_name"]
        return KeyedTable(self.spark, f"{self.database}.{name}", f"{self.location}/{name}", keys, buckets=1).create(schema)

    def table(self, resource: Resource, columns: list[str]) -> KeyedTable:
        keys = [safe_name(k) for k in find_key(columns, resource.key)]
        name = table_name(resource.name)
        return KeyedTable(self.spark, f"{self.database}.{name}", f"{self.location}/{name}", keys, self.buckets)

    def _position(self, name: str) -> datetime | None:
        # One row: the state is keyed by connector and table.
        row = self.sync_state.read().filter(
            (F.col("connector") == self.connector.id) & (F.col("table_name") == name)
        ).first()
        return row.high_water_mark if row else None

    def load(
        self, resource: Resource, source: DataFrame, as_of: datetime, seq: list[str] | None = None,
        op: str | None = None, overlap: timedelta = timedelta(0), look_back: timedelta | None = None,
        allow_drop: bool = False, schema: T.StructType | None = None,
    ) -> Loaded:
        """Bring one resource up to date.

        A first load takes everything, or what lies within ``look_back`` for feeds that only go back so far.
        Of several versions of a key the one with the newest time stays, unless ``seq`` names another order.
        The data is committed first, then the position. A load that dies in between is done again and changes
        nothing. The position is the newest time seen in the data, so the clocks of source and cluster need
        not agree. Freshness of a table moves only when rows were written.

        With a declared ``schema``, as the API specs give it, values are typed and judged before they are merged: bad dates
        are NULL, rows with other bad values or no key go to the folder of rejects, all are counted, and the comments of
        the schema reach the table.
        """
        table = self.table(resource, source.columns)
        name = table.name.split(".")[1]
        time_column = sync_column(source.schema, resource)
        since = self._position(name)
        if since is not None:
            delta = incremental(source, resource, since, overlap)
        elif time_column and look_back:
            delta = first_load(source, time_column, as_of, look_back)
        else:
            delta = source

        judged = None
        if schema is not None:
            also = [f for f in source.schema.fields if f.name in {op, *(seq or [])} and f.name not in schema.fieldNames()]
            judged = typed.split(delta, T.StructType([*schema.fields, *also]), find_key(source.columns, resource.key), f"{self.location}/judged/{name}/load={uuid.uuid4().hex}")
            delta = judged.rows
            source = delta.limit(0).select(*[F.col(f"`{f.name}`").alias(f.name, metadata=f.metadata or {}) for f in schema.fields], *[f.name for f in also])
        declared = rename_reserved(source.drop(*[c for c in (op,) if c]))
        if table.exists():
            table.evolve(declared.schema, allow_drop)
        else:
            table.create(declared.schema)

        renamed = {c: safe_name(c) for c in source.columns if c != op and safe_name(c) != c}
        done = table.upsert(
            delta.withColumnsRenamed(renamed), seq=[safe_name(c) for c in seq or ([time_column] if time_column else [])] or None, op=op
        )
        mark = since
        if time_column and done.rows:
            # Read from the written change set: one column, and the same rows that were merged.
            mark = high_water_mark(done.staged, safe_name(time_column), since).first()[0]
        with self._commit:  # a keyed table has one writer at a time
            self.sync_state.upsert(self._row(SYNC_STATE, name, mark, as_of))
            if done.rows:
                self.table_status.upsert(self._row(TABLE_STATUS, name, as_of, done.rows))
        if judged is None:
            return Loaded(table.name, done.rows, mark)
        return Loaded(table.name, done.rows, mark, judged.rejected, judged.bad_dates)

    def rejects(self, resource: Resource, schema: T.StructType) -> DataFrame:
        """Rows of all loads of a resource that were rejected, with the reason."""
        kept = T.StructType([*schema.fields, T.StructField(typed.REASON, T.StringType()), T.StructField("_refused", T.BooleanType())])
        found = self.spark.read.schema(kept).parquet(f"{self.location}/judged/{table_name(resource.name)}")
        return found.where("_refused").drop("_refused", "load")

    def _row(self, schema: T.StructType, name: str, *values) -> DataFrame:
        return self.spark.createDataFrame([(self.connector.id, name, *values)], schema)

    def load_all(self, sources: dict[str, DataFrame], as_of: datetime, threads: int = 4, **how) -> list[Loaded]:
        """All resources that have a source. They do not depend on each other, so several run at a time; their
        state rows are written one after the other."""
        wanted = [r for r in self.connector.resources if r.name in sources]
        one = inheritable_thread_target(self.spark)(lambda r: self.load(r, sources[r.name], as_of, **how))
        with ThreadPoolExecutor(max_workers=threads) as pool:
            return list(pool.map(one, wanted))

    def disconnect(self) -> None:
        """Drop all tables of the connector with its state."""
        disconnect(self.spark, self.database)
