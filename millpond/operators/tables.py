"""Keyed tables in the session catalog: a base with sorted change sets beside it.

A load writes its change set to a folder of its own and nothing else, so what it writes is in proportion to the changes.
The files of all versions lie in one partitioned catalog table, split by a hash of the key; the table users read is a view
that names the versions that count: the base without the keys that changed, and the newest change of each key. A commit is
one replacement of that view. Whoever reads keeps the versions they started with, and a load that dies half-way leaves files
that no view names. Every eighth change set or so they are folded: into one change set of similar ones, or into a new base.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millpond.functions.columns import bucket_of
from millpond.operators.keyed import REMOVED, latest_per_key, one_per_key, project_declared, row_hash, with_key
from millpond.operators.naming import evolved_schema, schema_change

BUCKET, VERSION, GONE, TIE, LATE = "_bucket", "_version", "_removed", "_tie", "_late"
FILES = "__files"  # between the name of a table and the number of its files table
OWN = (BUCKET, VERSION, GONE, TIE)
FOLD_AT = 8  # change sets beside the base before they are folded
TIER = 2  # newest change sets are folded together while each has at most so many times the rows of those after it
BUCKET_BYTES = 1 << 30  # a new base has more buckets if these would be larger


def _quoted(name: str) -> str:
    return ".".join(f"`{part}`" for part in name.split("."))


def _text(value: str) -> str:
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _comment(column: T.StructField) -> str:
    text = (column.metadata or {}).get("comment")
    return f" COMMENT {_text(text)}" if text else ""


@dataclass(frozen=True)
class Merged:
    """What an upsert did: buckets with changes, rows of the cleaned change set, and where that was written."""

    buckets: list[int]
    rows: int
    staged: DataFrame


@dataclass(frozen=True)
class State:
    """What the view of a table says: its columns, files table, versions (base first) with their rows, and batches done."""

    schema: T.StructType
    comment: str
    files: str
    buckets: int
    versions: list[tuple[str, int]] = field(default_factory=list)
    done: dict[str, int] = field(default_factory=dict)


class KeyedTable:
    """``name`` is ``database.table``; ``location`` is a folder all executors share. One writer at a time."""

    def __init__(self, spark: SparkSession, name: str, location: str, keys: list[str], buckets: int = 16):
        self.spark, self.name, self.location = spark, name, location.rstrip("/")
        self.keys, self.buckets = list(keys), buckets

    def exists(self) -> bool:
        return self.spark.catalog.tableExists(self.name)

    def create(self, schema: T.StructType, comment: str = "") -> "KeyedTable":
        missing = [k for k in self.keys if k not in schema.fieldNames()]
        if missing:
            raise ValueError(f"key columns not in schema: {', '.join(missing)}")
        database = self.name.split(".")[0]
        self.spark.sql(f"CREATE DATABASE IF NOT EXISTS {_quoted(database)} LOCATION {_text(self.location + '/database')}")
        if not self.exists():
            self._commit(State(schema, comment, self._new_files(schema), self.buckets))
        return self

    # What the catalog holds

    def _new_files(self, schema: T.StructType, hidden: list[T.StructField] = ()) -> str:
        """A files table for rows of a schema; nothing names it yet."""
        files = f"{self.name}{FILES}_{uuid.uuid4().hex[:8]}"
        columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in [*schema.fields, *hidden])
        self.spark.sql(
            f"CREATE TABLE {_quoted(files)} ({columns}, {GONE} BOOLEAN, {TIE} BIGINT, {VERSION} STRING, {BUCKET} INT) "
            f"USING parquet PARTITIONED BY ({VERSION}, {BUCKET}) LOCATION {_text(f'{self.location}/files/{files}')}"
        )
        return files

    def _state(self) -> State:
        held = {r.key: r.value for r in self.spark.sql(f"SHOW TBLPROPERTIES {_quoted(self.name)}").collect()}
        made = json.loads(held["state"])
        schema = self.spark.table(self.name).schema
        return State(schema, self.spark.catalog.getTable(self.name).description or "", made["files"], made["buckets"], [tuple(v) for v in made["versions"]], made["done"])

    def _commit(self, state: State) -> None:
        """Make a state the one readers see, in one catalog call."""
        columns = ", ".join(f"`{f.name}`{_comment(f)}" for f in state.schema.fields)
        kept = json.dumps({"files": state.files, "buckets": state.buckets, "versions": state.versions, "done": state.done})
        self.spark.sql(
            f"CREATE OR REPLACE VIEW {_quoted(self.name)} ({columns}) COMMENT {_text(state.comment)} "
            f"TBLPROPERTIES ('key' = {_text(','.join(self.keys))}, 'state' = {_text(kept)}) AS "
            f"{self._select(state, state.schema.fieldNames())} WHERE NOT {GONE}"
        )

    def _select(self, state: State, columns: list[str]) -> str:
        """SQL of one row per key, with those marked as removed; a WHERE may follow."""
        names = ", ".join(f"`{c}`" for c in dict.fromkeys([*columns, GONE]))
        out = ", ".join(f"`{c}`" for c in columns)
        versions = [_text(v) for v, _ in state.versions]
        files = _quoted(state.files)
        if len(versions) < 2:
            return f"SELECT {out} FROM (SELECT {names} FROM {files} WHERE {VERSION} {f'= {versions[0]}' if versions else 'IS NULL'})"
        keys = ", ".join(f"`{k}`" for k in self.keys)
        newest = f"SELECT * FROM {files} WHERE {VERSION} IN ({', '.join(versions[1:])})"
        if len(versions) > 2:
            newest = f"SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY {keys} ORDER BY {VERSION} DESC) AS _rn FROM ({newest})) WHERE _rn = 1"
        same = " AND ".join(f"b.`{k}` = d.`{k}`" for k in self.keys)
        return (
            f"SELECT {out} FROM (SELECT {names} FROM (SELECT * FROM {files} WHERE {VERSION} = {versions[0]}) b "
            f"LEFT ANTI JOIN (SELECT {keys} FROM {files} WHERE {VERSION} IN ({', '.join(versions[1:])})) d ON {same} "
            f"UNION ALL SELECT {names} FROM ({newest}))"
        )

    def _hidden(self, state: State) -> list[T.StructField]:
        """Columns of the files that are no columns of the table: sequences of loads, and columns no longer declared."""
        known = {*state.schema.fieldNames(), *OWN}
        return [f for f in self.spark.table(state.files).schema.fields if f.name not in known]

    def _rows(self, state: State, columns: list[str]) -> DataFrame:
        return self.spark.sql(self._select(state, columns))

    def schema(self) -> T.StructType:
        """The declared columns, with their comments."""
        return self.spark.table(self.name).schema

    def read(self) -> DataFrame:
        return self.spark.table(self.name)

    # Writing

    def _write(self, rows: DataFrame, version: str, buckets: int) -> tuple[str, int, list[int], int]:
        """Rows sorted by key in a folder of their own: the folder, the number of rows, the buckets with rows, and all rows.

        Rows marked as late lie in a folder beside these; only the last number counts them.
        """
        path = f"{self.location}/data/{version}"
        seen = Observation()
        split = [LATE, BUCKET] if LATE in rows.columns else [BUCKET]
        placed = rows.withColumn(BUCKET, bucket_of(self.keys, buckets)).hint("rebalance", *split).sortWithinPartitions(*split, *self.keys)
        counted = F.count_if(~F.col(LATE)) if LATE in rows.columns else F.count("*")
        placed.observe(seen, counted.alias("rows"), F.count("*").alias("all")).write.partitionBy(*split).parquet(path)
        at = f"{path}/{LATE}=false" if LATE in rows.columns else path
        found = sorted(int(s.getPath().getName().split("=")[1]) for s in self._list(at) if "=" in s.getPath().getName())
        return at, int(seen.get["rows"]), found, int(seen.get["all"])

    def _list(self, path: str) -> list:
        folder = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        fs = folder.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf())
        return list(fs.listStatus(folder)) if fs.exists(folder) else []

    def _add(self, files: str, version: str, path: str, buckets: list[int]) -> None:
        if buckets:
            places = " ".join(f"PARTITION ({VERSION} = {_text(version)}, {BUCKET} = {b}) LOCATION {_text(f'{path}/{BUCKET}={b}')}" for b in buckets)
            self.spark.sql(f"ALTER TABLE {_quoted(files)} ADD IF NOT EXISTS {places}")

    @staticmethod
    def _version(state: State, label: str) -> str:
        """A name that sorts behind all versions that count."""
        last = int(state.versions[-1][0].split("-")[0]) if state.versions else 0
        return f"{last + 1:09d}-{label}-{uuid.uuid4().hex[:12]}"

    def upsert(
        self, delta: DataFrame, seq: list[str] | None = None, op: str | None = None, label: str = "load",
        batch: tuple[str, int] | None = None,
    ) -> Merged:
        """Merge a change set.

        Running it again with the same change set leaves the table as it is. With ``seq`` the newer of the stored and
        the changed row wins, whatever order change sets come in: sequence columns that are not columns of the table
        are kept in its files, hidden, and so are removals, as marks. ``batch`` is (run, number): a batch of a run that is
        not behind the last one the table has taken is skipped, as both are committed together.
        """
        state = self._state()
        nothing = Merged([], 0, self.spark.createDataFrame([], state.schema))
        if batch and state.done.get(batch[0], -1) >= batch[1]:
            return nothing
        done = {**state.done, batch[0]: batch[1]} if batch else state.done
        hidden = self._hidden(state)
        extra = [delta.schema[c] for c in seq or [] if c not in {*state.schema.fieldNames(), *(f.name for f in hidden)}]
        if extra:
            columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in extra)
            self.spark.sql(f"ALTER TABLE {_quoted(state.files)} ADD COLUMNS ({columns})")
            hidden = [*hidden, *extra]
        target = T.StructType([*state.schema.fields, *hidden])
        changes = one_per_key(with_key(delta, self.keys), self.keys, seq)
        gone = F.coalesce(F.col(op) == REMOVED, F.lit(False)) if op else F.lit(False)
        changes = project_declared(changes.withColumn(GONE, gone), T.StructType([*target.fields, T.StructField(GONE, T.BooleanType())]))
        changes = changes.withColumn(TIE, F.bitwise_not(row_hash(changes.drop(GONE))) if seq else F.lit(None).cast("long"))

        if seq and state.versions:
            # Rows are judged on their way to the files, in the tasks that made them unique.
            changes = self._against_stored(changes, state, seq)
        version = self._version(state, label)
        path, rows, touched, everything = self._write(changes, version, state.buckets)
        staged = self.spark.read.schema(T.StructType([*changes.schema.fields, T.StructField(BUCKET, T.IntegerType())])).parquet(f"{self.location}/data/{version}")
        written = sorted(self._buckets_of(version)) if LATE in changes.columns else touched
        merged = Merged(written, everything, staged.select(*[F.col(f"`{c}`") for c in state.schema.fieldNames()]))
        if not rows:
            if batch:
                self._commit(replace(state, done=done))
            return merged
        self._add(state.files, version, path, touched)
        self._commit(replace(state, versions=[*state.versions, (version, rows)], done=done))
        if len(state.versions) >= FOLD_AT:
            self.fold()
        return merged

    def _buckets_of(self, version: str) -> set[int]:
        """The buckets of a change set, those of its late rows too."""
        folders = [s.getPath() for s in self._list(f"{self.location}/data/{version}") if s.getPath().getName().startswith(LATE)]
        return {int(s.getPath().getName().split("=")[1]) for f in folders for s in self._list(f.toString())}

    def _against_stored(self, changes: DataFrame, state: State, seq: list[str]) -> DataFrame:
        """Change rows with ``_late``: whether the stored row, or the mark of a removal, is newer.

        Of what is stored only keys, sequence and content hash are read.
        """
        old = self._rows(state, [*dict.fromkeys([*self.keys, *seq]), GONE, TIE])
        order = F.struct(*[F.col(f"`{c}`") for c in seq])
        old = old.select(*self.keys, F.struct(order.alias("seq"), F.col(GONE).alias("gone"), F.col(TIE).alias("tie")).alias("_old"))
        new = changes.join(old, self.keys, "left").select(*changes.columns, "_old")
        leaves = F.col(GONE) & (order >= F.col("_old.seq"))
        stays = F.when(F.col("_old.gone"), order > F.col("_old.seq")).otherwise(F.struct(order.alias("seq"), F.col(TIE).alias("tie")) >= F.struct("_old.seq", "_old.tie"))
        return new.withColumn(LATE, F.col("_old").isNotNull() & ~F.coalesce(leaves | stays, F.lit(False))).drop("_old")

    # Folding

    def fold(self) -> None:
        """Fold the change sets: all into a new base once they have half its rows, else the newest of similar size."""
        state = self._state()
        changed = [n for _, n in state.versions[1:]]
        if 2 * sum(changed) >= state.versions[0][1]:
            self.compact()
            return
        first, total = len(changed) - 1, changed[-1]
        while first > 0 and changed[first - 1] <= TIER * total:
            first -= 1
            total += changed[first]
        if first == len(changed) - 1:
            return
        folded = [v for v, _ in state.versions[1 + first :]]
        rows = self.spark.table(state.files).where(F.col(VERSION).isin(folded))
        rows = latest_per_key(rows, self.keys, [VERSION]).drop(VERSION, BUCKET)
        version = self._version(state, "fold")
        path, count, touched, _ = self._write(rows, version, state.buckets)
        self._add(state.files, version, path, touched)
        self._commit(replace(state, versions=[*state.versions[: 1 + first], (version, count)]))

    def compact(self, buckets: int | None = None, forget: str | None = None) -> None:
        """Write a new base, with more buckets if these have grown too large, and drop what changes replaced.

        Of removals one mark a key stays where it has a sequence a late row could be behind; ``forget`` is a condition on
        the sequence columns, as SQL, under which marks are dropped too, and without a sequence all are.
        """
        state = self._state()
        hidden = self._hidden(state)
        rows = self._rows(state, [*state.schema.fieldNames(), *[f.name for f in hidden], GONE, TIE])
        marked = F.col(GONE) & F.col(TIE).isNotNull() & ~F.coalesce(F.expr(forget), F.lit(False)) if forget else F.col(GONE) & F.col(TIE).isNotNull()
        live = {v for v, _ in state.versions}
        fs = lambda s: s.getPath().getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf())
        folders = [s for v in live for s in self._list(f"{self.location}/data/{v}") if s.getPath().getName() != f"{LATE}=true"]
        size = sum(fs(s).getContentSummary(s.getPath()).getLength() for s in folders)
        wanted = buckets or state.buckets
        while not buckets and wanted * BUCKET_BYTES < size:
            wanted *= 2
        version = self._version(state, "base")
        path, count, touched, _ = self._write(rows.where(~F.col(GONE) | marked), version, wanted)
        self._add(state.files, version, path, touched)
        self._commit(replace(state, versions=[(version, count)] if count else [], buckets=wanted))

    def evolve(self, wanted: T.StructType, allow_drop: bool = False) -> None:
        """Bring the table to the declared schema. Columns are dropped only when that is allowed.

        New columns are a catalog change. A new type or a drop writes a new base into files of the new types, and readers
        go over to it in one step; until then they see the old table.
        """
        state = self._state()
        described = {f.name: f.metadata for f in state.schema.fields if f.metadata}
        wanted = T.StructType([T.StructField(f.name, f.dataType, f.nullable, f.metadata or described.get(f.name)) for f in wanted.fields])
        change = schema_change(state.schema, wanted)
        texts = {f.name: f.metadata for f in wanted.fields if f.metadata}
        if texts != {n: m for n, m in described.items() if n in texts}:
            state = replace(state, schema=T.StructType([T.StructField(f.name, f.dataType, f.nullable, texts.get(f.name) or f.metadata) for f in state.schema.fields]))
            if change.is_empty():
                self._commit(state)
        if change.is_empty() or (not allow_drop and not change.added and not change.retyped):
            return
        hidden = self._hidden(state)
        if not change.retyped and not (allow_drop and change.missing):
            # A sequence column that becomes a declared one is there already.
            added = [f for f in wanted.fields if f.name in change.added]
            new = [f for f in added if f.name not in {h.name for h in hidden}]
            if new:
                columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in new)
                self.spark.sql(f"ALTER TABLE {_quoted(state.files)} ADD COLUMNS ({columns})")
            self._commit(replace(state, schema=T.StructType([*state.schema.fields, *added])))
            return
        target = evolved_schema(state.schema, wanted, allow_drop)
        hidden = [f for f in hidden if f.name not in target.fieldNames()]
        own = [T.StructField(GONE, T.BooleanType()), T.StructField(TIE, T.LongType())]
        rows = self._rows(state, [*state.schema.fieldNames(), *[f.name for f in self._hidden(state)], GONE, TIE])
        files, version = self._new_files(target, hidden), self._version(state, "evolve")
        path, count, touched, _ = self._write(project_declared(rows, T.StructType([*target.fields, *hidden, *own])), version, state.buckets)
        self._add(files, version, path, touched)
        self._commit(replace(state, schema=target, files=files, versions=[(version, count)] if count else []))

    def vacuum(self, keep_hours: float = 24.0) -> list[str]:
        """Delete folders of versions the table no longer names, once they are older than any running query.

        One load at a time may write a table; a folder of a load under way is protected by its age.
        """
        state = self._state()
        live = {v for v, _ in state.versions}
        newest = self.spark._jvm.java.lang.System.currentTimeMillis() - int(keep_hours * 3_600_000)
        deleted = []
        for status in self._list(f"{self.location}/data"):
            path, version = status.getPath(), status.getPath().getName()
            if version not in live and status.getModificationTime() <= newest:
                self.spark.sql(f"ALTER TABLE {_quoted(state.files)} DROP IF EXISTS PARTITION ({VERSION} = {_text(version)})")
                path.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf()).delete(path, True)
                deleted.append(f"data/{version}")
        if deleted:
            database, table = self.name.split(".")
            for other in self.spark.catalog.listTables(database):
                if other.name.startswith(f"{table}{FILES}_") and f"{database}.{other.name}" != state.files:
                    self.spark.sql(f"DROP TABLE IF EXISTS {_quoted(f'{database}.{other.name}')}")
        return deleted

    def describe(self, comment: str, columns: dict[str, str] | None = None) -> None:
        """Set the comments of the table and of its columns."""
        state = self._state()
        said = lambda f: {**(f.metadata or {}), "comment": columns[f.name]} if columns and f.name in columns else f.metadata
        schema = T.StructType([T.StructField(f.name, f.dataType, f.nullable, said(f)) for f in state.schema.fields])
        self._commit(replace(state, schema=schema, comment=comment))

    def drop(self) -> None:
        """Drop the table; its folders stay."""
        if self.exists():
            database, table = self.name.split(".")
            self.spark.sql(f"DROP VIEW {_quoted(self.name)}")
            for other in self.spark.catalog.listTables(database):
                if other.name.startswith(f"{table}{FILES}_"):
                    self.spark.sql(f"DROP TABLE IF EXISTS {_quoted(f'{database}.{other.name}')}")


def disconnect(spark: SparkSession, database: str) -> None:
    """Drop every table of a connector, and its database."""
    spark.sql(f"DROP DATABASE IF EXISTS {_quoted(database)} CASCADE")


def table_listing(spark: SparkSession, hidden: tuple[str, ...] = ("information_schema", "global_temp")) -> DataFrame:
    """One row per table: database, name, DDL text. Databases of the system are left out."""
    rows = []
    for db in sorted(d.name for d in spark.catalog.listDatabases()):
        if db in hidden:
            continue
        for t in sorted(t.name for t in spark.catalog.listTables(db) if not t.isTemporary and FILES not in t.name):
            columns = [c for c in spark.catalog.listColumns(f"{db}.{t}") if c.name != BUCKET]
            body = ",\n  ".join(
                f'"{c.name}" {c.dataType}' + (f" -- {c.description}" if c.description else "") for c in columns
            )
            rows.append((db, t, f'CREATE TABLE "{t}" (\n  {body}\n);'))
    return spark.createDataFrame(rows, "schema_name string, table_name string, ddl string")
