"""Read-only SQL and named queries."""

from __future__ import annotations

import json
import re
from collections import OrderedDict

from pyspark.errors import AnalysisException, ParseException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.storagelevel import StorageLevel

from millpond.functions.dates import parse_datetime
from millpond.functions.text import camel_case
from millpond.model import RESULT_TYPES, QuerySpec
from millpond.operators.keyed import REMOVED
from millpond.operators.reports import result_records
from millpond.operators.tables import KeyedTable

# Fixed value: rows a caller is shown of a large result.
SHOWN_ROWS = 50


class ReadOnlyError(ValueError):
    pass


_TOKEN = re.compile(r"""'(?:[^'\\]|\\.|'')*'|"(?:[^"\\]|\\.|"")*"|`(?:[^`]|``)*`|--[^\n]*|/\*.*?\*/|.""", re.S)
_QUOTED_NAMES = "spark.sql.ansi.doubleQuotedIdentifiers"


def bare_statement(text: str) -> str:
    """The statement without the semicolons, comments and space that follow it; quoted text is left alone."""
    tokens = _TOKEN.findall(text)
    while tokens and (tokens[-1].isspace() or tokens[-1] == ";" or tokens[-1].startswith(("--", "/*"))):
        tokens.pop()
    return "".join(tokens)


def run_sql(spark: SparkSession, text: str, args: list | dict | None = None) -> DataFrame:
    """Run one query. It runs as a subquery, where commands, writes and several statements cannot be parsed,
    whatever word they start with. Names may stand in double quotes."""
    before = spark.conf.get(_QUOTED_NAMES)
    spark.conf.set(_QUOTED_NAMES, "true")
    try:
        return spark.sql(f"SELECT * FROM (\n{bare_statement(text)}\n) AS asked", args=args)
    except ParseException as e:
        raise ReadOnlyError(f"only one SELECT statement is allowed: {text}") from e
    finally:
        spark.conf.set(_QUOTED_NAMES, before)


def preview(df: DataFrame, rows: int = SHOWN_ROWS) -> DataFrame:
    """The first rows, each with the full row count. The count is a subquery; no result is collected."""
    total = df.agg(F.count("*")).scalar()
    return df.limit(rows).withColumn("total_rows", total)


def preview_note(shown: int, total: int) -> str | None:
    if total <= shown:
        return None
    return f"Showing {shown} of {total} rows. Filter the query or add a limit to see particular rows."


def broken_queries(spark: SparkSession, specs: list[QuerySpec]) -> list[tuple[str, str]]:
    """Name and error of every query that does not analyse. Nothing is run."""
    errors = []
    for spec in specs:
        try:
            run_sql(spark, spec.query).schema
        except (AnalysisException, ReadOnlyError) as e:
            errors.append((spec.name, f'Query {spec.name} "{spec.query}" failed with error: {e}'))
    return errors


NAMED_QUERY = (
    T.StructType().add("project", "string").add("name", "string").add("description", "string").add("query", "string")
    .add("columns", T.ArrayType(T.StructType().add("name", "string").add("type", "string"))).add("sample", "string")
)


def _as_text(value) -> str | None:
    if value is None or isinstance(value, str):
        return value
    return value.isoformat() if hasattr(value, "isoformat") else json.dumps(value)


def _typed(column: str, declared: str):
    """A column of text as its declared result type."""
    if declared == "date":
        return parse_datetime(column)
    if declared == "json":
        return F.try_parse_json(column)
    return F.col(column).try_cast(RESULT_TYPES[declared])


class QueryRegistry:
    """Named queries per project. Registering a project replaces all of its queries.

    With a keyed table on (project, name) they outlive the session; else they are kept in it.
    """

    def __init__(self, spark: SparkSession, store: KeyedTable | None = None):
        self.spark, self.store = spark, store
        self._projects: dict[str, dict[str, QuerySpec]] = {}

    def register(self, project: str, specs: list[QuerySpec]) -> str:
        if self.store is not None:
            gone = set(self._find(project) or {}) - {s.name for s in specs}
            self._write(project, specs, gone)
        self._projects[project] = {s.name: s for s in specs}
        return project

    def unregister(self, project: str) -> None:
        if self.store is not None:
            self._write(project, [], set(self._find(project) or {}))
        self._projects.pop(project, None)

    def get(self, project: str) -> list[QuerySpec] | None:
        specs = self._find(project)
        return None if specs is None else list(specs.values())

    def _write(self, project: str, specs: list[QuerySpec], gone: set[str]) -> None:
        rows = [(project, s.name, s.description, s.query, list(s.columns), json.dumps(s.sample, default=_as_text), "added") for s in specs]
        rows += [(project, name, None, None, None, None, REMOVED) for name in sorted(gone)]
        self.store.upsert(self.spark.createDataFrame(rows, T.StructType([*NAMED_QUERY.fields, T.StructField("op", T.StringType())])), op="op")

    def _find(self, project: str) -> dict[str, QuerySpec] | None:
        if project not in self._projects and self.store is not None:
            # The queries of one project, a handful of rows.
            rows = self.store.read().filter(F.col("project") == project).orderBy("name").collect()
            if rows:
                self._projects[project] = {
                    r.name: QuerySpec(
                        r.name, r.query, r.description, tuple((c.name, c.type) for c in r["columns"]), tuple(json.loads(r["sample"]))
                    )
                    for r in rows
                }
        return self._projects.get(project)

    def _spec(self, project: str, name: str) -> QuerySpec:
        specs = self._find(project)
        if specs is None:
            raise KeyError(f"Unknown dataSpec for project: {project}")
        if name not in specs:
            raise KeyError(f"Unknown query: {name}")
        return specs[name]

    def run(self, project: str, name: str, args: list | dict | None = None) -> DataFrame:
        return run_sql(self.spark, self._spec(project, name).query, args)

    def sample(self, project: str, name: str) -> DataFrame:
        """The declared example rows; empty when there are none."""
        spec = self._spec(project, name)
        names = [c for c, _ in spec.columns]
        rows = [tuple(_as_text(row.get(c)) for c in names) for row in spec.sample]
        texts = self.spark.createDataFrame(rows, T.StructType([T.StructField(c, T.StringType()) for c in names]))
        return texts.select(*[_typed(c, t).alias(c) for c, t in spec.columns])

    def proxy(self, project: str) -> "QueryProxy":
        if self._find(project) is None:
            raise KeyError(f"Unknown dataSpec for project: {project}")
        return QueryProxy(self, project)

    def bundle(self, project: str, names: list[str]) -> DataFrame:
        """Records of the named queries as rows, each query run once."""
        frames = [result_records(self.run(project, n), n) for n in dict.fromkeys(names)]
        out = frames[0]
        for frame in frames[1:]:
            out = out.unionByName(frame)
        return out


class QueryProxy:
    """``proxy.salesByWeek()`` runs the query "sales by week"."""

    def __init__(self, registry: QueryRegistry, project: str):
        self._registry, self._project = registry, project
        self._names = {camel_case(s.name): s.name for s in registry.get(project)}

    def __getattr__(self, method: str):
        if method.startswith("_") or method not in self._names:
            raise AttributeError(method)
        return lambda: self._registry.run(self._project, self._names[method])

    def fetch_data(self, name: str) -> DataFrame:
        return self._registry.run(self._project, name)


def _source_sizes(plan) -> tuple[int, ...]:
    """Bytes of each source a plan reads: files that came or went change them. A keyed table's plan names its versions."""
    leaves = plan.collectLeaves()
    return tuple(int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.size()))


class ResultCache:
    """The first rows of results, kept by what a statement means and what its tables hold.

    Statements whose plans compare as equal share an entry, however they are spelt. A load makes an entry stale by itself:
    the plan of a keyed table names the versions it reads, and of other sources the size of their files is compared. At most
    ``size`` entries are kept, the longest unused goes first. Only what a caller is shown is kept, never a whole result.
    """

    def __init__(self, spark: SparkSession, size: int = 100, rows: int = SHOWN_ROWS):
        self.spark, self.size, self.rows = spark, size, rows
        self._kept: OrderedDict[int, tuple] = OrderedDict()
        self._next = 0

    def run(self, text: str) -> DataFrame:
        df = run_sql(self.spark, text)
        plan = df._jdf.queryExecution().analyzed()
        sizes = _source_sizes(plan)
        for number, (known, known_sizes, names, shown) in self._kept.items():
            if sizes == known_sizes and names == df.columns and known.semanticHash() == plan.semanticHash() and known.sameResult(plan):
                self._kept.move_to_end(number)
                return shown
        shown = preview(df, self.rows).persist(StorageLevel.MEMORY_AND_DISK)
        self._kept[self._next] = (plan, sizes, df.columns, shown)
        self._next += 1
        while len(self._kept) > self.size:
            self._kept.popitem(last=False)[1][-1].unpersist()
        return shown

    def clear(self) -> None:
        for *_, shown in self._kept.values():
            shown.unpersist()
        self._kept.clear()
