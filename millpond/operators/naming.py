"""Column names that are safe to use unquoted, and schema comparison."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

# Words that get the suffix by default, those a feed is likely to use as a field name.
# Pass `reserved` to use another set, e.g. the keyword list of the store the data came from.
RESERVED_WORDS = frozenset(
    """
    select from where insert update delete create drop alter table index view schema database user role
    grant revoke commit rollback begin end if else while for case when then order by group having union
    join inner left right outer cross natural on as in not and or is null true false like between exists
    all any some distinct top limit offset fetch first last only with recursive window over partition rows
    range preceding following current row unbounded rank date time timestamp interval year month day hour
    minute second quarter week epoch timezone zone at now today yesterday tomorrow round floor abs sign
    mod power log random count sum avg min max mode median constraint primary key foreign references
    unique check default identity serial sequence generated always stored virtual binary unicode character
    varchar char text image bit int integer bigint smallint decimal numeric float real double precision
    money datetime xml type function procedure trigger event package body library source class method
    field property attribute interface exception error warning info log permission login password hash
    signature public private internal external local session connection transaction level read timeout
    wait share access lock plan statistics merge loop sort stream variable temp cast enum global extract sql
    security lookup convert
    """.split()
)
SUFFIX = "_col"


def reserved_words(spark: SparkSession, path: str | None = None) -> frozenset[str]:
    """The default words with Spark's own keywords and, if given, those of a text file with one word per line."""
    words = spark.sql("SELECT lower(keyword) AS value FROM sql_keywords()")
    if path:
        words = words.union(spark.read.text(path).selectExpr("lower(trim(value))"))
    # A few hundred words, needed on the driver to name columns.
    return RESERVED_WORDS | {r.value for r in words.distinct().collect() if r.value}


def safe_name(name: str, reserved: frozenset[str] = RESERVED_WORDS) -> str:
    return f"{name}{SUFFIX}" if name.lower() in reserved else name


def safe_names(names: list[str], reserved: frozenset[str] = RESERVED_WORDS) -> dict[str, str]:
    """Old to new name. Two names that end up the same are an error, not one column."""
    renamed = {n: safe_name(n, reserved) for n in names}
    seen: dict[str, str] = {}
    for old, new in renamed.items():
        if new.lower() in seen:
            raise ValueError(f'columns "{seen[new.lower()]}" and "{old}" both become "{new}"')
        seen[new.lower()] = old
    return renamed


def rename_reserved(df: DataFrame, reserved: frozenset[str] = RESERVED_WORDS) -> DataFrame:
    renamed = {old: new for old, new in safe_names(df.columns, reserved).items() if old != new}
    return df.withColumnsRenamed(renamed)


@dataclass(frozen=True)
class SchemaChange:
    added: tuple[str, ...]
    retyped: tuple[str, ...]
    missing: tuple[str, ...]

    def is_empty(self) -> bool:
        return not (self.added or self.retyped or self.missing)


def schema_change(stored: T.StructType, wanted: T.StructType) -> SchemaChange:
    """Columns to add, with another type, and no longer declared. Data types are compared as types."""
    old = {f.name: f.dataType for f in stored.fields}
    new = {f.name: f.dataType for f in wanted.fields}
    return SchemaChange(
        added=tuple(n for n in new if n not in old),
        retyped=tuple(n for n in new if n in old and new[n] != old[n]),
        missing=tuple(n for n in old if n not in new),
    )


def evolved_schema(stored: T.StructType, wanted: T.StructType, allow_drop: bool = False) -> T.StructType:
    """Declared columns first; stored ones that are no longer declared stay unless dropping is allowed."""
    kept = [] if allow_drop else [f for f in stored.fields if f.name not in wanted.fieldNames()]
    return T.StructType(list(wanted.fields) + kept)
