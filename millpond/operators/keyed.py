"""Rows with a key: cleaning, one row per key, merging a change set into a table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Key columns looked for when none is configured, in order.
COMMON_KEYS = ("id", "uuid", "guid")
REMOVED = "removed"


def find_key(columns: list[str], configured: tuple[str, ...] = ()) -> list[str]:
    """The configured key (all of its columns), else a common one, else an error."""
    available = ", ".join(columns)
    if configured:
        missing = [c for c in configured if c not in columns]
        if missing:
            raise ValueError(f'key column "{missing[0]}" not found; available columns: {available}')
        return list(configured)
    for name in COMMON_KEYS:
        if name in columns:
            return [name]
    raise ValueError(f"No ID field found in schema: tried {', '.join(COMMON_KEYS)}; available columns: {available}")


def _key_present(keys: list[str]) -> Column:
    present = F.col(keys[0]).isNotNull()
    for k in keys[1:]:
        present = present & F.col(k).isNotNull()
    return present


def with_key(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.filter(_key_present(keys))


def without_key(df: DataFrame, keys: list[str]) -> DataFrame:
    """The rejected rows, with the first key column that is missing."""
    reason = F.coalesce(*[F.when(F.col(k).isNull(), F.lit(f"null key: {k}")) for k in keys])
    return df.filter(~_key_present(keys)).withColumn("reject_reason", reason)


def first_per_key(df: DataFrame, keys: list[str], order: list) -> DataFrame:
    """One row per key, the first by ``order``.

    A filter on ``row_number() = 1`` is cut to one row per key inside every task before the shuffle,
    so a key that holds a large part of the table sends only a few rows to its reducer.
    """
    w = W.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).filter("_rn = 1").drop("_rn")


def _hashable(kind: T.DataType) -> bool:
    if isinstance(kind, T.StructType):
        return all(_hashable(f.dataType) for f in kind.fields)
    if isinstance(kind, T.ArrayType):
        return _hashable(kind.elementType)
    return not isinstance(kind, (T.MapType, T.VariantType))


def row_hash(df: DataFrame) -> Column:
    """A number that depends on the content of a row only; types that hold a map or variant are left out."""
    return F.xxhash64(*[F.col(f"`{f.name}`") for f in df.schema.fields if _hashable(f.dataType)])


def one_per_key(df: DataFrame, keys: list[str], seq: list[str] | None = None) -> DataFrame:
    """The latest row per key; without a sequence the choice depends on the rows only, not on their order."""
    return latest_per_key(df, keys, seq) if seq else first_per_key(df, keys, [row_hash(df)])


def latest_per_key(df: DataFrame, keys: list[str], seq: list[str]) -> DataFrame:
    """Rows equal in the sequence are decided by their content, so a repeat of a load takes the same one."""
    return first_per_key(df, keys, [*[F.col(c).desc_nulls_last() for c in seq], row_hash(df)])


def merge_by_key(
    base: DataFrame,
    delta: DataFrame,
    keys: list[str],
    seq: list[str] | None = None,
    op: str | None = None,
) -> DataFrame:
    """``base`` with the rows of ``delta`` inserted, replaced or, where ``op`` says so, removed.

    ``base`` has one row per key already, so only the change set is made unique. The anti join ships
    nothing but keys of the change set; rows of ``base`` pass through unsorted.
    """
    changes = one_per_key(with_key(delta, keys), keys, seq)
    kept = base.join(changes.select(*keys), keys, "left_anti")
    if op:
        changes = changes.filter(F.coalesce(F.col(op), F.lit("")) != REMOVED)
    return kept.select(*base.columns).unionByName(changes.select(*base.columns))


def update_fields(base: DataFrame, delta: DataFrame, keys: list[str], seq: str, masks: dict[str, Column]) -> DataFrame:
    """Change only the given fields of each key; ``masks`` says per column when a row sets it.

    Several changes of one key fold into one row per key first: per column the last value that was set. The base is
    only looked up, not sorted into a full join; keys it lacks are added.
    """
    folded = with_key(delta, keys).groupBy(*keys).agg(
        *[F.max_by(F.struct(F.col(c)), F.when(m, F.col(seq))).alias(f"_new_{c}") for c, m in masks.items()]
    )
    changed = []
    for name in base.columns:
        new = F.col(f"_new_{name}")
        changed.append(F.when(new.isNotNull(), new[name]).otherwise(F.col(name)).alias(name) if name in masks else F.col(name))
    added = [
        F.col(f"_new_{f.name}")[f.name].alias(f.name) if f.name in masks
        else F.col(f.name) if f.name in keys else F.lit(None).cast(f.dataType).alias(f.name)
        for f in base.schema.fields
    ]
    fresh = folded.join(base.select(*keys), keys, "left_anti")
    return base.join(folded, keys, "left").select(*changed).unionByName(fresh.select(*added))


def project_declared(df: DataFrame, schema: T.StructType) -> DataFrame:
    """Exactly the declared columns in declared order; a column the rows lack is NULL."""
    have = set(df.columns)
    return df.select(
        *[
            (F.col(f.name) if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name)
            for f in schema.fields
        ]
    )


def nested_to_json(df: DataFrame) -> DataFrame:
    """Nested columns as JSON text, for stores without nested types."""
    nested = (T.ArrayType, T.MapType, T.StructType)
    return df.select(
        *[F.to_json(f.name).alias(f.name) if isinstance(f.dataType, nested) else F.col(f.name) for f in df.schema.fields]
    )
