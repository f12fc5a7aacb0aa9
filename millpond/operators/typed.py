"""The typed way into a table: declared types, reject reasons and counts in one pass over the rows."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millpond.functions.dates import clean_date, clean_timestamp
from millpond.operators.keyed import nested_to_json
from millpond.session import new_folder

REASON, BAD_DATES = "reject_reason", "_bad_dates"
MOMENTS = (T.TimestampType, T.TimestampNTZType, T.DateType)
NESTED = (T.ArrayType, T.MapType, T.StructType)


def typed_value(name: str, have: T.DataType, want: T.DataType) -> Column:
    """A column as its declared type; NULL where it has no such value.

    Dates are cleaned as written text: junk and years out of range are NULL. Nested values become JSON text where text is
    declared, and JSON text becomes nested ones.
    """
    column = F.col(f"`{name}`")
    if have == want:
        return column
    if isinstance(want, MOMENTS) and isinstance(have, T.StringType):
        return clean_date(column) if isinstance(want, T.DateType) else clean_timestamp(column).cast(want)
    if isinstance(want, T.StringType) and isinstance(have, NESTED):
        return F.to_json(column)
    if isinstance(want, NESTED) and isinstance(have, T.StringType):
        return F.from_json(column, want)
    return column.try_cast(want)


def judged(df: DataFrame, schema: T.StructType, keys: list[str]) -> DataFrame:
    """The declared columns as declared, with the reason a row is rejected (NULL if it is not) and its dates made NULL.

    A row is rejected for a key that is NULL, or a value other than a date that is not of its type. Columns the rows lack
    are NULL, others are left out. Nothing fails on a bad text.
    """
    have = {f.name: f.dataType for f in df.schema.fields}
    value = {f.name: typed_value(f.name, have[f.name], f.dataType) if f.name in have else F.lit(None).cast(f.dataType) for f in schema.fields}
    # Values stand beside what they were made from, so each is worked out once.
    both = df.select(
        F.struct(*[v.alias(n) for n, v in value.items()]).alias("_new"),
        F.struct(*[F.col(f"`{f.name}`").isNotNull().alias(f.name) if f.name in have else F.lit(False).alias(f.name) for f in schema.fields]).alias("_had"))
    new, lost = (lambda n: F.col(f"_new.`{n}`")), (lambda n: F.col(f"_had.`{n}`") & F.col(f"_new.`{n}`").isNull())
    moments = [f.name for f in schema.fields if isinstance(f.dataType, MOMENTS)]
    reasons = [F.when(lost(f.name), f"bad value: {f.name}") for f in schema.fields if f.name not in moments]
    reasons += [F.when(new(k).isNull(), f"null key: {k}") for k in keys]
    bad = sum((lost(n).cast("long") for n in moments), F.lit(0).cast("long"))
    return both.select(*[new(f.name).alias(f.name, metadata=f.metadata or {}) for f in schema.fields], F.coalesce(*reasons, F.lit(None).cast("string")).alias(REASON), bad.alias(BAD_DATES))


@dataclass(frozen=True)
class Judged:
    """Accepted rows and rejects, both stored, with the counts of the pass."""

    rows: DataFrame
    rejects: DataFrame
    accepted: int
    rejected: int
    bad_dates: int


def split(df: DataFrame, schema: T.StructType, keys: list[str], path: str | None = None) -> Judged:
    """Judge all rows and write them once, accepted and rejected side by side; the counts are observed on the way."""
    path = path or new_folder(df.sparkSession, "judged")
    seen, refused = Observation(), F.col(REASON).isNotNull()
    rows = judged(df, schema, keys).withColumn("_refused", refused)
    rows.observe(
        seen, F.count("*").alias("rows"), F.coalesce(F.sum(refused.cast("long")), F.lit(0)).alias("rejected"), F.coalesce(F.sum(BAD_DATES), F.lit(0)).alias("bad_dates")
    ).write.partitionBy("_refused").parquet(path)
    counts = seen.get
    stored = df.sparkSession.read.schema(rows.schema).parquet(path)
    names = [F.col(f"`{f.name}`") for f in schema.fields]
    return Judged(
        stored.where("NOT _refused").select(*names), stored.where("_refused").select(*names, REASON),
        int(counts["rows"] - counts["rejected"]), int(counts["rejected"]), int(counts["bad_dates"]))


def as_text(df: DataFrame) -> DataFrame:
    """All columns as text, nested ones as JSON: rows as feeds write them."""
    return nested_to_json(df).select(*[F.col(f"`{c}`").cast("string").alias(c) for c in df.columns])
