"""Number parsing and defaults."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from millpond.functions.columns import as_column


def parse_number(col) -> Column:
    """A number, or NULL for text that is none (NaN included)."""
    number = as_column(col).try_cast("double")
    return F.when(~F.isnan(number), number)


def exact_number(col) -> Column:
    """Number as a wide decimal, so that no digit is lost on the way to the table."""
    return as_column(col).try_cast("decimal(38,10)")


def number_or_zero(col) -> Column:
    return F.coalesce(parse_number(col), F.lit(0.0))


def label_or_item(label, position) -> Column:
    """The label, or "Item n" by position (from 0) when it is missing or empty."""
    text = as_column(label).cast("string")
    fallback = F.concat(F.lit("Item "), (as_column(position) + 1).cast("string"))
    return F.coalesce(F.when(text != "", text), fallback)


def numeric_share(col) -> Column:
    """Aggregate: the share of rows whose value is a number."""
    return F.avg(F.when(parse_number(col).isNotNull(), 1.0).otherwise(0.0))


def y_range_top(*cols) -> Column:
    """Aggregate: upper end of the value axis, 110 % of the largest value, 100 without any."""
    tops = [F.max(parse_number(c)) for c in cols]
    top = F.greatest(*tops) if len(tops) > 1 else tops[0]
    return F.coalesce(F.ceil(top * 1.1).cast("long"), F.lit(100).cast("long"))
