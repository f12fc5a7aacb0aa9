"""Message parts: ``array<struct<type, text, data>>``."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from millpond.functions.columns import as_column

# Part types that carry an artifact, and the one that is never shown.
ARTIFACT_PARTS = ("data-ui-bundle", "data-report-bundle")
HIDDEN_PART = "step-start"


def message_text(parts) -> Column:
    """Text parts joined by a space, empty without any."""
    texts = F.transform(
        F.filter(as_column(parts), lambda p: p["type"] == "text"),
        lambda p: F.coalesce(p["text"], F.lit("")),
    )
    return F.coalesce(F.array_join(texts, " "), F.lit(""))


def has_part(parts, part_type: str) -> Column:
    return F.coalesce(F.exists(as_column(parts), lambda p: p["type"] == part_type), F.lit(False))


def artifacts(parts, types=ARTIFACT_PARTS) -> Column:
    """Data of the artifact parts, in order; parts without data are left out."""
    wanted = F.filter(as_column(parts), lambda p: p["type"].isin(*types) & p["data"].isNotNull())
    return F.coalesce(F.transform(wanted, lambda p: p["data"]), F.array().cast("array<string>"))


def visible_parts(parts) -> Column:
    return F.filter(as_column(parts), lambda p: p["type"] != HIDDEN_PART)
