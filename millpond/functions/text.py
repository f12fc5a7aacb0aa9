"""Identifiers, report blocks, tokens and JSON paths."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from millpond.functions.columns import as_column

# The fences a report uses.
SUMMARY_FENCE = r"```summary\s*\n([\s\S]*?)```"
CHART_FENCE = r"```chart\s*\n([\s\S]*?)\n```"
CHART_SCHEMA = "type string, dataQueryName string, keyColumnName string, seriesColumnNames array<string>"
ERROR_LENGTH = 500

WORD_BREAK = r"[^a-z0-9]+"


def slug(col) -> Column:
    """Lower case, every run of other characters one underscore, none at the ends."""
    return F.btrim(F.regexp_replace(F.lower(as_column(col)), WORD_BREAK, "_"), F.lit("_"))


def slug_id(col) -> Column:
    """Slug with a six-character suffix; taken from a hash, so a re-run gives the same id."""
    return F.concat_ws("_", slug(col), F.substring(F.md5(as_column(col).cast("binary")), 1, 6))


def clean_identifier(col) -> Column:
    """Dots and dashes to underscores, lower case."""
    return F.lower(F.translate(as_column(col), ".-", "__"))


def schema_name(connector_id: str) -> str:
    return re.sub(r"[.-]", "_", connector_id)


def table_name(resource: str) -> str:
    return resource.lower()


def strip_whitespace(col) -> Column:
    """Strip white space of every kind; ``trim`` would leave newlines."""
    return F.regexp_replace(as_column(col), r"^\s+|\s+$", "")


def summary_block(col) -> Column:
    """Content of the first summary fence, empty without one."""
    return strip_whitespace(F.regexp_extract(F.coalesce(as_column(col), F.lit("")), SUMMARY_FENCE, 1))


def chart_blocks(col) -> Column:
    """Raw content of every chart fence."""
    return F.regexp_extract_all(as_column(col), F.lit(CHART_FENCE), F.lit(1))


def strip_reasoning(col) -> Column:
    return F.regexp_replace(as_column(col), r"(?s)<reasoning>.*?</reasoning>", "")


def error_text(col, length: int = ERROR_LENGTH) -> Column:
    text = F.coalesce(as_column(col), F.lit("Unknown error occurred"))
    cut = F.concat(F.substring(text, 1, length - 3), F.lit("..."))
    return F.when(F.length(text) > length, cut).otherwise(text)


def words(col) -> Column:
    """Lower-case words of letters and digits, in order. The first and last may be empty; drop those after
    exploding, where a filter is compiled code."""
    return F.split(F.lower(F.coalesce(as_column(col), F.lit(""))), WORD_BREAK)


def query_terms(query: str) -> list[str]:
    """Distinct words of a search text, in order. Symbols separate words and mean nothing else."""
    return list(dict.fromkeys(w for w in re.split(WORD_BREAK, query.lower()) if w))


def any_word(terms: list[str]) -> str:
    """Pattern of whole words in lower-case text. Terms are letters and digits only."""
    return rf"(?<![a-z0-9])(?:{'|'.join(terms)})(?![a-z0-9])"


def word_count(col, terms: list[str]) -> Column:
    """How often any of the words occurs: one pass over the text for all of them, no array of words is built."""
    return F.regexp_count(F.lower(F.coalesce(as_column(col), F.lit(""))), F.lit(any_word(terms)))


def has_word(col, terms: list[str]) -> Column:
    return F.lower(F.coalesce(as_column(col), F.lit(""))).rlike(any_word(terms))


def contains_text(columns, needle: str) -> Column:
    """Case-insensitive substring test over several columns."""
    needle = needle.lower()
    hits = [F.lower(as_column(c)).contains(needle) for c in columns]
    found = hits[0]
    for hit in hits[1:]:
        found = found | hit
    return found


def json_value(col, path: str) -> Column:
    return F.get_json_object(as_column(col), path)


def camel_case(name: str) -> str:
    """Method name of a query: words joined, the first in lower case."""
    words = re.findall(r"[A-Z]{2,}(?![a-z])|[A-Z]?[a-z]+|[A-Z]|\d+", name)
    if not words:
        return ""
    return words[0].lower() + "".join(w.lower().capitalize() for w in words[1:])
