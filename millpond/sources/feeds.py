"""Feeds landed as JSON pages: calendar, mail, channel activity and transaction changes.

A page is one JSON text ``{"items": [...], "nextPageToken": ...}``. A folder of such pages is read by
``spark.read.text(path, wholetext=True)``; the functions take any frame with the page in a column.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millpond.functions.dates import clean_timestamp, epoch_ms_to_datetime, parse_datetime
from millpond.functions.numbers import exact_number
from millpond.operators.keyed import REMOVED, latest_per_key, with_key
from millpond.operators.status import LOOK_BACK, moment

CALENDAR_ITEM = (
    "id string, status string, summary string, created string, updated string, "
    "start struct<date: string, dateTime: string, timeZone: string>, "
    "end struct<date: string, dateTime: string, timeZone: string>"
)
MAIL_ITEM = "id string, threadId string, labelIds array<string>, snippet string, internalDate string"
ACTIVITY_ITEM = (
    "id string, kind string, etag string, "
    "snippet struct<title: string, publishedAt: string, type: string, channelId: string>"
)
ACCOUNT_ITEM = (
    "account_id string, name string, official_name string, type string, subtype string, mask string, "
    "balances struct<available: string, current: string, limit: string, iso_currency_code: string>"
)
# The largest page each API gives.
CALENDAR_PAGE, MAIL_PAGE, ACTIVITY_PAGE = 2500, 100, 50
CANCELLED = "cancelled"


def page_items(pages: DataFrame, page: str, item: str, keep: list[str] | None = None) -> DataFrame:
    """Items of all pages, one row each."""
    schema = f"items array<struct<{_struct(item)}>>, nextPageToken string"
    parsed = pages.withColumn("_page", F.from_json(page, schema))
    return parsed.select(*(keep or []), F.explode("_page.items").alias("item")).select(*(keep or []), "item.*")


def _struct(ddl: str) -> str:
    """``a string, b array<..>`` as the inside of ``struct<..>``."""
    from pyspark.sql.types import StructType

    return StructType.fromDDL(ddl).simpleString()[len("struct<"):-1]


def page_completeness(pages: DataFrame, page: str, keep: list[str], full: int) -> DataFrame:
    """Whether each page says there is more: it has a token and is full."""
    schema = "items array<string>, nextPageToken string"
    parsed = pages.withColumn("_page", F.from_json(page, schema))
    count = F.coalesce(F.size("_page.items"), F.lit(0))
    return parsed.select(
        *keep,
        count.alias("items"),
        (F.col("_page.nextPageToken").isNotNull() & (count >= full)).alias("has_more"),
    )


def calendar_events(items: DataFrame, as_of: datetime, since: datetime | None = None) -> DataFrame:
    """Events that overlap the look-back window and start before now; only updated ones after a first load.

    Deleted events stay in the feed with their status; ``is_deleted`` marks them. They may come without times.
    """
    start = F.coalesce(clean_timestamp("start.dateTime"), clean_timestamp("start.date"))
    end = F.coalesce(clean_timestamp("end.dateTime"), clean_timestamp("end.date"))
    events = items.select(
        "id", "status", "summary", clean_timestamp("created").alias("created"),
        clean_timestamp("updated").alias("updated"), start.alias("start_time"), end.alias("end_time"),
        F.coalesce(F.col("status") == CANCELLED, F.lit(False)).alias("is_deleted"),
        # The window is about instants, whatever zone a time is written in; whole days are days in UTC.
        F.coalesce(parse_datetime("start.dateTime"), parse_datetime("start.date")).alias("_start"),
        F.coalesce(parse_datetime("end.dateTime"), parse_datetime("end.date")).alias("_end"),
        parse_datetime("updated").alias("_updated"),
    ).filter(
        (F.col("_end").isNull() | (F.col("_end") > moment(as_of - LOOK_BACK)))
        & (F.col("_start").isNull() | (F.col("_start") < moment(as_of)))
    )
    if since:
        events = events.filter(F.col("_updated").isNull() | (F.col("_updated") >= moment(since)))
    return events.drop("_start", "_end", "_updated")


def mail_messages(ids: DataFrame, details: DataFrame, as_of: datetime, since: datetime | None = None) -> DataFrame:
    """Listed messages with their details. The bound is in whole seconds, details that could not be fetched
    are left out."""
    bound = (since or as_of - LOOK_BACK).replace(microsecond=0)
    got = ids.filter(F.col("id").isNotNull()).join(details, "id", "inner")
    received = epoch_ms_to_datetime(F.col("internalDate").try_cast("long"))
    return got.withColumn("received", received).filter(F.col("received") > moment(bound))


def channel_activities(items: DataFrame, as_of: datetime, since: datetime | None = None) -> DataFrame:
    published = clean_timestamp("snippet.publishedAt")
    instant = parse_datetime("snippet.publishedAt")
    return items.select(
        "id", "kind", F.col("snippet.title").alias("title"), F.col("snippet.type").alias("activity_type"),
        published.alias("published"), instant.alias("_published"),
    ).filter(F.col("_published") > moment(since or as_of - LOOK_BACK)).drop("_published")


def account_rows(pages: DataFrame, page: str, seq: str) -> DataFrame:
    """Accounts of a transaction feed, one row each: the page with the largest ``seq`` that lists an account decides.

    Balances are exact decimals. An account without an id is left out.
    """
    schema = f"accounts array<struct<{_struct(ACCOUNT_ITEM)}>>"
    listed = pages.select(F.col(seq).alias("_seq"), F.explode(F.from_json(page, schema)["accounts"]).alias("a"))
    rows = listed.select(
        F.col("a.account_id").alias("account_id"), F.coalesce("a.official_name", "a.name").alias("name"), F.col("a.type").alias("kind"), "a.subtype", "a.mask",
        F.col("a.balances.iso_currency_code").alias("currency"), exact_number("a.balances.available").alias("available"),
        exact_number("a.balances.current").alias("current"), exact_number("a.balances.limit").alias("credit_limit"), "_seq")
    return latest_per_key(with_key(rows, ["account_id"]), ["account_id"], ["_seq"]).drop("_seq")


def change_rows(pages: DataFrame, page: str, seq: str, item: str) -> DataFrame:
    """A change feed page (added, modified, removed) as rows ``(change_seq, change_pos, op, ...)`` for a keyed merge.

    Within a page a modification comes after an addition of the same key, and a removal after both.
    """
    inner = _struct(item)
    schema = f"added array<struct<{inner}>>, modified array<struct<{inner}>>, removed array<struct<{inner}>>"
    parsed = pages.select(F.col(seq), F.from_json(page, schema).alias("_page"))
    empty = F.array().cast(f"array<struct<{inner}>>")

    def tagged(op: str):
        return F.transform(
            F.coalesce(F.col(f"_page.{op}"), empty),
            lambda x: F.struct(F.lit(op).alias("op"), x.alias("item")),
        )

    changes = F.concat(tagged("added"), tagged("modified"), tagged(REMOVED))
    rows = parsed.select(F.col(seq), F.posexplode(changes).alias("change_pos", "c"))
    return rows.select(F.col(seq).alias("change_seq"), "change_pos", F.col("c.op").alias("op"), "c.item.*")


def split_by_resource(records: DataFrame, tag: str, resources: list[str]) -> dict[str, DataFrame]:
    """One frame per declared resource out of a tagged record stream."""
    return {r: records.filter(F.col(tag) == r) for r in resources}


def undeclared(records: DataFrame, tag: str, resources: list[str]) -> DataFrame:
    """Counts of records whose tag no resource declares."""
    return (
        records.filter(~F.coalesce(F.col(tag).isin(*resources), F.lit(False)))
        .groupBy(tag)
        .agg(F.count("*").alias("skipped"))
    )
