"""State of connectors, tables and load runs."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millpond.functions.columns import as_column
from millpond.operators.keyed import latest_per_key

# Fixed values.
UNFINISHED = ("created", "running")
RUN_LIMIT = timedelta(seconds=60)
FRESH_FOR = timedelta(hours=1)
LOOK_BACK = timedelta(days=365)


def moment(value: datetime) -> Column:
    return F.lit(value).cast("timestamp_ntz")


def latest_job(jobs: DataFrame, connector: str, created: str, tiebreak: str) -> DataFrame:
    return latest_per_key(jobs, [connector], [created, tiebreak])


def unfinished(state, states=UNFINISHED) -> Column:
    return as_column(state).isin(*states)


def stale(state, updated, as_of: datetime, limit: timedelta = RUN_LIMIT, states=UNFINISHED) -> Column:
    """Unfinished and silent for more than twice the run limit."""
    return unfinished(state, states) & (as_column(updated) < moment(as_of - 2 * limit))


def due(enabled, next_run, as_of: datetime) -> Column:
    next_run = as_column(next_run)
    return as_column(enabled) & (next_run.isNull() | (next_run <= moment(as_of)))


def fresh(synced, as_of: datetime, within: timedelta = FRESH_FOR) -> Column:
    return F.coalesce(as_column(synced) >= moment(as_of - within), F.lit(False))


def high_water_mark(df: DataFrame, ts: str, stored: datetime | None = None, by: list[str] | None = None) -> DataFrame:
    """Largest time seen, never below the stored one, also when no new row came."""
    seen = F.max(ts)
    mark = F.greatest(seen, moment(stored)) if stored else seen
    return df.groupBy(*(by or [])).agg(mark.cast("timestamp_ntz").alias("high_water_mark"))


def table_status(loaded: DataFrame, resource: str, ts: str) -> DataFrame:
    """Freshness rows of the tables that really got rows in this load."""
    return loaded.groupBy(F.col(resource).alias("table_name")).agg(
        F.max(ts).alias("last_synced_at"), F.count("*").alias("rows_written")
    )


def run_totals(load_log: DataFrame, run: str, rows: str) -> DataFrame:
    """Rows per run as the sum of its batches."""
    return load_log.groupBy(run).agg(F.count("*").alias("batches"), F.sum(rows).alias("rows_written"))


def listing_with_status(listing: DataFrame, status: DataFrame) -> DataFrame:
    """Listed tables with the columns of their status row, NULL for a table that no load has written."""
    return listing.join(status, ["schema_name", "table_name"], "left")
