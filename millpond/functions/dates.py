"""Date parsing, cleaning, relative periods and axis labels."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column
from pyspark.sql import functions as F

from millpond.functions.columns import as_column

# Stored dates must have a year from 1000 to 9999. The pattern of the year says so, which saves
# parsing a value again just to look at its year.
STORED_YEAR = r"[1-9]\d{3}"
ANY_YEAR = r"\d{4,6}"
# Plain numbers are epoch milliseconds only between 2000-01-01 and 2100-01-01.
FIRST_EPOCH_MS, LAST_EPOCH_MS = 946_684_800_000, 4_102_444_800_000

# What a text looks like, and its format; `Y` stands for the year. The look is tested first: a cast alone would
# complete a bare time of day with today's date, and a failed parse costs far more than a test.
ISO_LOOK = r"^Y(-\d{2}(-\d{2}([T ].*)?)?)?$"
# Parts in brackets may be missing; the longer form of two comes first.
GENERAL_FORMATS = (
    (r"^[A-Z][a-z]{2,8} \d{1,2}, Y( \d{1,2}:\d{2}(:\d{2})?( [AP]M)?)?$", "[MMMM][MMM] d, yyyy[ h:mm:ss a][ h:mm a][ HH:mm:ss]"),
    (r"^\d{1,2}/\d{1,2}/Y(,? \d{1,2}:\d{2}(:\d{2})?( [AP]M)?)?$", "M/d/yyyy[,][ h:mm:ss a][ h:mm a][ HH:mm:ss][ H:mm]"),
    (r"^\d{1,2} [A-Z][a-z]{2,8} Y( \d{2}:\d{2}:\d{2})?$", "d [MMMM][MMM] yyyy[ HH:mm:ss]"),
    (r"^Y/\d{1,2}/\d{1,2}( \d{2}:\d{2}:\d{2})?$", "yyyy/M/d[ HH:mm:ss]"),
)
# The date of a mail header: a day of the week that says nothing new, and a zone at the end.
MAIL_LOOK = r"^[A-Z][a-z]{2}, \d{1,2} [A-Z][a-z]{2} Y \d{2}:\d{2}:\d{2} (GMT|UTC|UT|Z|[+-]\d{4})( \([A-Z]+\))?$"
MAIL_FORMAT = "d MMM yyyy HH:mm:ss"
BASIC_LOOK, BASIC_FORMAT = r"^Y\d{2}\d{2}$", "yyyyMMdd"

# Label patterns of a time axis.
TIME_ONLY = "h:mm a"
DATE_WITH_TIME = "MMM d, h:mm a"
DATE_WITH_YEAR = "MMM d, yyyy"
DATE_ONLY = "MMM d"


def _parsed(text: Column, iso_type: str, year: str) -> Column:
    text = F.trim(text)
    looks = lambda pattern: text.rlike(pattern.replace("Y", year))
    iso = F.when(looks(ISO_LOOK), text.try_cast(iso_type)).cast("timestamp_ntz")
    general = [
        F.when(looks(look), F.try_to_timestamp(text, F.lit(f))).cast("timestamp_ntz") for look, f in GENERAL_FORMATS
    ]
    # Without a zone the written time of day is kept; with one it becomes the instant.
    written = F.regexp_extract(text, r"^[A-Za-z]+, (.*?) (?:[A-Z]+|[+-]\d{4})(?: \([A-Z]+\))?$", 1)
    if iso_type == "timestamp":
        zone = F.regexp_replace(F.regexp_extract(text, r":\d{2} ([A-Z]+|[+-]\d{4})", 1), "^[A-Z]+$", "+0000")
        mail = F.try_to_timestamp(F.concat_ws(" ", written, zone), F.lit(MAIL_FORMAT + " Z"))
        general.append(F.when(looks(BASIC_LOOK.replace("Y", r"\d{4}")), F.try_to_timestamp(text, F.lit(BASIC_FORMAT))).cast("timestamp_ntz"))
    else:
        mail = F.try_to_timestamp(written, F.lit(MAIL_FORMAT))
    return F.coalesce(iso, *general, F.when(looks(MAIL_LOOK), mail).cast("timestamp_ntz"))


def parse_datetime(col) -> Column:
    """Text to a point in time: ISO first, then common written forms, else NULL.

    A zone offset is applied, so the result is the instant in the session's time zone.
    """
    return _parsed(as_column(col), "timestamp", ANY_YEAR)


def epoch_ms_to_datetime(col) -> Column:
    """Numbers to a point in time, NULL outside 2000..2100."""
    ms = as_column(col).cast("long")
    return F.when(ms.between(FIRST_EPOCH_MS, LAST_EPOCH_MS), F.timestamp_millis(ms).cast("timestamp_ntz"))


def clean_timestamp(col) -> Column:
    """Text to a stored timestamp: zone offset dropped, junk and years outside 1000..9999 NULL."""
    return _parsed(as_column(col), "timestamp_ntz", STORED_YEAR)


def clean_date(col) -> Column:
    return clean_timestamp(col).cast("date")


def run_time_ms(started, finished, as_of: datetime) -> Column:
    """Milliseconds from start to finish, to ``as_of`` while running, 0 before the start."""
    started, finished = as_column(started), as_column(finished)
    end = F.coalesce(finished, F.lit(as_of).cast("timestamp_ntz"))
    spent = F.timestamp_diff("MILLISECOND", started, end)
    return F.when(started.isNull(), F.lit(0).cast("long")).otherwise(spent)


def day_of_month(col, as_of: datetime) -> Column:
    """Day number in the month of ``as_of``, clamped to the month's length."""
    today = F.lit(as_of.date())
    day = F.least(F.greatest(as_column(col).cast("int"), F.lit(1)), F.dayofmonth(F.last_day(today)))
    return F.make_date(F.lit(as_of.year), F.lit(as_of.month), day)


# How far back each named range of a running chart reaches, in months; None is everything.
RANGE_MONTHS = {"1M": 1, "3M": 3, "6M": 6, "1Y": 12, "All": None}


def in_range(col, label: str, as_of: datetime) -> Column:
    """Inside the named range that ends at ``as_of``; plain literals, so the scan can skip files."""
    col = as_column(col)
    upper = col <= F.lit(as_of).cast("timestamp_ntz")
    months = RANGE_MONTHS[label]
    if months is None:
        return upper
    return (col > F.lit(_months_before(as_of, months)).cast("timestamp_ntz")) & upper


def _months_before(moment: datetime, months: int) -> datetime:
    total = moment.year * 12 + moment.month - 1 - months
    year, month = divmod(total, 12)
    for day in (moment.day, 30, 29, 28):
        try:
            return moment.replace(year=year, month=month + 1, day=day)
        except ValueError:
            continue
    raise ValueError(moment)


def period_bounds(label: str, as_of: datetime) -> tuple[datetime, datetime]:
    """Half-open bounds of "last week", "this month", "past quarter" and alike, seen from ``as_of``."""
    which, unit = label.lower().split()
    midnight = as_of.replace(hour=0, minute=0, second=0, microsecond=0)
    if unit == "week":
        from datetime import timedelta

        start = midnight - timedelta(days=midnight.weekday())
        step = lambda m, n: m + timedelta(days=7 * n)
    elif unit in ("month", "quarter", "year"):
        size = {"month": 1, "quarter": 3, "year": 12}[unit]
        first_month = (midnight.month - 1) // size * size + 1
        start = midnight.replace(month=first_month, day=1)
        step = lambda m, n: _months_before(m, -size * n)
    else:
        raise ValueError(f"unknown period: {label}")
    if which == "this":
        return start, step(start, 1)
    if which in ("last", "past", "previous"):
        return step(start, -1), start
    raise ValueError(f"unknown period: {label}")


def axis_pattern(col) -> Column:
    """Aggregate: the label pattern that fits the time values of one axis.

    Distinct years and days are decided from the extremes, so no distinct count is needed.
    """
    ts = as_column(col).cast("timestamp_ntz")
    low, high = F.min(ts), F.max(ts)
    has_time = F.coalesce(F.bool_or((F.hour(ts) != 0) | (F.minute(ts) != 0)), F.lit(False))
    return (
        F.when(low.isNull(), DATE_WITH_YEAR)
        .when(has_time & (low.cast("date") == high.cast("date")), TIME_ONLY)
        .when(has_time, DATE_WITH_TIME)
        .when(F.year(low) != F.year(high), DATE_WITH_YEAR)
        .otherwise(DATE_ONLY)
    )
