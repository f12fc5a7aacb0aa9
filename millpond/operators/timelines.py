"""Operators along time: idle gaps, as-of values, look-back counts, running totals, trends.

One key may hold a large part of all rows, so no window here runs over all rows of a key. Rows are split by
(key, time slice); what a slice needs from earlier slices is carried over by a second window that sees one
row per slice.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

HOUR_MS = 3_600_000
# Fixed value: a stream is closed after this time without a chunk.
IDLE_MS = 60_000


def epoch_ms(ts: str) -> Column:
    """Zone-less time as epoch milliseconds, cut to the millisecond."""
    return F.unix_millis(F.col(ts).cast("timestamp"))


def idle_sessions(
    df: DataFrame, by: list[str], ts: str, idle_ms: int = IDLE_MS, slice_ms: int = HOUR_MS
) -> DataFrame:
    """Sessions per key: a gap of at least ``idle_ms`` closes one.

    Rows are counted per millisecond first, which bounds a slice to ``slice_ms`` rows however hot its key is.
    Rows without a key or a time belong to no session.
    """
    points = (
        df.dropna(subset=[*by, ts])
        .groupBy(*by, epoch_ms(ts).alias("_t"))
        .agg(F.count("*").alias("_n"))
        .withColumn("_slice", F.col("_t") - F.pmod(F.col("_t"), F.lit(slice_ms)))
        .filter(F.col("_slice").isNotNull())
    )
    in_slice = W.partitionBy(*by, "_slice").orderBy("_t")
    over_slices = W.partitionBy(*by).orderBy("_slice")

    # Starts inside a slice need nothing from outside; only its first row does.
    local = points.withColumn(
        "_start", F.when(F.col("_t") - F.lag("_t").over(in_slice) >= idle_ms, F.col("_t"))
    ).withColumn("_start", F.last("_start", ignorenulls=True).over(in_slice))
    # The sum keeps the columns of both uses of `local` alike, so that they share one shuffle.
    slices = (
        local.groupBy(*by, "_slice")
        .agg(
            F.min("_t").alias("_first"), F.max("_t").alias("_last"), F.max("_start").alias("_inner"),
            F.sum("_n").alias("_rows"),
        )
        .withColumn("_gap", F.col("_first") - F.lag("_last").over(over_slices))
        .withColumn("_opens", F.when(F.col("_gap").isNull() | (F.col("_gap") >= idle_ms), F.col("_first")))
        .withColumn(
            "_before",
            F.last(F.coalesce("_inner", "_opens"), ignorenulls=True).over(
                over_slices.rowsBetween(W.unboundedPreceding, -1)
            ),
        )
        .select(*by, "_slice", F.coalesce("_opens", "_before").alias("_open"), "_rows")
    )
    started = local.join(slices.filter("_rows > 0"), [*by, "_slice"])
    return started.groupBy(*by, F.coalesce("_start", "_open").alias("session_start_ms")).agg(
        F.max("_t").alias("session_end_ms"), F.sum("_n").alias("rows")
    )


def as_of_join(
    left: DataFrame, right: DataFrame, by: list[str], ts: str, values: list[str], slice_unit: str = "minute"
) -> DataFrame:
    """Each left row with the values of the latest right row of its key that is not later.

    Both sides have ``by`` and ``ts``. Of right rows with one time the largest values win. Every left row stays;
    one without a key or a time finds nothing.
    """
    right = right.dropna(subset=[*by, ts])
    # Rows that can find nothing go round the windows, where they would all be one group.
    known = F.forall(F.array(*[F.col(c).isNotNull() for c in [*by, ts]]), lambda x: x)
    types = {f.name: f.dataType for f in right.schema.fields}
    lost = left.filter(~known).select(*left.columns, *[F.lit(None).cast(types[c]).alias(n) for c, n in [(ts, f"as_of_{ts}"), *((v, v) for v in values)]])
    left = left.filter(known)
    payload = F.struct(F.col(ts), *[F.col(v) for v in values])
    left_columns = left.columns
    rows = left.select(F.lit(1).alias("_side"), *left_columns, F.lit(None).alias("_right")).unionByName(
        right.select(F.lit(0).alias("_side"), *by, ts, payload.alias("_right")), allowMissingColumns=True
    ).withColumn("_slice", F.date_trunc(slice_unit, F.col(ts)).cast("timestamp_ntz"))

    in_slice = W.partitionBy(*by, "_slice").orderBy(ts, "_side", "_right").rowsBetween(W.unboundedPreceding, 0)
    over_slices = W.partitionBy(*by).orderBy("_slice").rowsBetween(W.unboundedPreceding, -1)
    carried = rows.groupBy(*by, "_slice").agg(F.max("_right").alias("_latest")).select(
        *by, "_slice", F.last("_latest", ignorenulls=True).over(over_slices).alias("_carried")
    )
    found = (
        rows.withColumn("_local", F.last("_right", ignorenulls=True).over(in_slice))
        .filter("_side = 1")
        .join(carried, [*by, "_slice"], "left")
        .withColumn("_found", F.coalesce("_local", "_carried"))
    )
    found = found.select(
        *left_columns, F.col(f"_found.{ts}").alias(f"as_of_{ts}"), *[F.col(f"_found.{v}").alias(v) for v in values]
    )
    return found.unionAll(lost)


# Cells of interval joins: the finest is one minute, each level is eight times as wide, the last one has no bound.
CELL_MS, CELL_FACTOR, CELL_LEVELS = 60_000, 8, 12


def _celled(df: DataFrame, by: list[str], start: str, end: str, side: str) -> DataFrame:
    """One row for each cell an interval lies in, at the finest level where it lies in at most two, and all coarser ones."""
    width = lambda level: F.lit(CELL_MS) * F.pow(F.lit(CELL_FACTOR), level).cast("long")
    length = F.col(end) - F.col(start)
    own = F.lit(CELL_LEVELS)
    for level in reversed(range(CELL_LEVELS)):
        own = F.when(length <= CELL_MS * CELL_FACTOR**level, level).otherwise(own)
    at = lambda ms, level: F.floor(F.col(ms) / width(level)).cast("long")
    cells = F.transform(
        F.sequence(F.col("_own"), F.lit(CELL_LEVELS)),
        lambda level: F.when(level == CELL_LEVELS, F.array(F.lit(0).cast("long"))).otherwise(F.sequence(at(start, level), at(end, level))))
    valid = df.filter(F.col(start).isNotNull() & F.col(end).isNotNull() & (F.col(start) <= F.col(end)))
    rows = valid.withColumn("_own", own).select(
        *[F.col(k).alias(f"_k{n}") for n, k in enumerate(by)], F.struct(*df.columns).alias(f"_{side}"),
        F.col(start).alias(f"_{side}_start"), F.col(end).alias(f"_{side}_end"), F.col("_own").alias(f"_{side}_level"),
        F.posexplode(cells).alias("_step", "_cells"))
    return rows.withColumn("_level", F.col(f"_{side}_level") + F.col("_step")).withColumn("_cell", F.explode("_cells")).drop("_step", "_cells")


def overlaps(left: DataFrame, right: DataFrame, by: list[str], start: str, end: str, totals: bool = False) -> DataFrame:
    """Pairs of intervals (milliseconds, both ends inclusive) of one key that have a moment in common: ``left``, ``right``.

    Both sides are dealt to time cells and joined on key and cell. An interval lies in at most two cells of each level from
    the first that is as wide as it is long; two intervals meet at the wider one's level, in the cell where the later start
    lies. So a pair is found once, and what a task gets of a busy key is bounded by time. Intervals without a bound, or that
    end before they start, have no partner.

    With ``totals`` the pairs are added up and not made: each ``right`` row that has a partner, the number of its
    partners (``pairs``), and the milliseconds it shares with them (``shared_ms``).
    """
    if totals:
        return _overlap_totals(left, right, by, start, end)
    a, b = _celled(left, by, start, end, "left"), _celled(right, by, start, end, "right")
    keys = [*[f"_k{n}" for n in range(len(by))], "_level", "_cell"]
    met = a.join(b, keys).filter(
        (F.col("_level") == F.greatest("_left_level", "_right_level"))
        & (F.col("_left_start") <= F.col("_right_end")) & (F.col("_right_start") <= F.col("_left_end")))
    later = F.greatest("_left_start", "_right_start")
    width = F.lit(CELL_MS) * F.pow(F.lit(CELL_FACTOR), F.col("_level")).cast("long")
    first = (F.col("_level") == CELL_LEVELS) | (F.col("_cell") == F.floor(later / width).cast("long"))
    return met.filter(first).select(F.col("_left").alias("left"), F.col("_right").alias("right"))


def _overlap_totals(
    left: DataFrame, right: DataFrame, by: list[str], start: str, end: str, slice_ms: int = CELL_MS
) -> DataFrame:
    """Sums over all pairs of an interval join, from running sums along time.

    Partners of a right interval are the left ones that start up to its end, less those that end before its start. The time
    shared is the area below the number of open left intervals, between both ends. At a time t that area is t times the
    open ones, less the sum of their starts, plus that of the ends gone by. Starts and ends are counted per millisecond, and
    the sums are kept per (key, time slice) and carried over. What is carried is decimal: times multiplied by rows are too
    large for a long.
    """
    keys = [f"_k{n}" for n in range(len(by))]
    bounds = lambda df: df.filter(F.col(start) <= F.col(end)).dropna(subset=by).select(
        *[F.col(k).alias(n) for n, k in zip(keys, by)], F.col(start).cast("long").alias("_start"), F.col(end).cast("long").alias("_end"))
    none, big = F.lit(0).cast("long"), "decimal(38,0)"
    # An ask at a start is put before the ends of its millisecond, which still meet it, and one at an end behind the starts.
    counted = bounds(left).select(*keys, F.explode(F.array(
        F.struct(F.col("_start").alias("_at"), F.lit(1).cast("long").alias("_n")),
        F.struct(F.col("_end").alias("_at"), F.lit(-1).cast("long").alias("_n")),
    )).alias("p")).groupBy(*keys, F.col("p._at").alias("_at")).agg(
        F.sum(F.greatest("p._n", none)).alias("_opened"), F.sum(F.greatest(-F.col("p._n"), none)).alias("_closed"))
    asked = bounds(right).distinct()
    points = (
        asked.select(*keys, "_start", "_end", F.explode(F.array(
            F.struct(F.col("_start").alias("_at"), F.lit(0).alias("_order")), F.struct(F.col("_end").alias("_at"), F.lit(2).alias("_order")),
        )).alias("p")).select(*keys, "p.*", none.alias("_opened"), none.alias("_closed"), "_start", "_end")
        .unionByName(counted.withColumn("_order", F.lit(1)), allowMissingColumns=True)
        .withColumn("_in", F.pmod("_at", F.lit(slice_ms)))
        .withColumn("_slice", F.col("_at") - F.col("_in"))
        # Times inside a slice are small numbers, so their sums stay longs.
        .withColumn("_moved", (F.col("_opened") - F.col("_closed")) * F.col("_in"))
    )
    in_slice = W.partitionBy(*keys, "_slice").orderBy("_at", "_order").rowsBetween(W.unboundedPreceding, 0)
    over_slices = W.partitionBy(*keys).orderBy("_slice").rowsBetween(W.unboundedPreceding, -1)
    zero = F.lit(0).cast(big)
    per_slice = points.groupBy(*keys, "_slice").agg(F.sum("_opened").alias("_opened"), F.sum("_closed").alias("_closed"), F.sum("_moved").alias("_moved"))
    carried = per_slice.withColumn(
        "_times", (F.col("_slice").cast("decimal(19,0)") * (F.col("_opened") - F.col("_closed")).cast("decimal(18,0)")).cast(big) + F.col("_moved").cast("decimal(19,0)")
    ).select(
        *keys, "_slice", F.coalesce(F.sum("_opened").over(over_slices), none).alias("_opened_before"),
        F.coalesce(F.sum("_closed").over(over_slices), none).alias("_closed_before"),
        F.coalesce(F.sum(F.col("_times").cast("decimal(28,0)")).over(over_slices), zero).alias("_times_before"))
    summed = points.select(
        *keys, "_slice", "_at", "_in", "_order", "_start", "_end",
        *[F.sum(c).over(in_slice).alias(c) for c in ("_opened", "_closed", "_moved")]).filter("_order <> 1")
    found = summed.join(carried, [*keys, "_slice"])
    open_before = (F.col("_opened_before") - F.col("_closed_before")).cast("decimal(18,0)")
    area = (
        (F.col("_at").cast("decimal(19,0)") * open_before).cast(big) - F.col("_times_before").cast(big)
        + (F.col("_in") * (F.col("_opened") - F.col("_closed")) - F.col("_moved")).cast(big))
    at_end = F.col("_order") == 2
    answers = found.groupBy(*keys, "_start", "_end").agg(
        F.sum(F.when(at_end, F.col("_opened_before") + F.col("_opened")).otherwise(-F.col("_closed_before") - F.col("_closed"))).alias("pairs"),
        (F.max(F.when(at_end, area)) - F.max(F.when(~at_end, area))).cast("long").alias("shared_ms"),
    ).filter("pairs > 0")
    rows = right.select(F.struct(*right.columns).alias("right"), *[F.col(k).alias(n) for n, k in zip(keys, by)], F.col(start).cast("long").alias("_start"), F.col(end).cast("long").alias("_end"))
    return rows.join(answers, [*keys, "_start", "_end"]).select("right", "pairs", "shared_ms")


def counts_before(
    df: DataFrame, by: list[str], ts: str, is_counted: Column, is_asking: Column, within_seconds: int,
    slice_seconds: int = 60,
) -> DataFrame:
    """For each asking row, how many counted rows of its key lie within the seconds before it (inclusive).

    A range join without pairs: the answer is the running count up to the row less the one up to the start of
    its range. Both are read off one running count per key, kept per (key, time slice) and carried over.
    """
    width, slice_us = within_seconds * 1_000_000, slice_seconds * 1_000_000
    rows = df.withColumn("_us", F.unix_micros(F.col(ts).cast("timestamp")))
    keyed = rows.dropna(subset=[*by, "_us"])
    counted = keyed.filter(is_counted).groupBy(*by, "_us").agg(F.count("*").alias("_n"))
    asked = keyed.filter(is_asking).select(*by, "_us").distinct()
    none = F.lit(0).cast("long")
    points = (
        asked.select(*by, F.explode(F.array(
            F.struct((F.col("_us") - width).alias("_at"), F.lit(0).alias("_order"), none.alias("_n"), F.col("_us").alias("_ask"), F.lit(-1).alias("_sign")),
            F.struct(F.col("_us").alias("_at"), F.lit(2).alias("_order"), none.alias("_n"), F.col("_us").alias("_ask"), F.lit(1).alias("_sign")),
        )).alias("p")).select(*by, "p.*")
        .unionByName(counted.select(
            *by, F.col("_us").alias("_at"), F.lit(1).alias("_order"), "_n", F.lit(None).cast("long").alias("_ask"), F.lit(0).alias("_sign")))
        .withColumn("_slice", F.col("_at") - F.pmod(F.col("_at"), F.lit(slice_us)))
    )
    in_slice = W.partitionBy(*by, "_slice").orderBy("_at", "_order").rowsBetween(W.unboundedPreceding, 0)
    over_slices = W.partitionBy(*by).orderBy("_slice").rowsBetween(W.unboundedPreceding, -1)
    carried = points.groupBy(*by, "_slice").agg(F.sum("_n").alias("_n")).select(
        *by, "_slice", F.coalesce(F.sum("_n").over(over_slices), none).alias("_before")
    )
    answers = (
        points.withColumn("_sum", F.sum("_n").over(in_slice))
        .filter("_order <> 1")
        .join(carried, [*by, "_slice"])
        .groupBy(*by, F.col("_ask").alias("_us"))
        .agg(F.sum(F.col("_sign") * (F.col("_sum") + F.col("_before"))).alias("rows_before"))
    )
    return rows.filter(is_asking).join(answers, [*by, "_us"], "left").select(
        *df.columns, F.coalesce("rows_before", none).alias("rows_before")
    )


def running_total(df: DataFrame, by: list[str], ts: str, value: Column, grain: str = "day") -> DataFrame:
    """Running sum per key along time. Rows are summed per period first, so a window sees one row per period."""
    period = F.date_trunc(grain, F.col(ts)).cast("timestamp_ntz").alias("period")
    totals = df.groupBy(*by, period).agg(F.sum(value).alias("amount"))
    w = W.partitionBy(*by).orderBy("period").rowsBetween(W.unboundedPreceding, 0)
    return totals.withColumn("running_total", F.sum("amount").over(w))


def period_change(df: DataFrame, by: list[str], ts: str, value: Column, grain: str = "week") -> DataFrame:
    """Sum per period and its change against the period before that has rows."""
    period = F.date_trunc(grain, F.col(ts)).cast("timestamp_ntz").alias("period")
    totals = df.groupBy(*by, period).agg(F.sum(value).alias("amount"))
    w = W.partitionBy(*by).orderBy("period")
    before = F.lag("amount").over(w)
    return totals.withColumn("previous", before).withColumn("change", F.col("amount") - F.col("previous"))


def share_per_period(df: DataFrame, ts: str, category: str, value: Column, grain: str = "month") -> DataFrame:
    """Sum per period and category, and its percentage of the period."""
    period = F.date_trunc(grain, F.col(ts)).cast("timestamp_ntz").alias("period")
    totals = df.groupBy(period, category).agg(F.sum(value).alias("amount"))
    # A join, not a window: a period may have any number of categories.
    whole = totals.groupBy("period").agg(F.sum("amount").alias("_whole"))
    shares = totals.join(whole, "period").withColumn("percentage", F.try_divide(F.col("amount") * 100.0, "_whole"))
    return shares.drop("_whole")


def windowed_counts(df: DataFrame, ts: str, by: list[str], size: str, slide: str | None = None) -> DataFrame:
    """Tumbling or sliding windows; works on batch and streaming frames."""
    return (
        df.groupBy(F.window(ts, size, slide or size), *by)
        .agg(F.count("*").alias("rows"))
        .select(
            F.col("window.start").cast("timestamp_ntz").alias("window_start"),
            F.col("window.end").cast("timestamp_ntz").alias("window_end"),
            *by,
            "rows",
        )
    )
