import random

from pyspark.sql import functions as F

from millpond.operators import timelines
from tests.test_intervals import SPAN


def test_totals_equal_the_sums_over_all_pairs(spark):
    r = random.Random(8)
    lengths = [0, 1, 59_999, 60_000, 60_001, 500_000, 4_000_000, 10**9, 10**15]

    def some(n, first):
        out = []
        for i in range(n):
            start = r.choice([0, r.randrange(-10**6, 10**6), r.randrange(10**9), 60_000 * r.randrange(50)])
            out.append((r.choice(["hot"] * 4 + ["a", "b"]), first + i, start, start + r.choice(lengths)))
        return out + [(None, first + 900, 0, 5), ("a", first + 901, None, 5), ("a", first + 902, 5, None), ("a", first + 903, 9, 3), out[0], out[0]]

    left, right = (spark.createDataFrame(some(*a), SPAN) for a in ((150, 0), (120, 1000)))
    shared = F.least("left.end_ms", "right.end_ms") - F.greatest("left.start_ms", "right.start_ms")
    pairs = timelines.overlaps(left, right, ["k"], "start_ms", "end_ms")
    want = pairs.groupBy("right.id").agg(F.count("*").alias("n"), F.sum(shared).alias("ms"))
    got = timelines.overlaps(left, right, ["k"], "start_ms", "end_ms", totals=True)
    # A right row that comes twice has its totals twice, as it has its pairs twice.
    got = got.groupBy("right.id").agg(F.sum("pairs").alias("n"), F.sum("shared_ms").alias("ms"))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    assert timelines.overlaps(left.limit(0), right, ["k"], "start_ms", "end_ms", totals=True).count() == 0


def test_a_thousand_million_pairs_are_added_up_not_made(spark):
    ms = 1_700_000_000_000
    left = spark.range(100_000).select(F.lit("k").alias("k"), "id", F.lit(ms).alias("start_ms"), (F.lit(ms + 86_400_000) + F.col("id")).alias("end_ms"))
    right = spark.range(10_000).select(F.lit("k").alias("k"), "id", (F.lit(ms - 5) + F.col("id")).alias("start_ms"), F.lit(ms + 3_600_000).alias("end_ms"))
    got = timelines.overlaps(left, right, ["k"], "start_ms", "end_ms", totals=True)
    row = got.agg(F.count("*"), F.min("pairs"), F.max("pairs"), F.max("shared_ms")).first()
    assert tuple(row) == (10_000, 100_000, 100_000, 100_000 * 3_600_000)
