from datetime import datetime, timedelta

from millpond.plans import analysis


def test_months_in_which_no_item_is_surely_frequent(spark, tmp_path, as_rows):
    start = datetime(2024, 1, 3)
    rows = [(i, start + timedelta(minutes=i % 30_000), i % 6000, "even", float(i % 97)) for i in range(24_000)]
    # One user has a tenth of the rows of the other type, so it has to be listed.
    rows += [(i, start + timedelta(minutes=i), 7 if i % 10 == 0 else i, "busy", 1.0) for i in range(5000)]
    spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, user_id long, event_type string, value double").write.parquet(str(tmp_path / "events.parquet"))
    got = {r.event_type: r for r in analysis.kept_sketches(spark, str(tmp_path)).collect()}
    assert {k: (r.rows, r.users) for k, r in got.items()} == {"even": (24_000, 6000), "busy": (5000, 4500)}
    assert all(r.users_near and r.median_near and r.p95_near and r.busiest_near for r in got.values())
