"""Run a registered query and its SQL side by side and compare the rows.

    python tests/oracle.py [--sf FOLDER] [name ...]
"""

from __future__ import annotations

import math
import os
import sys
import time
from decimal import Decimal
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def connect(folder: str):
    import duckdb

    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    return con


def _plain(value):
    if isinstance(value, float):
        return ("float", "nan") if math.isnan(value) else ("float", repr(value + 0.0))
    if isinstance(value, Decimal):
        return ("decimal", str(value.normalize()))
    return (type(value).__name__, value if value is not None else "")


def normal(rows, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(_plain(r[i]) for i in order) for r in rows), key=repr)


def compare(spark, con, folder: str, build, sql: str) -> str | None:
    """None when equal, else what differs."""
    df = build(spark, folder)
    got_columns = df.columns
    got = normal([tuple(r) for r in df.collect()], got_columns)
    cur = con.execute(sql)
    want_columns = [d[0] for d in cur.description]
    want = normal(cur.fetchall(), want_columns)
    if sorted(got_columns) != sorted(want_columns):
        return f"columns {sorted(got_columns)} != {sorted(want_columns)}"
    if len(got) != len(want):
        return f"rows {len(got)} != {len(want)}"
    if not want:
        return "no rows"
    bad = [(g, w) for g, w in zip(got, want) if g != w]
    return f"{len(bad)} of {len(want)} rows differ, e.g.\n   spark {str(bad[0][0])[:400]}\n   sql   {str(bad[0][1])[:400]}" if bad else None


def main(args: list[str]) -> int:
    import __spark_entry__
    from millpond.session import build_session

    PLANS, SQL = __spark_entry__.queries(), __spark_entry__.oracle_sql()

    folder = "/root/testdata/sf0.01"
    if args[:1] == ["--sf"]:
        folder, args = args[1], args[2:]
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session(
        master=f"local[{cpus}]", **{"spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false", "spark.sql.shuffle.partitions": "8", "spark.driver.memory": "8g"}
    )
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(folder)
    failed = 0
    for name in args or list(PLANS):
        start = time.monotonic()
        try:
            if name in SQL:
                problem = compare(spark, con, folder, PLANS[name], SQL[name])
            else:
                rows = PLANS[name](spark, folder).count()
                problem = None if rows else "no rows"
        except Exception as e:  # report and go on
            problem = f"{type(e).__name__}: {str(e)[:600]}"
        failed += problem is not None
        note = "ok" if problem is None else problem
        print(f"{name:36s} {time.monotonic() - start:6.2f}s {'sql' if name in SQL else 'rows'} {note}", flush=True)
    print(f"{failed} failed")
    spark.stop()
    return failed


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
