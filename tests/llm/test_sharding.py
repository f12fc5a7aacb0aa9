import itertools
import zlib
from collections import Counter

import pytest

from millpond.llm import sharding


@pytest.mark.parametrize("dims, bits", [(2, 3), (3, 2), (3, 3)])
def test_curve_visits_each_point_once_in_single_steps(spark, dims, bits):
    points = spark.createDataFrame(list(itertools.product(range(1 << bits), repeat=dims)), [f"d{i}" for i in range(dims)])
    rows = sorted((r.curve, tuple(r[:dims])) for r in sharding.hilbert_index(points, points.columns, bits).collect())
    assert [c for c, _ in rows] == list(range(1 << (dims * bits)))
    assert all(sum(abs(p - q) for p, q in zip(a[1], b[1])) == 1 for a, b in zip(rows, rows[1:]))


def check(rows, docs):
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in rows) == Counter((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in docs)
    n = Counter(r.shard for r in rows)
    counts = [n[s] for s in range(16)]
    assert max(counts) - min(counts) <= 1
    for s in n:
        assert sorted(r.slot for r in rows if r.shard == s) == list(range(n[s]))
    # Runs of the curve: shards follow each other along it.
    ordered = sorted(rows, key=lambda r: (r.shard, r.slot))
    assert all(a.curve <= b.curve for a, b in zip(ordered, ordered[1:]))
    assert {(r.law, r.grown_shard) for r in rows} <= {("rows", None)}


def test_law_holds_for_odd_and_hot_rows(docs_of, odd_rows):
    check(sharding.hilbert_shards(docs_of(odd_rows, extra=True)).collect(), odd_rows)
    hot = [(i, "same text") for i in range(500)] + [(7, "twice")] * 40 + [(i, f"text {i}" * (i % 9)) for i in range(600, 903)]
    check(sharding.hilbert_shards(docs_of(hot)).collect(), hot)
    assert sharding.hilbert_shards(docs_of([])).collect() == []


def test_text_quantiles_follow_the_whole_value(spark):
    values = ["same long beginning " + v for v in ["a"] * 500 + ["b"] * 100 + [f"c{i:03d}" for i in range(200)]] + [""] * 3
    df = spark.createDataFrame([(v,) for v in values], "v string")
    ordered = sorted(values)
    want = [ordered[-(-i * len(values) // 8) - 1] for i in range(1, 8)]
    assert sharding.text_quantiles(df, "v", 8) == want and len(set(want)) == 3
    assert sharding.text_quantiles(df.limit(0), "v", 8) == []


def test_main_path_is_native(docs_of, odd_rows):
    plan = sharding.hilbert_shards(docs_of(odd_rows))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


@pytest.mark.parametrize("prefix", ["", "https://www.example.org/crawl/"])
def test_shards_prune(spark, small, prefix):
    from pyspark.sql import functions as F

    docs = spark.read.parquet(f"{small}/documents.parquet").withColumn("source", F.concat(F.lit(prefix), "source"))
    rows = sharding.hilbert_shards(docs).join(docs.select("doc_id", "lang", "source"), "doc_id").collect()
    spread = lambda of: sum(len({of(r) for r in rows if r.shard == s}) for s in range(16)) / 16
    assert spread(lambda r: r.lang) < 0.75 * len({r.lang for r in rows}) and spread(lambda r: r.source) < 0.6 * len({r.source for r in rows})
