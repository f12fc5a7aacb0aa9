import math
import random

import numpy as np
from pyspark.sql import functions as F

from millpond.llm import whitening

SCHEMA = "vec_id long, embedding array<float>, label int"


def plain(rows, components=32):
    """Row by row over the whole fit list: deviation, and |whitened| and explained of each component."""
    kept = [(i, [math.floor(64 * float(np.float32(c))) + 1_000_000 for c in v]) for i, v, _ in rows if v is not None and v and all(c is not None and math.isfinite(c) for c in v)]
    x = np.array([v for _, v in kept], object)
    n, total = len(kept), x.sum(axis=0)
    far = n * x - total
    d = (far / n).astype(float)
    values, vectors = np.linalg.eigh(d.T @ d / n)
    values, vectors = values[::-1][:components], vectors[:, ::-1][:, :components]
    white = d @ vectors / np.sqrt(values)
    return [(i, n, int((f * f).sum()), np.abs(w)) for (i, _), f, w in zip(kept, far, white)], values / np.trace(d.T @ d / n)


def check(found, rows, components=32):
    want, explained = plain(rows, components)
    got = {}
    for r in found:
        got.setdefault((r.vec_id, r.deviation, r.n), []).append((r.component, abs(r.whitened), r.explained, r.identity_error))
    assert sum(len(v) for v in got.values()) == sum(len(w) for *_, w in want)
    for i, n, deviation, white in want:
        own = sorted(set(got[i, deviation, n]))
        assert [c for c, *_ in own] == list(range(1, len(white) + 1))
        assert np.allclose([w for _, w, *_ in own], white, rtol=1e-7, atol=1e-9)
        assert np.allclose([e for _, _, e, _ in own], explained, rtol=1e-9)
        assert own[0][3] <= 1e-4


def test_small_table_equals_a_plain_version(spark, small):
    df = spark.read.parquet(f"{small}/embeddings.parquet")
    check(whitening.report(df).collect(), [tuple(r) for r in df.select("vec_id", "embedding", "label").collect()])


def test_copies_count_as_often_as_they_occur(spark):
    r = random.Random(2)
    base = [[r.gauss(0, 1) for _ in range(5)] for _ in range(30)]
    rows = [(i, base[0] if i % 3 == 0 else r.choice(base), 0) for i in range(400)]  # a third is one vector
    rows += [(1000, None, 0), (1001, [1.0, None, 1.0, 1.0, 1.0], 0), (1002, [math.nan, 0.0, 0.0, 0.0, 0.0], 0), (1003, [math.inf] + [0.0] * 4, 0)]
    rows += [(0, base[0], 0), (0, base[0], 0)]  # wholly repeated rows
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    assert whitening.distinct_vectors(whitening.quantised(df)).count() <= 30
    check(whitening.report(df).collect(), rows)
    clash = df.withColumns({c: F.lit(1) for c in ["x", "id", "n", "component", "whitened", "deviation", "explained"]})
    check(whitening.report(clash).collect(), rows)


def test_odd_tables(spark):
    make = lambda rows: spark.createDataFrame(rows, SCHEMA)
    assert whitening.report(make([])).collect() == []
    assert whitening.report(make([(1, [0.5, 0.25], 0)])).collect() == []  # no variance, nothing to whiten
    assert whitening.report(make([(1, None, 0), (2, [], 0), (3, [3e38, 1.0], 0)])).collect() == []
    # A dimension without variance has no component; a vector of another length is left out.
    rows = [(i, [float(i), 1.0, float(i * i % 7)], 0) for i in range(20)]
    found = whitening.report(make([*rows, (99, [1.0], 0), (None, [2.0, 1.0, 4.0], 0)])).collect()
    assert {r.component for r in found} == {1, 2} and {r.vec_id for r in found} == {*range(20), None}
    # Beyond 64 bits sums stay exact, and a deviation too large for a long is null.
    far = whitening.report(make([(1, [1e16], 0), (2, [-1e16], 0)])).collect()
    assert [r.deviation for r in far] == [None, None] and sorted(r.whitened for r in far) == [-1.0, 1.0]
