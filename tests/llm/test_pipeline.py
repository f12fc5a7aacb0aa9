import hashlib

import corpus_pipeline
import duckdb
import pytest
from tests.llm.test_bpe import expected
from tests.llm.test_neardup import brute as classes
from tests.llm.test_pii import base

from millpond.llm.decontaminate import STEP, WINDOW, Index, plain
from millpond.llm.queries import QUERIES, SQL


def test_rows_equal_a_plain_version(spark, small):
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{small}/{t}.parquet'")
    texts = dict(con.execute("SELECT doc_id, text FROM documents").fetchall())
    kept = [(i, texts[i]) for (i,) in con.execute(f"SELECT doc_id FROM ({SQL['op4_quality']}) WHERE kept ORDER BY 1").fetchall()]
    first = {c for _, c in classes(kept)}
    kept = [(i, t) for i, t in kept if i in first]
    items = con.execute("SELECT item_id, text FROM benchmark").fetchall()
    rows = []
    for item, text in items:
        t = plain(text)
        last = max(0, len(t) - WINDOW)
        rows += [(item, s, t[s : s + WINDOW]) for s in sorted({*range(0, last, STEP), last})]
    dirty = {i for (i, _), found in zip(kept, Index(rows).find([t for _, t in kept])) if found}
    exact = {i for i, t in kept for _, b in items if plain(b) in plain(t)}
    assert exact <= dirty
    kept = {i: t for i, t in kept if i not in dirty}
    got = {r.doc_id: r for r in corpus_pipeline.run(spark, small).collect()}
    assert set(got) == set(kept)
    for i, text in kept.items():
        if base(text):
            continue  # masked; see below
        ids, decoded = expected(text)
        r = got[i]
        if r.n_tokens == len(ids):
            assert r.ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
    clean = [i for i, t in kept.items() if not any(c.isdigit() for c in t)]
    assert clean and all(got[i].n_tokens == len(expected(kept[i])[0]) for i in clean)


def test_stages_keep_the_columns(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, small).dtypes == docs.dtypes, name


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_every_query_runs_on_the_given_tables(spark, small, name):
    assert QUERIES[name](spark, small).columns


@pytest.mark.parametrize("name", sorted(SQL))
def test_queries_equal_their_sql(spark, small, name):
    from tests.oracle import compare, connect

    assert compare(spark, connect(small), small, QUERIES[name], SQL[name]) is None
