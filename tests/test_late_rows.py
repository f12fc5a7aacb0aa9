from millpond.operators import search


def test_a_load_with_late_rows_is_written_once(spark, keyed_table, tmp_path, as_rows):
    table = keyed_table("id long, v string, seq int", ["id"])
    load = lambda *rows: table.upsert(spark.createDataFrame(list(rows), "id long, v string, seq int"), seq=["seq"])
    load((1, "a", 5), (2, "a", 5), (3, "a", 5))
    done = load((1, "late", 4), (2, "b", 6), (4, "b", 1))
    assert done.rows == 3 and as_rows(done.staged, "id", "v") == [(1, "late"), (2, "b"), (4, "b")]
    assert as_rows(table.read(), "id", "v") == [(1, "a"), (2, "b"), (3, "a"), (4, "b")]
    assert len(list((tmp_path / "t" / "data").iterdir())) == 2  # one folder for each load
    assert load((1, "late", 3), (3, "late", 3)).rows == 2
    table.compact()
    assert as_rows(table.read(), "id", "v") == [(1, "a"), (2, "b"), (3, "a"), (4, "b")]
    assert load((4, "c", 2)).rows == 1 and as_rows(table.read(), "id", "v")[-1] == (4, "c")


def test_words_are_unpacked_without_a_function_for_each(spark):
    docs = spark.createDataFrame([(1, "b a", "a a c"), (2, None, "c"), (3, "d", None), (3, "d", ""), (4, None, None)], "id long, n string, d string")
    index = search.term_index(docs, "id", "n", "d")
    got = {(r.term, r.id): (r.name_count, r.description_count) for r in index.collect()}
    assert got == {("a", 1): (1, 2), ("b", 1): (1, 0), ("c", 1): (0, 1), ("c", 2): (0, 1), ("d", 3): (2, 0)}
    assert "lambda" not in index._jdf.queryExecution().executedPlan().toString()
