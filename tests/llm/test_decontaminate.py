import random

import pytest

from millpond.llm import decontaminate as D


def distance(window, text):
    """Least edits between the window and any part of the text."""
    before = [0] * (len(text) + 1)
    for i, c in enumerate(window):
        row = [i + 1]
        for j, x in enumerate(text):
            row.append(min(before[j] + (x != c), before[j + 1] + 1, row[j] + 1))
        before = row
    return min(before)


def brute(docs, items):
    out = set()
    for i, text in docs:
        text = D.plain(text or "")
        for item, body in items:
            body = D.plain(body or "")
            last = max(0, len(body) - D.WINDOW)
            cut = [body[s : s + D.WINDOW] for s in sorted({*range(0, last, D.STEP), last})] if body else []
            edits = [(f" {w} " not in f" {text} ") * 99 if len(w) < D.Q else distance(w, text) for w in cut]
            good = [e for w, e in zip(cut, edits) if e <= D.budget(len(w))]
            if good:
                out.add((i, item, len(good), min(good)))
    return out


@pytest.fixture(scope="module")
def case():
    rng = random.Random(7)
    word = lambda: "".join(rng.choice("aeinrst") for _ in range(rng.randrange(2, 8)))
    items = [(i, " ".join(word() for _ in range(rng.choice([2, 12, 30, 50])))) for i in range(14)] + [(20, "ab"), (21, ""), (22, None), (23, "?!")]
    docs = [(100, None), (101, ""), (102, "so ab it is"), (103, "abab")]
    for i in range(40):
        body = list(rng.choice(items[:14])[1])
        for _ in range(rng.choice([0, 2, 5, 9, 20])):
            p = rng.randrange(len(body))
            body[p : p + 1] = rng.choice([[], ["q"], ["x", body[p]]])
        docs.append((i, f"{' '.join(word() for _ in range(rng.randrange(30)))} {''.join(body).upper()}!! {word()}"))
    return docs, items


@pytest.mark.parametrize("block", [10_000, 7])
def test_finds_what_alignment_of_all_finds(spark, docs_of, case, block, monkeypatch):
    docs, items = case
    monkeypatch.setattr(D.blocks, "__defaults__", (block,))
    benchmark = spark.createDataFrame([(*x, "t") for x in items], "item_id long, text string, window string")
    got = {tuple(r) for r in D.leaks(docs_of(docs, extra=True), benchmark).collect()}
    want = brute(docs, items)
    assert got == want and len(want) > 15
    left = D.clean(docs_of(docs, extra=True), benchmark)
    assert {r.doc_id for r in left.collect()} == {i for i, _ in docs} - {w[0] for w in want}
    assert left.columns == docs_of(docs, extra=True).columns


def test_odd_rows(spark, docs_of, odd_rows):
    benchmark = spark.createDataFrame([(1, "seven wizards quietly mix potent boxes")], "item_id long, text string")
    got = D.leaks(docs_of(odd_rows), benchmark).collect()
    assert sorted(((r.doc_id, r.n_windows, r.edits) for r in got), key=repr) == sorted([(4, 1, 0), (5, 1, 0), (None, 1, 0)], key=repr)
    assert D.clean(docs_of(odd_rows), benchmark).count() == len(odd_rows) - 4
    none = spark.createDataFrame([], "item_id long, text string")
    assert D.leaks(docs_of(odd_rows), none).collect() == [] and D.clean(docs_of(odd_rows), none).count() == len(odd_rows)
    assert D.leaks(docs_of([]), benchmark).collect() == []


def test_a_long_repetitive_text_takes_bounded_memory(monkeypatch):
    import tracemalloc

    item = D.plain("ha " * 160)
    last = len(item) - D.WINDOW
    rows = [(1, s, item[s : s + D.WINDOW]) for s in sorted({*range(0, last, D.STEP), last})]
    index = D.Index(rows)
    few = index.find(["ha " * 600, "hu " * 600])
    monkeypatch.setattr(D, "HITS", 1000)
    assert index.find(["ha " * 600, "hu " * 600]) == few and few[0][1][0] == len(rows) and few[1] == {}
    monkeypatch.undo()
    tracemalloc.start()
    found = index.find(["ha " * 60_000])
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert found[0][1][0] == len(rows) and peak < 700 << 20


def test_a_region_stays_in_its_text():
    window = "abcdefghij" * 10
    index = D.Index([(1, 0, window)])
    assert index.find([window[:-1], "j of the next text"]) == [{1: [1, 1]}, {}]
    assert index.find(["text before a", window[1:]]) == [{}, {1: [1, 1]}]


def test_columns_of_the_documents_may_clash(spark, docs_of):
    from pyspark.sql import functions as F

    docs = docs_of([(1, "seven wizards quietly mix potent boxes"), (2, "nothing")], extra=True).withColumns({c: F.lit("x") for c in ["item_id", "n_windows", "edits", "window", "start"]})
    benchmark = spark.createDataFrame([(1, "seven wizards quietly mix potent boxes", "x")], "item_id long, text string, doc_id string")
    assert [tuple(r) for r in D.leaks(docs, benchmark).collect()] == [(1, 1, 1, 0)]
    left = D.clean(docs, benchmark)
    assert left.columns == docs.columns and [r.doc_id for r in left.collect()] == [2]


def test_a_quote_of_the_stated_length_is_found_wherever_it_starts():
    rng = random.Random(9)
    item = "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(433))
    last = len(item) - D.WINDOW
    index = D.Index([(1, s, item[s : s + D.WINDOW]) for s in sorted({*range(0, last, D.STEP), last})])
    found = lambda n: [bool(x) for x in index.find([item[s : s + n] for s in range(len(item) - n + 1)])]
    assert all(found(D.WINDOW + D.STEP - 1))
    assert not all(found(D.WINDOW))
