import random
import re

from millpond.llm import quality


def measures(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    seen = {}
    for i in range(len(words) - 2):
        seen.setdefault(tuple(words[i : i + 3]), []).append(i)
    covered = {i + j for at in seen.values() if len(at) > 1 for i in at for j in range(3)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered)


def test_counts_equal_a_plain_version(docs_of, odd_rows):
    rng = random.Random(2)
    rows = odd_rows + [(100 + i, "".join(rng.choice(["a", "b", "cc", " ", " ", "\n", "#", "|", "\x0b", "\x1c", "é"]) for _ in range(rng.randrange(400)))) for i in range(300)]
    got = quality.judge(docs_of(rows, extra=True)).collect()
    assert len(got) == len(rows)
    want = sorted(((i, *measures(t)) for i, t in rows), key=repr)
    assert sorted(((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in got), key=repr) == want
    for r in got:
        assert r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words)
    assert quality.judge(docs_of([])).collect() == []


def test_boilerplate_depletes_but_copies_do_not(docs_of):
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(6))
    prose = lambda n: " ".join(word() for _ in range(n))
    menu = [prose(12) for _ in range(6)]
    own = [(i, prose(60)) for i in range(100)]
    depleted = [(1000 + i, "\n".join([*menu, prose(10)])) for i in range(400)]
    framed = [(2000 + i, "\n".join([menu[0], prose(70)])) for i in range(40)]
    text = prose(80).split()
    copies = [(3000 + i, " ".join(text)) for i in range(60)]
    near = [(4000 + i, "\n".join([" ".join(text[:40]), " ".join(text[40:] + [f"w{i}"])])) for i in range(60)]
    got = {r.doc_id: r.kept for r in quality.judge(docs_of(own + depleted + framed + copies + near)).collect()}
    assert not any(got[i] for i, _ in depleted)
    assert all(got[i] for i, _ in own + framed + copies + near)
    docs = docs_of(own + depleted, extra=True)
    left = quality.keep(docs)
    assert left.columns == docs.columns and sorted(r.doc_id for r in left.collect()) == sorted(i for i, _ in own)


def test_a_passage_counts_every_document_that_holds_it(docs_of):
    rng = random.Random(4)
    prose = lambda n: " ".join("".join(rng.choice("abcdefghij") for _ in range(6)) for _ in range(n))
    passage = prose(200)
    rows = [(i, f"{passage}\n{prose(1)}") for i in range(30)] + [(100 + i, f"{passage.upper()} \n same") for i in range(50)] + [(200, f"{passage}\nsame")]
    seen = quality.features(docs_of(rows))
    assert seen.select("_document").distinct().count() == 31
    assert quality.frequent_lines(seen, line_docs=30).count() == 1
    assert quality.frequent_lines(seen, line_docs=31).count() == 0


def test_main_path_is_native(docs_of, odd_rows):
    plan = quality.features(docs_of(odd_rows))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_a_kept_document_loses_its_frequent_lines(docs_of):
    rng = random.Random(5)
    prose = lambda n: " ".join("".join(rng.choice("abcdefghij") for _ in range(6)) for _ in range(n))
    menu, own = prose(60), [prose(40) + "\n\n" + prose(40) for _ in range(30)]
    docs = docs_of([(i, f"{menu}\n{x}\n {menu.upper()}") for i, x in enumerate(own)] + [(None, f"{own[0]}\n{menu}")] * 2 + [(50, prose(80)), (51, menu), (52, None)], extra=True)
    want = {**dict(enumerate(own)), None: own[0]}
    left = quality.keep(docs)
    assert left.dtypes == docs.dtypes
    got = left.collect()
    assert len(got) == 33
    for r in got:
        assert r.doc_id == 50 or r.text == want[r.doc_id]
        assert r.n_chars == len(r.text)


def test_a_line_is_frequent_at_a_small_and_at_a_hot_source(spark):
    seen = spark.sql("""
        SELECT if(id < 500, 'small', 'hot') AS _host, id AS _document,
               array(named_struct('h', CASE WHEN id < 25 OR id BETWEEN 1000 AND 1249 THEN -1 WHEN id BETWEEN 2000 AND 2149 THEN -2 WHEN id BETWEEN 480 AND 499 THEN -3 ELSE id END, 'n', 400)) AS _lines
        FROM range(30000)""")
    assert {(r["_host"], r.h) for r in quality.frequent_lines(seen).collect()} == {("small", -1), ("hot", -1)}


def plain_kept(rows):
    """doc -> kept, document by document and line by line; rows are (doc_id, text, source)."""
    from collections import Counter, defaultdict

    space = " \t\n\x0b\f\r"
    split = lambda text: [x for x in re.split(r"[\x20\x09-\x0D]+", text) if x]
    normal = lambda line: " ".join(split(line)).lower()
    holders, hosts = defaultdict(set), defaultdict(set)
    for _, text, host in rows:
        whole = " ".join(split(text or "")).lower()
        hosts[host or ""].add(whole)
        for line in {normal(x) for x in (text or "").split("\n") if x.strip(space)}:
            holders[host or "", line].add(whole)
    often = {key for key, docs in holders.items() if len(docs) > 20 and (len(docs) > 200 or 100 * len(docs) > 2 * len(hosts[key[0]]))}
    out = Counter()
    for i, text, host in rows:
        n_words, *_, again = measures(text)
        lines = [x for x in (text or "").split("\n") if x.strip(space)]
        lost = sum(len(x.strip(space)) for x in lines if (host or "", normal(x)) in often)
        total = sum(len(x.strip(space)) for x in lines)
        out[i, n_words >= 50 and 100 * again <= 50 * n_words and 100 * lost <= 70 * total] += 1
    return out


def test_verdicts_equal_a_plain_version(spark):
    from collections import Counter

    rng = random.Random(9)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(5))
    prose = lambda n: " ".join(word() for _ in range(n))
    menus = [[prose(rng.choice([10, 30, 60])) for _ in range(4)] for _ in range(6)]
    rows = []
    for i in range(3000):
        host = rng.choice(["hot", "hot", "a", "b", None, ""])  # two thirds of the rows at few hosts
        held = [x if rng.random() < 0.5 else x.upper() + " " for x in rng.choice(menus) if rng.random() < 0.8] if rng.random() < 0.3 else []
        rows.append((i, "\n".join(rng.sample(held + [prose(rng.choice([5, 20, 60]))], len(held) + 1)), host))
    rows += [(5000 + i, rows[7][1], "a") for i in range(40)] + [(9000, None, "a"), (None, "", None), rows[3], rows[3]]
    for i in range(260):  # frequent by number, not by share
        rows.append((6000 + i, f"{menus[0][0]} same\n{prose(3)}", "big"))
    rows += [(20_000 + i, prose(55), "big") for i in range(14_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(6)
    got = Counter((r.doc_id, r.kept) for r in quality.judge(docs).select("doc_id", "kept").collect())
    want = plain_kept(rows)
    assert got == want and 1000 < sum(n for (_, kept), n in want.items() if not kept) and any(6000 <= (i or 0) < 6260 and not kept for i, kept in want)
