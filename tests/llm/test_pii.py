import hashlib
import random
import re

from millpond.llm import pii

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(m):
    d = [int(c) for c in m if c.isdigit()][::-1]
    return sum(x if i % 2 == 0 else sum(divmod(2 * x, 10)) for i, x in enumerate(d)) % 10 == 0


def base(text):
    out = []
    for k, pattern in enumerate(PATTERNS.values()):
        for m in re.finditer(pattern, text or ""):
            s, n = m.group(), sum(c.isdigit() for c in m.group())
            if [True, k != 1 or all(int(p) <= 255 for p in s.split(".")), 12 <= n <= 19 and luhn(s), 9 <= n <= 15][k]:
                out.append((m.start(), k, m.end()))
    return sorted(out)


def written(found):
    return ",".join(f"{pii.KINDS[k]}:{s}:{e}" for s, k, e in found)


def test_base_spans_equal_a_plain_version(docs_of, odd_rows):
    rng = random.Random(11)
    texts = ["a@b.c_d@e.f.g@h.i", "1.2.3.4.5.6.7.8.9", "256.1.1.1 001.02.3.4", "é🙂 a.b@c.d-e.fr, 4111 1111 1111 1111!", "a" * 30_000 + "@x.y", "1" * 30_000, "+1" + "(" * 5000 + "5"]
    texts += ["".join(rng.choice("0123456789.+-() @ab_%é\n") for _ in range(rng.randrange(200))) for _ in range(700)]
    texts += ["".join(rng.choice("01234.+- @a") for _ in range(rng.randrange(60))) for _ in range(700)]
    rows = odd_rows + [(100 + i, t) for i, t in enumerate(texts)]
    got = pii.report(docs_of(rows, extra=True)).collect()
    want = sorted(((i, hashlib.sha256(written(base(t)).encode()).hexdigest(), *(sum(k == x for _, x, _ in base(t)) for k in range(4))) for i, t in rows), key=repr)
    assert sorted(((r.doc_id, r.base_sha256, r.n_email, r.n_ip, r.n_card, r.n_phone) for r in got), key=repr) == want
    by_id = {i: t for i, t in rows if i and i >= 100}
    for r in got:
        if r.doc_id in by_id:
            assert set(filter(None, written(base(by_id[r.doc_id])).split(","))) <= set(r.spans.split(","))
    assert pii.report(docs_of([])).collect() == []


def test_reliabilities_find_the_good_labelers():
    rng = random.Random(5)
    counts = {}
    for _ in range(4000):
        truth = rng.random() < 0.4
        vote = lambda right: (1 if truth else -1) * (1 if rng.random() < right else -1)
        v = (vote(0.95), vote(0.9), vote(0.5), vote(0.85), 0)
        counts[v] = counts.get(v, 0) + 1
    counts = sorted(counts.items())
    post = pii.reliabilities(counts)
    assert post[1, 1, 1, 1, 0] > 0.95 and post[-1, -1, 1, -1, 0] < 0.05
    assert abs(post[1, 1, 1, 1, 0] - post[1, 1, -1, 1, 0]) < 0.05
    w = pii.classifier(counts, post)
    assert w[3] > w[1] and w[6] > w[4] and abs(w[9] - w[7]) < abs(w[6] - w[4])


def test_votes_add_what_the_rules_miss_and_context_decides(docs_of):
    good = [(i, f"please pay by visa card {n} today") for i, n in enumerate(["4111111111111111", "5500005555555559"] * 40)]
    typo = [(500, "please pay by visa card 4111111111111112 today")]
    other = [(600 + i, f"order hash x{10**11 + i * 7919}y end") for i in range(40)]
    got = {r.doc_id: r for r in pii.report(docs_of(good + typo + other)).collect()}
    assert got[500].n_card == 0 and got[500].spans == "card:24:40"
    assert not any(got[i].spans for i, _ in other if not got[i].n_card)


def test_mask(docs_of):
    docs = docs_of([(1, "mail a.b@c.de or +1 (017) 555-7713, é 10.0.0.1"), (2, "clean text"), (3, None), (4, "")], extra=True)
    got = pii.mask(docs)
    assert got.columns == docs.columns
    assert {r.doc_id: (r.text, r.n_chars) for r in got.collect()} == {1: ("mail [EMAIL] or [PHONE], é [IP]", 31), 2: ("clean text", 10), 3: (None, None), 4: ("", 0)}


def test_main_path_is_native(docs_of, odd_rows):
    plan = pii.candidates(docs_of(odd_rows))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
