import random
import time
from collections import Counter

import numpy as np
import pytest

from millpond.llm import neardup


def bag(text):
    w = text.lower().split()
    return Counter(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else Counter()


def similarity(a, b):
    return sum((a & b).values()) / max(1, sum((a | b).values()))


def brute(rows):
    """doc -> smallest id of its class, by all pairs."""
    texts = sorted({t or "" for _, t in rows})
    bags = [bag(t) for t in texts]
    parent = list(range(len(texts)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(texts)):
        for j in range(i):
            if bags[i] and bags[j] and similarity(bags[i], bags[j]) >= 0.8:
                parent[root(i)] = root(j)
    at = {t: root(i) for i, t in enumerate(texts)}
    least = {}
    for i, t in rows:
        r = at[t or ""]
        if i is not None:
            least[r] = min(least.get(r, i), i)
    return sorted(((i, least.get(at[t or ""])) for i, t in rows), key=repr)


def family(seed, n, edits, length=300):
    rng = random.Random(seed)
    words = [f"w{rng.randrange(10**6)}" for _ in range(length)]
    out = []
    for _ in range(n):
        copy = words.copy()
        for _ in range(rng.randrange(edits + 1)):
            copy[rng.randrange(length)] = f"x{rng.randrange(10**6)}"
        out.append(" ".join(copy))
    return out


def test_signature_is_an_unbiased_estimate_for_weighted_sets():
    rng = np.random.default_rng(1)
    errors = []
    for _ in range(200):
        keys = np.sort(rng.integers(0, 2**63, 60).astype(np.uint64))
        a, b = (rng.choice([1, 1, 2, 3, 7, 40], 60) for _ in range(2))
        keep = rng.random(60) < 0.9
        x, y = neardup.signatures([(keys, a), (keys[keep], b[keep])])
        truth = np.minimum(a, b)[keep].sum() / (np.maximum(a, b)[keep].sum() + a[~keep].sum())
        errors.append((x == y).mean() - truth)
    assert abs(np.mean(errors)) < 0.01 and np.std(errors) < 0.06


def test_small_and_heavy_bags_fill_all_components():
    shingles = neardup.Shingles()
    rows = neardup.signatures([shingles("one"), shingles("b " * 20_000), shingles("a b c d e f g")])
    assert (rows != 0).all() and len(set(rows[0])) > 100


def test_classes_equal_all_pairs(spark, docs_of, small, odd_rows):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{small}/documents.parquet").collect()]
    got = neardup.report(docs_of(rows, extra=True)).collect()
    assert sorted(((r.doc_id, r.class_id) for r in got), key=repr) == brute(rows)
    odd = neardup.report(docs_of(odd_rows)).collect()
    assert sorted(((r.doc_id, r.class_id) for r in odd), key=repr) == brute(odd_rows)
    assert neardup.report(docs_of([])).collect() == []


@pytest.mark.parametrize("small_bucket", [32, 16])
def test_hot_families_are_whole(docs_of, monkeypatch, small_bucket):
    monkeypatch.setattr(neardup, "SMALL", small_bucket)
    texts = family(1, 60, 6) + family(2, 40, 12) + ["same text of six words here"] * 50 + family(3, 30, 1, 40)
    rows = list(enumerate(texts, 1000))
    random.Random(3).shuffle(rows)
    got = neardup.report(docs_of(rows)).collect()
    assert sorted((r.doc_id, r.class_id) for r in got) == brute(rows)
    assert all(r.n_copies == 50 for r in got if 1100 <= r.doc_id < 1150)


def test_a_large_family_near_the_limit_equals_all_pairs(docs_of):
    rng = random.Random(7)
    base = [f"w{i}" for i in range(300)]
    rows = []
    for i in range(1200):
        copy = base.copy()
        for at in rng.sample(range(300), 3 if i % 20 == 0 else 5):
            copy[at] = f"x{rng.randrange(10**9)}"
        rows.append((i, " ".join(copy)))
    bags = [bag(t) for _, t in rows]
    assert max(max(b.values()) for b in bags) == 1
    known = {s: k for k, s in enumerate(set().union(*bags))}
    held = np.zeros((len(rows), len(known)), np.float32)
    for i, b in enumerate(bags):
        held[i, [known[s] for s in b]] = 1
    both, size = held @ held.T, held.sum(axis=1)
    near = both >= 0.8 * (size[:, None] + size - both)
    want = np.arange(len(rows))
    while (new := np.where(near, want, len(rows)).min(axis=1)).tolist() != want.tolist():
        want = new
    assert 100 < len(set(want.tolist())) < 1000
    got = {r.doc_id: r.class_id for r in neardup.report(docs_of(rows)).collect()}
    assert [got[i] for i in range(len(rows))] == want.tolist()


def bucket(spark, label, bands=None):
    """One bucket, band number 3, whose texts have equal signatures."""
    members = spark.createDataFrame([(1, 3, bytearray(t)) for t in label], "band long, no int, th binary")
    labels = spark.createDataFrame([(bytearray(t), bytearray(x)) for t, x in label.items()], "node binary, label binary")
    own = lambda t: (bands or {}).get(t, [-ord(t[:1]) * 100 - t[-1], -ord(t[:1]) * 100 - t[-1] - 50, -t[-1], 1])
    nodes = spark.createDataFrame([(bytearray(t), bytearray(192), own(t), 800) for t in label], "th binary, signature binary, bands array<long>, size long")
    return members, labels, nodes


def paired(x, y):
    return {x.side, y.side} == {0, 1} or x.side == y.side == 2


def test_every_pair_across_classes_counts_in_one_block(spark, monkeypatch):
    monkeypatch.setattr(neardup, "BLOCK", 4)
    label = {bytes([i]): bytes([0 if i < 30 else i]) for i in range(50)}
    members, labels, nodes = bucket(spark, label)
    dealt = neardup.blocks(members, labels, nodes)
    met, several = Counter(), neardup.gathered(dealt).collect()
    for r in several:
        for x in r.g:
            for y in r.g:
                if x.label != y.label and bytes(x.th) < bytes(y.th) and paired(x, y):
                    met[bytes(x.th), bytes(y.th)] += 1
    assert len(several) > 5 and met == Counter((x, y) for x in label for y in label if x < y and label[x] != label[y])
    # All have equal signatures, so all that meet somebody go on.
    went = {(r.i, r.j, bytes(r.th)) for r in neardup.hopeful(dealt, nodes).collect()}
    assert went == {(r.i, r.j, bytes(x.th)) for r in several for x in r.g if any(x.label != y.label and paired(x, y) for y in r.g)}


def test_a_pair_goes_on_in_its_first_common_bucket_only(spark):
    label = {b"a1": b"a1", b"a2": b"a1", b"b1": b"b1", b"c1": b"c1"}
    members, labels, nodes = bucket(spark, label, {b"a1": [7, 0, 2, 1], b"a2": [8, 1, 3, 1], b"b1": [7, 2, 4, 1], b"c1": [9, 0, 5, 1]})
    went = {bytes(r.th) for r in neardup.hopeful(neardup.blocks(members, labels, nodes), nodes).collect()}
    assert went == {b"a2", b"b1", b"c1"}  # a1 has met both others before, in bands 0 and 1


def test_a_block_gives_out_only_links_that_join_classes():
    rng = np.random.default_rng(4)
    for _ in range(30):
        base = rng.integers(0, 2**63, 50, dtype=np.uint64)
        bags = [np.unique(np.concatenate([rng.choice(base, rng.integers(30, 50), replace=False), rng.integers(0, 2**63, rng.integers(0, 6), dtype=np.uint64)])) for _ in range(25)]
        label, side = np.unique(rng.integers(0, 12, 25), return_inverse=True)[1], rng.choice([0, 1] if rng.random() < 0.5 else [2], 25)
        sets = [set(b.tolist()) for b in bags]
        near = [(i, j) for i in range(25) for j in range(25) if i != j and label[i] != label[j] and (side[i] == side[j] == 2 or {side[i], side[j]} == {0, 1}) and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])]
        found = neardup.joining(bags, label, side)
        assert set(found) <= set(near) and len(found) < max(1, len(set(label.tolist())))

        def classes(pairs):
            own = list(range(label.max() + 1))
            for i, j in pairs:
                own = [own[label[i]] if x == own[label[j]] else x for x in own]
            return [own.index(x) for x in own]

        assert classes(found) == classes(near)


def test_a_family_of_thousands_below_the_limit_makes_few_rows(spark, docs_of):
    """4000 texts near 0.76: eight million likely pairs, hardly a link."""
    rng = random.Random(11)
    base = [f"w{i}" for i in range(300)]
    rows = []
    for i in range(4000):
        copy = base.copy()
        for at in rng.sample(range(300), 4):
            copy[at] = f"x{rng.randrange(10**9)}"
        rows.append((i, " ".join(copy)))
    start = time.time()
    got = {r.doc_id: r.class_id for r in neardup.report(docs_of(rows)).collect()}
    assert time.time() - start < 240
    # Checked against all pairs of a part, and every class against its members.
    bags = [set(bag(t)) for _, t in rows]
    for i in rng.sample(range(4000), 40):
        near = [j for j in range(4000) if len(bags[i] & bags[j]) >= 0.8 * len(bags[i] | bags[j])]
        assert len({got[j] for j in near}) == 1


def test_one_row_of_each_class_stays(docs_of, odd_rows):
    docs = docs_of(odd_rows + [(20, t) for t in family(5, 3, 2)] + [(21, None)], extra=True)
    left = neardup.deduplicate(docs)
    assert left.columns == docs.columns
    classes = {c for _, c in brute([(r.doc_id, r.text) for r in docs.collect()])}
    assert sorted(r.doc_id for r in left.collect()) == sorted(classes)


def test_components_of_a_path_and_a_star(spark):
    edges = [(f"{i:04d}", f"{i + 1:04d}") for i in range(60)] + [("5000", f"6{i:03d}") for i in range(200)]
    df = spark.createDataFrame([(bytearray(a, "ascii"), bytearray(b, "ascii")) for a, b in edges], "a binary, b binary")
    got = {bytes(r.node): bytes(r.label) for r in neardup.components(df).collect()}
    assert set(got.values()) == {b"0000", b"5000"} and len(got) == 262
