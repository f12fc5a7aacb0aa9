import bisect
import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from millpond.llm import alignment
from millpond.llm.perfect_hash import PerfectHash, block_of, build

FILES = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def plain_tokens():
    """Bytes and ids of both sides, by the libraries the files are made for."""
    a = Tokenizer.from_file(FILES[0])
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=FILES[1])
    keep = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letters = {chr(x): x for x in keep} | {chr(256 + i): x for i, x in enumerate(x for x in range(256) if x not in keep)}

    def tokens(text):
        if not text:
            return [], []
        one = [(i, bytes(letters[c] for c in a.id_to_token(i))) for i in a.encode(" " + text, add_special_tokens=False).ids]
        two = []
        for i in b.encode(text):
            piece = b.id_to_piece(i)
            two.append((i, bytes([int(piece[3:5], 16)]) if b.is_byte(i) else piece.replace("▁", " ").encode()))
        raw = (" " + text).encode()
        return (one, two) if b"".join(x for _, x in one) == b"".join(x for _, x in two) == raw else ([], [])

    return tokens


def plain(rows, tokens):
    """What ``report`` gives, token by token."""
    found, corpus = [], Counter()
    for doc, text in rows:
        a, b = tokens(text)
        spans = []
        for side in (a, b):
            at, own = 0, []
            for i, raw in side:
                own.append((i, at, at + len(raw)))
                at += len(raw)
            spans.append(own)
        links, j = [], 0
        for i, start, end in spans[0]:
            while spans[1][j][2] <= start:
                j += 1
            k = j
            while k < len(spans[1]) and spans[1][k][1] < end:
                links.append((i, spans[1][k][0]))
                k += 1
        corpus.update(set(links))
        ends = sorted({e for *_, e in spans[0]} & {e for *_, e in spans[1]})
        groups = [[[], []] for _ in ends]
        for which, side in enumerate(spans):
            for i, _, end in side:
                groups[bisect.bisect_left(ends, end)][which].append(str(i))
        groups = ["|".join(map(",".join, g)) for g in groups]
        found.append((doc, len(a), len(b), ends, links, ";".join(groups)))
    best = defaultdict(int)
    for (i, _), n in corpus.items():
        best[i] = max(best[i], n)
    return sorted(
        ((doc, n_a, n_b, len(ends), len(links), sum(corpus[x] == best[x[0]] for x in links), sum(corpus[x] for x in links), hashlib.sha256(g.encode()).hexdigest() if g else "")
         for doc, n_a, n_b, ends, links, g in found), key=repr)


def both(spark):
    return alignment.Tokenizers(spark, *FILES)


@pytest.fixture(scope="module")
def odd():
    r = random.Random(3)
    parts = ["hello world", " ", "\n", "日本語", "🙂", "<|endoftext|>", "</s>", "naïve café", "x" * 30, "▁", "\x00", "İstanbul", "1234", "\t\t", "the the the"]
    return [(i, "".join(r.choices(parts, k=r.randint(1, 8)))) for i in range(60)] + [(60, None), (61, ""), (5, "tie"), (5, "tie"), (None, "no id"), (62, "word " * 300), (63, "y" * 999)]


def test_equals_a_plain_version(spark, docs_of, odd, plain_tokens):
    want = plain(odd, plain_tokens)
    for extra in (False, True):
        assert sorted(map(tuple, alignment.report(docs_of(odd, extra).repartition(3), *FILES).collect()), key=repr) == want


def test_tables_in_parts_and_count_trees_change_nothing(spark, docs_of, odd, plain_tokens, monkeypatch):
    monkeypatch.setattr(alignment, "FAN", 2)
    pair = both(spark)
    counts = alignment.pair_counts(docs_of(odd).repartition(9), pair, block_keys=16)
    assert counts.count() > 3
    got = alignment.align(docs_of(odd).select("doc_id", "text"), pair, counts, part_pairs=200)
    assert sorted(map(tuple, got.collect()), key=repr) == plain(odd, plain_tokens)


def test_small_table_equals_a_plain_version(spark, small, plain_tokens):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    assert sorted(map(tuple, alignment.report(docs, *FILES).collect()), key=repr) == plain(rows, plain_tokens)


def test_pairs_of_another_corpus_count_nothing(spark, docs_of):
    pair = both(spark)
    counts = alignment.pair_counts(docs_of([(1, "alpha beta")]), pair)
    row = alignment.align(docs_of([(2, "日本語 gamma")]).select("doc_id", "text"), pair, counts).first()
    assert row.n_links > 0 and row.count_sum == 0 and row.n_best == 0
    links = {tuple(r) for r in alignment.token_links(counts, pair).collect()}
    assert links and all(n == 1 for *_, n in links)


def test_very_long_texts(spark, docs_of):
    n = 400_000
    long, run = alignment.report(docs_of([(1, "word " * n), (2, "y" * n)]), *FILES).orderBy("doc_id").collect()
    assert long.n_a >= n and long.n_groups >= n and run.n_a > 0 and run.n_links >= run.n_groups > 0


def test_empty_table(spark, docs_of):
    assert alignment.report(docs_of([]), *FILES).collect() == []
    only = alignment.report(docs_of([(1, None), (2, "")]), *FILES).collect()
    assert sorted(map(tuple, only)) == [(1, 0, 0, 0, 0, 0, 0, ""), (2, 0, 0, 0, 0, 0, 0, "")]


def test_perfect_hash_is_minimal_and_perfect():
    keys = np.unique(np.random.default_rng(1).integers(0, 2**40, 50_000))
    blocks = [build(keys[block_of(keys, 7) == b]) for b in range(7)]
    places = PerfectHash([b[0] for b in blocks], [b[1] for b in blocks])
    found = places(keys)
    assert sorted(found.tolist()) == list(range(len(keys)))
    stored = np.concatenate([b[2] for b in blocks])
    assert (stored[found] == keys).all()
    strange = np.setdiff1d(np.random.default_rng(2).integers(0, 2**40, 1000), keys)
    at = places(strange)
    assert (stored[at[at >= 0]] != strange[at >= 0]).all()
    assert PerfectHash([], [])(keys[:3]).tolist() == [-1, -1, -1]
