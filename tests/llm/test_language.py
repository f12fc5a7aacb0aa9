import numpy as np

from millpond.llm import language


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = language.identify(docs).join(docs.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert len(rows) > 250 and sum(r.lang == r.lang_pred for r in rows) / len(rows) > 0.98
    assert all(0 <= r.score <= 1 for r in rows)


def test_mixture_finds_proportions_and_leaves_out_the_rest():
    rng = np.random.default_rng(3)
    truth = np.array([0] * 70 + [2] * 30)
    likelihood = rng.normal(0, 0.5, (4, 100))
    likelihood[truth, np.arange(100)] += 5
    mix = language.mixture(likelihood)
    assert abs(mix[0] - 0.7) < 0.05 and abs(mix[2] - 0.3) < 0.05 and mix[1] == mix[3] == 0


def test_mixed_text_names_both_languages(spark, docs_of):
    en = ["the house and the garden are with this man that was here", "which of them would have thought that there is something"]
    de = ["das haus und der garten sind mit diesem mann der hier war", "nicht wahr ich weiss auch nicht warum wir uns dort treffen"]
    rows = [(i, t) for i, t in enumerate((en + de) * 12)]
    train = spark.createDataFrame([(i, t, "en" if t in en else "de") for i, t in rows], "doc_id long, text string, lang string")
    asked = [(1000, en[0] + " " + de[1]), (1001, en[1]), (1002, de[0].upper() + " 123 !!")]
    got = {r.doc_id: r for r in language.identify(docs_of(asked), train).collect()}
    assert sorted(got[1000].languages) == ["de", "en"] and got[1000].score < 0.75
    assert got[1001].languages == ["en"] and got[1002].lang_pred == "de"


def plain_identify(rows, train):
    """Prediction, share and languages of each text, word by word and language by language, without blocks or hashing."""
    import math
    import re
    import unicodedata

    def words(text):
        runs, run = [], ""
        for c in text.lower() + " ":
            if unicodedata.category(c)[0] == "L":
                run += c
            elif run:
                runs.append(run)
                run = ""
        return runs

    def pieces(word):
        w = f" {word} "
        return [w[i : i + n] for n in (2, 3) for i in range(len(w) - n + 1)]

    from millpond.llm.ngrams import codes, hashed

    bucket = lambda g: int(hashed(codes(g), len(g), 16)[0])
    names = sorted({lang for _, _, lang in train})
    count = {lang: {} for lang in names}
    for _, text, lang in train:
        for w in words(text):
            for g in map(bucket, pieces(w)):
                count[lang][g] = count[lang].get(g, 0) + 1
    known = set().union(*(c for c in count.values()))
    total = {lang: sum(c.values()) + 0.5 * 2**16 for lang, c in count.items()}
    log = lambda lang, g: math.log((count[lang].get(g, 0) + 0.5) / total[lang]) if g in known else 0.0
    out = {}
    for i, text in rows:
        like = []
        for w in words(text or ""):
            own = [sum(log(lang, g) for g in map(bucket, pieces(w))) / 2 for lang in names]
            like.append([math.exp(max(x - max(own), -60)) for x in own])
        if not like:
            out[i] = ("und", 0.0, [])
            continue

        def em(rows):
            mix = [1 / len(rows)] * len(rows)
            for _ in range(500 if len(rows) > 1 else 0):
                share = [sum(m * w[r] / sum(m2 * w[r2] for m2, r2 in zip(mix, rows)) for w in like) / len(like) for m, r in zip(mix, rows)]
                moved, mix = max(abs(a - b) for a, b in zip(mix, share)), share
                if moved <= 1e-3:
                    break
            return mix, sum(math.log(sum(m * w[r] for m, r in zip(mix, rows))) for w in like)

        chosen = list(range(len(names)))
        mix, fit = em(chosen)
        while len(chosen) > 1:
            fewer = [c for j, c in enumerate(chosen) if j != mix.index(min(mix))]
            new, new_fit = em(fewer)
            if fit - new_fit > 0.5 * math.log(len(like) + 1):
                break
            chosen, mix, fit = fewer, new, new_fit
        order = sorted(range(len(chosen)), key=lambda j: (-mix[j], chosen[j]))
        out[i] = (names[chosen[order[0]]], mix[order[0]], [names[chosen[j]] for j in order])
    return out


def test_equals_a_plain_version(spark, docs_of):
    docs = [r for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect() if r.text and len(r.text) < 1500]
    train = [(r.doc_id, r.text, r.lang) for r in docs[:60]]
    asked = [(r.doc_id, r.text) for r in docs[60:100]] + [(9000 + i, docs[i].text[:200] + " " + docs[i + 7].text[:200]) for i in range(20)] + [(9100, "½ ² ① Ⅷ 12"), (9101, "")]
    got = {r.doc_id: r for r in language.identify(docs_of(asked), spark.createDataFrame([t for t in train if __import__("zlib").crc32(str(t[0]).encode()) % 3 != 1], "doc_id long, text string, lang string")).collect()}
    want = plain_identify(asked, [t for t in train if __import__("zlib").crc32(str(t[0]).encode()) % 3 != 1])
    for i, (lang, share, found) in want.items():
        assert (got[i].lang_pred, got[i].languages) == (lang, found) and abs(got[i].score - share) < 1e-3, i
    assert got[9100].lang_pred == "und"


def test_long_texts_in_blocks_give_the_same(monkeypatch):
    rng = np.random.default_rng(2)
    table = np.log(rng.dirichlet(np.ones(1 << language.BITS), 5)).astype(np.float32)
    words = ["".join(rng.choice(list("abcde"), 5)) for _ in range(3000)]
    whole = language.mixture_of(language.judged(words, table), 5, len(words))
    monkeypatch.setattr(language, "HELD", 100)
    monkeypatch.setattr(language, "WORDS_AT_ONCE", 170)
    assert np.allclose(language.mixture_of(language.judged(words, table), 5, len(words)), whole, atol=1e-9)


def test_em_has_converged():
    rng = np.random.default_rng(8)
    likelihood = rng.normal(0, 0.8, (3, 2000))
    likelihood[rng.choice([0, 1, 2], 2000, p=[0.5, 0.3, 0.2]), np.arange(2000)] += 1.5
    mix, part = language.mixture(likelihood), language.scaled(likelihood)
    again = mix * (part @ (1 / (mix @ part))) / 2000
    assert np.abs(again - mix).max() <= 1e-3 and abs(mix.sum() - 1) < 1e-9


def test_words_keep_their_own_ngrams():
    apart = [language.grams(w)[0] for w in ("ab", "cde", "f")]
    bucket, owner, n = language.grams("Ab, cde\n1 f")
    assert n == 3
    for i, own in enumerate(apart):
        assert sorted(bucket[owner == i]) == sorted(own)


def test_odd_rows_and_nothing_to_learn(spark, docs_of, odd_rows):
    train = spark.createDataFrame([(i, "some words of english", "en") for i in range(9)] + [(i, None, "fr") for i in range(9)] + [(3, "unlabelled", None)], "doc_id long, text string, lang string")
    got = language.identify(docs_of(odd_rows, extra=True), train).collect()
    assert len(got) == len(odd_rows)
    for r, text in zip(sorted(got, key=repr), sorted(odd_rows, key=repr)):
        assert r.lang_pred in ("en", "und")
    assert {r.lang_pred for r in got if r.doc_id in (1, 2, 3, 9)} == {"und"}
    assert {(r.lang_pred, r.score) for r in language.identify(docs_of(odd_rows), train.where("false")).collect()} == {("und", 0.0)}
    assert language.identify(docs_of([]), train).collect() == []
