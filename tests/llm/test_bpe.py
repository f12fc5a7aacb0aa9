import hashlib
import json

import public_tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from millpond.llm import bpe

PATH = public_tokenizers.path("word_bpe_49k.json")
LIBRARY = Tokenizer.from_file(PATH)
OWN = bpe._bpe(open(PATH, encoding="utf-8").read())


def expected(text):
    ids = LIBRARY.encode(text, add_special_tokens=False).ids
    return ids, LIBRARY.decode(ids, skip_special_tokens=False)


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.sampled_from("abcdeTH'sdlr 09.,!<|>\n\t\x1c\x85 éÉßΣİñ日🙂é"), max_size=60))
def test_same_ids_and_text_as_the_library(text):
    ids = OWN.encode(text)
    assert (ids, OWN.decode(ids)) == expected(text)


def test_added_tokens_are_found_in_the_raw_text():
    for text in ("<|endoftext|>a<|startoftext|>", "A<|ENDOFTEXT|>", "x <|endoftext|> y", "<|endoftext|"):
        assert OWN.encode(text) == expected(text)[0]


def test_merges_go_by_rank_and_skip_stale_entries():
    ranks = {(0, 1): (0, 10), (1, 2): (1, 11), (10, 2): (2, 12), (0, 0): (3, 13)}
    assert bpe.merge([0, 1, 2], ranks) == [12]
    assert bpe.merge([0, 0, 0], ranks) == [13, 0]
    assert bpe.merge([1, 2, 0, 1], ranks) == [11, 10]
    assert bpe.merge([], ranks) == []


def test_full_cache_is_replaced(monkeypatch):
    monkeypatch.setattr(bpe, "CACHED_WORDS", 2)
    text = "one two three four one two three"
    assert bpe.WordBpe(__import__("json").load(open(PATH))).encode(text) == expected(text)[0]


def test_odd_rows_and_clashing_columns(docs_of, odd_rows):
    rows = bpe.digests(docs_of(odd_rows, extra=True), PATH).collect()
    want = []
    for i, text in odd_rows:
        ids, decoded = expected(text or "")
        want.append((i, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest()))
    assert sorted(map(tuple, rows), key=repr) == sorted(want, key=repr)
    assert bpe.digests(docs_of([]), PATH).collect() == []


def test_general_interface_keeps_columns_and_decodes(docs_of):
    coded = bpe.encode(docs_of([(1, "Hello world"), (2, None)], extra=True), PATH)
    assert {"th", "source", "token_ids"} <= set(coded.columns)
    back = bpe.decode(coded.select("doc_id", "token_ids"), PATH).orderBy("doc_id").collect()
    assert [r.decoded for r in back] == ["hello</w> world</w>", ""]


def test_caches_hold_no_long_words_and_columns_may_clash(docs_of):
    from pyspark.sql import functions as F

    spec = bpe.WordBpe(json.loads(open(PATH, encoding="utf-8").read()))
    for i in range(200):
        spec.encode("日本語" * 200 + chr(0x4E00 + i))
    assert not spec and not spec.merged
    docs = docs_of([(1, "one two")], extra=True).withColumns({"__text": F.lit("x"), "__text_": F.lit("y")})
    row = bpe.encode(docs, PATH).first()
    assert row["__text"] == "x" and row["__text_"] == "y" and len(row.token_ids) == 2
