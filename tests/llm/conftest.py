import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
# Names that operators use inside or give to their results.
CLASHING = "th string, band long, label string, kept boolean, n_words string, token_ids string, decoded string, held_out string, score string, _text string, _row long, rank long, _key string, a string, b string, words string, _bad string, spans string"


@pytest.fixture(scope="session")
def docs_of(spark):
    def make(rows, extra=False):
        df = spark.createDataFrame([(i, t, "en", "src0", None if t is None else len(t)) for i, t in rows], DOCS)
        if extra:
            from pyspark.sql import functions as F

            df = df.withColumns({c.split()[0]: F.lit(None).cast(c.split()[1]) for c in CLASHING.split(", ")})
        return df

    return make


@pytest.fixture(scope="session")
def odd_rows():
    """Nulls, empty and very long texts, ties and wholly repeated rows, null and repeated ids."""
    prose = "the quick brown fox jumps over the lazy dog while seven wizards quietly mix potent boxes of jugs"
    return [
        (1, None), (2, ""), (3, " \n\t "), (4, prose), (4, prose), (5, prose), (6, "x" * 200_000), (7, "word " * 30_000),
        (None, prose + " again"), (None, None), (8, "\x00\x1c é🙂\r\n  +1 (017) 555-7713"), (9, "1 " * 5000), (10, "日本語 テキスト"),
    ]
