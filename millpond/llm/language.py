"""Language identification by multilingual mixture inference.

Each word has a likelihood under each language from character n-grams. Expectation maximisation finds the proportions
in which a document mixes languages, and the set of languages is the one with the best penalised likelihood: starting
from all, the weakest is taken out as long as the Bayesian information criterion gains by it.

N-gram counts are learnt from a sample of the training rows, about ``TRAIN_ROWS`` of each language, drawn by a hash of
the id; the model is one array of languages x 2^BITS numbers, and documents are judged row by row without a shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millpond.llm.common import held_out, slices

BITS = 16
SIZES = (2, 3)
TRAIN_ROWS = 2000  # rows of each language that are counted, on average
LANGUAGES = 400  # more languages than this are refused: the model has an array for each
SMOOTH = 0.5
STEPS, STILL = 200, 1e-3  # EM goes on until no proportion moves by more, at most so many steps
HELD = 16 << 20  # likelihoods of words by language that a task holds; beyond, they are worked out again each step
WORDS_AT_ONCE = 50_000


def grams(text: str):
    """Buckets of the n-grams of each letter run with its borders, and the number of the run each belongs to."""
    return word_grams(letter_runs(text))


def letter_runs(text: str) -> list[str]:
    import regex

    return regex.findall(r"\p{L}+", text.lower())


def word_grams(words: list[str]):
    """Buckets of the n-grams of words, the number of the word each belongs to, and how many words there are."""
    import numpy as np

    from millpond.llm.ngrams import codes, hashed

    if not words:
        return np.empty(0, np.int64), np.empty(0, np.int64), 0
    # Each letter run stands between two borders of its own, so no n-gram crosses from one run into the next.
    letters = codes(" " + "  ".join(words) + " ")
    run = np.cumsum(letters == 32) // 2
    buckets, owners = [], []
    for n in SIZES:
        found = hashed(letters, n, BITS)
        # No n-gram crosses from one run into the next, and the border that opens a run has its number.
        inside = np.ones(len(found), bool)
        for i in range(n - 1):
            inside &= ~((letters[i : len(found) + i] == 32) & (letters[i + 1 : len(found) + i + 1] == 32))
        buckets.append(found[inside])
        owners.append(run[: len(found)][inside])
    return np.concatenate(buckets), np.concatenate(owners), len(words)


def learn(docs: DataFrame, rows: int = TRAIN_ROWS):
    """(languages, log-probabilities by language and bucket) from rows with a language that are not held out."""
    import numpy as np

    train = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out()).select("doc_id", F.col("lang").cast("string").alias("lang"), "text")
    count = {r.lang: r.n for r in train.groupBy("lang").agg(F.count("*").alias("n")).limit(LANGUAGES + 1).collect()}
    if len(count) > LANGUAGES:
        raise ValueError(f"more than {LANGUAGES} languages")
    names = sorted(count)
    if not names:
        return [], np.zeros((0, 1 << BITS), np.float32)
    draw = F.pmod(F.xxhash64("doc_id", F.lit("fit")), F.lit(1 << 20))
    share = F.element_at(F.create_map(*[F.lit(v) for k in names for v in (k, int((1 << 20) * min(1.0, rows / count[k])) + 1)]), F.col("lang"))

    def counts(batches: Iterator) -> Iterator:
        import pyarrow as pa

        held = np.zeros((len(names), 1 << BITS), np.int64)
        for part in slices(batches, "text"):
            for lang, text in zip(part.column("lang").to_pylist(), part.column("text").to_pylist()):
                held[names.index(lang)] += np.bincount(grams(text)[0], minlength=1 << BITS)
        lang, bucket = np.nonzero(held)
        yield pa.RecordBatch.from_arrays([pa.array(lang.astype(np.int32)), pa.array(bucket.astype(np.int32)), pa.array(held[lang, bucket])], names=["lang", "bucket", "n"])

    summed = train.where(draw < share).select("lang", "text").mapInArrow(counts, "lang int, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toArrow()
    table = np.full((len(names), 1 << BITS), SMOOTH)
    table[summed.column("lang").to_numpy(), summed.column("bucket").to_numpy()] += summed.column("n").to_numpy()
    # Buckets that no language has seen say nothing.
    unseen = (table == SMOOTH).all(axis=0)
    table = np.log(table / table.sum(axis=1, keepdims=True))
    table[:, unseen] = 0.0
    return names, table.astype(np.float32)


def scaled(likelihood):
    """Likelihoods from their logarithms, the largest of each column 1."""
    import numpy as np

    return np.exp(np.maximum(likelihood - likelihood.max(axis=0), -60))


def mixture(likelihood):
    """``mixture_of`` a matrix of log-likelihoods, languages by words."""
    return mixture_of(lambda: [scaled(likelihood)], *likelihood.shape)


def mixture_of(blocks, k: int, n: int):
    """Proportions of k languages that best explain n words, as EM finds them; 0 outside the penalised set.

    ``blocks()`` gives the scaled likelihoods, languages by words, of some words at a time.
    """
    import numpy as np

    chosen = list(range(k))

    def em(rows: list[int]):
        mix = np.full(len(rows), 1 / len(rows))
        for _ in range(STEPS if len(rows) > 1 else 0):
            # Expected share of each word, then the mean over words.
            new = mix * sum(part[rows] @ (1 / np.maximum(mix @ part[rows], 1e-300)) for part in blocks()) / n
            moved, mix = np.abs(new - mix).max(), new
            if moved <= STILL:
                break
        return mix, sum(np.log(np.maximum(mix @ part[rows], 1e-300)).sum() for part in blocks())

    mix, fit = em(chosen)
    while len(chosen) > 1:
        fewer = [c for i, c in enumerate(chosen) if i != int(np.argmin(mix))]
        new_mix, new_fit = em(fewer)
        if fit - new_fit > 0.5 * np.log(n + 1):
            break
        chosen, mix, fit = fewer, new_mix, new_fit
    out = np.zeros(k)
    out[chosen] = mix
    return out


def judged(words: list[str], table):
    """``blocks`` for ``mixture_of``: the likelihoods of the words of one text, some words at a time.

    They are kept as long as they take bounded memory, whatever the length of the text and the number of languages.
    """
    import numpy as np

    def blocks():
        for at in range(0, len(words), WORDS_AT_ONCE):
            bucket, owner, n = word_grams(words[at : at + WORDS_AT_ONCE])
            # The n-grams of the several sizes overlap, so their sum tells each letter that many times.
            yield scaled(np.stack([np.bincount(owner, row[bucket], n) for row in table]) / len(SIZES))

    if len(words) * len(table) > HELD:
        return blocks
    held = list(blocks())
    return lambda: held


def identify(docs: DataFrame, train: DataFrame | None = None, rows: int = TRAIN_ROWS) -> DataFrame:
    """doc_id, held_out, lang_pred, score and the languages found, largest first, of every row.

    ``lang_pred`` has the largest proportion, ``score`` is that proportion; of equal ones the first by name is taken.
    A text that is null or has no letter, or any text where nothing could be learnt, is ``und`` with score 0. Repeated
    rows are judged alike.
    """
    import numpy as np

    names, table = learn(docs if train is None else train, rows)
    shared = docs.sparkSession.sparkContext.broadcast((names, table))

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        names, table = shared.value
        for part in slices(batches, "text"):
            best, score, found = [], [], []
            for text in part.column("text").to_pylist():
                words = letter_runs(text or "")
                if not words or not names:
                    best.append("und"), score.append(0.0), found.append([])
                    continue
                mix = mixture_of(judged(words, table), len(names), len(words))
                order = [k for k in np.lexsort((np.arange(len(names)), -mix)) if mix[k] > 0]
                best.append(names[order[0]]), score.append(float(min(1.0, mix[order[0]]))), found.append([names[k] for k in order])
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("held_out"), pa.array(best), pa.array(score, pa.float64()), pa.array(found, pa.list_(pa.string()))], names=["doc_id", "held_out", "lang_pred", "score", "languages"])

    return docs.select("doc_id", held_out().alias("held_out"), "text").mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double, languages array<string>")
