"""Toxicity: a linear classifier on character n-grams, each scaled by its naive Bayes log-count ratio.

A text's features are the different hashed n-grams it holds. Log-count ratios and weights are fitted on a bounded
sample of the labelled rows, drawn by a hash of the id, ``TRAIN_ROWS`` of each class on average; scoring is row by row
over whole texts, without a shuffle, with one array of fixed size in a broadcast.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millpond.llm.common import held_out, slices, text_or_empty

BITS = 18
SIZES = (4, 5, 6)
TRAIN_ROWS = 2500  # labelled rows of each class that the model is fitted on, on average
TRAIN_CHARS = 60_000  # of these, rows with longer texts are left out of fitting; all rows are scored
SMOOTH = 1.0
L2 = 1e-5
THRESHOLD = 0.7


def plain(text: str) -> str:
    """Lower case, every run of other characters than letters and digits one space."""
    import re

    return f" {' '.join(re.findall(r'[^\W_]+', text.lower()))} "


def sample(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> DataFrame:
    """(text, toxic) of about ``rows`` labelled rows of each class, none of them held out."""
    marks = labels.where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out()).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    count = {r.toxic: r.n for r in marks.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    draw = F.pmod(F.xxhash64("doc_id", F.lit("fit")), F.lit(1 << 20))
    drawn = marks.where(sum(((F.col("toxic") == k) & (draw < int((1 << 20) * min(1.0, rows / n)))).cast("int") for k, n in count.items()) + F.lit(0) > 0)
    # Both classes together are some 2 * rows ids: a bounded broadcast.
    return docs.select("doc_id", "text").join(F.broadcast(drawn), "doc_id").where(F.length("text") <= TRAIN_CHARS).select("text", "toxic")


def fit(drawn: DataFrame, bits: int = BITS, sizes: tuple[int, ...] = SIZES):
    """Weights by bucket and intercept. Without rows of both classes every score is one half."""
    import numpy as np

    from millpond.llm.ngrams import logistic

    def features(batches: Iterator) -> Iterator:
        import pyarrow as pa

        from millpond.llm.ngrams import Distinct

        distinct = Distinct(sizes, bits)
        for part in slices(batches, "text"):
            found = [distinct(plain(t or "")).astype(np.int32).tobytes() for t in part.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.binary()), part.column("toxic")], names=["grams", "toxic"])

    table = drawn.mapInArrow(features, "grams binary, toxic int").toArrow()
    label = np.array(table.column("toxic").to_pylist(), float)
    rows = [np.frombuffer(g, np.int32) for g in table.column("grams").to_pylist()]
    if len(set(label)) < 2:
        return np.zeros(1 << bits), 0.0
    order = sorted(range(len(rows)), key=lambda i: (label[i], len(rows[i]), rows[i][:8].tobytes()))  # rows arrive in any order
    rows, label = [rows[i] for i in order], label[order]
    count = [SMOOTH + sum((np.bincount(r, minlength=1 << bits) for r, y in zip(rows, label) if y == k), np.zeros(1 << bits)) for k in (0, 1)]
    seen = count[0] + count[1] - 2 * SMOOTH
    ratio = np.where(seen >= 3, np.log(count[1] / (label == 1).sum()) - np.log(count[0] / (label == 0).sum()), 0.0)
    # N-grams that say little are left out of the fit: their scaled features are near zero.
    useful = np.abs(ratio) >= 1.0
    return logistic([r[useful[r]] for r in rows], label, ratio * useful, L2)


def score(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, train_rows: int = TRAIN_ROWS) -> DataFrame:
    """doc_id, held_out, score and predicted of every row of ``docs``.

    A null text is an empty one and gets the score of a text without known n-grams. Repeated rows are scored alike; of
    labels that repeat an id the largest counts. Without labels of both classes every score is 0.5.
    """
    import numpy as np

    weights, bias = fit(sample(docs, labels, train_rows))
    shared = docs.sparkSession.sparkContext.broadcast((weights.astype(np.float32), bias))  # 2^BITS floats

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        from millpond.llm.ngrams import Distinct

        weights, bias = shared.value
        distinct = Distinct(SIZES, BITS)
        for part in slices(batches, "text"):
            z = np.array([float(weights[distinct(plain(t))].sum(dtype=np.float64)) + bias for t in part.column("text").to_pylist()])
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("held_out"), pa.array(1 / (1 + np.exp(-np.clip(z, -50, 50))))], names=["doc_id", "held_out", "score"])

    rows = docs.select("doc_id", held_out().alias("held_out"), text_or_empty().alias("text"))
    done = rows.mapInArrow(run, "doc_id long, held_out boolean, score double")
    return done.withColumn("predicted", (F.col("score") >= threshold).cast("int"))
