import random

import numpy as np

from millpond.llm import toxicity


def corpus(docs_of, spark, n=600):
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randrange(2, 7)))
    rows, labels = [], []
    for i in range(n):
        words = [word() for _ in range(rng.randrange(20, 200))]
        toxic = i % 4 == 0
        if toxic:
            for _ in range(2):
                words[rng.randrange(len(words))] = rng.choice(["Vileword!", "GRUMBLECAKE", "nastything"])
        rows.append((i, " ".join(words)))
        labels.append((i, 1, int(toxic)))
    return docs_of(rows, extra=True), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_unseen_rows_are_told_apart(spark, docs_of):
    docs, labels = corpus(docs_of, spark)
    got = toxicity.score(docs, labels).collect()
    held = [r for r in got if r.held_out]
    assert 150 < len(held) < 250 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in got)
    toxic = np.array([r.score for r in held if r.doc_id % 4 == 0])
    clean = np.array([r.score for r in held if r.doc_id % 4])
    assert (toxic[:, None] > clean).mean() > 0.98 and (toxic >= 0.7).mean() > 0.9 and (clean >= 0.7).mean() < 0.02


def test_held_out_labels_change_nothing(spark, docs_of):
    from pyspark.sql import functions as F

    from millpond.llm.common import held_out

    docs, labels = corpus(docs_of, spark, 120)
    other = labels.withColumn("toxic", F.when(held_out(), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    a, b = (sorted((r.doc_id, r.score) for r in toxicity.score(docs, x).collect()) for x in (labels, other))
    assert a == b


def test_odd_rows_and_no_labels(spark, docs_of, odd_rows):
    docs, labels = corpus(docs_of, spark, 60)
    odd = docs_of(odd_rows)
    got = toxicity.score(odd.unionByName(docs.select(odd.columns)), labels).collect()
    assert len(got) == 60 + len(odd_rows)
    none = toxicity.score(odd, labels.where("false")).collect()
    assert [r.score for r in none] == [0.5] * len(odd_rows)
    assert toxicity.score(docs_of([]), labels).collect() == []
