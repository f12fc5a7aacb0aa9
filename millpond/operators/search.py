"""Text search with a score, a stored term index, line search and vector neighbours."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millpond.functions.columns import as_column, bucket_of
from millpond.functions.text import has_word, query_terms, word_count, words
from millpond.functions.vectors import dot, norm
from millpond.operators.keyed import first_per_key

# The name counts more than the description.
NAME_WEIGHT, DESCRIPTION_WEIGHT = 1.0, 0.4
TOP_RESULTS = 10


def bounded(score: Column) -> Column:
    return score / (score + 1.0)


def _filtered(docs: DataFrame, equals: dict) -> DataFrame:
    for column, wanted in equals.items():
        if wanted is None:
            continue
        match = F.col(column).isin(*wanted) if isinstance(wanted, (list, tuple)) else F.col(column) == wanted
        docs = docs.filter(match)
    return docs


def matching(docs: DataFrame, query: str, name: str, description: str, **equals) -> DataFrame:
    """Documents that hold any word of the query, with their score.

    The test stops at the first word found; words are counted only in documents that pass. Nothing is shuffled.
    """
    docs = _filtered(docs, equals)
    terms = query_terms(query)
    if not terms:
        return docs.withColumn("score", F.lit(0.0))
    total = word_count(name, terms) * NAME_WEIGHT + word_count(description, terms) * DESCRIPTION_WEIGHT
    return docs.filter(has_word(name, terms) | has_word(description, terms)).withColumn("score", bounded(total))


def ranked_search(
    docs: DataFrame, query: str, id_col: str, name: str, description: str,
    offset: int = 0, limit: int | None = None, **equals,
) -> DataFrame:
    """Best matches first; a blank query lists everything by name."""
    found = matching(docs, query, name, description, **equals)
    order = [F.col("score").desc(), F.col(id_col)] if query_terms(query) else [F.col(name), F.col(id_col)]
    found = found.orderBy(*order)
    if offset:
        found = found.offset(offset)
    return found.limit(limit) if limit else found


def search_packages(
    docs: DataFrame, query: str, packages: list[str], package: str, name: str, description: str, id_col: str,
    limit: int = TOP_RESULTS,
) -> DataFrame:
    """Matches over several packages, one per (package, name), the first ``limit``, with the number found.

    The number is a subquery over the same exchange as the page.
    """
    found = first_per_key(
        matching(docs, query, name, description, **{package: packages}), [package, name], [F.col(id_col)]
    ).select(name, description, package)
    total = found.agg(F.count("*")).scalar()
    return found.orderBy(package, name).limit(limit).withColumn("total_found", total)


def term_index(docs: DataFrame, id_col: str, name: str, description: str, buckets: int = 64) -> DataFrame:
    """One row per (term, document) with its weight; write it partitioned by ``term_bucket``.

    All words of a document's field are exploded in one task, so they are counted there before the shuffle.
    """
    # One array of words for each field, unpacked by two generators: words are not put into structs one by one first.
    fields = F.array(*[F.struct(F.lit(n).alias("n"), words(c).alias("terms")) for c, n in ((name, 1), (description, 0))])
    found = docs.select(id_col, F.explode(fields).alias("f")).select(id_col, "f.n", (1 - F.col("f.n")).alias("d"), F.explode("f.terms").alias("term")).filter("term <> ''")
    counts = found.groupBy("term", id_col).agg(F.sum("n").alias("name_count"), F.sum("d").alias("description_count"))
    own = bucket_of(["term"], buckets)
    return counts.withColumn("term_bucket", own.alias("term_bucket", metadata={"buckets": buckets})).withColumn("buckets", F.lit(buckets))


def write_term_index(index: DataFrame, path: str) -> None:
    """A frequent word fills its bucket with many documents; rebalance splits such a bucket into more files.

    Files are sorted by word, so a lookup skips row groups. The number of buckets stands beside the index and is written
    last: an index without it is not finished.
    """
    metadata = index.schema["term_bucket"].metadata or {} if "term_bucket" in index.columns else {}
    if "buckets" not in metadata or "buckets" not in index.columns:
        raise ValueError("the index does not say how many buckets it has")
    rows = index.drop("buckets")
    rows.hint("rebalance", "term_bucket").sortWithinPartitions("term_bucket", "term").write.mode("overwrite").partitionBy("term_bucket").parquet(path)
    index.sparkSession.createDataFrame([(metadata["buckets"],)], "buckets int").write.mode("overwrite").parquet(f"{path.rstrip('/')}_buckets")


def stored_term_index(docs: DataFrame, id_col: str, name: str, description: str, root: str, buckets: int = 64) -> str:
    """Path of the index of ``docs`` below ``root``; built only if the files of ``docs`` have none yet.

    The path is named after the files, their size and what is indexed, so new data gets a new index.
    """
    spark, plan = docs.sparkSession, docs._jdf.queryExecution().optimizedPlan()
    made_of = [*sorted(docs.inputFiles()), str(plan.stats().sizeInBytes()), plan.canonicalized().toString(), id_col, name, description, str(buckets)]
    path = f"{root.rstrip('/')}/terms-{hashlib.sha256('|'.join(made_of).encode()).hexdigest()[:24]}"
    done = spark._jvm.org.apache.hadoop.fs.Path(f"{path}_buckets/_SUCCESS")
    if not done.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).exists(done):
        write_term_index(term_index(docs, id_col, name, description, buckets), path)
    return path


def search_index(index: DataFrame, query: str, id_col: str) -> DataFrame:
    """Scores from the stored index: reads only the buckets of the query's words."""
    terms = query_terms(query)
    if not terms:
        return index.select(id_col).distinct().withColumn("score", F.lit(0.0))
    hits = index.filter(F.col("term").isin(*terms))
    weight = F.sum(F.col("name_count") * NAME_WEIGHT + F.col("description_count") * DESCRIPTION_WEIGHT)
    return hits.groupBy(id_col).agg(bounded(weight).alias("score"))


def read_term_index(spark, path: str, query: str) -> DataFrame:
    index = spark.read.parquet(path)
    terms = query_terms(query)
    buckets = spark.read.parquet(f"{path.rstrip('/')}_buckets").first().buckets
    if not terms or buckets is None:
        return index
    # Bucket numbers of a few literal words, worked out by the same hash the index was written with.
    words = spark.createDataFrame([(t,) for t in terms], "term string")
    wanted = [r[0] for r in words.select(bucket_of(["term"], buckets)).distinct().collect()]
    return index.filter(F.col("term_bucket").isin(*wanted))


def grep(texts: DataFrame, id_col: str, text: str, pattern: str, literal: bool = False, limit: int | None = None) -> DataFrame:
    """Matching lines with their numbers from 1. With ``literal`` whole texts without the words are skipped first."""
    content = F.col(text)
    rows = texts.filter(content.contains(pattern)) if literal else texts
    lines = rows.select(id_col, F.posexplode(F.split(content, "\n")).alias("_pos", "line"))
    hit = F.col("line").contains(pattern) if literal else F.col("line").rlike(pattern)
    found = lines.filter(hit).select(id_col, (F.col("_pos") + 1).alias("line_number"), "line")
    return found.orderBy(id_col, "line_number").limit(limit) if limit else found


def nearest(vectors: DataFrame, id_col: str, vector: str, query: list[float], k: int) -> DataFrame:
    """Exact cosine neighbours of one vector: scored row by row, then a distributed top-k.

    The query's length is a constant of the plan, so only the stored vector is measured per row.
    """
    q = F.array(*[F.lit(float(x)) for x in query])
    length = sum(float(x) ** 2 for x in query) ** 0.5
    similarity = F.try_divide(dot(vector, q), norm(vector) * F.lit(length))
    return (
        vectors.select(id_col, similarity.alias("similarity"))
        .filter("similarity IS NOT NULL")
        .orderBy(F.col("similarity").desc(), id_col)
        .limit(k)
    )


def nearest_by_hash(vectors: DataFrame, id_col: str, vector: str, query: list[float], k: int, width: float = 0.5, tables: int = 8) -> DataFrame:
    """Approximate neighbours: random projections of normalised vectors, distance checked on the candidates."""
    from pyspark.ml.feature import BucketedRandomProjectionLSH, Normalizer
    from pyspark.ml.functions import array_to_vector
    from pyspark.ml.linalg import Vectors

    data = vectors.select(id_col, array_to_vector(F.col(vector).cast("array<double>")).alias("_raw"))
    data = Normalizer(inputCol="_raw", outputCol="_unit").transform(data).select(id_col, "_unit")
    model = BucketedRandomProjectionLSH(
        inputCol="_unit", outputCol="_hash", bucketLength=width, numHashTables=tables, seed=7
    ).fit(data)
    length = sum(float(x) ** 2 for x in query) ** 0.5
    unit = Vectors.dense([float(x) / length for x in query])
    found = model.approxNearestNeighbors(data, unit, k, distCol="_distance")
    if found.count() < k:
        # Too few share a bucket with the query: the exact form finds the rest.
        return nearest(vectors, id_col, vector, query, k)
    # For unit vectors the cosine follows from the distance.
    return found.select(id_col, (1 - F.col("_distance") * F.col("_distance") / 2).alias("similarity"))
