"""Text search, line search and vector neighbours."""

from pyspark.sql import functions as F

from millpond.operators import search
from millpond.plans import plan, read_parquet
from millpond.session import shared_folder

QUERY = "License THE worthless"
TERMS = ("license", "the", "worthless")


def _docs(spark, sf):
    return read_parquet(spark, sf, "documents").select("doc_id", F.concat("source", F.lit(" "), "lang").alias("name"), "text", "source")


def _weights(terms):
    words = "regexp_split_to_array(lower({0}), '[^a-z0-9]+')"
    parts = [
        f"len([w for w in {words.format(col)} if w = '{t}']) * {weight}"
        for t in terms for col, weight in (("source || ' ' || lang", "1.0"), ("text", "0.4"))
    ]
    return " + ".join(parts)


def _scored(terms, where="true"):
    return (
        f"SELECT doc_id, source, lang, text, CAST(s AS DOUBLE) / (CAST(s AS DOUBLE) + 1) AS score FROM "
        f"(SELECT *, {_weights(terms)} AS s FROM documents WHERE {where}) WHERE s > 0"
    )


@plan(
    "ranked_search", "X1 L6",
    f"SELECT doc_id, source, round(score, 6) AS score FROM ({_scored(TERMS)}) ORDER BY score DESC, doc_id LIMIT 100",
)
def ranked_search(spark, sf):
    found = search.ranked_search(_docs(spark, sf), QUERY, "doc_id", "name", "text", limit=100)
    return found.select("doc_id", "source", F.round("score", 6).alias("score"))


@plan(
    "search_in_package", "X1 F5 L2",
    f"""SELECT doc_id, round(score, 6) AS score FROM ({_scored(('src7', 'license'), "source = 'src7'")}) ORDER BY score DESC, doc_id LIMIT 20 OFFSET 5""",
)
def search_in_package(spark, sf):
    found = search.ranked_search(
        _docs(spark, sf), "src7 | license!", "doc_id", "name", "text", offset=5, limit=20, source="src7")
    return found.select("doc_id", F.round("score", 6).alias("score"))


@plan(
    "blank_search", "X1",
    "SELECT doc_id, source || ' ' || lang AS name FROM documents ORDER BY 2, 1",
)
def blank_search(spark, sf):
    return search.ranked_search(_docs(spark, sf), "  ", "doc_id", "name", "text").select("doc_id", "name")


@plan("search_count", "A2", f"SELECT count(*) AS found FROM ({_scored(TERMS)})")
def search_count(spark, sf):
    return search.matching(_docs(spark, sf), QUERY, "name", "text").agg(F.count("*").alias("found"))


_TWO = _scored(TERMS, "source IN ('src3', 'src7')")


@plan(
    "search_packages", "X2 F13 W1 L5",
    f"""WITH u AS (SELECT source || ' ' || lang AS name, source, text, row_number() OVER (PARTITION BY source, lang ORDER BY doc_id) AS rn FROM ({_TWO}))
        SELECT name, text, source, (SELECT count(*) FROM u WHERE rn = 1) AS total_found FROM u WHERE rn = 1 ORDER BY source, name LIMIT 10""",
)
def search_packages(spark, sf):
    return search.search_packages(_docs(spark, sf), QUERY, ["src3", "src7"], "source", "name", "text", "doc_id")


@plan("document_by_name", "X3", "SELECT doc_id, text FROM documents WHERE source = 'src7' AND lang = 'fr'")
def document_by_name(spark, sf):
    return _docs(spark, sf).filter("name = 'src7 fr' AND source IN ('src3', 'src7')").select("doc_id", "text")


@plan(
    "term_index", "X4",
    """SELECT term, doc_id, CAST(sum(n) AS BIGINT) AS name_count, CAST(sum(d) AS BIGINT) AS description_count FROM (
         SELECT doc_id, unnest(regexp_split_to_array(lower(text), '[^a-z0-9]+')) AS term, 0 AS n, 1 AS d FROM documents
         UNION ALL SELECT doc_id, unnest([source, lang]), 1, 0 FROM documents) WHERE term <> '' GROUP BY 1, 2""",
)
def term_index(spark, sf):
    return search.term_index(_docs(spark, sf), "doc_id", "name", "text").drop("term_bucket", "buckets")


@plan("indexed_search", "X4 X1", f"SELECT doc_id, round(score, 6) AS score FROM ({_scored(TERMS)})")
def indexed_search(spark, sf):
    """Scores from a stored index equal those of a search over the texts."""
    path = search.stored_term_index(_docs(spark, sf), "doc_id", "name", "text", f"{shared_folder(spark)}/indexes", buckets=8)
    found = search.search_index(search.read_term_index(spark, path, QUERY), QUERY, "doc_id")
    return found.select("doc_id", F.round("score", 6).alias("score"))


@plan(
    "matching_lines", "X6",
    r"""SELECT doc_id, line_number, line FROM (
         SELECT doc_id, unnest(string_split(text, E'\n')) AS line, unnest(range(1, len(string_split(text, E'\n')) + 1)) AS line_number FROM documents)
       WHERE regexp_matches(line, '(MIT|Apache) License')""",
)
def matching_lines(spark, sf):
    found = search.grep(read_parquet(spark, sf, "documents"), "doc_id", "text", "(MIT|Apache) License")
    return found.withColumn("line_number", F.col("line_number").cast("long"))


@plan(
    "first_matching_page_lines", "X6",
    r"""SELECT page_id, line_number, line FROM (
         SELECT page_id, unnest(string_split(html, E'\n')) AS line, unnest(range(1, len(string_split(html, E'\n')) + 1)) AS line_number FROM pages)
       WHERE contains(line, '<article>') ORDER BY page_id, line_number LIMIT 10""",
)
def first_matching_page_lines(spark, sf):
    found = search.grep(read_parquet(spark, sf, "pages"), "page_id", "html", "<article>", literal=True, limit=10)
    return found.withColumn("line_number", F.col("line_number").cast("long"))


def _query_vector(vectors):
    """The vector of one key; a single row."""
    return [float(x) for x in vectors.filter("vec_id = 0").select("embedding").first()[0]]


@plan(
    "nearest_vectors", "X5",
    """SELECT vec_id, round(list_cosine_similarity(CAST(embedding AS DOUBLE[]), (SELECT CAST(embedding AS DOUBLE[]) FROM embeddings WHERE vec_id = 0)), 6) AS similarity
       FROM embeddings ORDER BY 2 DESC, 1 LIMIT 10""",
)
def nearest_vectors(spark, sf):
    vectors = read_parquet(spark, sf, "embeddings")
    found = search.nearest(vectors, "vec_id", "embedding", _query_vector(vectors), 10)
    return found.withColumn("similarity", F.round("similarity", 6))


@plan("nearest_vectors_by_hash", "X5")
def nearest_vectors_by_hash(spark, sf):
    vectors = read_parquet(spark, sf, "embeddings")
    return search.nearest_by_hash(vectors, "vec_id", "embedding", _query_vector(vectors), 10)
