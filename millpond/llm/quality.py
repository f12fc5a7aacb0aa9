"""Quality rules with cross-document line frequency, in DataFrame functions only.

Lines are normalised and hashed. A line that more than ``LINE_PERCENT`` of a host's documents or more than ``LINE_MANY`` of
them hold (and more than ``LINE_DOCS``, at a small host) is boilerplate and is removed; a document that loses more than ``DEPLETED`` of its characters is
rejected, as is one that fails the base rules.

Copies of a document are one document here: a line counts once for each *document*, a hash of the whole text in lower case
with white space collapsed. Else a text copied a thousand times would be taken for boilerplate where near-duplicate
removal should keep one of it. Near copies are documents of their own.

The text is read once, into a stored table of counts and line hashes. Counts are combined in each task before they are
shuffled, so a host or line that holds a third of all rows arrives as one row per task and document.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millpond.llm.common import stored, text_or_empty

SPACE = " \t\n\x0b\f\r"
SPACES = r"[\x20\x09-\x0D]+"
SYMBOLS = r"[^#*$%&|<>]+"
MIN_WORDS = 50
REPEATED_PERCENT = 50
LINE_DOCS = 20  # a line in no more documents of its host than this is never removed
LINE_PERCENT = 2  # nor one in no more than this share of them, unless
LINE_MANY = 200  # it lies in more documents of its host than this, however many the host has
DEPLETED_PERCENT = 70  # a document that loses more of its characters than this is rejected


def _repeat_words(df: DataFrame) -> DataFrame:
    """From ``_words``: the words that lie in 3-word windows found twice or more."""
    w = F.col("_words")
    df = df.withColumn("_win", F.when(F.size(w) >= 3, F.transform(F.slice(w, F.lit(1), F.size(w) - 2), lambda x, i: F.xxhash64(x, w[i + 1], w[i + 2]))).otherwise(F.expr("array()").cast("array<long>")))
    win = F.col("_win")
    # Hashes found again, from a sort of plain numbers; each step is a column of its own, as a lambda evaluates what
    # it names for every element.
    df = df.withColumn("_sorted", F.when(F.size(F.array_distinct(win)) < F.size(win), F.sort_array(win)))
    s = F.col("_sorted")
    df = df.withColumn("_again", F.array_distinct(F.filter(s, lambda x, i: (i > 0) & (s[F.greatest(i - 1, F.lit(0))] == x))))
    again = F.col("_again")
    # Few different ones are looked up; many are found by sorting hashes with their places.
    few = F.filter(F.transform(win, lambda h, i: F.when(F.array_contains(again, h), i)), lambda i: i.isNotNull())
    df = df.withColumn("_placed", F.when(F.size(again) > 16, F.sort_array(F.transform(win, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))))
    p, n = F.col("_placed"), F.size(F.col("_placed"))
    many = F.sort_array(F.transform(
        F.filter(p, lambda x, i: ((i > 0) & (p[F.greatest(i - 1, F.lit(0))]["h"] == x["h"])) | ((i < n - 1) & (p[F.least(i + 1, n - 1)]["h"] == x["h"]))),
        lambda x: x["i"]))
    df = df.withColumn("_at", F.when(p.isNotNull(), many).when(F.size(again) > 0, few))
    at = F.col("_at")
    # Windows overlap, so each start adds the words up to the next start, three at most.
    steps = F.transform(at, lambda x, i: F.when(i < F.size(at) - 1, F.least(F.lit(3), at[F.least(i + 1, F.size(at) - 1)] - x)).otherwise(3))
    total = F.aggregate(steps, F.lit(0).cast("long"), lambda a, x: a + x)
    return df.withColumn("n_repeat_words", F.coalesce(total, F.lit(0).cast("long"))).drop("_win", "_sorted", "_again", "_placed", "_at")


def _line_hash(line: Column) -> Column:
    return F.xxhash64(F.lower(F.regexp_replace(F.btrim(line, F.lit(SPACE)), SPACES, " ")))


def features(docs: DataFrame) -> DataFrame:
    """Base counts, document hash and line hashes of every row. _row tells rows apart once this is stored."""
    text = F.col("_text")
    bare = F.col("_bare")
    df = docs.select("doc_id", F.coalesce(F.col("source").cast("string"), F.lit("")).alias("_host"), text_or_empty().alias("_text"))
    df = df.withColumn("_bare", F.btrim(text, F.lit(SPACE)))
    df = df.withColumn("_words", F.when(bare == "", F.expr("array()").cast("array<string>")).otherwise(F.split(bare, SPACES)))
    df = _repeat_words(df)
    df = df.withColumn("_lines", F.filter(F.split(text, "\n"), lambda x: F.btrim(x, F.lit(SPACE)) != ""))
    lines = F.col("_lines")
    return df.select(
        F.monotonically_increasing_id().alias("_row"),
        "doc_id",
        F.xxhash64("_text", "_host").alias("_hash"),
        "_host",
        F.size("_words").cast("long").alias("n_words"),
        F.length(F.regexp_replace(text, SPACES, "")).cast("long").alias("word_chars"),
        F.length(F.regexp_replace(text, SYMBOLS, "")).cast("long").alias("n_symbols"),
        (F.size(lines) - F.size(F.array_distinct(lines))).cast("long").alias("n_dup_lines"),
        "n_repeat_words",
        F.xxhash64(F.lower(F.array_join("_words", " "))).alias("_document"),
        F.transform(lines, lambda x: F.struct(_line_hash(x).alias("h"), F.length(F.btrim(x, F.lit(SPACE))).alias("n"))).alias("_lines"),
    )


def frequent_lines(seen: DataFrame, line_docs: int = LINE_DOCS, line_percent: int = LINE_PERCENT, line_many: int = LINE_MANY) -> DataFrame:
    """(_host, h) of the lines above the limits; from ``features``."""
    hosts = seen.groupBy("_host").agg(F.count_distinct("_document").alias("_docs"))
    lines = seen.select("_host", "_document", F.explode(F.array_distinct(F.transform("_lines", lambda x: x["h"]))).alias("h"))
    often = lines.groupBy("_host", "h").agg(F.count_distinct("_document").alias("_n")).where(F.col("_n") > line_docs)
    return often.join(hosts, "_host").where((F.col("_n") > line_many) | (F.col("_n") * 100 > F.col("_docs") * line_percent)).select("_host", "h")


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (F.col("n_repeat_words") * 100 > F.col("n_words") * REPEATED_PERCENT)


def judge(docs: DataFrame, depleted_percent: int = DEPLETED_PERCENT) -> DataFrame:
    """Base counts, base_failed and kept for every row, with _hash beside doc_id.

    A null text is an empty one, which fails for want of words; a null source is a host of its own. Repeated rows get
    equal verdicts. A text without lines loses nothing.
    """
    return _judged(docs, depleted_percent)[0]


def _judged(docs: DataFrame, depleted_percent: int) -> tuple[DataFrame, DataFrame]:
    """The rows of ``judge``, and (doc_id, _hash, h) of the frequent lines in them."""
    seen = stored(features(docs), "quality")
    # Written as well, so that both sides of the next join are plain shuffles, which Spark splits where a line is hot.
    often = stored(frequent_lines(seen), "quality-lines")
    total = F.aggregate("_lines", F.lit(0).cast("long"), lambda a, x: a + x["n"])
    lines = seen.select("_row", "doc_id", "_hash", "_host", total.alias("_total"), F.explode("_lines").alias("_line")).select("_row", "doc_id", "_hash", "_host", "_total", F.col("_line.h").alias("h"), F.col("_line.n").alias("n"))
    hit = lines.join(often, ["_host", "h"])
    lost = hit.groupBy("_row", "_total").agg(F.sum("n").alias("_lost"))
    bad = lost.where(F.col("_lost") * 100 > F.col("_total") * depleted_percent).select("_row", F.lit(True).alias("_bad"))
    out = seen.join(bad, "_row", "left")
    out = out.select(
        "doc_id", "_hash", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        base_failed().alias("base_failed"), (~base_failed() & F.col("_bad").isNull()).alias("kept"))
    return out, hit.select("doc_id", "_hash", "h")


def keep(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that are kept, with the columns of ``docs``; the frequent lines are taken out of ``text``, and
    ``n_chars``, if there, is counted anew where a line went. Blank lines stay."""
    judged, lines = _judged(docs, DEPLETED_PERCENT)
    # Rows of one key have equal lines and verdicts, as frequency is by host.
    bad = judged.where(~F.col("kept")).select("doc_id", "_hash", F.lit(None).cast("long").alias("h"))
    gone = bad.union(lines).groupBy(F.col("doc_id").alias("_id"), F.col("_hash").alias("_of")).agg(F.collect_set("h").alias("_gone"), F.max(F.col("h").isNull()).alias("_bad"))
    key = F.xxhash64(text_or_empty(), F.coalesce(F.col("source").cast("string"), F.lit("")))
    # The row travels as one column, so none of its names can clash.
    marked = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_doc"), F.col("doc_id").alias("_own"), key.alias("_key"))
    found = marked.join(gone, F.col("_own").eqNullSafe(F.col("_id")) & (F.col("_key") == F.col("_of")), "left").where("_bad is null or not _bad")
    left = F.filter(F.split(F.col("_doc.text"), "\n"), lambda x: ~F.array_contains("_gone", _line_hash(x)) | (F.btrim(x, F.lit(SPACE)) == ""))
    found = found.withColumn("_left", F.when(F.col("_gone").isNotNull(), F.array_join(left, "\n")))
    new = {"text": F.coalesce("_left", "_doc.text"), "n_chars": F.coalesce(F.length("_left"), F.col("_doc.n_chars")) if "n_chars" in docs.columns else None}
    return found.select(*[(new[c].cast(docs.schema[c].dataType) if c in new else F.col(f"_doc.`{c}`")).alias(c) for c in docs.columns])
