"""Text, date and number functions over whole tables."""

from datetime import datetime

from pyspark.sql import functions as F

from millpond.functions import dates, numbers, text
from millpond.plans import plan, read_parquet


@plan(
    "slugs", "E1",
    """SELECT p_partkey, trim(regexp_replace(lower(p_name || ' / ' || p_brand), '[^a-z0-9]+', '_', 'g'), '_') AS slug,
         trim(regexp_replace(lower(p_name || ' / ' || p_brand), '[^a-z0-9]+', '_', 'g'), '_') || '_' || substr(md5(p_name || ' / ' || p_brand), 1, 6) AS slug_id
       FROM part""",
)
def slugs(spark, sf):
    name = F.concat("p_name", F.lit(" / "), "p_brand")
    return read_parquet(spark, sf, "part").select("p_partkey", text.slug(name).alias("slug"), text.slug_id(name).alias("slug_id"))


@plan("clean_identifiers", "E2 K16", "SELECT page_id, lower(translate(url, '.-', '__')) AS identifier FROM pages")
def clean_identifiers(spark, sf):
    return read_parquet(spark, sf, "pages").select("page_id", text.clean_identifier("url").alias("identifier"))


@plan(
    "parsed_dates", "E3",
    """SELECT o_orderkey, CASE WHEN o_orderpriority <> '5-LOW' THEN o_orderdate END AS parsed,
         CASE WHEN o_orderdate >= TIMESTAMP '2000-01-01' THEN o_orderdate END AS from_ms FROM orders""",
)
def parsed_dates(spark, sf):
    d, p = F.col("o_orderdate"), F.col("o_orderpriority")
    written = (
        F.when(p == "1-URGENT", F.date_format(d, "yyyy-MM-dd'T'HH:mm:ss"))
        .when(p == "2-HIGH", F.date_format(d, "yyyy-MM-dd"))
        .when(p == "3-MEDIUM", F.date_format(d, "MMM d, yyyy"))
        .when(p == "4-NOT SPECIFIED", F.date_format(d, "M/d/yyyy"))
        .otherwise("not a date")
    )
    return read_parquet(spark, sf, "orders").select(
        "o_orderkey", dates.parse_datetime(written).alias("parsed"),
        dates.epoch_ms_to_datetime(F.unix_millis(d.cast("timestamp"))).alias("from_ms"))


@plan(
    "parsed_numbers", "E4 E5",
    """SELECT event_id, CASE WHEN event_type NOT IN ('error', 'view') THEN value END AS number,
         CASE WHEN event_type NOT IN ('error', 'view') THEN value ELSE 0.0 END AS number_or_zero FROM events""",
)
def parsed_numbers(spark, sf):
    kind = F.col("event_type")
    written = F.when(kind == "error", "n/a").when(kind == "view", "NaN").otherwise(F.col("value").cast("string"))
    return read_parquet(spark, sf, "events").select(
        "event_id", numbers.parse_number(written).alias("number"), numbers.number_or_zero(written).alias("number_or_zero"))


@plan(
    "default_labels", "E5",
    "SELECT p_partkey, CASE WHEN p_size < 10 THEN 'Item ' || (p_partkey + 1) ELSE p_name END AS label FROM part",
)
def default_labels(spark, sf):
    name = F.when(F.col("p_size") < 5, F.lit(None)).when(F.col("p_size") < 10, "").otherwise(F.col("p_name"))
    return read_parquet(spark, sf, "part").select("p_partkey", numbers.label_or_item(name, "p_partkey").alias("label"))


@plan(
    "report_summaries", "E6",
    r"""SELECT doc_id, regexp_replace(CASE WHEN lang = 'de' THEN '' ELSE text END, '^\s+|\s+$', '', 'g') AS summary FROM documents""",
)
def report_summaries(spark, sf):
    report = F.concat(F.lit("# Report\n\n```summary\n\n"), F.col("text"), F.lit("\n```\n\n```summary\nsecond\n```\n"))
    body = F.when(F.col("lang") == "de", F.col("text")).otherwise(report)
    return read_parquet(spark, sf, "documents").select("doc_id", text.summary_block(body).alias("summary"))


@plan(
    "texts_without_reasoning", "E8",
    "SELECT doc_id, text || ' and ' || lang AS text FROM documents",
)
def texts_without_reasoning(spark, sf):
    thought = F.concat(F.lit("<reasoning>because\n"), F.col("source"), F.lit("</reasoning>"))
    body = F.concat(thought, F.col("text"), F.lit(" and "), thought, F.col("lang"))
    return read_parquet(spark, sf, "documents").select("doc_id", text.strip_reasoning(body).alias("text"))


@plan(
    "json_path_values", "E11",
    """SELECT event_type, CAST(sum(CAST(json_extract_string(props, '$.k') AS BIGINT)) AS BIGINT) AS total, count(*) AS rows
       FROM events GROUP BY event_type""",
)
def json_path_values(spark, sf):
    k = text.json_value("props", "$.k").cast("long")
    return read_parquet(spark, sf, "events").groupBy("event_type").agg(F.sum(k).alias("total"), F.count("*").alias("rows"))


@plan(
    "job_run_times", "E12",
    """SELECT o_orderkey, CASE o_orderstatus WHEN 'P' THEN 0
         WHEN 'O' THEN date_diff('millisecond', o_orderdate, TIMESTAMP '2001-08-02')
         ELSE date_diff('millisecond', o_orderdate, o_orderdate + INTERVAL 90 SECOND) END AS run_time_ms FROM orders""",
)
def job_run_times(spark, sf):
    status, d = F.col("o_orderstatus"), F.col("o_orderdate")
    started = F.when(status != "P", d)
    finished = F.when(status == "F", d + F.expr("INTERVAL 90 SECOND"))
    return read_parquet(spark, sf, "orders").select(
        "o_orderkey", dates.run_time_ms(started, finished, datetime(2001, 8, 2)).alias("run_time_ms"))


@plan(
    "short_error_texts", "E13",
    """SELECT doc_id, CASE WHEN lang = 'es' THEN 'Unknown error occurred'
         WHEN length(text) > 500 THEN substr(text, 1, 497) || '...' ELSE text END AS error FROM documents""",
)
def short_error_texts(spark, sf):
    message = F.when(F.col("lang") != "es", F.col("text"))
    return read_parquet(spark, sf, "documents").select("doc_id", text.error_text(message).alias("error"))


@plan(
    "days_of_month", "E14",
    """SELECT p_partkey, make_date(2001, 2, CAST(least(greatest(p_size - 5, 1), 28) AS INTEGER)) AS day FROM part""",
)
def days_of_month(spark, sf):
    return read_parquet(spark, sf, "part").select(
        "p_partkey", dates.day_of_month(F.col("p_size") - 5, datetime(2001, 2, 14)).alias("day"))


@plan(
    "spend_of_past_quarter", "E15 A11",
    """SELECT o_orderpriority, count(*) AS orders, round(sum(o_totalprice), 2) AS spent FROM orders
       WHERE o_orderdate >= TIMESTAMP '2001-04-01' AND o_orderdate < TIMESTAMP '2001-07-01' GROUP BY 1""",
)
def spend_of_past_quarter(spark, sf):
    start, end = dates.period_bounds("past quarter", datetime(2001, 8, 1))
    orders = read_parquet(spark, sf, "orders")
    day = F.col("o_orderdate")
    return orders.filter((day >= F.lit(start).cast("timestamp_ntz")) & (day < F.lit(end).cast("timestamp_ntz"))).groupBy(
        "o_orderpriority").agg(F.count("*").alias("orders"), F.round(F.sum("o_totalprice"), 2).alias("spent"))


@plan(
    "array_arithmetic", "E16",
    """SELECT vec_id, len(embedding) AS dims, CAST(list_max(embedding) AS DOUBLE) AS largest, len([x for x in embedding if x > 0]) AS positive
       FROM embeddings""",
)
def array_arithmetic(spark, sf):
    e = F.col("embedding")
    return read_parquet(spark, sf, "embeddings").select(
        "vec_id", F.size(e).cast("long").alias("dims"), F.array_max(e).cast("double").alias("largest"),
        F.size(F.filter(e, lambda x: x > 0)).cast("long").alias("positive"))
