from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from millpond.functions import dates, messages, numbers, text
from millpond.functions.vectors import cosine_similarity


def one(spark, column):
    return spark.range(1).select(column.alias("v")).first().v


@pytest.mark.parametrize(
    "value, want",
    [
        ("2023-10-09T12:00:00", datetime(2023, 10, 9, 12)), ("2023-10-09", datetime(2023, 10, 9)), ("hello", None),
        ("not a date", None), ("", None), ("Oct 9, 2023", datetime(2023, 10, 9)), ("10/9/2023", datetime(2023, 10, 9)),
        ("2023-10-09T12:00:00+02:00", datetime(2023, 10, 9, 10)), ("12:30", None), ("2023", datetime(2023, 1, 1)),
        ("13/45/2023", None), ("October 9, 2023", datetime(2023, 10, 9)), (None, None),
    ],
)
def test_parse_datetime(spark, value, want):
    assert one(spark, dates.parse_datetime(F.lit(value).cast("string"))) == want


def test_epoch_numbers(spark):
    assert one(spark, dates.epoch_ms_to_datetime(F.lit(1640000000000))) == datetime(2021, 12, 20, 11, 33, 20)
    assert one(spark, dates.epoch_ms_to_datetime(F.lit(1640000000))) is None
    assert one(spark, dates.epoch_ms_to_datetime(F.lit(4102444800001))) is None


@pytest.mark.parametrize(
    "values, want",
    [
        ([datetime(2024, 1, 1, 9), datetime(2024, 1, 1, 10, 30)], "h:mm a"),
        ([datetime(2023, 1, 1), datetime(2024, 1, 1)], "MMM d, yyyy"),
        ([datetime(2024, 1, 1), datetime(2024, 2, 1)], "MMM d"),
        ([datetime(2024, 1, 1, 9), datetime(2024, 1, 2)], "MMM d, h:mm a"),
        ([datetime(2024, 1, 1)], "MMM d"),
        ([], "MMM d, yyyy"),
        ([None, datetime(2024, 1, 1, 9)], "h:mm a"),
    ],
)
def test_axis_pattern(spark, values, want):
    df = spark.createDataFrame([(v,) for v in values], "t timestamp_ntz")
    assert df.agg(dates.axis_pattern("t").alias("p")).first().p == want


def test_day_of_month(spark):
    as_of = datetime(2024, 2, 10)
    for n, want in [(15, 15), (31, 29), (0, 1), (-3, 1)]:
        assert one(spark, dates.day_of_month(F.lit(n), as_of)) == date(2024, 2, want)


def test_periods():
    as_of = datetime(2024, 5, 15, 13)  # a Wednesday
    assert dates.period_bounds("last week", as_of) == (datetime(2024, 5, 6), datetime(2024, 5, 13))
    assert dates.period_bounds("this month", as_of) == (datetime(2024, 5, 1), datetime(2024, 6, 1))
    assert dates.period_bounds("past quarter", as_of) == (datetime(2024, 1, 1), datetime(2024, 4, 1))
    assert dates.period_bounds("last year", as_of) == (datetime(2023, 1, 1), datetime(2024, 1, 1))
    with pytest.raises(ValueError):
        dates.period_bounds("next decade", as_of)
    assert dates._months_before(datetime(2024, 5, 31), 3) == datetime(2024, 2, 29)


@pytest.mark.parametrize("label, days", [("1M", 31), ("3M", 92), ("6M", 182), ("1Y", 366), ("All", 800)])
def test_ranges(spark, label, days):
    as_of = datetime(2024, 8, 1)
    df = spark.range(800).select((F.lit(as_of).cast("timestamp_ntz") - F.make_dt_interval(F.col("id"))).alias("t"))
    assert df.filter(dates.in_range("t", label, as_of)).count() == days


def test_run_time(spark):
    t = lambda *a: F.lit(datetime(*a)).cast("timestamp_ntz")
    none, as_of = F.lit(None).cast("timestamp_ntz"), datetime(2024, 1, 1, 0, 1)
    assert one(spark, dates.run_time_ms(t(2024, 1, 1), t(2024, 1, 1, 0, 0, 2), as_of)) == 2000
    assert one(spark, dates.run_time_ms(t(2024, 1, 1), none, as_of)) == 60_000
    assert one(spark, dates.run_time_ms(none, none, as_of)) == 0


def test_numbers(spark):
    df = spark.createDataFrame([("1.5",), ("x",), (None,), ("NaN",), ("7",)], "v string")
    assert [r[0] for r in df.select(numbers.parse_number("v")).collect()] == [1.5, None, None, None, 7.0]
    assert [r[0] for r in df.select(numbers.number_or_zero("v")).collect()] == [1.5, 0.0, 0.0, 0.0, 7.0]
    assert str(one(spark, numbers.exact_number(F.lit("12345678901234567890.0123456789")))) == "12345678901234567890.0123456789"


def test_slugs(spark):
    assert one(spark, text.slug(F.lit("Gmail Messages"))) == "gmail_messages"
    assert one(spark, text.slug(F.lit("--A  b!!C__"))) == "a_b_c"
    first, second = (one(spark, text.slug_id(F.lit(n))) for n in ("Gmail Messages", "Gmail-Messages"))
    assert first != second and first.startswith("gmail_messages_") and len(first) == len("gmail_messages_") + 6
    assert text.schema_name("test.connector-1") == "test_connector_1" and text.table_name("Event") == "event"
    assert one(spark, text.clean_identifier(F.lit("My.Table-1"))) == "my_table_1"


def test_report_blocks(spark):
    report = "# R\n```summary\n- one\n- two\n```\ntext\n```chart\n{\"type\": \"line\"}\n```\n```chart \n{bad\n```\n```summary\nlater```"
    assert one(spark, text.summary_block(F.lit(report))) == "- one\n- two"
    assert one(spark, text.summary_block(F.lit("no fence"))) == ""
    assert one(spark, text.summary_block(F.lit(None).cast("string"))) == ""
    assert one(spark, text.chart_blocks(F.lit(report))) == ['{"type": "line"}', "{bad"]
    assert one(spark, text.strip_reasoning(F.lit("a<reasoning>x\ny</reasoning>b<reasoning>z</reasoning>c"))) == "abc"


def test_error_text(spark):
    assert one(spark, text.error_text(F.lit("short"))) == "short"
    assert one(spark, text.error_text(F.lit("x" * 500))) == "x" * 500
    assert one(spark, text.error_text(F.lit("x" * 501))) == "x" * 497 + "..."
    assert one(spark, text.error_text(F.lit(None).cast("string"))) == "Unknown error occurred"


def test_camel_case():
    assert text.camel_case("sales by week") == "salesByWeek"
    assert text.camel_case("get_all_users") == "getAllUsers"
    assert text.camel_case("topSpenders") == "topSpenders"
    assert text.camel_case("Q1-report") == "q1Report"


PARTS = "parts array<struct<type: string, text: string, data: string>>"


def test_message_parts(spark):
    rows = [
        ([("text", "Hello", None), ("step-start", None, None), ("text", None, None), ("text", "there", None)],),
        ([("data-report-bundle", None, "R"), ("data-ui-bundle", None, None), ("data-other", None, "O"), ("data-ui-bundle", None, "U")],),
        ([],), (None,),
    ]
    df = spark.createDataFrame(rows, PARTS)
    got = df.select(
        messages.message_text("parts"), messages.has_part("parts", "text"), messages.artifacts("parts"),
        F.size(messages.visible_parts("parts"))).collect()
    assert tuple(got[0]) == ("Hello  there", True, [], 3)
    assert tuple(got[1]) == ("", False, ["R", "U"], 4)
    assert tuple(got[2])[:3] == ("", False, []) and tuple(got[3])[:3] == ("", False, [])


def test_words(spark):
    assert text.query_terms("Button OR 'ui' | UI & or") == ["button", "or", "ui"]
    assert one(spark, text.word_count(F.lit("The theme, the THE-the 4the"), ["the"])) == 4
    assert one(spark, text.word_count(F.lit("ab abc a"), ["a", "ab"])) == 2
    assert one(spark, text.has_word(F.lit(None).cast("string"), ["a"])) is False


def test_cosine(spark):
    a = lambda *x: F.array(*[F.lit(float(v)) for v in x])
    assert one(spark, cosine_similarity(a(1, 0), a(1, 1))) == pytest.approx(0.5**0.5)
    assert one(spark, cosine_similarity(a(0, 0), a(1, 1))) is None
