from __future__ import annotations

from pyspark.sql import functions as F

from credtrail.functions import dates, text


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def test_mask(spark):
    cases = {"ab": "****", "abcd": "****", "abcde": "ab*de", "x" * 40: "xx" + "*" * 16 + "xx"}
    for value, want in cases.items():
        assert one(spark, text.mask(F.lit(value))) == want
    assert one(spark, text.mask(F.lit("x" * 40), capped=False)) == "xx" + "*" * 36 + "xx"


def test_texts(spark):
    assert one(spark, text.preview(F.lit("abcdefghijkl"))) == "abcdefghij..."
    assert one(spark, text.preview(F.lit("abc"))) == "abc"
    assert one(spark, text.truncate(F.lit("abcdefgh"), 6)) == "abc..."
    assert one(spark, text.truncate(F.lit("abcdef"), 6)) == "abcdef"
    assert one(spark, text.csv_escape(F.lit("a;b\nc"))) == '"a,b c"'
    assert one(spark, text.csv_escape(F.lit('a"b'))) == '"a""b"'
    assert one(spark, text.csv_escape(F.lit("ab"))) == "ab"
    assert one(spark, text.count_literal(F.lit("passpass pas"), F.lit("pass"))) == 2
    assert one(spark, text.bar_width(F.lit(10), F.lit(20))) == 25
    assert one(spark, text.bar_width(F.lit(20), F.lit(20))) == 30
    assert one(spark, text.bar_width(F.lit(0), F.lit(0))) == 0
    assert one(spark, text.bar_width(F.lit(5), F.lit(10), 20, None)) == 10


def test_quoting(spark):
    for raw in ("a.b*c", "x$y{z}", "back\\slash", "(a|b)[c]^d?e+f", "plain"):
        assert one(spark, text.quote_regex(F.lit(raw))) == text.java_quote(raw)
        assert one(spark, F.lit(raw).rlike("^" + text.java_quote(raw) + "$"))


def test_regex_dialect():
    assert text.java_regex(r"^\s*a$") == r"(?d)^[ \t\n\f\r]*a\z"
    assert text.java_regex(r"[\s$&[]\$") == r"(?d)[ \t\n\f\r$\&\[]\$"
    assert text.java_regex(r"\\s") == r"(?d)\\s"


def test_dates(spark):
    early, late = F.lit("2024-01-01T01:00:00+05:00"), F.lit("2024-01-01T00:30:00Z")
    assert one(spark, dates.compare_dates(early, late)) == -1
    assert one(spark, dates.compare_dates(late, early)) == 1
    assert one(spark, dates.compare_dates(early, early)) == 0
    # an unreadable date comes before all others
    assert one(spark, dates.compare_dates(F.lit("soon"), early)) == -1
    assert one(spark, dates.local_day(early)) == "2024-01-01"
    assert one(spark, dates.local_day(F.lit("soon"))) == "soon"
    a = F.lit("2024-01-01T00:00:00Z").cast("timestamp")
    b = F.lit("2024-01-02T23:59:59Z").cast("timestamp")
    assert one(spark, dates.days_between(a, b)) == 1
