from __future__ import annotations

import datetime
from dataclasses import replace

from pyspark.sql import functions as F

from credtrail import default_rules
from credtrail.operators import aggregate as agg
from credtrail.operators import merge, pickaxe, scan
from credtrail.operators.dedup import first_findings, longest_first, usable_values
from credtrail.queries import commit_lines

R = default_rules()
SCHEMA = (
    "seq BIGINT, commit STRING, author STRING, date TIMESTAMP, file STRING, sign STRING, "
    "line STRING"
)


def day(n):
    return datetime.datetime(2024, 1, n)


def lines(spark, rows):
    """``(commit, author, day, file, sign, line)``"""
    data = [(i, c, a, day(d), f, s, x) for i, (c, a, d, f, s, x) in enumerate(rows)]
    return spark.createDataFrame(data, SCHEMA)


def tuples(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


def test_a_line_counts_once_per_keyword(spark):
    df = lines(spark, [("c1", "a", 1, "x.env", "+", "client_secret=abcdef")])
    row = scan.scan_history(df, R).first()
    # secret, and client_secret in two groups
    assert (row.hits, row.kw_first) == (3, 5)
    hits = scan.by_keyword(scan.scan_history(df, R), R)
    assert tuples(hits, "kw_idx", "keyword") == [
        (5, "secret"), (6, "client_secret"), (30, "client_secret"),
    ]


def test_filters(spark):
    df = lines(spark, [
        ("c1", "a", 1, "x.env", "-", "password=removed1x"),
        ("c1", "a", 1, "x.md", "+", "password=inmarkdown"),
        ("c1", "a", 1, "x.png", "+", "password=inpicture"),
        ("c1", "a", 1, "x.env", "+", "timeout=30"),
        ("c1", "a", 1, "x.env", "+", "PASSWORD=kept1"),
        ("c1", "a", 1, "x.env", "+", "password = https://h/x"),
        ("c1", "a", 1, "x.env", "+", "password"),
    ])
    assert tuples(scan.scan_history(df, R), "key", "value") == [("PASSWORD", "kept1")]
    strict = replace(R, case_sensitive=True)
    assert scan.scan_history(df, strict).count() == 0


def test_ref_filter(spark):
    df = lines(spark, [("c1", "a", 1, "x", "+", "pass=abc"), ("c2", "a", 1, "x", "+", "pass=abd")])
    df = df.withColumn("ref", F.when(F.col("commit") == "c1", "main").otherwise("dev"))
    assert tuples(scan.scan_history(df, R, "main"), "value") == [("abc",)]
    assert scan.scan_history(df, R).count() == 2


def test_fallthrough(spark):
    df = lines(spark, [("c1", "a", 1, "x", "+", 'pass = f("password": "realvalue1")')])
    assert scan.scan_history(df, R).count() == 0
    rules = replace(R, fallthrough=True)
    assert tuples(scan.scan_history(df, rules), "key", "value") == [("password", "realvalue1")]


def history_and_current(spark):
    history = scan.scan_history(lines(spark, [
        ("c2", "bob", 2, "x", "+", "password=shared1"),
        ("c1", "ann", 1, "x", "+", "password=shared1"),
        ("c1", "ann", 1, "x", "+", "password=oldone"),
        ("c1", "ann", 1, "y", "+", "token=onlyhist"),
    ]), R)
    files = spark.createDataFrame(
        [("x", "password=shared1"), ("x", "password=shared1"), ("x", "password=newone"),
         ("z", "pwd=onlycurrent")], "file STRING, line STRING")
    current = scan.scan_current(files, F.lit(day(30)), R)
    return current, history


def test_merge(spark):
    current, history = history_and_current(spark)
    rows = merge.merged_secrets(current, history, R)
    # password: hits of password and pass in history (2 each line), one per current value
    assert tuples(rows, "file", "key", "type", "change_count", "total_occurrences") == [
        ("x", "password", "password", 3, 2 + 6),
        ("y", "token", "token", 1, 1),
        ("z", "pwd", "pwd", 1, 1),
    ]
    # a shared value keeps the current dates
    assert rows.where("file = 'x'").first().first_seen == day(1)
    shared = merge.merged_values(current, history).where("value = 'shared1'").first()
    assert (shared.first_seen, shared.last_seen) == (day(30), day(30))
    authors = tuples(merge.merged_authors(current, history).where("file = 'x'"), "author")
    assert authors == [("ann",), ("bob",), ("current",)]


def test_history_wins(spark):
    current, history = history_and_current(spark)
    rows = merge.merged_secrets_history_wins(current, history, R)
    assert tuples(rows, "file", "change_count", "total_occurrences", "last_seen") == [
        ("x", 2, 6, day(2)), ("y", 1, 1, day(1)), ("z", 1, 1, day(30)),
    ]


def test_live_and_gone(spark):
    current, history = history_and_current(spark)
    assert tuples(merge.still_live(current, history), "value") == [("shared1",)]
    assert tuples(merge.only_in_history(current, history), "value") == [
        ("oldone",), ("onlyhist",),
    ]


def test_union_prefers_current_then_keyword_then_log_order(spark):
    current, history = history_and_current(spark)
    rows = merge.findings_union(current, history)
    assert tuples(rows, "value", "commit") == [
        ("newone", "current"), ("oldone", "c1"), ("onlycurrent", "current"),
        ("onlyhist", "c1"), ("shared1", "current"),
    ]
    assert tuples(first_findings(history), "value", "commit")[2] == ("shared1", "c2")


def test_merge_with_itself_changes_no_values(spark):
    _, history = history_and_current(spark)
    rows = merge.merged_secrets(history.limit(0), history, R)
    want = agg.secrets(history, R)
    names = ("file", "key", "type", "change_count", "total_occurrences")
    assert tuples(rows, *names) == tuples(want, *names)


def test_group_type(spark):
    keys = spark.createDataFrame([("client_secret",), ("my_secret",), ("auth",)], "key STRING")
    assert tuples(agg.with_group_type(keys, R), "key", "type_group") == [
        ("auth", "credentials"), ("client_secret", "secret"), ("my_secret", "unknown"),
    ]


def test_source_detection(spark):
    current, history = history_and_current(spark)
    def source(df):
        return agg.detect_source(df).first().source

    assert source(current) == "current"
    assert source(history) == "history"
    assert source(merge.both_sources(current, history)) == "both"
    assert source(history.limit(0)) == "both"
    removed = current.withColumn("value", F.lit("xREMOVEDx"))
    assert source(removed) == "both"


def test_gate_and_range(spark):
    _, history = history_and_current(spark)
    assert tuple(agg.gate(history).first()) == (True, 4)
    assert tuple(agg.gate(history.limit(0)).first()) == (False, 0)
    assert agg.in_date_range(history, F.lit(day(2)), F.lit(day(3))).count() == 1


def test_pickaxe_misses_changed_values(spark):
    df = lines(spark, [
        ("c1", "a", 1, "x", "+", "password=one1"),
        ("c2", "a", 2, "x", "-", "password=one1"),
        ("c2", "a", 2, "x", "+", "password=two2"),
        ("c3", "a", 3, "x", "+", "PASSWORD=three3"),
    ])
    changed = pickaxe.pickaxe_commits(df, R).where("keyword = 'password'")
    assert tuples(changed, "commit") == [("c1",)]
    found = pickaxe.pickaxe_findings(scan.scan_history(df, R), df, R)
    assert tuples(found, "commit", "value", "kw_first") == [("c1", "one1", 0), ("c1", "one1", 3)]


def test_longest_first(spark):
    found = spark.createDataFrame(
        [("abc",), ("abcdef",), ("xREMOVEDy",), ("",), ("abd",), ("abc",)], "value STRING")
    assert [r.value for r in longest_first(usable_values(found)).collect()] == [
        "abcdef", "abc", "abd",
    ]


def test_dates_keep_the_offset_of_the_author(spark):
    df = lines(spark, [("c1", "a", 1, "x", "+", "pwd=abc"), ("c2", "a", 1, "x", "+", "pwd=abc")])
    raw = F.when(F.col("commit") == "c1", "2024-01-01T01:00:00+05:00").otherwise(
        "2024-01-01T00:30:00Z")
    df = df.withColumn("date_raw", raw).withColumn("date", F.to_timestamp("date_raw"))
    row = agg.secrets(scan.scan_history(df, R), R).first()
    assert row.first_raw == "2024-01-01T01:00:00+05:00"
    assert row.last_raw == "2024-01-01T00:30:00Z"


def test_repositories_stay_apart(spark):
    df = lines(spark, [("c1", "a", 1, "x", "+", "pwd=abc"), ("c2", "a", 1, "x", "+", "pwd=abc")])
    df = df.withColumn("repo", F.col("commit"))
    rows = agg.secrets(scan.scan_history(df, R), R)
    assert tuples(rows, "repo", "change_count") == [("c1", 1), ("c2", 1)]


def test_known_numbers(spark):
    df = commit_lines(spark, "/root/testdata/sf0.01")
    found = scan.scan_history(df, R)
    total = found.agg(F.count("*"), F.sum("hits")).first()
    assert tuple(total) == (1800, 4066)
    values = found.select("file", "key", "value").distinct().count()
    assert (values, usable_values(found).count()) == (235, 84)
    top = agg.by_change_count(agg.secrets(found, R)).first()
    assert (top.file, top.key, top.change_count, top.total_occurrences) == (
        "cfg/svc2.env", "password", 39, 312)


def test_empty_table(spark):
    df = lines(spark, [("c1", "a", 1, "x", "+", "nothing")]).limit(0)
    found = scan.scan_history(df, R)
    assert tuple(agg.scan_summary(agg.secrets(found, R)).first()) == (0, 0, 0)
