"""Rules, counts and findings as tables of any size."""

from __future__ import annotations

import datetime
import random

import pytest
from pyspark.sql import functions as F

from credtrail import default_rules
from credtrail.operators import aggregate as agg
from credtrail.operators import lookup, redact, scan
from credtrail.operators.ignore import without_ignored
from credtrail.plans import sizing
from credtrail.queries import history
from credtrail.rules import keyword_table
from credtrail.sources import layout

R = default_rules()


@pytest.mark.parametrize("limit", [sizing.BROADCAST_BYTES, 0])
def test_fifty_thousand_keywords(spark, monkeypatch, limit):
    monkeypatch.setattr(redact, "BROADCAST_BYTES", limit)
    rng = random.Random(1)
    words = sorted({"".join(rng.choices("abcdefgh_", k=rng.randint(2, 12))) for _ in range(60_000)})[:50_000]
    words += [words[0], "ÄÖ", "x.y*"]
    texts = [" ".join(rng.sample(words, 3) + ["".join(rng.choices("ABCDEFGH_", k=20))]) for _ in range(40)] + ["", "äö x.y* z"]
    keywords = spark.createDataFrame(list(enumerate(words)), "kw_idx INT, keyword STRING")
    lines = spark.createDataFrame(list(enumerate(texts)), "seq INT, line STRING")
    got = sorted(map(tuple, lookup.keyword_matches(lines, keywords, ["seq"]).collect()))
    folded = [w.lower() for w in words]
    assert got == sorted((i, k) for i, t in enumerate(texts) for k, w in enumerate(folded) if w in t.lower())
    exact = lookup.keyword_matches(lines, keywords, ["seq"], case_sensitive=True)
    want = sorted((i, k) for i, t in enumerate(texts) for k, w in enumerate(words) if w in t)
    assert sorted(map(tuple, exact.collect())) == want


def test_keyword_table_gives_the_same_findings(spark):
    texts = ["password=one11", "client_secret: abcd", "nothing=here", "TOKEN=T0K3N99", "x", '"auth": "zzzz9"', "token=password"]
    lines = spark.createDataFrame([(i, "f.env", t) for i, t in enumerate(texts)], "seq INT, file STRING, line STRING")
    names = ["seq", "key", "value", "hits", "kw_first"]
    a = scan.findings(lines, R).select(*names)
    b = lookup.findings_by_table(lines, keyword_table(spark, R), R, ["seq"]).select(*names)
    assert sorted(map(tuple, a.collect())) == sorted(map(tuple, b.collect())) and a.count() == 4


def test_globs_of_many_lists(spark):
    rng = random.Random(2)
    paths = [f"{rng.choice(['a', 'b/c', 'vendor', ''])}/{rng.choice(['x', 'y.go', 'z.min.js', 'vendor'])}" for _ in range(300)]
    files = spark.createDataFrame([(f"r{i % 4}", p, i) for i, p in enumerate(paths)], "repo STRING, file STRING, n INT")
    globs = [("r0", "**/x"), ("r0", "a/"), ("r1", "*.go"), ("r1", "vendor**"), ("r2", "b/c/x"), ("r2", "*.min.js"), (None, "a/")]

    def ignored(repo, path):
        if repo == "r0":
            return True
        if repo == "r1":
            return path.endswith(".go") or path.startswith("vendor")
        return repo == "r2" and (path == "b/c/x" or path.endswith(".min.js"))

    kept = without_ignored(files, spark.createDataFrame(globs, "repo STRING, glob STRING"), by=("repo",))
    got = {r.n for r in kept.collect()}
    assert got == {i for i, p in enumerate(paths) if not ignored(f"r{i % 4}", p)}
    plan = kept._jdf.queryExecution().executedPlan().toString()
    assert kept.columns == files.columns and "CartesianProduct" not in plan


def test_sketches_of_days_add_up(spark):
    rows = spark.range(30_000).select(
        F.concat(F.lit("f"), F.col("id") % 2).alias("file"), F.lit("k").alias("key"),
        F.md5((F.col("id") % 7000).cast("string")).alias("value"), (F.col("id") % 30).alias("day"),
    )
    kept = agg.value_sketches(rows, "file", "day")
    assert kept.count() == 30  # ids of even days are in one file
    for by, unique, overall in (((), 7000, 7000), (("file",), 3500, 3500)):
        for r in agg.sketched_values(kept, *by).collect():
            assert abs(r.unique_values - unique) < 0.05 * unique
            assert abs(r.global_unique_values - overall) < 0.05 * overall


def test_only_the_days_asked_for_are_read(spark, tmp_path):
    path = str(tmp_path / "days")
    found = history(spark, "/root/testdata/sf0.001").select("date", "file", "key", "value", "hits")
    layout.write_by_day(found, path)
    ranges = [(1, datetime.date(2024, 1, 3), datetime.date(2024, 1, 6)), (2, datetime.date(2024, 1, 5), datetime.date(2024, 1, 6)),
              (3, datetime.date(2024, 1, 9), datetime.date(2024, 1, 9))]
    ranges = spark.createDataFrame(ranges, "range INT, since DATE, until DATE")
    rows = layout.in_days(layout.read_by_day(spark, path), ranges.where("range < 9"))
    plan = rows._jdf.queryExecution().executedPlan().toString()
    scans = [x for x in plan.splitlines() if "PartitionFilters" in x]
    assert any("dynamicpruning" in x for x in scans)
    got = {(r.range, r["count"]) for r in rows.groupBy("range").count().collect()}

    def n(since, until):
        return agg.in_date_range(found, F.lit(since).cast("timestamp_ntz"), F.lit(until).cast("timestamp_ntz")).count()

    assert got == {(1, n("2024-01-03", "2024-01-06")), (2, n("2024-01-05", "2024-01-06"))}


def test_first_findings_leave_the_line_behind(spark):
    from credtrail.operators.dedup import first_findings

    plan = first_findings(history(spark, "/root/testdata/sf0.001"))._jdf.queryExecution().executedPlan().toString()
    for x in plan.splitlines():
        if "Exchange" in x or "SortAggregate" in x:
            assert "line" not in x
