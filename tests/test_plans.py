from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from credtrail import default_rules
from credtrail.operators import nested, scan
from credtrail.operators import aggregate as agg
from credtrail.operators.timeline import secret_timeline
from credtrail.plans.ranking import numbered
from credtrail.plans.sizing import byte_size, spread
from credtrail.queries import commit_lines
from credtrail.sources import records

R = default_rules()


@pytest.fixture(scope="module")
def found(spark):
    return scan.scan_history(commit_lines(spark, "/root/testdata/sf0.001"), R).cache()


def hot_rows():
    """One key with two thirds of the rows, many ties."""
    random.seed(7)
    rows = [("hot", random.randrange(40), i) for i in range(2000)]
    rows += [(f"k{i % 300}", random.randrange(5), 5000 + i) for i in range(1000)]
    random.shuffle(rows)
    return rows


@pytest.fixture
def many_slices(spark):
    """Keep tiny partitions apart, so that hot groups span several."""
    name = "spark.sql.adaptive.coalescePartitions.enabled"
    spark.conf.set(name, "false")
    yield
    spark.conf.unset(name)


@pytest.mark.usefixtures("many_slices")
def test_numbers_inside_a_hot_group(spark):
    rows = hot_rows()
    df = spark.createDataFrame(rows, "k STRING, a INT, b INT").repartition(8)
    out = numbered(
        df, [F.col("a").desc(), F.col("b").asc()], ["k"],
        neighbours={"before": "-b", "after": "+b"},
    )
    got = {(r.k, r.b): (r.position, r.before, r.after) for r in out.collect()}
    want = {}
    for key in {r[0] for r in rows}:
        group = sorted((r for r in rows if r[0] == key), key=lambda r: (-r[1], r[2]))
        for i, r in enumerate(group):
            want[key, r[2]] = (
                i + 1,
                group[i - 1][2] if i else None,
                group[i + 1][2] if i + 1 < len(group) else None,
            )
    assert got == want


@pytest.mark.usefixtures("many_slices")
def test_hot_group_spreads_over_slices(spark):
    df = spark.createDataFrame(hot_rows(), "k STRING, a INT, b INT")
    laid = df.repartitionByRange(F.col("k"), F.col("a"), F.col("b"))
    parts = laid.where("k = 'hot'").select(F.spark_partition_id()).distinct().count()
    assert parts > 1


@pytest.mark.usefixtures("many_slices")
def test_weights_without_keys(spark):
    df = spark.createDataFrame([(i, i % 3 + 1) for i in range(100)], "i INT, w INT")
    out = numbered(df, [F.col("i").asc()], weight=F.col("w")).orderBy("i").collect()
    total = 0
    for r in out:
        total += r.w
        assert r.position == total


def test_empty(spark):
    df = spark.createDataFrame([], "i INT")
    assert numbered(df, [F.col("i").asc()]).count() == 0


def test_timeline_by_occurrences(spark, found):
    rows = secret_timeline(agg.values(found), "occurrences")
    one = rows.where("version = 1").select("file", "key", "occurrences")
    most = agg.values(found).groupBy("file", "key").agg(F.max("occurrences").alias("occurrences"))
    assert one.exceptAll(most).count() == 0 and one.count() == most.count()


def flat(df):
    """(file, key, value) -> sorted commits and authors, over all parts."""
    each = df.select("file", "key", F.explode("history").alias("h"))
    out = {}
    for r in each.collect():
        commits, authors = out.setdefault((r.file, r.key, r.h.value), ([], set()))
        commits += r.h.commits
        authors |= set(r.h.authors)
    return {k: (sorted(c), a) for k, (c, a) in out.items()}


def test_parts_hold_everything(spark, found):
    whole = nested.nested_secrets(found, R)
    parts = nested.nested_secrets(found, R, part_size=3)
    assert whole.where("part > 0").count() == 0
    assert parts.where("part > 0").count() > 0
    # a part holds its size, and one row of at most its size that crosses the end
    most = parts.select(F.expr("aggregate(history, 0, (n, h) -> n + size(h.commits))").alias("n"))
    assert most.agg(F.max("n")).first()[0] <= 6
    assert flat(whole) == flat(parts)
    occurrences = {
        (r.file, r.key, r.value): r.occurrences for r in agg.values(found).collect()
    }
    assert {k: len(c) for k, (c, _) in flat(parts).items()} == occurrences


def test_nested_order_and_text(spark, found):
    for r in nested.nested_secrets(found, R).collect():
        assert r.changeCount == len(r.history)
        assert r.totalOccurrences == sum(len(h.commits) for h in r.history)
        firsts = [h.firstSeen for h in r.history]
        assert firsts == sorted(firsts)
        assert sorted(r.authors) == r.authors
        assert all(h.firstSeen.endswith("Z") for h in r.history)


def test_parts_come_together_when_read(spark, found, tmp_path):
    path = str(tmp_path / "secrets")
    records.write_secrets(nested.nested_secrets(found, R, part_size=3), path)
    back = records.analyzed_secrets(records.read_secrets(spark, path))
    names = ["file", "key", "type", "change_count", "total_occurrences"]
    want = agg.secrets(found, R).select(*names)
    got = back.select(*names)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_csv_parts(spark, found):
    whole = {(r.File, r.Key): r for r in nested.csv_view(found, R).collect()}
    parts = {}
    for r in nested.csv_view(found, R, part_size=2).orderBy("Part").collect():
        parts.setdefault((r.File, r.Key), []).append(r)
    assert any(len(p) > 1 for p in parts.values())
    for key, rows in parts.items():
        assert " | ".join(r.Values for r in rows if r.Values) == whole[key].Values
        assert ", ".join(r.Authors for r in rows if r.Authors) == whole[key].Authors


def test_sizes(spark):
    df = spark.createDataFrame([("a" * 100, 1), ("b" * 50, 2)], "s STRING, n INT")
    assert 150 < byte_size(df) < 1000
    assert byte_size(df.limit(0)) == 0
    assert spread(df.coalesce(1), "n").rdd.getNumPartitions() == 8


def test_no_python_and_no_nested_loops_in_the_scan(spark):
    df = agg.secrets(scan.scan_history(commit_lines(spark, "/root/testdata/sf0.001"), R), R)
    plan = df._jdf.queryExecution().executedPlan().toString()
    for word in ("Python", "Pandas", "NestedLoop", "Cartesian", "SortAggregate"):
        assert word not in plan
    # the regexes are there once per use in the extraction, not once per test
    assert plan.count("RLIKE(line") <= 8
