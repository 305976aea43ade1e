"""Both sources as one scan, and long secrets over several rows."""

from __future__ import annotations

import datetime
import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from credtrail import default_rules
from credtrail.operators import merge, nested
from credtrail.plans import sizing
from credtrail.sources import records

R = default_rules()
SCHEMA = "file STRING, key STRING, value STRING, commit STRING, author STRING, date TIMESTAMP, hits INT, kw_first INT, seq BIGINT"


def rows_of_history(seed=1, n=400):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        hot = rng.random() < 0.4
        rows.append((
            "hot.env" if hot else f"f{rng.randrange(3)}.env", "password",
            "hot" if hot and rng.random() < 0.5 else f"v{rng.randrange(30):02d}",
            f"c{i % 90:03d}", f"dev{rng.randrange(12):02d}",
            datetime.datetime(2024, 1, 1) + datetime.timedelta(hours=i), rng.randint(1, 3), rng.randrange(5), i,
        ))
    return rows


def rows_of_current():
    now = datetime.datetime(2030, 1, 1)
    pairs = [("hot.env", "hot"), ("hot.env", "hot"), ("hot.env", "new"), ("f0.env", "v01"), ("only.env", "x"), ("only.env", "y")]
    return [(f, "password", v, "current", "current", now, 2, 7, i) for i, (f, v) in enumerate(pairs)]


@pytest.fixture(scope="module")
def sources(spark):
    return spark.createDataFrame(rows_of_current(), SCHEMA), spark.createDataFrame(rows_of_history(), SCHEMA)


def plain(history_wins):
    """(file, value) -> commits, and file -> authors, change count, occurrences."""
    current, history = rows_of_current(), rows_of_history()
    commits, files = defaultdict(list), {}
    for r in current:
        commits[r[0], r[2]] = ["current"]
    mine, theirs = defaultdict(list), set(commits)
    for r in history:
        mine[r[0], r[2]] += [r[3]] * r[6]
    known = {f for f, _ in mine}
    if history_wins:
        commits = {k: v for k, v in commits.items() if k[0] not in known} | dict(mine)
    else:
        commits = dict(commits) | {k: v for k, v in mine.items() if k not in theirs}
    for f in {f for f, _ in commits}:
        side = {r[4] for r in history if r[0] == f}
        here = {r[4] for r in current if r[0] == f}
        wins = history_wins and f in known
        n_here = 0 if wins else len({v for g, v in theirs if g == f})
        n_there = sum(r[6] for r in history if r[0] == f)
        files[f] = (side if wins else side | here, sum(g == f for g, _ in commits), n_here + n_there)
    return {k: sorted(v) for k, v in commits.items()}, files


@pytest.mark.parametrize("limit", [sizing.BROADCAST_BYTES, 0])
@pytest.mark.parametrize("history_wins", [False, True])
@pytest.mark.parametrize("part_size", [10_000, 10, 3])
def test_merged_lists(spark, sources, monkeypatch, tmp_path, part_size, history_wins, limit):
    monkeypatch.setattr(sizing.broadcast_if_small, "__defaults__", (limit,))
    rows = nested.merged_nested(*sources, R, part_size, history_wins)
    path = str(tmp_path / "both")
    records.write_secrets(rows, path)
    back = records.read_secrets(spark, path)
    assert records.incomplete_secrets(back).count() == 0
    commits, authors, facts = defaultdict(list), defaultdict(list), {}
    for r in back.collect():
        assert sum(len(h.commits) for h in r.history) < 2 * part_size and len(r.authors) <= part_size
        authors[r.file] += r.authors
        facts[r.file] = (r.changeCount, r.totalOccurrences)
        for h in r.history:
            commits[r.file, h.value] += h.commits
    want, files = plain(history_wins)
    assert {k: sorted(v) for k, v in commits.items()} == want
    assert {f: sorted(a) for f, a in authors.items()} == {f: sorted(a) for f, (a, _, _) in files.items()}
    assert facts == {f: (c, n) for f, (_, c, n) in files.items()}
    assert (back.agg(F.max("parts")).first()[0] > 1) == (part_size < 100)


def test_current_values_come_first(sources):
    row = nested.merged_nested(*sources, R).where("file = 'hot.env'").first()
    values = [h.value for h in row.history]
    assert values[:2] == ["hot", "new"] and row.history[0].commits == ["current"]
    firsts = [h.firstSeen for h in row.history[2:]]
    assert firsts == sorted(firsts)


def test_totals(sources):
    current, history = sources
    for wins, summary in ((False, merge.merged_summary), (True, merge.merged_summary_history_wins)):
        _, files = plain(wins)
        row = summary(current, history, R).first()
        assert row.secrets_found == len(files)
        assert row.total_occurrences == sum(n for _, _, n in files.values())
    both = len({(r[0], r[2]) for r in rows_of_current()}) + len({(r[0], r[2]) for r in rows_of_history()})
    assert row.total_values == both


def test_merging_with_nothing(sources):
    current, history = sources
    for a, b in ((current, history.limit(0)), (current.limit(0), history)):
        for wins in (False, True):
            rows = nested.merged_nested(a, b, R, history_wins=wins)
            side = a if b is not history else b
            assert rows.select(F.explode("history")).count() == side.select("file", "value").distinct().count()
    assert nested.merged_nested(current.limit(0), history.limit(0), R).count() == 0


def test_missing_parts_are_told(sources):
    rows = nested.merged_nested(*sources, R, 10)
    lost = rows.where("not (file = 'hot.env' and part = 1)")
    assert [r.file for r in records.incomplete_secrets(lost).collect()] == ["hot.env"]
    twice = rows.unionByName(rows.where("file = 'hot.env' and part = 1"))
    assert [r.file for r in records.incomplete_secrets(twice).collect()] == ["hot.env"]


def test_scan_results_carry_parts(spark, sources, tmp_path):
    rows = nested.merged_nested(*sources, R, 10)
    path = str(tmp_path / "scan")
    records.write_scan_results(records.scan_results(rows, "r", "b", "d", result_size=50), path)
    back = records.read_scan_results(spark, path)
    assert spark.read.text(path).count() > 1 and records.incomplete_secrets(back).count() == 0
    assert back.count() == rows.count()


@pytest.mark.parametrize("quoting", ["standard", "flat"])
@pytest.mark.parametrize("part_size", [10_000, 2])
def test_csv_files_alone_hold_everything(spark, sources, tmp_path, part_size, quoting):
    _, history = sources
    path = str(tmp_path / "csv")
    records.write_csv(nested.csv_view(history, R, part_size), path, quoting)
    back = records.read_csv(spark, path)
    header = spark.read.option("sep", ";").text(path).where("value like 'File;%'").first()[0]
    assert len(header.split(";")) == (11 if part_size > 2 else 13)
    lists = defaultdict(list)
    for r in records.csv_lists(back).collect():
        lists[r.File, r.kind].append(r.text)
    rows = rows_of_history()
    for f in {r[0] for r in rows}:
        assert sorted(lists[f, "author"]) == sorted({r[4] for r in rows if r[0] == f})
        assert len(lists[f, "value"]) == len({r[2] for r in rows if r[0] == f})
    facts = {r.File: (r.ChangeCount, r.TotalOccurrences) for r in records.csv_secrets(back).collect()}
    assert facts == {f: (len({r[2] for r in rows if r[0] == f}), sum(r[6] for r in rows if r[0] == f)) for f in {r[0] for r in rows}}
