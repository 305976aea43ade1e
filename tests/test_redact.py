from __future__ import annotations

import random
import re

import pytest
from pyspark.sql import functions as F

from credtrail import default_rules
from credtrail.operators import redact, scan
from credtrail.plans import sizing

R = default_rules()
MARK = "***REMOVED***"


def brute(text, values):
    for v in sorted(values, key=lambda v: (-len(v), v)):
        text = text.replace(v, MARK)
    return text


def world(seed=3, n_values=90):
    random.seed(seed)
    alphabet = "ab1_-.$é"
    values = {"".join(random.choices(alphabet, k=random.randint(1, 14))) for _ in range(n_values)}
    values |= {"AKIA0000" + str(i) for i in range(30)} | {"sharedprefix-xyz", "prefix-x"}
    values = [v for v in values if v]
    texts = []
    for i in range(120):
        words = random.choices(["plain", "words", "\n", "x", "é"], k=12)
        words += random.choices(values, k=random.randint(0, 3))
        random.shuffle(words)
        texts.append((i, "".join(words)))
    texts += [(1000, ""), (1001, "\n\n"), (1002, "nothing to see")]
    return texts, values


@pytest.mark.parametrize("limit", [sizing.BROADCAST_BYTES, 0])
def test_anchor_kernel_is_exact(spark, monkeypatch, limit):
    """Broadcast or shuffled, long and short values, shared starts."""
    monkeypatch.setattr(redact, "BROADCAST_BYTES", limit)
    texts, values = world()
    df = spark.createDataFrame(texts, "id INT, text STRING")
    vals = spark.createDataFrame([(v,) for v in values], "value STRING")
    done = redact.redact_by_anchor(df, vals, ["id"], "text")
    got = {r.id: (r.redacted, r.modified) for r in done.collect()}
    want = {i: (brute(t, values), brute(t, values) != t) for i, t in texts}
    assert got == want


@pytest.mark.parametrize("limit", [sizing.BROADCAST_BYTES, 0])
def test_found_values_are_exact(spark, monkeypatch, limit):
    monkeypatch.setattr(redact, "BROADCAST_BYTES", limit)
    texts, values = world(5)
    df = spark.createDataFrame(texts, "id INT, text STRING")
    vals = spark.createDataFrame([(v,) for v in values], "value STRING")
    got = {tuple(r) for r in redact.find_values(df, vals, ["id"], "text").collect()}
    assert got == {(i, v) for i, t in texts for v in values if v in t}


def test_values_with_line_ends(spark):
    df = spark.createDataFrame([(1, "a key\nvalue1 b"), (2, "key value1")], "id INT, text STRING")
    vals = spark.createDataFrame([("key\nvalue1",)], "value STRING")
    got = {r.id: r.redacted for r in redact.redact_by_anchor(df, vals, ["id"], "text").collect()}
    assert got == {1: f"a {MARK} b", 2: "key value1"}


def test_few_values_are_folded(spark):
    texts, values = world(9, 20)
    values = values[:40]
    df = spark.createDataFrame(texts, "id INT, text STRING")
    vals = spark.createDataFrame([(v,) for v in values], "value STRING")
    got = {r.id: r.redacted for r in redact.redact(df, vals, ["id"], "text").collect()}
    assert got == {i: brute(t, values) for i, t in texts}


def test_no_values(spark):
    df = spark.createDataFrame([(1, "text")], "id INT, text STRING")
    vals = spark.createDataFrame([], "value STRING")
    for kernel in (redact.redact, redact.redact_by_anchor):
        row = kernel(df, vals, ["id"], "text").first()
        assert (row.redacted, row.modified) == ("text", False)


def test_anchor_is_the_rarest_piece(spark):
    values = [(f"eyJhbGciOiJI{i:08d}",) for i in range(1000, 1100)]
    rows = redact.anchors(spark.createDataFrame(values, "value STRING"))
    assert rows.count() == 100
    # no anchor is shared, although all values start alike
    assert rows.select("anchor").distinct().count() == 100


def test_pattern_batches(spark):
    values = [("v" * (i % 50 + 3) + str(i),) for i in range(250)] + [("a.b*(c",)]
    rows = redact.pattern_batches(spark.createDataFrame(values, "value STRING")).orderBy("batch")
    rows = rows.collect()
    assert [(r.batch, r.n) for r in rows] == [(0, 100), (1, 100), (2, 51)]
    listed = [v for r in rows for v in r.pattern[1:-1].split("|")]
    want = sorted((v for v, in values), key=lambda v: (-len(v), v))
    assert listed == [v.replace("a.b*(c", r"a\.b\*\(c") for v in want]


def test_pattern_kernel(spark):
    texts, values = world(11)
    # whole words, so that order inside a text cannot matter
    values = [v for v in values if len(v) >= 6]
    texts = [(i, f"<{random.choice(values)}> and ]{random.choice(values)}[") for i in range(60)]
    df = spark.createDataFrame(texts, "id INT, text STRING")
    vals = spark.createDataFrame([(v,) for v in set(values)], "value STRING")
    one = redact.redact_by_pattern(df, vals, ["id"], "text")
    import re

    pattern = "|".join(re.escape(v) for v in sorted(set(values), key=lambda v: (-len(v), v)))
    got = {r.id: r.redacted for r in one.collect()}
    assert got == {i: re.sub(pattern, MARK, t) for i, t in texts}


@pytest.mark.parametrize("limit", [redact.BROADCAST_BYTES, 0])
def test_one_meaning_for_any_number_of_values(spark, monkeypatch, limit):
    monkeypatch.setattr(redact, "BROADCAST_BYTES", limit)
    monkeypatch.setattr("credtrail.plans.sizing.BROADCAST_BYTES", limit)
    rows = [(1, "password=secret1value"), (None, "x=secret1value MOVE"), (3, "abcdefg"), (4, None)]
    df = spark.createDataFrame(rows, "id INT, text STRING")
    seen = []
    for n in (10, 100, 2000):
        values = ["MOVE", "secret1value", "abcd", "cdefg", *(f"filler{i:06d}" for i in range(n))]
        vals = spark.createDataFrame([(v,) for v in values], "value STRING")
        done = redact.redact(df, vals, ["id"], "text").collect()
        seen.append({r.id: (r.redacted, r.modified) for r in done})
    assert seen[0] == seen[1] == seen[2]
    assert seen[0] == {
        1: (f"password={MARK}", True), None: (f"x={MARK} {MARK}", True),
        3: (f"ab{MARK}", True), 4: (None, False),
    }


def test_only_named_files(spark):
    files = spark.createDataFrame(
        [(1, "a", "pw=value123"), (2, "b", "pw=value123"), (3, "c", "value123" + "x" * 2_000_000)],
        "id INT, file STRING, text STRING")
    found = spark.createDataFrame([("a", "value123"), ("c", "value123")], "file STRING, value STRING")
    rows = redact.redact_files(files, found, ["id"], "text", max_bytes=1 << 20).collect()
    assert [(r.id, r.redacted) for r in rows] == [(1, f"pw={MARK}")]
    rows = redact.redact_files(files, found, ["id"], "text").collect()
    assert sorted(r.id for r in rows if r.modified) == [1, 3]
    assert redact.redact_files(files, found.limit(0), ["id"], "text").count() == 0


def test_scan_of_redacted_lines_is_empty(spark):
    rows = [(i, "x.env", f"password=secret{i}value") for i in range(30)]
    df = spark.createDataFrame(rows, "seq INT, file STRING, line STRING")
    found = scan.findings(df, R)
    done = redact.redact_lines(df, redact.usable_values(found), ["seq"])
    again = done.select("seq", "file", F.col("redacted").alias("line"))
    assert scan.findings(again, R).count() == 0
    assert redact.residual(done, redact.usable_values(found), ["seq"]).count() == 0
    assert tuple(redact.redact_summary(done).first()) == (30, 30)


def test_plan(spark):
    found = spark.createDataFrame(
        [(f"f{i % 3}", f"value{i}", "current") for i in range(205)],
        "file STRING, value STRING, commit STRING")
    row = redact.redact_plan(found).first()
    assert tuple(row) == (205, 3, "current", 3)
    shown = redact.redact_preview(redact.usable_values(found)).orderBy("rank").collect()
    assert [r.rank for r in shown] == list(range(1, 11))
    assert shown[0].masked == "va****00"
    loaded = redact.load_for_cleaning(found)
    assert (loaded.values.count(), loaded.files.count()) == (205, 3)
    assert loaded.source.first().source == "current"


def test_written_to_a_new_path(spark, tmp_path):
    from credtrail.sources.records import write_redacted

    df = spark.createDataFrame([(1, "pw=value123")], "id INT, text STRING")
    vals = spark.createDataFrame([("value123",)], "value STRING")
    path = str(tmp_path / "out")
    write_redacted(redact.redact(df, vals, ["id"], "text"), path, "text")
    assert spark.read.parquet(path).first().text == f"pw={MARK}"
    with pytest.raises(Exception, match="exist"):
        write_redacted(redact.redact(df, vals, ["id"], "text"), path, "text")


def test_marks_and_replacements_in_the_text(spark):
    """Whatever a text holds already, a fold replaces what was there at first."""
    texts = [(1, "x \ufdd0\ufdd1 y password=abcdef"), (2, MARK + "abcdef" + MARK), (3, "abcABCDEFdef"), (4, None)]
    values = ["abcdef", "ABCDEF", "MOVE", "***"]
    df = spark.createDataFrame(texts, "id INT, text STRING")
    vals = spark.createDataFrame([(v,) for v in values], "value STRING")
    got = {r.id: (r.redacted, r.modified) for r in redact.redact(df, vals, ["id"], "text").collect()}
    assert got[1] == (f"x \ufdd0\ufdd1 y password={MARK}", True)
    assert got[2] == ((f"{MARK}RE{MARK}D{MARK}") + MARK + (f"{MARK}RE{MARK}D{MARK}"), True)
    assert got[3] == (f"abc{MARK}def", True) and got[4] == (None, False)


def by_pattern(text, values, size, replacement=MARK):
    ordered = sorted(set(values), key=lambda v: (-len(v), v))
    for i in range(0, len(ordered), size):
        text = re.sub("|".join(map(re.escape, ordered[i : i + size])), lambda m: replacement, text)
    return text


@pytest.mark.parametrize("limit", [sizing.BROADCAST_BYTES, 0])
@pytest.mark.parametrize("replacement", [MARK, "$1\\x", "ab", ""])
def test_pattern_kernel_with_many_values(spark, monkeypatch, limit, replacement):
    """More than a thousand values, batches of all lengths, values that a replacement completes."""
    monkeypatch.setattr(redact, "BROADCAST_BYTES", limit)
    random.seed(12)
    values = ["".join(random.choices("ab*$x1", k=random.randint(3, 9))) for _ in range(1500)]
    values = sorted({*values, "***x", "MOV", "xab", "b$1"})
    texts = [(i, "".join(random.choices(["z", "b", "a ", *random.sample(values, 4)], k=14))) for i in range(60)]
    texts += [(100, "nothing"), (101, "")]
    df = spark.createDataFrame([*texts, (102, None)], "id INT, text STRING")
    vals = spark.createDataFrame([(v,) for v in values], "value STRING")
    got = {r.id: (r.redacted, r.modified) for r in redact.redact_by_pattern(df, vals, ["id"], "text", replacement).collect()}
    want = {i: by_pattern(t, values, redact.BATCH_SIZE, replacement) for i, t in texts}
    assert got == {**{i: (w, w != t) for (i, t), w in zip(texts, want.values())}, 102: (None, False)}


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_one_pass_finds_and_one_folds(spark, tmp_path, monkeypatch):
    """Values of several kinds are looked for in one scan of the texts and one explode of pieces;
    what is shuffled holds no text."""
    path = str(tmp_path / "texts")
    spark.createDataFrame([(i, f"line {i} of words") for i in range(50)], "id INT, text STRING").write.parquet(path)
    texts = spark.read.parquet(path)
    values = spark.createDataFrame([("abc",), ("abcd",), ("with a blank",), ("long1234word",)], "value STRING")
    for limit in (sizing.BROADCAST_BYTES, 0):
        monkeypatch.setattr(redact, "BROADCAST_BYTES", limit)
        pairs, _ = redact.candidates(texts, values, ["id"], "text")
        plan = plan_of(pairs)
        # lines and pieces: two explodes over one scan of the folder (the anchors are a table).
        assert plan.count("Generate explode") == 2
        assert len([x for x in plan.splitlines() if "Scan parquet" in x and "text" in x]) == 1
        # a piece meets the sieve before any exchange
        assert not any("Exchange" in x and "_line" in x for x in plan.splitlines())
    done = redact.redact(texts, values, ["id"], "text")
    plan = plan_of(done)
    assert len([x for x in plan.splitlines() if "Scan parquet" in x and "text" in x]) == 1


def test_sieve_lets_all_anchors_pass(spark):
    rows = spark.range(3000).select(F.md5(F.col("id").cast("string")).alias("value"))
    table = redact.anchors(rows)
    bits, longs = redact._sieve(table)
    kept = table.withColumn("passes", redact._passes(F.col("anchor"), bits, longs))
    assert kept.where("passes").count() == 3000
    other = spark.range(3000, 9000).select(F.md5(F.col("id").cast("string")).substr(1, 8).alias("p"))
    assert other.where(redact._passes(F.col("p"), bits, longs)).count() < 1200
