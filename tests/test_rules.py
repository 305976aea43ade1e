from __future__ import annotations

import json
from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from credtrail import alternative_rules, default_rules, load_rules
from credtrail.functions import files, values
from credtrail.functions.extract import extracted
from credtrail.rules import ExtractionPattern, ignore_table, keyword_table, pattern_table

R = default_rules()

LINES = [
    ("db_pass=wren-41", "db_pass", "wren-41"),
    ("login_token: heron77x", "login_token", "heron77x"),
    ('"seal": "plover88"', "seal", "plover88"),
    ("export DB_TOKEN=stork-903", "DB_TOKEN", "stork-903"),
    ("auth_code = finch0042", "auth_code", "finch0042"),
    ('AUTH_CODE: "siskin55"', "AUTH_CODE", "siskin55"),
    # keys with slashes, dollars and dots
    ("srv/relay$smtp.out.pass=Zt4!kW8@uB", "srv/relay$smtp.out.pass", "Zt4!kW8@uB"),
    ("etc/sso$Door.Main.signKey=0b7d52c9-93ae-4f10-8d26-5ac1e07f3b94",
     "etc/sso$Door.Main.signKey", "0b7d52c9-93ae-4f10-8d26-5ac1e07f3b94"),
    # quotes stay with the first pattern, and only the first assignment counts
    ('password="abc"', "password", '"abc"'),
    ("a=1 b=2", "a", "1 b=2"),
    # line ends of other alphabets and old ones belong to the value
    ("pass=a\u2028b", "pass", "a\u2028b"),
    ("pass=a\u0085b", "pass", "a\u0085b"),
    ("pass=ab\r", "pass", "ab"),
    ("pass=\u00a0ab\u3000", "pass", "ab"),
    ("pass=héllo", "pass", "héllo"),
    ("pass\x0b=abc", None, None),
    ("no assignment here", None, None),
    ("", None, None),
]


def test_extraction(spark):
    df = spark.createDataFrame([(i, x[0]) for i, x in enumerate(LINES)], "i INT, line STRING")
    rows = df.select("i", extracted(F.col("line"), R).alias("x")).orderBy("i").collect()
    got = [(r.x.key, r.x.value) if r.x else (None, None) for r in rows]
    assert got == [(k, v) for _, k, v in LINES]


IGNORED = [
    "order.Total", "tree.Leaf", "make(map[int]bool)", "append(birds, wren)", "rows[17]",
    "{wren: heron}", "one.two.three.four.five", "return total", "www.birds.example",
    "zz", "q" * 501, "HTTPS://birds/1", "mailto:wren", "Password", "TOKEN",
    "a ${NEST} b", "ChangeMe", "w***n", "heron}", "len(birds",
]
KEPT = [
    "Zt4!kW8@uB", "0b7d52c9-93ae-4f10-8d26-5ac1e07f3b94", "srv/relay$out", "heronsecretnest",
    "wrn", "w" * 500, "wren.nest", "w-n.Xy", ".Nest", "Wren.", "w(n", "w]n", "one.two.three.four.Q",
    "tokens",
]


@pytest.mark.parametrize("rules", [R, alternative_rules()])
def test_reason_and_predicate_agree(spark, rules):
    df = spark.createDataFrame([(v,) for v in IGNORED + KEPT], "v STRING")
    v = F.col("v")
    both = df.select(
        values.is_ignored_value(v, rules).alias("a"),
        values.reject_reason(v, rules).isNotNull().alias("b"),
    )
    assert all(r.a == r.b for r in both.collect())


def test_ignored_values(spark):
    df = spark.createDataFrame([(v,) for v in IGNORED + KEPT], "v STRING")
    kept = df.where(~values.is_ignored_value(F.col("v"), R)).collect()
    # three dots are too many, however they end
    assert [r.v for r in kept] == [v for v in KEPT if v.count(".") <= 2]


def test_case_sensitive_never_matches_upper_case_entries(spark):
    rules = replace(R, case_sensitive=True, ignored_values=("TODO", "sample"))
    df = spark.createDataFrame([("TODO later",), ("a sample",), ("A SAMPLE",)], "v STRING")
    kept = df.where(~values.has_ignored_text(F.col("v"), rules)).collect()
    assert [r.v for r in kept] == ["TODO later"]


def test_length_in_bytes(spark):
    df = spark.createDataFrame([("éa",)], "v STRING")
    by_bytes = replace(R, length_in_bytes=True)
    row = df.select(
        values.bad_length(F.col("v"), R).alias("chars"),
        values.bad_length(F.col("v"), by_bytes).alias("bytes"),
    ).first()
    assert (row.chars, row.bytes) == (True, False)


PATHS = {
    "*.md": (["a.md", "d/b.md"], ["a.mdx", "md", "a.md/b"]),
    "vendor/**": (["vendor/a", "vendor/b/c"], ["x/vendor/a", "vendor"]),
    "**/x": (["anything", "x"], []),
    "docs/": (["docs/a"], ["docs", "a/docs/b"]),
    "a.lock": (["a.lock"], ["b/a.lock", "a.lockx"]),
    "*.min.js": (["a.min.js"], ["a.js", "aminxjs"]),
}


@pytest.mark.parametrize("glob", PATHS)
def test_globs(spark, glob):
    hit, miss = PATHS[glob]
    rules = replace(R, ignored_files=(glob,), excluded_extensions=())
    df = spark.createDataFrame([(p,) for p in hit + miss], "file STRING")
    one = df.where(files.matches_glob(F.col("file"), glob)).collect()
    all_ = df.where(~files.is_scanned_file(F.col("file"), rules)).collect()
    assert [r.file for r in one] == hit
    assert [r.file for r in all_] == hit


def test_globs_as_a_table(spark):
    from credtrail.operators.ignore import without_ignored

    paths = sorted({p for hit, miss in PATHS.values() for p in hit + miss})
    df = spark.createDataFrame([(p,) for p in paths], "file STRING")
    chosen = [g for g in PATHS if g != "**/x"]
    globs = spark.createDataFrame([(g,) for g in chosen], "glob STRING")
    kept = {r.file for r in without_ignored(df, globs).collect()}
    rules = replace(R, ignored_files=tuple(chosen), excluded_extensions=())
    want = {r.file for r in df.where(files.is_scanned_file(F.col("file"), rules)).collect()}
    assert kept == want
    everything = spark.createDataFrame([("**/x",)], "glob STRING")
    assert without_ignored(df, everything).count() == 0


def test_defaults():
    assert len(R.keywords) == 39 and len({k for _, _, k in R.keywords}) == 38
    assert len(R.groups) == 10 and len(R.ignored_values) == 36
    assert len(R.ignored_files) == 28 and len(R.excluded_extensions) == 25


def write(tmp_path, content):
    path = tmp_path / "rules.json"
    path.write_text(json.dumps(content))
    return str(path)


def test_file_without_patterns_keeps_the_defaults(spark, tmp_path):
    path = write(tmp_path, {
        "keywords": [{"name": "k", "patterns": ["kk"], "description": "d"}],
        "settings": {"minSecretLength": 5},
    })
    rules = load_rules(spark, path)
    assert rules.patterns == R.patterns and rules.min_length == 5 and rules.max_length == 500
    assert rules.keywords == [(0, "k", "kk")]


def test_patterns_in_a_file_replace_the_defaults(spark, tmp_path):
    path = write(tmp_path, {
        "extractionPatterns": [
            {"name": "custom", "pattern": "^custom_(.+)=(.+)$"},
            {"name": "broken", "pattern": "(("},
        ],
        "ignoredValues": [],
    })
    rules = load_rules(spark, path)
    assert rules.patterns == (ExtractionPattern("custom", "^custom_(.+)=(.+)$", 2),)
    assert rules.ignored_values == () and rules.groups == R.groups
    df = spark.createDataFrame([("custom_a=b",), ("a=b",)], "line STRING")
    rows = df.select(extracted(F.col("line"), rules).alias("x")).collect()
    assert (rows[0].x.key, rows[0].x.value, rows[1].x) == ("a", "b", None)


def test_rules_as_tables(spark):
    assert keyword_table(spark, R).count() == 39
    assert pattern_table(spark, R).count() == 4
    assert ignore_table(spark, R).count() == 36 + 28 + 25
