from __future__ import annotations

import json
import random

import pytest

from credtrail import default_rules
from credtrail.operators import aggregate as agg
from credtrail.operators import nested, report, scan
from credtrail.queries import commit_lines
from credtrail.sources import git_log, records
from credtrail.sources.files import read_file_lines, read_file_texts
from credtrail.sources.git_log import read_git_log

R = default_rules()

LOG = """COMMIT_START|c3|ann|2024-01-03T00:00:00+02:00

diff --git a/app.env b/app.env
index 1..2 100644
--- a/app.env
+++ b/app.env
@@ -1 +1 @@
 context password=ctx
-password=old1
+password=new1 COMMIT_START|x
+++plus=lost
+a b/c=1
COMMIT_START|short
diff --git a/dir/x y b/dir/x y
+token=second
diff --git broken header
+token=third
COMMIT_START|c2|bob|when|ever
+orphan=none
diff --git a/b.md b/b.md
+password=inmd
"""


def write_log(tmp_path, text):
    folder = tmp_path / "log"
    folder.mkdir(exist_ok=True)
    (folder / "a.txt").write_bytes(text.encode())
    return str(folder)


def log_rows(df):
    names = ("commit", "author", "date_raw", "file", "sign", "line")
    return [tuple(r) for r in df.orderBy("seq").select(*names).collect()]


EXPECTED = [
    ("c3", "ann", "2024-01-03T00:00:00+02:00", "app.env", "-", "password=old1"),
    ("c3", "ann", "2024-01-03T00:00:00+02:00", "app.env", "+", "password=new1 COMMIT_START|x"),
    ("c3", "ann", "2024-01-03T00:00:00+02:00", "app.env", "+", "a b/c=1"),
    ("c3", "ann", "2024-01-03T00:00:00+02:00", "dir/x y", "+", "token=second"),
    ("c3", "ann", "2024-01-03T00:00:00+02:00", "dir/x y", "+", "token=third"),
    ("c2", "bob", "when|ever", "b.md", "+", "password=inmd"),
]


@pytest.mark.parametrize("ends", ["\n", "\r\n"])
def test_log(spark, tmp_path, ends):
    path = write_log(tmp_path, LOG.replace("\n", ends))
    assert log_rows(read_git_log(spark, path)) == EXPECTED


@pytest.mark.parametrize(("size", "limit"), [(17, None), (40, 0), (64, None), (150, 0)])
def test_log_cut_anywhere(spark, tmp_path, monkeypatch, size, limit):
    """Splits that start inside commits and files give the same rows, with the
    headers broadcast or shuffled."""
    if limit is not None:
        monkeypatch.setattr(git_log, "BROADCAST_BYTES", limit)
    path = write_log(tmp_path, LOG)
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", size)
    try:
        assert log_rows(read_git_log(spark, path)) == EXPECTED
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def test_no_line_is_lost_when_splits_change(spark, tmp_path):
    """Between building and running, the size of splits may be set anew."""
    out = []
    for c in range(40):
        out.append(f"COMMIT|h{c}|dev|2024-01-01T00:00:00Z")
        out.append("diff --git a/f.env b/f.env")
        out += [f"+line{c}={i}" for i in range(50)]
    path = write_log(tmp_path, "\n".join(out) + "\n")
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", 4000)
        lines = read_git_log(spark, path)
        spark.conf.set("spark.sql.files.maxPartitionBytes", 700)
        got = [tuple(r) for r in lines.orderBy("path", "seq").select("commit", "file", "line").collect()]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert got == [(f"h{c}", "f.env", f"line{c}={i}") for c in range(40) for i in range(50)]


def test_lines_without_their_split_are_an_error(spark):
    row = ("p", 7, 0, None, None, "+a=b")
    changes = spark.createDataFrame([row], "path STRING, block BIGINT, at BIGINT, header STRING, file_line STRING, line STRING")
    none = spark.createDataFrame([], "path STRING, block BIGINT, _in_header STRING, _in_file STRING, _known BOOLEAN")
    with pytest.raises(Exception, match="no headers for a block of p"):
        git_log._with_incoming(changes, none).collect()


def test_paths_below_odd_roots(spark, tmp_path):
    root = tmp_path / "a b" / "c+d%20"
    for name in ("x y.env", "sub/p+q.env", "50%.env"):
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_text("password=abc\n")
    want = {"x y.env", "sub/p+q.env", "50%.env"}
    assert {r.file for r in read_file_lines(spark, str(root), R).collect()} == want
    assert {r.file for r in read_file_texts(spark, str(root)).collect()} == want


def test_log_with_rules_gives_the_same_findings(spark, tmp_path):
    random.seed(1)
    out = []
    for c in range(30):
        out.append(f"COMMIT|h{c}|dev{c % 4}|2024-01-{c % 28 + 1:02d}T00:00:00Z")
        for f in range(random.randint(1, 3)):
            out.append(f"diff --git a/f{f}.env b/f{f}.env")
            out += [random.choice(("+", "-")) + random.choice(
                ("password=abc", "x=1", "token: abcd", "plain")) + str(i) for i in range(9)]
    path = write_log(tmp_path, "\n".join(out) + "\n")
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", 300)
    try:
        whole = scan.scan_history(read_git_log(spark, path), R)
        thin = scan.scan_history(read_git_log(spark, path, R), R)
        names = ["commit", "author", "date", "file", "key", "value", "hits"]
        a, b = (sorted(map(tuple, x.select(*names).collect())) for x in (whole, thin))
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert a == b and len(a) > 50


def test_files(spark, tmp_path):
    root = tmp_path / "tree"
    for name, data in {
        "app.env": b"password=abc1\r\npwd=abc2\n",
        "dir with space/x.cfg": "token=é\n".encode(),
        ".git/config": b"password=hidden1\n",
        "sub/.git/config": b"password=hidden2\n",
        "vendor/a.cfg": b"password=vendored\n",
        "notes.md": b"password=indocs\n",
        "pic.png": b"password=inpic\n",
        "big.cfg": b"password=toolarge\n" + b"x" * 1024 * 1024,
        "edge.cfg": b"x" * (1024 * 1024 - 14) + b"\npassword=edge",
    }.items():
        path = root / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_bytes(data)
    every = read_file_lines(spark, str(root), R)
    assert every.where("line = 'password=toolarge'").count() == 1
    df = read_file_lines(spark, str(root), R, max_bytes=1 << 20)
    got = sorted((r.file, r.line) for r in df.where("line LIKE '%=%'").collect())
    assert got == [
        ("app.env", "password=abc1"), ("app.env", "pwd=abc2"),
        ("dir with space/x.cfg", "token=é"), ("edge.cfg", "password=edge"),
    ]
    texts = {r.file: r.text for r in read_file_texts(spark, str(root), 1 << 20).collect()}
    assert texts["app.env"] == "password=abc1\r\npwd=abc2\n"
    assert ".git/config" not in texts and "big.cfg" not in texts and "notes.md" in texts
    assert read_file_texts(spark, str(root)).where("file = 'big.cfg'").count() == 1


def test_findings_with_bad_lines(spark, tmp_path):
    good = {"file": "a|b", "key": "k", "value": 'v"é', "maskedValue": "****", "type": "t",
            "commit": "c", "author": "x", "date": "2024-01-01T00:00:00+05:00"}
    lines = [json.dumps(good), "{broken", "", "[]", json.dumps({"file": "only"}), "12"]
    path = tmp_path / "f"
    path.mkdir()
    (path / "a.jsonl").write_text("\n".join(lines) + "\n")
    rows = records.read_findings(spark, str(path)).drop("date").orderBy("file").collect()
    assert [(r.file, r.value, r.commit) for r in rows] == [("a|b", 'v"é', "c"), ("only", "", "")]
    assert rows[0].date_raw == "2024-01-01T00:00:00+05:00"
    assert tuple(records.count_bad_findings(spark, str(path)).first()) == (6, 4)


def test_sample_scan_result(spark, tmp_path):
    history = [
        {"value": "v1", "maskedValue": "****", "commits": ["a", "b", "a"], "authors": ["x"],
         "firstSeen": "2024-01-01T00:00:00Z", "lastSeen": "2024-01-05T00:00:00Z"},
        {"value": "v2", "maskedValue": "****", "commits": ["current"], "authors": ["current"],
         "firstSeen": "2024-02-01T00:00:00Z", "lastSeen": "2024-02-01T00:00:00Z"},
    ]
    result = {"repository": "r", "branch": "b", "secretsFound": 1, "totalValues": 2,
              "scanDate": "2024-03-01T00:00:00Z",
              "secrets": [{"file": "f", "key": "k", "type": "t", "changeCount": 2,
                           "totalOccurrences": 4, "authors": ["x"], "history": history}]}
    path = tmp_path / "r"
    path.mkdir()
    (path / "scan.json").write_text(json.dumps(result, indent=2))
    secrets = records.read_scan_results(spark, str(path), multi_line=True)
    row = records.analyzed_secrets(secrets).first()
    assert (row.change_count, row.total_occurrences) == (2, 4)
    assert row.first_seen.isoformat() == "2024-01-01T00:00:00"
    assert agg.detect_source(records.commits_of_secrets(secrets)).first().source == "both"


@pytest.mark.parametrize("quoting", ["standard", "flat"])
def test_csv_texts(spark, tmp_path, quoting):
    rows = [("a;b.env", 'k"1', "t", 2, 3, "x, y", 2, "2024-01-01", "2024-01-02", 1, "** | **", 0)]
    names = ("File STRING, Key STRING, Type STRING, ChangeCount BIGINT, TotalOccurrences BIGINT, "
             "Authors STRING, AuthorCount BIGINT, FirstSeen STRING, LastSeen STRING, "
             "DaysActive INT, `Values` STRING, Part BIGINT")
    path = str(tmp_path / "csv")
    records.write_csv(spark.createDataFrame(rows, names), path, quoting)
    text = [r.value for r in spark.read.text(path).collect()]
    head = "File;Key;Type;ChangeCount;TotalOccurrences;Authors;AuthorCount;FirstSeen;LastSeen;DaysActive;Values"
    first = '"a;b.env";"k""1"' if quoting == "standard" else '"a,b.env";"k""1"'
    assert text[0] == head
    authors = "x, y" if quoting == "standard" else '"x, y"'
    assert text[1] == f"{first};t;2;3;{authors};2;2024-01-01;2024-01-02;1;** | **"


def test_report_cuts_long_lists(spark):
    found = scan.scan_history(commit_lines(spark, "/root/testdata/sf0.01"), R).cache()
    for r in report.report_secrets(found, R, 3).collect():
        assert len(r.authors) == 67 and r.authors.endswith("...") and r.remaining == 9
    values = report.report_values(found, R, 1, reveal=True).collect()
    assert all(len(r.preview) <= 13 for r in values)
    assert len({(r.file, r.key) for r in values}) == 1


def test_stats_csv(spark, tmp_path):
    found = scan.scan_history(commit_lines(spark, "/root/testdata/sf0.001"), R)
    stats = report.stats_long(report.secret_stats(found, R))
    records.write_stats_csv(stats, str(tmp_path / "s"))
    back = spark.read.option("header", True).option("sep", ";").csv(str(tmp_path / "s"))
    assert {r.section for r in back.collect()} == {"summary", "authors", "files", "types"}


def test_result_rows(spark):
    found = scan.scan_history(commit_lines(spark, "/root/testdata/sf0.001"), R).cache()
    rows = nested.nested_secrets(found, R)
    args = ("r", "--all", "2024-01-01T00:00:00Z")
    one = records.scan_results(rows, *args).collect()
    total = agg.scan_summary(agg.secrets(found, R)).first()
    assert len(one) == 1
    assert (one[0].secretsFound, one[0].totalValues) == (total.secrets_found, total.total_values)
    counts = [s.changeCount for s in one[0].secrets]
    assert counts == sorted(counts, reverse=True) and len(counts) == total.secrets_found
    many = records.scan_results(rows, *args, result_size=40).collect()
    assert len(many) > 2 and {r.secretsFound for r in many} == {total.secrets_found}
    listed = sorted((s.file, s.key) for r in many for s in r.secrets)
    assert listed == sorted((s.file, s.key) for s in one[0].secrets)
