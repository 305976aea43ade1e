"""Indented results read line by line, against the JSON reader of Python."""

from __future__ import annotations

import json
import random

import pytest
from pyspark.sql import functions as F

from credtrail import default_rules
from credtrail.operators import nested
from credtrail.plans import sizing
from credtrail.sources import indented, records


def result(seed, n_secrets=6):
    rng = random.Random(seed)
    odd = ['q"uote', "back\\slash", "tab\tend", "é\u2028", "a, b", "{", "}", "[", "x: y", '"key": "v",', "", "null", "<&>", "12"]
    secrets = []
    for i in range(n_secrets):
        history = [
            {
                "value": f"v{i}-{j}-{rng.choice(odd)}", "maskedValue": "**",
                "commits": [rng.choice(odd) + str(k) for k in range(rng.choice([0, 1, 3, 40]))],
                "authors": rng.sample(odd, 2) if j % 2 else [],
                "firstSeen": f"2024-01-0{j + 1}T00:00:00Z", "lastSeen": f"2024-02-0{j + 1}T00:00:00+02:00",
            }
            for j in range(rng.randint(1, 4))
        ]
        secrets.append({
            "file": f"dir/{rng.choice(odd)}{i}", "key": rng.choice(odd) or "k", "type": "token", "changeCount": len(history),
            "totalOccurrences": 7, "authors": rng.sample(odd, 3), "history": history,
        })
    return {"repository": "/r", "branch": "--all", "secretsFound": n_secrets, "totalValues": 1, "secrets": secrets, "scanDate": "now"}


def facts(docs):
    commits, values, authors = [], {}, []
    for doc in docs:
        for s in doc["secrets"] or ():
            authors += [(s["file"], s["key"], a) for a in s["authors"]]
            for h in s["history"] or ():
                commits += [(s["file"], s["key"], s["type"], h["value"], c) for c in h["commits"]]
                values[s["file"], s["key"], s["type"], h["value"]] = len(h["commits"])
    return sorted(commits), values, sorted(authors)


def read_facts(rows):
    commits = sorted(map(tuple, indented.indented_commits(rows).collect()))
    values = {(r.file, r.key, r.type, r.value): r.occurrences for r in indented.indented_values(rows).collect()}
    authors = rows.where("name = 'secretAuthors'").select("file", "key", "text").collect()
    return commits, values, sorted(map(tuple, authors))


@pytest.mark.parametrize(("size", "limit"), [(None, None), (64, 0), (333, None), (5000, 0)])
@pytest.mark.parametrize("ascii_only", [True, False])
def test_documents_cut_anywhere(spark, tmp_path, monkeypatch, size, limit, ascii_only):
    if limit is not None:
        monkeypatch.setattr(sizing.broadcast_if_small, "__defaults__", (limit,))
    docs = [result(s) for s in range(3)]
    (tmp_path / "a.json").write_text(json.dumps(docs[0], indent=2, ensure_ascii=ascii_only))
    both = [json.dumps(d, indent=2, ensure_ascii=ascii_only) for d in docs[1:]]
    (tmp_path / "b.json").write_text("\r\n".join("\r\n".join(b.split("\n")) for b in both) + "\r\n")
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    if size:
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
    try:
        rows = indented.read_indented(spark, str(tmp_path))
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert rows.where("bad").count() == 0
    assert read_facts(rows) == facts(docs)


def test_same_as_the_reader_of_whole_documents(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps(result(9), indent=2))
    whole = records.read_scan_results(spark, str(tmp_path), multi_line=True)
    rows = indented.read_indented(spark, str(tmp_path))
    names = ["file", "key", "type", "change_count", "total_occurrences", "first_seen", "last_seen"]
    a, b = (sorted(map(tuple, x.select(*names).collect())) for x in (records.analyzed_secrets(whole), indented.indented_secrets(rows)))
    assert a == b and len(a) > 3


def test_other_indentation_and_empty_lists(spark, tmp_path):
    doc = result(4) | {"secrets": []}
    (tmp_path / "a.json").write_text(json.dumps(doc, indent=4))
    assert indented.read_indented(spark, str(tmp_path), indent=4).count() == 0
    nothing = result(5)
    nothing["secrets"][0]["history"] = None
    (tmp_path / "a.json").write_text(json.dumps(nothing, indent=4))
    rows = indented.read_indented(spark, str(tmp_path), indent=4)
    assert rows.where("bad").count() == 0 and read_facts(rows) == facts([nothing])


def test_bad_lines_are_counted(spark, tmp_path):
    text = json.dumps(result(6), indent=2).split("\n")
    at = next(i for i, x in enumerate(text) if '"type"' in x)
    text[at] = '      "type": "broken,'
    text.insert(at, "   odd line")
    (tmp_path / "a.json").write_text("\n".join(text))
    rows = indented.read_indented(spark, str(tmp_path))
    assert indented.count_bad_lines(rows).first().bad_lines == 2


def test_written_documents_are_json(spark, tmp_path):
    schema = "file STRING, key STRING, value STRING, commit STRING, author STRING, date TIMESTAMP, hits INT, kw_first INT"
    found = spark.sql("SELECT 'f\"1' file, 'k' key, concat('v', id % 3, '\\n\"') value, concat('c', id) commit, 'a,b' author, "
                      "timestamp'2024-01-01' date, 2 hits, 0 kw_first FROM range(9)").to(spark.createDataFrame([], schema).schema)
    rows = nested.nested_secrets(found, default_rules())
    value = indented.indented_documents(rows, "r", "b", "d").first()[0]
    doc = json.loads(value)
    assert value == json.dumps(doc, indent=2)
    assert [len(h["commits"]) for h in doc["secrets"][0]["history"]] == [6, 6, 6]


def test_empty_folder(spark, tmp_path):
    (tmp_path / "a.json").write_text("")
    rows = indented.read_indented(spark, str(tmp_path))
    assert rows.count() == 0 and indented.indented_secrets(rows).count() == 0
    assert rows.select(F.lit(1)).count() == 0
