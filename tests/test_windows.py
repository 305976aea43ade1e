from __future__ import annotations

import random

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from credtrail.functions import windows
from credtrail.operators import lookup, redact


def sieve_of(strings: list[str], longs: int) -> np.ndarray:
    bits = np.zeros(longs, np.uint64)
    for row in windows.sieve_bits(pa.array(strings), longs).to_pylist():
        bits[row["id"]] |= np.uint64(row["bits"] & (1 << 64) - 1)
    return bits


def test_windows_are_those_of_a_plain_search():
    r = random.Random(3)
    texts = ["".join(r.choices("abcé字 _\x00", k=r.randint(0, 60))) for _ in range(300)] + ["", None, "é" * 9]
    listed = ["abc", "a\x00", "é字", "字字字", "cab ", "_" * 8, "ééééé", "ab é_c", "b"]
    listed += [t[3:11] for t in texts[:40] if len(t) > 11]
    sizes = sorted({len(v.encode()) for v in listed})
    batch = pa.RecordBatch.from_pydict({"no": list(range(len(texts))), "t": texts}).slice(1)
    found = {}
    for part in windows.with_windows(batch, "t", sizes, sieve_of(listed, 4096)):
        for row in part.to_pylist():
            assert row["t"] == texts[row["no"]]
            short = [w for w in row["_anchors"] if len(w.encode()) <= 8]
            assert len(short) == len(set(short)) and all(w in row["t"] for w in row["_anchors"])
            found[row["no"]] = set(row["_anchors"]) & set(listed)
    for n, text in enumerate(texts[1:], 1):
        assert found.get(n, set()) == {v for v in listed if v in (text or "")}, n


def test_a_full_sieve_lets_every_window_pass():
    batch = pa.RecordBatch.from_pydict({"t": ["aabaab", "x", "é"]})
    full = np.full(16, ~np.uint64(0))
    rows = [r for p in windows.with_windows(batch, "t", [2], full) for r in p.to_pylist()]
    assert [(r["t"], sorted(r["_anchors"])) for r in rows] == [("aabaab", ["aa", "ab", "ba"]), ("é", ["é"])]


def test_lines_are_not_cut_into_a_row_per_window(spark):
    """A line goes on with the few windows that may be anchors; no regex cuts it at every place."""
    texts = spark.range(20).select("id", F.concat(F.lit("some text é, no "), F.expr("repeat('x', 500)"), "id").alias("text"))
    values = spark.createDataFrame([("no x",), ("é, n",), ("absent words",), ("xx19",)], "value STRING")
    table = redact.anchors(values)
    offers = redact._offers(texts, table, ["id"], "text")
    plan = offers._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and "regexp_extract_all" not in plan
    got = {(r.id, r.value) for r in redact.find_values(texts, values, ["id"], "text").collect()}
    assert got == {(i, v) for i in range(20) for v in ("no x", "é, n")} | {(19, "xx19")}


def test_keywords_on_repeated_keys_and_null_lines(spark):
    lines = spark.createDataFrame(
        [(1, "Alpha beta"), (1, "alpha"), (None, "beta\nALPHABETICAL"), (2, None), (3, "")], "id INT, line STRING"
    )
    words = spark.createDataFrame([(1, "alpha"), (2, "BETA"), (3, "alphabetical"), (4, "")], "kw_idx INT, keyword STRING")
    for folded, expected in ((False, [(1, 1), (1, 2), (None, 1), (None, 2), (None, 3)]), (True, [(1, 1)])):
        got = lookup.keyword_matches(lines, words, ["id"], case_sensitive=folded).collect()
        assert sorted(map(tuple, got), key=str) == sorted(expected, key=str)
