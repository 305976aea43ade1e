"""Framing of archives at every offset, and the recall of the neighbour index."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from credtrail.llm import permutation, warc
from credtrail.llm.common import table
from credtrail.plans.storage import new_path

PAGES = "page_id bigint, url string, html string, payload string, record_type string"


def read_back(spark, pages, **sizes):
    path = new_path(spark, "warc")
    warc.write_archive(warc.deduplicated(pages), path, **sizes)
    return warc.reassembled(warc.read_records(spark, path))


@pytest.mark.parametrize("tail", ["", "\r\n", "\r", "\n", "\r\n\r\n"])
def test_version_text_anywhere(spark, tail):
    """The version line, whole or in part, at each offset around the ends of chunks and segments."""
    rows = [(i, "u", "x" * i + "WARC/1.1" + tail + "y" * (i % 3), "clash", "clash") for i in range(70)]
    rows += [(100 + i, "u", "é" * i + "WARC/1.1" * 3 + tail, "clash", "clash") for i in range(24)]
    got = read_back(spark, spark.createDataFrame(rows, PAGES), segment_bytes=40, chunk_bytes=16)
    texts = {r.page_id: bytes(r.payload).decode() for r in got.collect()}
    assert texts == {r[0]: r[2] for r in rows}


def test_no_pages(spark):
    empty = spark.createDataFrame([], PAGES)
    path = new_path(spark, "warc")
    warc.write_archive(warc.deduplicated(empty), path)
    assert warc.payload_facts(warc.reassembled(warc.read_records(spark, path))).collect() == []


def test_records_have_the_mandatory_fields(spark):
    page = {"page_id": 1, "url": "http://a/", "payload": b"z" * 100, "refers_to": None}
    records = list(warc._records(page, 60, 32, "2024-05-06T07:08:09Z"))
    records += warc._records(page | {"refers_to": 2}, 60, 32, "2024-05-06T07:08:09Z")
    for r in records:
        head = r.split(b"\r\n\r\n")[0].decode()
        for name in ("WARC-Type", "WARC-Record-ID", "WARC-Date", "Content-Length"):
            assert f"\r\n{name}: " in head
        assert r.startswith(b"WARC/1.1\r\n") and r.count(b"WARC/1.1\r\n") == 1
    assert b"Content-Type: application/http; msgtype=response" in records[0]
    assert b"WARC-Profile: " in records[-1]


def test_very_long_record(spark):
    """Ten thousand segments are put together in one go."""
    page = "".join(chr(97 + i % 26) for i in range(200_000))
    got = read_back(spark, spark.createDataFrame([(1, None, page, "", "")], PAGES), segment_bytes=20, chunk_bytes=300)
    row = got.first()
    assert bytes(row.payload).decode() == page and row.payload_bytes == len(page)


def recall(rows, found, wanted=20) -> float:
    ids = np.array([r[0] for r in rows])
    m, by_query = np.array([r[1] for r in rows]), {}
    for r in found:
        by_query.setdefault(r.query_id, []).append(r.score)
    hits = total = 0
    for q, scores in by_query.items():
        exact = m @ m[np.flatnonzero(ids == q)[0]]
        least = np.sort(exact[ids != q])[-min(wanted, len(ids) - 1)]
        hits += sum(s >= least - 1e-9 for s in scores)
        total += min(wanted, len(ids) - 1)
    return hits / total


def usable_rows(df):
    return [(r.vec_id, r.vector) for r in permutation.usable(df).collect()]


@pytest.mark.parametrize("sf", ["sf0.01", "sf0.1"])
def test_recall_on_the_tables(spark, sf):
    vectors = table(spark, f"/root/testdata/{sf}", "embeddings")
    found = permutation.search(vectors, F.col("vec_id") % 20 == 0).collect()
    assert recall(usable_rows(vectors), found) >= 0.95


def test_recall_over_several_blocks(spark, monkeypatch):
    """Random directions, the hardest case, with a small share of each block compared exactly."""
    monkeypatch.setattr(permutation, "BLOCK_ROWS", 4096)
    rng = np.random.default_rng(3)
    rows = [(i, v.tolist()) for i, v in enumerate(rng.normal(size=(16_000, 48)))]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")
    found = permutation.search(df, F.col("vec_id") % 200 == 0).collect()
    assert recall(rows, found) >= 0.9


@pytest.mark.parametrize("n", [1, 2, 7, 21])
def test_few_candidates(spark, n):
    rng = np.random.default_rng(n)
    rows = [(20 * i, v.tolist()) for i, v in enumerate(rng.normal(size=(n, 5)))]
    found = permutation.search(spark.createDataFrame(rows, "vec_id bigint, embedding array<double>"), F.lit(True)).collect()
    assert len(found) == n * min(20, n - 1) and (n < 2 or recall(rows, found) == 1)
