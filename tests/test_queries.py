"""All registered queries against their SQL in DuckDB, on the smallest tables."""

from __future__ import annotations

import pytest

import __spark_entry__ as entry
from credtrail.case_queries import CASE_QUERIES
from credtrail.queries import QUERIES as MAIN_QUERIES
from tests.compare import differences, duck

SF_DIR = "/root/testdata/sf0.001"
QUERIES = {**MAIN_QUERIES, **CASE_QUERIES}
SQL = entry.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return duck(SF_DIR)


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, con, name):
    df = entry.queries()[name](spark, SF_DIR)
    if name in SQL:
        error, _ = differences(df, con, SQL[name])
        assert error is None
    else:
        assert df.count() > 0


def test_only_estimates_have_no_sql():
    assert set(QUERIES) - set(SQL) == {"approx_unique_values"}
    assert set(SQL) | set(QUERIES) <= set(entry.queries())


def test_estimate_is_close(spark):
    exact = entry.queries()["unique_values"](spark, SF_DIR).first()
    near = entry.queries()["approx_unique_values"](spark, SF_DIR).first()
    assert abs(near[0] - exact[0]) <= 0.05 * exact[0]
    assert abs(near[1] - exact[1]) <= 0.05 * exact[1]


def test_entry(spark):
    rows = entry.entry(spark).collect()
    assert len(rows) > 0
    counts = [r.change_count for r in rows]
    assert counts == sorted(counts, reverse=True)
