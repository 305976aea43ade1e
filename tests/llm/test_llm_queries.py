"""The registered queries and the pipeline on the smallest tables."""

from __future__ import annotations

import pytest

import corpus_pipeline
from credtrail.llm.common import table, written
from credtrail.llm.queries import LLM_ORACLE, LLM_QUERIES
from tests.compare import differences, duck

SF_DIR = "/root/testdata/sf0.001"
ONE_PER = {"op1_warc": "pages", "op6_permutation_index": None, "op5_prefix_targets": None, "op13_source_divergence": None}


@pytest.mark.parametrize("name", list(LLM_QUERIES))
def test_query(spark, name):
    found = LLM_QUERIES[name](spark, SF_DIR)
    n = found.count()
    of = ONE_PER.get(name, "documents")
    assert n == table(spark, SF_DIR, of).count() if of else n > 0


@pytest.mark.parametrize("name", list(LLM_ORACLE))
def test_query_equals_its_sql(spark, name):
    error, n = differences(LLM_QUERIES[name](spark, SF_DIR), duck(SF_DIR), LLM_ORACLE[name])
    assert error is None and n > 0


def test_pipeline(spark):
    docs = table(spark, SF_DIR, "documents")
    counts = [docs.count()]
    for name, stage in corpus_pipeline.STAGES:
        out = written(stage(spark, docs, SF_DIR), name)
        assert name == "tokens" or out.columns == docs.columns
        docs = out
        counts.append(docs.count())
    assert counts == sorted(counts, reverse=True) and counts[-1] > 0
    assert docs.where("not round_trip").count() == 0
