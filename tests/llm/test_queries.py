"""The registered queries against SQL and the stages of the pipeline."""

from __future__ import annotations

import pytest
from conftest import TINY
from oracle_check import compare, connect

import corpus_pipeline
from claimsieve.llm import oracles, queries


@pytest.mark.parametrize("name", sorted(oracles.ORACLES))
def test_query_equals_sql(spark, name):
    assert compare(queries.REGISTRY[name](spark, TINY), connect(TINY), oracles.ORACLES[name]) == []


def test_stages_keep_columns(spark):
    docs = spark.read.parquet(f"{TINY}/documents.parquet")
    ids = {r.doc_id for r in docs.select("doc_id").collect()}
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, TINY)
        assert out.columns == docs.columns
        kept = [r.doc_id for r in out.select("doc_id").collect()]
        assert len(kept) == len(set(kept)) and set(kept) <= ids
        ids = set(kept)
        docs = spark.createDataFrame(out.collect(), out.schema)
    tokens = corpus_pipeline.STAGES[-1][1](spark, docs, TINY)
    assert {r.doc_id for r in tokens.collect()} == ids
