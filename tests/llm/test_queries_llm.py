"""Queries of the subpackage against their SQL; the others run and keep their shape."""

from __future__ import annotations

import pytest

from tapewell.llm.queries import QUERIES, SQL
from tests.comparing import tuples

COLUMNS = {
    "p1_found": ["ticker_a", "ticker_b"],
    "p2_found": ["id"],
    "p3_found": ["id"],
    "p5_found": ["id", "kind"],
    "p8_ids": ["doc_id", "ids"],
    "p10_found": ["doc_id", "subject"],
}


@pytest.mark.parametrize("name", sorted(SQL))
def test_matches_sql(spark, folder, duck, name):
    ours, theirs = QUERIES[name](spark, folder).toPandas(), duck.sql(SQL[name]).df()
    assert sorted(ours.columns) == sorted(theirs.columns)
    assert tuples(ours) == tuples(theirs)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_runs(spark, folder, name):
    frame = QUERIES[name](spark, folder).toPandas()
    assert len(frame) > 0
    if name in COLUMNS:
        assert list(frame.columns) == COLUMNS[name]


def test_every_document_has_ids(spark, folder):
    want = {r[0] for r in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id").collect()}
    assert {r[0] for r in QUERIES["p8_ids"](spark, folder).select("doc_id").collect()} == want
