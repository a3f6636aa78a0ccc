"""Queries with SQL against it; all others return a row for each input row."""

import os

import pytest

from tessella.llm import queries as Q


@pytest.mark.parametrize("name", list(Q.oracle_sql()))
def test_sql(spark, compare, sf, name):
    ours, theirs = compare(Q.queries()[name](spark, sf), Q.oracle_sql()[name], sf)
    assert ours == theirs


@pytest.mark.parametrize("name", [n for n in Q.queries() if n not in Q.oracle_sql()])
def test_rows(spark, sf, name):
    table = "conversations" if "chat" in name else "documents"
    assert Q.queries()[name](spark, sf).count() == spark.read.parquet(os.path.join(sf, f"{table}.parquet")).count()
