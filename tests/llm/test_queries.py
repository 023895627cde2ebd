"""The corpus queries that have SQL give the same rows; the others run over the smallest test tables."""

import os

import pytest

import oracle
from conftest import DATA
from graphloom.llm import queries

FOLDER = f"{DATA}/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_query(spark, name):
    assert oracle.difference(spark, oracle.connect(FOLDER), FOLDER, queries.QUERIES[name], queries.SQL[name]) == ""


@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - set(queries.SQL)))
def test_rows(spark, name):
    assert queries.QUERIES[name](spark, FOLDER).count() > 0
