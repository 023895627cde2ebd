"""Every query with an SQL counterpart gives the same rows on the smallest test tables."""

import os

import pytest

import oracle
from conftest import DATA
from graphloom.queries import data_quality, data_quality_sql, graph, graph_sql, plans, plans_sql

FOLDER = f"{DATA}/sf0.001"
QUERIES = {**graph.QUERIES, **plans.QUERIES, **data_quality.QUERIES}
SQL = {**graph_sql.sql(), **plans_sql.sql(), **data_quality_sql.sql()}
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")


@pytest.fixture(scope="module")
def con():
    return oracle.connect(FOLDER)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query(spark, con, name):
    assert oracle.difference(spark, con, FOLDER, QUERIES[name], SQL[name]) == ""


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_rows(spark, name):
    assert QUERIES[name](spark, FOLDER).count() > 0
