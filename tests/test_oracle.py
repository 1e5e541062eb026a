"""Every registered query against its SQL, and its plan."""

import os

import pytest

import oracle
from __spark_entry__ import entry, oracle_sql, queries

SF_DIR = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="test tables are not here")


@pytest.fixture(scope="module")
def con():
    return oracle.connect(SF_DIR)


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_query_matches_sql(spark, con, name):
    assert oracle.compare(spark, con, SF_DIR, queries()[name], oracle_sql()[name]) is None


@pytest.mark.parametrize("name", sorted(set(queries()) - set(oracle_sql())))
def test_query_without_sql_has_rows(spark, name):
    assert queries()[name](spark, SF_DIR).count() > 0


def test_every_sql_has_a_query():
    assert set(oracle_sql()) <= set(queries())


def test_entry(spark):
    assert entry(spark).count() > 0


@pytest.mark.parametrize("name", ["ujoin_shared", "ujoin_nary", "doc_similarity", "pivot_frac_sum", "hist_decimal", "tfidf_long",
                                  "similarity_matrix", "scale_cells", "label_many_values"])
def test_no_cartesian_product_and_no_row_python(spark, name):
    plan = queries()[name](spark, SF_DIR)._jdf.queryExecution().toString()
    for operator in ("CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython"):
        assert operator not in plan


def test_filters_and_columns_reach_the_scan(spark):
    plan = queries()["ujoin_shared"](spark, SF_DIR)._jdf.queryExecution().toString()
    assert "GreaterThan(l_quantity,45.0)" in plan
    assert "l_extendedprice" not in plan.split("== Physical Plan ==")[1]
