import os

import pytest

import __spark_entry__ as entry
from oracle_check import compare, duck

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="test tables are not here")


@pytest.fixture(scope="module")
def con():
    return duck(SF)


def test_every_twin_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


#: trainings of minutes and a stream, whose parts have tests of their own; oracle_check.py compares them
ELSEWHERE = {"word2vec_docs", "subword_docs", "graph_docs", "stream_numbered_lines"}


# queries of the optional package begin with op and are compared with its own tests
@pytest.mark.parametrize("name", sorted(n for n in set(entry.oracle_sql()) - ELSEWHERE if not n.startswith("op")))
def test_query_equals_sql(spark, con, name):
    got = entry.queries()[name](spark, SF).toPandas()
    assert compare(got, con.sql(entry.oracle_sql()[name]).df()) == ""


def test_entry(spark):
    assert entry.entry(spark).columns == ["label", "n", "percent"]


@pytest.mark.parametrize("name", ["label_join", "term_stats", "cooccurrence_edges", "class_metrics", "file_summary", "tfidf_vocab"])
def test_plans_have_no_cross_join_or_global_window(spark, name):
    plan = entry.queries()[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
    assert "BatchEvalPython" not in plan
