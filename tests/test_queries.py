"""Every named query against its SQL on the smallest tables."""

import os

import pytest

import __spark_entry__ as entry
from modelwatch.plans.catalog import ORACLES, QUERIES
from tools.check_queries import compare, connect

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(entry.queries()))
def test_query(spark, con, name):
    plans = []

    def keep(session, sf_dir):
        df = entry.queries()[name](session, sf_dir)
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return df

    ok, note = compare(spark, con, name, SF, keep, entry.oracle_sql().get(name))
    assert ok, note
    assert "CartesianProduct" not in plans[0] and "NestedLoopJoin" not in plans[0]


def test_entry_has_rows(spark):
    found = entry.entry(spark)
    assert found.columns == ["feature", "psi"] and found.count() == 4


def test_only_random_or_trained_queries_lack_sql():
    assert set(QUERIES) - set(ORACLES) == {
        "inject_noise", "inject_severe", "forest_evaluation", "score_transactions", "feature_importance"
    }
