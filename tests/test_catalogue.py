import pytest
from oracle import connect, same

from sigengine.plans.catalogue import ORACLE, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_equals_sql(spark, con, name):
    same(spark, con, QUERIES[name], ORACLE[name], SF)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE)))
def test_query_without_sql_runs(spark, name):
    assert QUERIES[name](spark, SF).collect() is not None


def test_scores_rank_known_pairs_higher(spark):
    r = QUERIES["model_scores"](spark, SF).groupBy("label").avg("signal_probability").collect()
    mean = {x[0]: x[1] for x in r}
    assert mean[1] > mean[0]
