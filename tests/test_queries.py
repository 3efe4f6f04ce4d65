"""Each query against its SQL, at the smallest scale."""

import pytest

from tests.compare import assert_same, connection
from tessera.plans.catalogue import ORACLE, QUERIES


@pytest.fixture(scope="module")
def con(sf):
    return connection(sf)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_same_as_sql(spark, sf, con, name):
    assert_same(QUERIES[name](spark, sf), con, ORACLE[name])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE)))
def test_runs(spark, sf, name):
    assert QUERIES[name](spark, sf).collect() is not None


def test_every_oracle_has_a_query():
    assert set(ORACLE) <= set(QUERIES)
