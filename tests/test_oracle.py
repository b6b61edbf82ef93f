"""Every registered query against its SQL twin."""

import pytest

from siltworks.plans.registry import ORACLES, QUERIES, load_all
from tests.compare import compare, connect

SF = "/root/testdata/sf0.001"
load_all()


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, con, name):
    diff = compare(spark, con, name, QUERIES[name], ORACLES.get(name), SF)
    assert diff is None, diff


def test_every_sql_has_a_query():
    assert set(ORACLES) <= set(QUERIES)
