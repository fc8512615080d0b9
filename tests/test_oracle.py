"""Every registered query against its SQL on the smallest tables."""

import pytest
from check import compare, duck
from conftest import SMALL

from lingotide.plans.catalog import ORACLES, QUERIES


@pytest.fixture(scope="module")
def con():
    return duck(SMALL)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    got = QUERIES[name](spark, SMALL).toPandas()
    assert len(got) > 0
    if name in ORACLES:
        assert compare(got, con.execute(ORACLES[name]).df()) == ""
