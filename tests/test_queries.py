"""Every registered query against its SQL on DuckDB, over whole tables at the smallest scale."""

import pytest

from harness import compare, connect
from queries import load

SF = "/root/testdata/sf0.001"
QUERIES, ORACLES = load()


@pytest.fixture(scope="session")
def duck():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    assert compare(spark, duck, QUERIES[name], ORACLES.get(name), SF) == ""
