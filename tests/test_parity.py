"""Every registered query with SQL gives the rows DuckDB gives on the same files."""

import pytest
from paths import SF
from parity import compare, connect

from riskloom import checks, registry

QUERIES, ORACLES = registry.queries(), checks.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    return connect(SF)


def test_every_sql_has_a_query():
    assert set(ORACLES) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_parity(spark, duck, name):
    assert compare(QUERIES[name](spark, SF), duck, ORACLES[name]) is None
