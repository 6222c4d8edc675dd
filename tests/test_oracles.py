"""Every query of the library that SQL can express gives the rows that its SQL gives in DuckDB."""

import os

import pytest

from cuewright import registry

from .compare import connect, same

SQL = registry.oracle_sql()


@pytest.fixture(scope="module")
def data():
    """The scale that the driver compares at: ties and long texts that smaller tables lack."""
    return os.environ.get("TEST_ORACLE_DIR", "/root/testdata/sf0.01")


@pytest.fixture(scope="module")
def duck(data):
    return connect(data)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_matches_sql(name, spark, data, duck):
    same(registry.queries()[name](spark, data), duck, SQL[name])


@pytest.mark.parametrize("name", sorted(set(registry.queries()) - set(SQL)))
def test_query_runs(name, spark, data):
    df = registry.queries()[name](spark, data)
    assert df.columns and df.count() >= 0
