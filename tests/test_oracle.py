"""Every registered query that has SQL gives the same rows as DuckDB; the others run and give rows of a stable schema."""

import pytest
from oracle import connect, same

from recallum.queries import load

QUERIES, SQL = load()


@pytest.fixture(scope="module")
def con(sf):
    return connect(sf)


@pytest.mark.parametrize("name", sorted(SQL))
def test_oracle(spark, sf, con, name):
    same(QUERIES[name](spark, sf), SQL[name], con)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_runs(spark, sf, name):
    assert QUERIES[name](spark, sf).count() > 0
