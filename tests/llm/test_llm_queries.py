"""Queries of the package against their SQL at the smallest scale; those without SQL must run."""

import pytest

from quirework.llm import queries as Q
from tests.oracle import connect, same


@pytest.fixture(scope="module")
def db(sf):
    return connect(sf)


@pytest.mark.parametrize("name", sorted(Q.QUERIES))
def test_query(spark, sf, db, name):
    df = Q.QUERIES[name](spark, sf)
    if name in Q.SQL:
        same(df, db, Q.SQL[name])
    else:
        assert df.count() >= 0 and len(set(df.columns)) == len(df.columns)
