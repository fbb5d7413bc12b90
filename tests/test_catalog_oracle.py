"""Every query with an SQL oracle matches DuckDB on sf0.001 (small frame blocks on)."""

import os
import sys

import duckdb
import pytest

sys.path.insert(0, os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "scripts"))

import __spark_entry__ as E  # noqa: E402
from check_oracle import close, duck, rows  # noqa: E402

from paths import SF0001  # noqa: E402

SQL = E.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return duck(SF0001)


@pytest.mark.parametrize("key", sorted(SQL))
def test_query_matches_oracle(spark, con, key):
    sp = E.queries()[key](spark, SF0001).toPandas()
    dk = con.execute(SQL[key]).df()
    assert sorted(sp.columns) == sorted(dk.columns)
    assert len(sp) == len(dk)
    for a, b in zip(rows(sp), rows(dk)):
        assert close(a, b), (a, b)


def test_entry_smoke(spark):
    df = E.entry(spark)
    assert df.count() == 4
