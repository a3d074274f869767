"""Every registered query against its SQL on the smallest tables."""

import os

import pytest

import __spark_entry__ as entry
from compare import compare, duck

D = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
QUERIES, SQL = entry.queries(), entry.oracle_sql()

pytestmark = pytest.mark.skipif(not os.path.isdir(D), reason="no test tables")


@pytest.fixture(scope="module")
def con():
    return duck(D)


@pytest.mark.parametrize("name", [n for n in QUERIES if not n.startswith(("p2_", "p3_", "p8_", "p9_", "p10_"))])
def test_query(spark, con, name):
    if name not in SQL:
        df = QUERIES[name](spark, D)
        rows = df.collect()
        assert len(df.columns) > 1 and len(set(df.columns)) == len(df.columns) and len(rows) > 0
        return
    (ca, a), (cb, b) = compare(spark, con, D, QUERIES[name], SQL[name])
    assert ca == cb
    assert a == b


def test_every_sql_has_a_query():
    assert set(SQL) <= set(QUERIES)


def test_entry(spark):
    assert entry.entry(spark).limit(1).count() == 1
