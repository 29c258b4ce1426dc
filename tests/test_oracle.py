"""Every query with an SQL counterpart gives the same rows on the smallest tables."""

import os

import pytest

import __spark_entry__ as entry
from helpers import duck

D = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(D), reason="no test tables")
KINDS = {"BIGINT": "bigint", "INTEGER": "int", "VARCHAR": "string", "DOUBLE": "double", "BOOLEAN": "boolean"}


@pytest.fixture(scope="module")
def db():
    return duck(D)


@pytest.mark.parametrize("name", sorted(entry.queries()))
def test_query(spark, db, name):
    df = entry.queries()[name](spark, D)
    got = sorted((tuple(str(r[c]) for c in sorted(df.columns)) for r in df.collect()))
    sql = entry.oracle_sql().get(name)
    if sql is None:
        return
    rel = db.execute(sql)
    cols = [x[0] for x in rel.description]
    want = sorted(tuple(str(r[cols.index(c)]) for c in sorted(cols)) for r in rel.fetchall())
    assert sorted(df.columns) == sorted(cols)
    assert got == want


def test_entry(spark):
    assert entry.entry(spark).count() > 0
