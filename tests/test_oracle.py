"""Every library query against its SQL on the smallest driver tables."""

import math
import os

import duckdb
import pytest

from gridloom.plans import registry

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="driver tables are not there")


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for f in os.listdir(DATA):
        con.execute(f"create view {f.removesuffix('.parquet')} as select * from '{DATA}/{f}'")
    return con


def plain(x):
    return ("nan" if math.isnan(x) else repr(round(x, 5) + 0.0)) if isinstance(x, float) else repr(x)


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_matches_sql(spark, db, name):
    df = registry.queries()[name](spark, DATA)
    found = db.execute(registry.oracle_sql()[name])
    columns = [d[0] for d in found.description]
    assert sorted(columns) == sorted(df.columns)
    want = sorted([tuple(plain(x) for x in row) for row in found.fetchall()])
    assert sorted([tuple(plain(row[c]) for c in columns) for row in df.collect()]) == want


@pytest.mark.parametrize("name", sorted(set(registry.queries()) - set(registry.oracle_sql())))
def test_runs_without_sql(spark, name):
    df = registry.queries()[name](spark, DATA)
    assert df.columns and df.count() > 0
