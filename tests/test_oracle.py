"""Every query with SQL gives the rows that DuckDB gives on the same tables."""

import glob
import math
import os

import duckdb
import pytest

from lodestack.plans import registry

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = [os.path.basename(p).removesuffix(".parquet") for p in glob.glob(f"{DATA}/*.parquet")]


def plain(v):
    if isinstance(v, bool) or v is None:
        return (str(type(v)), v is True)
    if isinstance(v, (int, float)):
        return ("number", "nan" if isinstance(v, float) and math.isnan(v) else float(v))
    return ("text", str(v))


def table(rows, columns):
    order = sorted(range(len(columns)), key=columns.__getitem__)
    return sorted(tuple(plain(r[i]) for i in order) for r in rows)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return con


@pytest.mark.skipif(not TABLES, reason="no tables here")
@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_same_rows(spark, duck, name):
    got = registry.queries()[name](spark, DATA)
    want = duck.sql(registry.oracle_sql()[name])
    assert sorted(got.columns) == sorted(want.columns)
    assert table([tuple(r) for r in got.collect()], got.columns) == table(want.fetchall(), want.columns)


@pytest.mark.skipif(not TABLES, reason="no tables here")
@pytest.mark.parametrize("name", sorted(set(registry.queries()) - set(registry.oracle_sql())))
def test_runs(spark, name):
    assert registry.queries()[name](spark, DATA).count() > 0
