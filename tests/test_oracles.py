"""Every query with a SQL twin against DuckDB, over the smallest tables."""

import collections
import math
import os

import pytest

import __spark_entry__ as entry
from wayfare.plans import catalogue
from wayfare.session import TABLES

SF = "/root/testdata/sf0.001"
duckdb = pytest.importorskip("duckdb")
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="the given tables are not here")


@pytest.fixture(scope="module")
def sql():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def plain(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return None
    return float(f"{v:.9g}") if isinstance(v, float) else tuple(map(plain, v)) if isinstance(v, (list, tuple)) else v


@pytest.mark.parametrize("name", sorted(catalogue.ORACLES))
def test_query_equals_its_sql(spark, sql, name):
    df = entry.queries()[name](spark, SF)
    names = sorted(df.columns)
    got = collections.Counter(repr([plain(r[c]) for c in names]) for r in df.collect())
    found = sql.execute(entry.oracle_sql()[name])
    at = {c[0]: i for i, c in enumerate(found.description)}
    assert sorted(at) == names
    want = collections.Counter(repr([plain(r[at[c]]) for c in names]) for r in found.fetchall())
    assert got == want
