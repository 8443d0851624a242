"""Every query with SQL equals DuckDB's result on the smallest tables."""

import math
import os

import duckdb
import pytest

from riskloom.plans import registry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="the driver's tables are needed")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6) + 0.0
    return str(v)[:10] if hasattr(v, "isoformat") else v


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_equals_sql(spark, duck, name):
    found = registry.QUERIES[name](spark, SF)
    wanted = duck.sql(registry.ORACLE_SQL[name])
    names = sorted(found.columns)
    assert names == sorted(wanted.columns)
    at = [wanted.columns.index(c) for c in names]
    ours = sorted(repr([plain(r[c]) for c in names]) for r in found.collect())
    theirs = sorted(repr([plain(r[i]) for i in at]) for r in wanted.fetchall())
    assert ours == theirs


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLE_SQL)))
def test_runs_without_sql(spark, name):
    assert registry.QUERIES[name](spark, SF).count() > 0
