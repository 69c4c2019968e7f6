"""Queries held against their SQL in DuckDB, at the smallest size."""

import os

import duckdb
import pytest

from claimspark.plans import build, discovery, enrichment, extraction, groups, matching, registries, registry, registry_pages, scans, served, spans

SF = "/root/testdata/sf0.001"
NAMES = [n for m in (served, build, extraction, registries, enrichment, matching, discovery, registry_pages, scans, spans, groups) for n in vars(m) if n in registry.ORACLE and vars(m)[n].__module__ == m.__name__]
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="the test tables are not there")


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for f in os.listdir(SF):
        c.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{f}'")
    return c


def plain(v):
    return "null" if v is None else f"{v:.6f}" if isinstance(v, float) else str(v)


@pytest.mark.parametrize("name", NAMES)
def test_query_agrees_with_its_sql(spark, con, name):
    df = registry.QUERIES[name](spark, SF)
    got = con.execute(registry.ORACLE[name])
    columns = [d[0] for d in got.description]
    assert sorted(columns) == sorted(df.columns)
    want = sorted(tuple(map(plain, r)) for r in got.fetchall())
    assert sorted(tuple(plain(r[c]) for c in columns) for r in df.collect()) == want
