import pytest

import __spark_entry__ as e

SF = "/root/testdata/sf0.001"


def test_flagship(spark):
    assert e.entry(spark).count() > 0


def test_every_sql_has_a_query():
    assert set(e.oracle_sql()) <= set(e.queries())


@pytest.mark.parametrize("name", ["conflict_resolve", "group_rollup", "unique_attribution", "parse_inr", "match_key", "trigram_search"])
def test_query_columns_match_the_sql(spark, name):
    import duckdb

    con = duckdb.connect()
    for t in ("orders", "customer", "nation", "region", "pages", "part"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    got = e.queries()[name](spark, SF)
    want = con.execute(e.oracle_sql()[name])
    assert sorted(got.columns) == sorted(d[0] for d in want.description)
    assert got.count() == len(want.fetchall())
