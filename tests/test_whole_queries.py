import datetime

import __spark_entry__ as e


def test_merges_of_all_orders_against_union_find(spark, tmp_path):
    rows = [(k, (k * 7) % 50 * 10) for k in range(1, 40) if k % 23]
    spark.createDataFrame(rows, "o_orderkey long, o_custkey long").write.parquet(f"{tmp_path}/orders.parquet")
    root: dict = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for k, c in rows:
        a, b = find(c), find(c + 1 + k % 3)
        root[max(a, b)] = min(a, b)
    got = e.queries()["merge_decisions_all"](spark, str(tmp_path))
    assert {r.key: r.primary for r in got.collect()} == {x: find(x) for x in root}


def test_denylist_reads_the_whole_url_and_no_page_text(spark, tmp_path):
    rows = [(1, "http://a.org/" + "x" * 500 + "/Toppers", "fine"), (2, "http://a.org/fees", "C: RESULT AND ACADEMICS"), (3, "http://a.org/award", None), (4, None, "merit")]
    spark.createDataFrame(rows, "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    got = {r.page_id: r.pattern for r in e.queries()["denylist"](spark, str(tmp_path)).collect()}
    assert got == {1: "topper", 2: None, 3: "award", 4: None}


def test_disputes_are_looked_for_in_every_field(spark, tmp_path):
    at = datetime.datetime(2024, 1, 1)
    rows = [(1, 5, "F", 100.0, at, "1-URGENT"), (2, 5, "F", 101.0, at, "2-HIGH"), (6, 5, "F", 100.0, at, "5-LOW"), (8, 6, "F", 100.0, at, "1-URGENT"), (9, 6, "F", 200.0, at, "2-HIGH")]
    spark.createDataFrame(rows, "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double, o_orderdate timestamp_ntz, o_orderpriority string").write.parquet(f"{tmp_path}/orders.parquet")
    got = e.queries()["conflict_disputes"](spark, str(tmp_path))
    assert {(r.entity_key, r.field): r.disputed for r in got.collect()} == {("c:5", "total"): False, ("c:5", "qty"): True, ("c:6", "total"): True, ("c:6", "qty"): False}


def test_best_lines_do_not_depend_on_the_order_of_rows(spark, tmp_path):
    at = datetime.datetime(2024, 1, 1)
    rows = [(1, "A", 2, 10.0, 0.1, at), (1, "A", 2, 30.0, 0.1, at), (1, "A", 2, 20.0, 0.1, at), (1, "A", 1, 5.0, 0.0, at)]
    for name, given in (("up", rows), ("down", rows[::-1])):
        df = spark.createDataFrame(given, "l_orderkey long, l_returnflag string, l_linenumber int, l_extendedprice double, l_discount double, l_shipdate timestamp_ntz")
        df.coalesce(1).write.parquet(f"{tmp_path}/{name}/lineitem.parquet")
        assert [tuple(r) for r in e.queries()["distinct_on_best"](spark, f"{tmp_path}/{name}").collect()] == [(1, "A", 2, 30.0)]
