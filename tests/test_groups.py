"""Owners and brands are two axes: one merges, the other warns."""

from pyspark.sql import functions as F

from claimspark.operators import groups

ROW = "id long, canonical_name string, website string, legal_entity_name string, state string, ok boolean"


def grouped(spark, *rows, **how):
    got = groups.with_groups(spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], ROW), F.col("ok"), **how).orderBy("id").collect()
    return [(r.group_type, r.campus_count, r.brand_count, r.is_franchise) for r in got]


def test_the_table_of_decisions(spark):
    site = "https://www.lotus.in/a"
    own, network = groups.OWNER, groups.FRANCHISE
    assert grouped(spark, ("Lotus Vale A", site, "Hill Trust", "X", True), ("LOTUS VALE, B", site, "Hill Society (Regd.)", None, None)) == [(own, 2, 2, False)] * 2
    assert grouped(spark, ("Lotus Vale A", site, "Hill Trust", "X", True), ("Rose Dale", "https://rose.in", "trust HILL", "X", True)) == [(own, 2, None, False)] * 2
    assert grouped(spark, ("Lotus Vale A", site, "Hill Trust", "X", True), ("Lotus Vale B", site, "Lake Trust", "X", True)) == [(network, None, 2, True)] * 2
    assert grouped(spark, ("Lotus Vale A", site, None, "X", True), ("Lotus Vale B", site, None, "X", True)) == [(network, None, 2, True)] * 2
    assert grouped(spark, ("Lotus Vale A", site, None, "X", True), ("Lotus Vale B", "https://other.in", None, "X", True)) == [(None, None, None, False)] * 2
    assert grouped(spark, (None, None, None, None, None), ("The Public School", site, None, None, None), ("the public hall", site, None, None, None)) == [(None, None, None, False)] * 3
    assert grouped(spark) == []


def test_a_domain_of_many_names_is_no_brand(spark):
    rows = [(f"Name{i // 2} Vale", "https://x.host.in", None, "X", True) for i in range(6)]
    assert {x[3] for x in grouped(spark, *rows, most_names=2)} == {False} and {x[3] for x in grouped(spark, *rows, most_names=3)} == {True}


def test_totals_of_an_owner(spark):
    rows = [("a", None, "Hill Trust", s, q) for s, q in (("X", True), ("Y", True), ("X", False), ("Y", None), (None, True), (None, True), (None, True))]
    got = groups.owners(spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], ROW), F.col("ok")).first()
    assert (got.campus_count, got.states_present, got.hq_state, got.qualifying_campus_count, got.name) == (7, ["X", "Y"], "X", 5, "Hill Trust")
