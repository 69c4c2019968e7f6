"""Boxes to rows and fees against a plain fold; signals of two snapshots by kind."""

import random

import pytest
from pyspark.sql import functions as F

from claimspark.operators import scans, signals

BOX = "k string, page int, box_ix long, x double, y double, page_height double, text string"
SHOT = "k string, level string, principal string, address string, legal_entity string"


def folded(boxes):
    """The rows of one page, box by box."""
    rows = []
    for box in sorted(boxes, key=lambda b: (b[4], b[2])):
        if rows and abs(box[4] - rows[-1][0][4]) <= max(box[5] * 0.012, 1.0):
            rows[-1].append(box)
        else:
            rows.append([box])
    return [" ".join(b[6].strip() for b in sorted(row, key=lambda b: (b[3], b[4], b[2]))) for row in rows]


def lines(spark, rows):
    got = scans.rows_of_boxes(spark.createDataFrame(rows, BOX), "k").collect()
    return {(r.k, r.page, r.row_ix): r.line for r in got}


def test_a_row_is_anchored_at_its_first_box(spark):
    page = [("a", 0, i, float(10 - i), y, 1000.0, f"t{i}") for i, y in enumerate([100.0, 108.0, 112.0, 112.5, 120.0])]
    assert lines(spark, page) == {("a", 0, 0): "t2 t1 t0", ("a", 0, 1): "t4 t3"}  # not one chain of five


def test_rows_of_a_small_page_and_of_odd_boxes(spark):
    rows = [("a", 0, 1, 10.0, 100.0, 2000.0, "XITOXII"), ("a", 0, 2, 200.0, 101.0, 2000.0, "55500"), ("a", 0, 3, 400.0, 99.0, 2000.0, "138600"), ("a", 0, 4, 10.0, 300.0, 2000.0, "ITOIV"), ("a", 0, 5, 200.0, 301.0, 2000.0, " 80500 ")]
    odd = [("a", 0, 6, None, 300.0, 2000.0, "no"), ("a", 0, 7, 1.0, None, 2000.0, "no"), ("a", 0, 8, 1.0, 1.0, 2000.0, "  "), ("a", 0, 9, 1.0, float("nan"), 2000.0, "no"), (None, None, 1, 1.0, 1.0, None, "x"), (None, None, 2, 0.0, 2.0, None, "y"), ("", 0, 1, 0.0, 0.0, 10.0, "z")]
    assert lines(spark, rows + odd) == {("a", 0, 0): "XITOXII 55500 138600", ("a", 0, 1): "ITOIV 80500", (None, 0, 0): "y x", ("", 0, 0): "z"}
    assert lines(spark, []) == {}


def test_rows_against_a_fold(spark):
    r = random.Random(4)
    rows = [(f"d{r.randrange(4)}", r.randrange(3), i, float(r.randrange(20)), float(r.randrange(300)), 500.0, f"w{i}") for i in range(900)]
    rows += [("hot", 0, i, float(i % 7), float(i // 3), 500.0, f"h{i}") for i in range(3000)]
    want = {}
    for k, page in {b[:2] for b in rows}:
        want |= {(k, page, i): x for i, x in enumerate(folded([b for b in rows if b[:2] == (k, page)]))}
    spark_rows = spark.createDataFrame(rows, BOX)
    for n in (1, 5):
        got = scans.rows_of_boxes(spark_rows.repartition(n).withColumn("tolerance", F.lit("clash")), "k").collect()
        assert {(x.k, x.page, x.row_ix): x.line for x in got} == want


def fee(spark, *texts):
    rows = spark.createDataFrame([("a", 0, i, t) for i, t in enumerate(texts)], "k string, page int, row_ix int, line string")
    return scans.fees_of_scans(spark.createDataFrame([("a",), ("none",)], "k string"), rows, "k").where("k = 'a'").first()


def test_fees_of_scans(spark):
    got = fee(spark, "Session 2024", "-", "25 fees", "XITOXII 55500 27700 27700 27700 138600", "ITOIV 900000", "XII 138600 again")
    assert (got.fee, got.evidence, got.fee_year, got.confidence, got.unreadable) == (138600, "XITOXII 55500 27700 27700 27700 138600", 2024, 0.55, False)
    assert got.reason is not None and fee(spark, "XII 2,20,000").reason is None and fee(spark, "xii 52000").reason is not None
    for text in ("XITOXII 7A08O l38.6OO", "XII 12", "XII 99999999", "NUR LKG UKG 27000 81000", "XII 99999999999999999999"):
        got = fee(spark, text)
        assert got.unreadable and got.fee is None and got.confidence is None
    claims = scans.claims_of_scans(scans.fees_of_scans(spark.createDataFrame([("a",), ("b",)], "k string"), spark.createDataFrame([("a", 0, 0, "class 12 5000")], "k string, page int, row_ix int, line string"), "k"), "k")
    assert [tuple(r) for r in claims.collect()] == [("a", "fee_annual_inr_max", "5000", 0.55)]


def found(spark, old, new):
    got = signals.signals(spark.createDataFrame(old, SHOT), spark.createDataFrame(new, SHOT), "k")
    return sorted((r.k, r.signal_type, r.before, r.after) for r in got.collect())


def test_each_kind_of_signal(spark):
    old = [("a", "Secondary", "Dr. A B Sharma", "1, Hill Rd", "Lotus Trust"), ("b", "Senior Secondary", "Ravi", "2 Hill Rd", None), ("gone", None, None, None, None), (None, None, None, None, None)]
    new = [("a", "SENIOR SECONDARY", "A B Sharma", "1 hill rd.", "Lotus Trust"), ("b", "Secondary", "Mira", "3 Hill Rd", None), ("c", None, "X", None, "trust LOTUS"), ("d", None, None, None, "Other Society")]
    want = [("a", "level_upgrade", "Secondary", "SENIOR SECONDARY"), ("b", "address_change", "2 Hill Rd", "3 Hill Rd"), ("b", "principal_change", "Ravi", "Mira"), ("c", "new_campus", None, "trust LOTUS"), ("d", "new_affiliation", None, None), ("gone", "disaffiliation", None, None)]
    assert found(spark, old, new) == want


def test_what_is_unknown_or_repeated_is_no_change(spark):
    old = [("a", "secondary", None, "x", None), ("b", "college", "P", None, None), ("b", "college", "P", None, None)]
    new = [("a", None, "P", None, None), ("b", "secondary", "Mr P", "y", None)]
    assert found(spark, old, new) == [] and found(spark, [], []) == []
    assert [x[1] for x in found(spark, [], old[:1])] == ["new_affiliation"]


def test_a_snapshot_that_shrank_is_an_error(spark):
    old = [(str(i), None, None, None, None) for i in range(4)]
    assert len(found(spark, old, old[:2])) == 2
    for new in (old[:1], []):
        with pytest.raises(Exception, match="the snapshot has . rows, the one before 4"):
            found(spark, old, new)
