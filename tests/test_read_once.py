"""Steps that cost the most are in a plan once: tables read, pages parsed, texts searched."""

import re

import __spark_entry__ as e
from claimspark.operators import discovery as D
from claimspark.operators import fees

SF = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_fees_read_their_rows_once(spark, tmp_path):
    rows = [("a", 0, i, ["Class", "Annual Fee"] if i == 0 else [f"Class {i}", "9,000"]) for i in range(3)]
    spark.createDataFrame(rows, "k string, table_ix int, row_ix int, cells array<string>").write.parquet(f"{tmp_path}/rows")
    labels = {"fee": ["annual fee"], "fee_total_row": ["total fees"], "fee_total_column": ["total"], "instalment": ["quarter"], "class_12": ["class 12"], "not_money": ["affiliation"], "result": ["pass"], "strength": ["strength"]}
    df = fees.annual_fee(spark.read.parquet(f"{tmp_path}/rows"), "k", labels)
    assert len(re.findall("FileScan parquet", plan(df))) == 1
    assert [(r.k, r.fee, r.evidence) for r in df.collect()] == [("a", 9000, "Class 1 9,000")]


def test_details_parse_their_pages_once(spark):
    assert len(re.findall(r"EvalPythonUDTF", plan(e.queries()["registry_details"](spark, SF)))) == 1


def test_names_are_looked_for_once(spark):
    text = plan(e.queries()["names_after_labels"](spark, SF))
    assert not any("Filter" in line and "regexp_extract" in line for line in text.splitlines())


def test_names_after_signs_of_two_units(spark):
    from pyspark.sql import functions as F

    from claimspark.functions.spans import name_after_label

    df = spark.createDataFrame([("😀😀 Principal: Asha Rao, the principal's page",)], "t string")
    r = df.select(name_after_label(F.col("t")).alias("p")).first().p
    assert (r.given, r.start) == ("Asha Rao", 14)


def test_links_leave_a_page_as_they_are_read(spark):
    html = "<table><tr>" + "".join(f"<td><a href='/{i}'>{i}</a>" for i in range(300)) + "</table>"
    df = D.links_in_rows(spark.createDataFrame([(1, html, "http://a.org/"), (2, None, None)], "k long, html string, at string"), "k", "html", "at")
    got = df.collect()
    assert [(r.place, r.url, r.row_ix) for r in got] == [(i, f"http://a.org/{i}", 0) for i in range(300)]
    assert "MapInPandas" not in plan(df)
