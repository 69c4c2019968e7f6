"""Sums and headcounts out of tables of pages: rows (key, table_ix, row_ix, cells) to one value for each key, with the row it stands in.

A number counts only in a table that says what it is about. Rows are given what their table is found to be, and the
rest are aggregations over (key) and (key, label); no table is gathered.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from claimspark.functions.identity import squash
from claimspark.functions.text import PLAUSIBLE_FEE
from claimspark.sources.pages import has_label, labelled_value

# What looks like an address or an escape in one, and the most of a class.
URLISH = r"(?i)(?:https?://|www\.)\S+|\S+\.(?:pdf|docx?|xlsx?|jpe?g|png)\b"
ESCAPE = "%[0-9A-Fa-f]{2}"
MOST_OF_A_CLASS = 5_000


def numbers(cell: Column) -> Column:
    """Whole numbers of a cell, commas within them dropped; addresses and their escapes hold none."""
    plain = F.regexp_replace(F.regexp_replace(F.coalesce(cell, F.lit("")), URLISH, " "), ESCAPE, " ")
    return F.filter(F.transform(F.regexp_extract_all(plain, F.lit(r"\d[\d,]*"), F.lit(0)), lambda x: F.regexp_replace(x, ",", "").try_cast("long")), lambda n: n.isNotNull())


def _largest(cells: Column, low: int, high: int) -> Column:
    """Of all cells as one text: no number, address or escape reaches over the blanks between them."""
    return F.array_max(F.filter(numbers(F.array_join(cells, " | ")), lambda n: n.between(low, high)))


def _any(cells: Column, aliases: list[str]) -> Column:
    """All cells as one text again, put together by a character that no alias holds."""
    return has_label(F.array_join(cells, "\x01"), aliases)


def _text(cells: Column) -> Column:
    return F.array_join(F.filter(cells, lambda c: c != ""), " ")


def table_facts(rows: DataFrame, key: str, labels: dict[str, list[str]]) -> DataFrame:
    """(key, table_ix, is_fee, is_result, is_part, is_strength, total_at) of each table; total_at: the column, from 1, whose head says total."""
    where = lambda n, name: F.max((F.col("row_ix") < n) & _any(F.col("cells"), labels[name]))
    heads = F.transform("cells", lambda c, i: F.when(has_label(F.coalesce(c, F.lit("")), labels["fee_total_column"]), i + 1))
    return rows.groupBy(key, "table_ix").agg(
        F.max((F.col("row_ix") < 12) & (_any(F.col("cells"), labels["fee"]) | _any(F.col("cells"), labels["fee_total_row"]))).alias("is_fee"),
        where(4, "result").alias("is_result"), where(3, "instalment").alias("is_part"), where(12, "strength").alias("is_strength"),
        F.max(F.when(F.col("row_ix") == 0, F.array_min(F.array_compact(heads)))).alias("total_at"),
    )


def annual_fee(rows: DataFrame, key: str, labels: dict[str, list[str]]) -> DataFrame:
    """(key, fee, evidence). Instalments in tables of their own are added up for a label that all of them have; else the largest plausible
    sum of a row of class 12; else the largest of any row. Under a column of totals only that column counts; a row labelled as the
    total counts whole. Rows are read and shuffled once, by key; what their table is, is a window, the rest are aggregations above it."""
    there = rows.where(F.size("cells") > 0).repartition(key)
    near = lambda n, name: (F.col("row_ix") < n) & _any(F.col("cells"), labels[name])
    heads = F.transform("cells", lambda c, i: F.when(has_label(F.coalesce(c, F.lit("")), labels["fee_total_column"]), i + 1))
    said = there.withColumns({
        "fee_": (F.col("row_ix") < 12) & (_any(F.col("cells"), labels["fee"]) | _any(F.col("cells"), labels["fee_total_row"])), "result_": near(4, "result"), "part_": near(3, "instalment"),
        "total_": F.when(F.col("row_ix") == 0, F.array_min(F.array_compact(heads))),
    })
    table = Window.partitionBy(key, "table_ix")
    facts = {"is_fee": "fee_", "is_result": "result_", "is_part": "part_", "total_at": "total_"}
    all_ = said.withColumns({n: F.max(c).over(table) for n, c in facts.items()} | {"first": F.row_number().over(table.orderBy("row_ix")) == 1}).where("is_fee")

    head, rest = F.element_at("cells", 1), F.slice("cells", 2, F.greatest(F.size("cells") - 1, F.lit(0)))
    under = F.when(F.col("total_at").isNotNull() & (F.col("total_at") <= F.size("cells")), F.slice("cells", F.col("total_at"), 1)).otherwise(F.col("cells"))
    counts = ~F.col("is_result") & ~_any(F.slice("cells", 1, 2), labels["not_money"])
    row = F.when((F.col("row_ix") > 0) | F.col("total_at").isNull(), _largest(under, *PLAUSIBLE_FEE))
    named = F.when(has_label(F.coalesce(head, F.lit("")), labels["fee_total_row"]), _largest(rest, *PLAUSIBLE_FEE))
    read = all_.select(
        key, "table_ix", "row_ix", (F.col("first") & F.col("is_part")).cast("int").alias("part"), F.when(F.col("is_part"), squash(F.coalesce(head, F.lit("")))).alias("label"), F.when(F.col("is_part"), _largest(rest, *PLAUSIBLE_FEE)).alias("sum"),
        _text(F.col("cells")).alias("evidence"), F.when(counts, row).alias("row"), F.when(counts, named).alias("named"), _any(F.col("cells"), labels["class_12"]).alias("upper"),
    )
    usable = (F.col("sum").isNotNull()) & (F.col("label") != "") & ~F.col("label").rlike("^[0-9]+$")
    read = read.withColumns({"label": F.when(usable, F.col("label")), "v": F.greatest("row", "named")})
    place = ((-F.col("table_ix")).alias("t"), (-F.col("row_ix")).alias("r"))
    best = lambda v: F.struct(F.col(v).alias("fee"), *place, "evidence")  # noqa: E731 - the greatest is the largest, then the first in the page
    by_label = read.groupBy(key, "label").agg(
        F.sum("part").alias("parts"), F.count("label").alias("n"), F.sum(F.when(usable, F.col("sum"))).alias("total"), F.min(F.struct("table_ix", "row_ix")).alias("at"),
        F.max(F.when(F.col("upper") & F.col("row").isNotNull(), best("row"))).alias("c"), F.max(F.when(F.col("v").isNotNull(), best("v"))).alias("b"),
    )
    whole = by_label.withColumn("parts", F.sum("parts").over(Window.partitionBy(key))).withColumn("upper", has_label(F.col("label"), labels["class_12"]))
    sum_of_all = F.struct("upper", "total", (-F.col("at.table_ix")).alias("t"), (-F.col("at.row_ix")).alias("r"), F.concat_ws(" ", "label", F.col("total").cast("string")).alias("evidence"))
    complete = F.col("label").isNotNull() & (F.col("parts") > 1) & (F.col("n") == F.col("parts"))
    out = whole.groupBy(key).agg(F.max(F.when(complete, sum_of_all)).alias("s"), F.max("c").alias("c"), F.max("b").alias("b"))
    of = lambda x, fee: F.when(F.col(x).isNotNull(), F.struct(F.col(f"{x}.{fee}").alias("fee"), F.col(f"{x}.evidence").alias("evidence")))
    return out.select(key, F.coalesce(of("s", "total"), of("c", "fee"), of("b", "fee")).alias("f")).where("f IS NOT NULL").select(key, "f.fee", "f.evidence")


def class_12_total(rows: DataFrame, key: str, labels: dict[str, list[str]]) -> DataFrame:
    """(key, total, evidence): the largest headcount of the first row of class 12 in a table of strengths that is none of results."""
    there = rows.join(table_facts(rows, key, labels).where("is_strength AND NOT is_result"), [key, "table_ix"])
    found = there.where(_any(F.col("cells"), labels["class_12"])).select(key, "table_ix", "row_ix", _largest(F.col("cells"), 1, MOST_OF_A_CLASS).alias("total"), _text(F.col("cells")).alias("evidence")).where("total IS NOT NULL")
    return found.groupBy(key).agg(F.min_by(F.struct("total", "evidence"), F.struct("table_ix", "row_ix")).alias("f")).select(key, "f.*")


def labelled_int(rows: DataFrame, key: str, aliases: list[str], low: int = 1, high: int = 100_000) -> DataFrame:
    """(key, n, evidence): the first number within bounds of the labelled value."""
    got = labelled_value(rows, key, aliases)
    n = F.try_element_at(F.filter(numbers(F.col("value")), lambda x: x.between(low, high)), F.lit(1))
    return got.select(key, n.alias("n"), "evidence").where("n IS NOT NULL")
