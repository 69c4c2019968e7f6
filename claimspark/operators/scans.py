"""Scanned documents: boxes of text to the rows the eye sees, and the fee that the rows of class 12 state.

A box is (key, page, box_ix, x, y, page_height, text). A row is anchored at its highest box: whatever lies no lower than the tolerance
below it belongs to it, however far the next boxes lead on. Boxes go through a machine in the order of their page; it holds the open row alone,
so a page of any length streams through one task.

Boxes without text, x or y are left out; a null page counts as page 0, a null key is a key; boxes at one place stand in the order of
``box_ix``; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from claimspark.functions.identity import FEE_YEAR, fee_year
from claimspark.functions.text import PLAUSIBLE_FEE
from claimspark.operators.enrichment import review_reason, to_claims
from claimspark.operators.score import FEE_UPTO
from claimspark.sources.pages import has_label

# The share of a page's height within which boxes are one row (one unit at least), how sure a sum read from a picture is, what
# class 12 is called there, and how much of a row is kept as evidence.
ROW_TOLERANCE, LEAST_TOLERANCE = 0.012, 1.0
CONFIDENCE = 0.55
CLASS_12 = ["xi to xii", "xi & xii", "xi and xii", "class xi xii", "11 to 12", "11 & 12", "xii", "class xii", "class 12", "grade 12", "std xii"]
EVIDENCE = 500
EDGES = [limit for limit, _ in FEE_UPTO if limit]


def rows_of_boxes(boxes: DataFrame, key: str) -> DataFrame:
    """(key, page, row_ix, line): row_ix from 0 on each page; the texts of a row from left to right, joined by a space."""
    kind = boxes.schema[key].dataType.simpleString()
    known = F.col("text").isNotNull() & (F.trim("text") != "") & ~F.isnan(F.col("x").cast("double")) & ~F.isnan(F.col("y").cast("double"))
    height = F.coalesce(F.nanvl(F.col("page_height").cast("double"), F.lit(0.0)), F.lit(0.0))
    plain = boxes.where(known & F.col("x").isNotNull() & F.col("y").isNotNull()).select(
        F.coalesce(F.concat(F.lit("="), F.col(key).cast("string")), F.lit("")).alias("k"), F.coalesce(F.col("page").cast("int"), F.lit(0)).alias("page"), F.col("box_ix").alias("b"),
        F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"), F.greatest(height * ROW_TOLERANCE, F.lit(LEAST_TOLERANCE)).alias("tolerance"), F.trim("text").alias("text"),
    )

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        place, row, anchor, cells = None, 0, 0.0, []
        line = lambda: (*place, row, " ".join(t for _, _, t in sorted(cells)))
        frame = lambda rows: pd.DataFrame(rows, columns=["k", "page", "row_ix", "line"])
        for b in batches:
            done = []
            for k, page, x, y, tolerance, text in zip(*(b[c].tolist() for c in ("k", "page", "x", "y", "tolerance", "text")), strict=True):
                if cells and (k, page) == place and y - anchor <= tolerance:
                    cells.append((x, len(cells), text))
                    continue
                if cells:
                    done.append(line())
                row = row + 1 if (k, page) == place else 0
                place, anchor, cells = (k, page), y, [(x, 0, text)]
            yield frame(done)
        if cells:
            yield frame([line()])

    rows = plain.repartition("k", "page").sortWithinPartitions("k", "page", "y", "b").mapInPandas(run, "k string, page int, row_ix int, line string")
    return rows.select(F.when(F.col("k") != "", F.substring("k", 2, 1 << 30)).cast(kind).alias(key), "page", "row_ix", "line")


def plausible_numbers(line: Column) -> Column:
    """Whole numbers of a line that may be a fee. Nothing is repaired: a digit that was guessed is no digit."""
    found = F.transform(F.regexp_extract_all(line, F.lit(r"\d[\d,]*"), F.lit(0)), lambda x: F.regexp_replace(x, ",", "").try_cast("long"))
    return F.filter(found, lambda n: n.between(*PLAUSIBLE_FEE))


def fees_of_scans(scans: DataFrame, lines: DataFrame, key: str, aliases: Sequence[str] = CLASS_12) -> DataFrame:
    """(key, fee, evidence, fee_year, confidence, unreadable, reason) of each of ``scans``, by ``lines`` of ``rows_of_boxes``.

    The fee is the largest plausible number of a row of class 12, for parts stand beside their total; of equal ones the first counts. Its
    year is the first span of years of the whole text, which may run over the ends of rows. ``reason``: why a person is to see it."""
    order = Window.partitionBy(key).orderBy("page", "row_ix")
    text = F.concat_ws(" ", "line", F.lead("line", 1).over(order), F.lead("line", 2).over(order))  # a span has three parts, each row one or more
    seen = lines.where(F.col(key).isNotNull()).withColumn("text", text)
    starts = F.regexp_instr("text", F.lit(FEE_YEAR)).between(1, F.length("line"))
    fee = F.when(has_label(F.col("line"), list(aliases)), F.array_max(plausible_numbers(F.col("line"))))
    seen = seen.select(key, "page", "row_ix", "line", fee.alias("fee"), F.when(starts, fee_year(F.col("text"))).alias("year"))
    at = F.struct("fee", (-F.col("page")).alias("p"), (-F.col("row_ix")).alias("r"))
    read = seen.groupBy(key).agg(
        F.max_by(F.struct("fee", F.substring("line", 1, EVIDENCE).alias("evidence")), F.when(F.col("fee").isNotNull(), at)).alias("f"),
        F.min_by("year", F.when(F.col("year").isNotNull(), F.struct("page", "row_ix"))).alias("year"),
    )
    there = F.col("f.fee").isNotNull()
    return scans.select(key).distinct().join(read, key, "left").select(
        key, F.col("f.fee").alias("fee"), F.col("f.evidence").alias("evidence"), F.when(there, F.col("year")).alias("fee_year"), F.when(there, F.lit(CONFIDENCE)).alias("confidence"),
        (~there).alias("unreadable"), review_reason(F.col("f.fee"), EDGES).alias("reason"),
    )


def claims_of_scans(fees: DataFrame, key: str) -> DataFrame:
    """(key, field, value, confidence): sums and years alone, as names and addresses read from a picture are not to be trusted."""
    return to_claims(fees.where("NOT unreadable").withColumnRenamed("fee", "fee_annual_inr_max"), key, ["fee_annual_inr_max", "fee_year"]).withColumn("confidence", F.lit(CONFIDENCE))
