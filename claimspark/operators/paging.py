"""Pages of sorted results by continuation: a page begins after the last row of the one before, so no page costs what stands before it.

What is not known comes last, upwards and downwards; ties go by id. Rows without an id are left out; ids are unique.
"""

from __future__ import annotations

from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: What each sort goes by. The three counts of students are three different things.
SORTS = {
    "fit": "fit", "confidence": "confidence", "fee": "coalesce((fee_annual_inr_min + fee_annual_inr_max) / 2D, fee_annual_inr_min, fee_annual_inr_max)", "fee_min": "fee_annual_inr_min",
    "pcm_12": "pcm_12_count", "class_12": "class_12_total", "enrollment": "total_enrollment",
}


def _later(by: Column, key: Column, descending: bool, after: tuple[Any, Any]) -> Column:
    """Rows behind (value, id) in the order."""
    value, last = after
    if value is None:
        return by.isNull() & (key > last)
    further = by < value if descending else by > value
    return by.isNull() | further | ((by == value) & (key > last))


def page(rows: DataFrame, sort: str, size: int, *, descending: bool = True, after: tuple[Any, Any] | None = None, key: str = "id") -> DataFrame:
    """The next ``size`` rows with ``sort_value``, behind ``after`` = (sort_value, id) of the last row that was shown; None: the first page."""
    if sort not in SORTS:
        raise ValueError(f"no sort {sort}; there are {', '.join(SORTS)}")
    by = F.col("sort_value")
    out = rows.where(F.col(key).isNotNull()).withColumn("sort_value", F.expr(SORTS[sort]).cast("double"))
    if after is not None:
        out = out.where(_later(by, F.col(key), descending, after))
    return out.orderBy(by.desc_nulls_last() if descending else by.asc_nulls_last(), key).limit(size)


def token(shown: DataFrame, *, descending: bool = True, key: str = "id") -> tuple[Any, Any] | None:
    """(sort_value, id) of the last row of a page; None: there was none."""
    by = F.col("sort_value")
    last = shown.orderBy(by.asc_nulls_first() if descending else by.desc_nulls_first(), F.col(key).desc()).select("sort_value", key).first()
    return None if last is None else tuple(last)
