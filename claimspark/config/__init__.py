"""Fixed values as plain tables: words.csv has (list, key, value), in the order in which they count."""

from __future__ import annotations

import csv
from functools import cache
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


@cache
def _rows() -> tuple[tuple[str, str, str], ...]:
    with (Path(__file__).parent / "words.csv").open(newline="", encoding="utf-8") as f:
        return tuple((r["list"], r["key"], r["value"]) for r in csv.DictReader(f))


def words(name: str) -> list[str]:
    return [k for n, k, _ in _rows() if n == name]


def pairs(name: str) -> dict[str, str]:
    return {k: v for n, k, v in _rows() if n == name}


def table(spark: SparkSession) -> DataFrame:
    """(list, key, value) as a table, to be joined or looked at."""
    return spark.createDataFrame(list(_rows()), "list string, key string, value string")
