"""Rows of registries: addresses read from the right, labelled parts of a cell, row-count and drift guards, places of PIN codes."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The box that places lie in, and the names under which published tables of places have their columns.
BOX = (6.0, 37.5, 68.0, 97.5)
COLUMN_NAMES = {
    "pincode": ("pincode", "pin_code", "pin", "postal_code"), "latitude": ("latitude", "lat"), "longitude": ("longitude", "lon", "long", "lng"),
    "district": ("district", "districtname", "district_name"), "state": ("statename", "state", "state_name", "circlename"),
}
PIN_PART = r"^\d{3} ?\d{3}$"


def _squeezed(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def parse_address(text: Column) -> Column:
    """struct(country, pincode, state, district, address): the end of a comma-joined line is certain, so it is taken from there; what is
    left is the address."""
    parts = F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), ","), lambda x: _squeezed(x)), lambda x: x != "")
    n = F.size(parts)
    nth = lambda i: F.try_element_at(parts, F.when(i > 0, i))  # noqa: E731 - from 1
    foreign = (n > 0) & ~F.coalesce(nth(n).rlike(PIN_PART), F.lit(False))
    a = n - foreign.cast("int")
    coded = F.coalesce(nth(a).rlike(PIN_PART), F.lit(False))
    b = a - coded.cast("int")
    rest = F.when(b > 2, F.array_join(F.slice(parts, 1, F.greatest(b - 2, F.lit(0))), ", "))
    return F.struct(
        F.when(foreign, nth(n)).alias("country"), F.when(coded, F.regexp_replace(nth(a), " ", "")).alias("pincode"), nth(b).alias("state"), nth(b - 1).alias("district"), rest.alias("address"),
    )


def split_labelled(text: Column, labels: Sequence[str]) -> Column:
    """map(label, value) of a cell that packs "Label : value" pairs; only the labels given end a value."""
    any_ = "|".join(re.escape(x) for x in sorted(labels, key=len, reverse=True))
    values = [_squeezed(F.regexp_extract(text, rf"(?is){re.escape(x)}\s*:(.*?)(?=(?:{any_})\s*:|\z)", 1)) for x in labels]
    return F.map_filter(F.create_map(*[y for x, v in zip(labels, values, strict=True) for y in (F.lit(x), v)]), lambda k, v: v != "")


def row_count_guard(pages: DataFrame, key: str, parsed: str, skipped: str, stated: str) -> DataFrame:
    """The pages, or an error where the rows read and left out are not as many as the page says."""
    wrong = F.concat_ws(" ", F.lit("rows of"), F.col(key).cast("string"), F.lit("are not as many as stated"))
    return pages.withColumn(parsed, F.when((F.col(parsed) + F.col(skipped)) == F.col(stated), F.col(parsed)).otherwise(F.raise_error(wrong)))


def drift(snapshots: DataFrame, new: DataFrame, scope: Sequence[str], least: float = 0.5) -> DataFrame:
    """(scope, n, previous, aborts) of new row counts: fewer than ``least`` of the scope's last snapshot are not to be taken over."""
    last = snapshots.groupBy(*scope).agg(F.max_by("row_count", "taken_at").alias("previous"))
    return new.join(last, [*scope], "left").select(*scope, "n", "previous", F.coalesce(F.col("n") < least * F.col("previous"), F.lit(False)).alias("aborts"))


def centroids(table: DataFrame) -> DataFrame:
    """(pincode, latitude, longitude, district, state) out of a table with one of the known names for each column; rows without a whole
    code or a place within the box go, of repeated codes the last in the order of ``line`` (where there is such a column) stays."""
    there = {c.strip().lower().replace(" ", "_"): c for c in reversed(table.columns)}
    of = {k: next((there[n] for n in names if n in there), None) for k, names in COLUMN_NAMES.items()}
    if missing := [k for k in ("pincode", "latitude", "longitude") if of[k] is None]:
        raise ValueError(f"no column for {', '.join(missing)}; there are {', '.join(table.columns)}")
    text = lambda k: F.nullif(F.trim(F.col(of[k]).cast("string")), F.lit("")) if of[k] else F.lit(None).cast("string")
    line = F.col("line") if "line" in table.columns else F.monotonically_increasing_id()
    rows = table.select(F.regexp_replace(F.col(of["pincode"]).cast("string"), r"\D", "").alias("pincode"), F.col(of["latitude"]).try_cast("double").alias("latitude"), F.col(of["longitude"]).try_cast("double").alias("longitude"), text("district").alias("district"), text("state").alias("state"), line.alias("line"))
    south, north, west, east = BOX
    rows = rows.where((F.length("pincode") == 6) & F.col("latitude").between(south, north) & F.col("longitude").between(west, east))
    return rows.groupBy("pincode").agg(F.max_by(F.struct("latitude", "longitude", "district", "state"), "line").alias("c")).select("pincode", "c.*")


def located(rows: DataFrame, places: DataFrame, pin: str = "pincode") -> DataFrame:
    """``rows`` with latitude, longitude and geo_precision of their PIN code, null where it is not known."""
    p = places.select(F.col("pincode").alias("p"), "latitude", "longitude")
    out = rows.join(p, F.regexp_replace(F.col(pin), r"\D", "") == F.col("p"), "left")
    return out.withColumn("geo_precision", F.when(F.col("p").isNotNull(), "pin_centroid")).drop("p")


def homepage(site: Column) -> Column:
    """An address to be visited: a scheme without slashes goes, a missing one is https, slashes at the end go."""
    bare = F.regexp_replace(F.trim(site), r"(?i)^https?:(?!//)", "")
    whole = F.when(F.lower(bare).rlike("^https?://"), bare).otherwise(F.concat(F.lit("https://"), bare))
    return F.when(F.trim(site) != "", F.regexp_replace(whole, "/+$", ""))
