"""Stored web pages as tables: rows of cells, links, and what kind of page or table it is."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from html.parser import HTMLParser
from urllib.parse import urljoin

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from claimspark.functions.identity import squash

# Fixed values.
INTERSTITIAL_MARKERS = [
    "User validation required", "captcha_resp", "<title>Validation request</title>", "Checking your browser before accessing",
    "cf-browser-verification", "Just a moment...", "_cf_chl_opt",
]
DISCLOSURE = r"mandator|disclosur|appendix.?ix|public.?disclos"
PAGE_MARKERS = [r"fee", r"student\s*strength|class\s*wise|no\.?\s*of\s*students|enrol", r"affiliation", r"trust|society"]
LOGIN_WALL = r"(?:parent|student|staff)\s*(?:login|portal)|sign\s*in|username.{0,40}password"
RESULT_COLUMN = r"\b(roll|marks|percentage|percent|rank|grade|cgpa|score)\b"
NAME_COLUMN = r"\b(name|student|candidate)\b"

DROPPED = {"script", "style", "nav", "footer"}


def is_interstitial(body: Column, mitigated: Column | None = None) -> Column:
    """A bot check in place of a page: stated by the header, or a marker in the first 4096 characters."""
    head, hit = F.substring(F.coalesce(body, F.lit("")), 1, 4096), F.lit(False)
    for m in INTERSTITIAL_MARKERS:
        hit = hit | F.contains(head, F.lit(m))
    return hit if mitigated is None else hit | F.coalesce(mitigated != "", F.lit(False))


def is_disclosure_page(text: Column, least: int = 2) -> Column:
    return sum((text.rlike(f"(?i){m}").cast("int") for m in PAGE_MARKERS), F.lit(0)) >= least


def is_login_wall(text: Column) -> Column:
    return text.rlike(f"(?i){LOGIN_WALL}") & ~is_disclosure_page(text)


class _Reader(HTMLParser):
    """Tables (outside menus and scripts) of rows of cells, and links, of one page in document order. Markup that is never closed ends with its parent."""

    def __init__(self) -> None:
        super().__init__()
        self.rows: list[tuple[int, int, list[str]]] = []
        self.links: list[tuple[str, str]] = []
        self.skip, self.tables, self.open_tables, self.cell, self.href = 0, 0, [], None, None

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag in DROPPED:
            self.skip += 1
        elif tag == "a" and (href := dict(attrs).get("href")) is not None:  # menus have links that count
            self.href = (href, [])
        elif self.skip:
            return
        elif tag == "table":
            self.open_tables.append([self.tables, -1])
            self.tables += 1
        elif tag == "tr" and self.open_tables:
            self.open_tables[-1][1] += 1
            self.rows.append((*self.open_tables[-1], []))
            self.cell = None
        elif tag in ("td", "th") and self.rows and self.open_tables:
            self.cell = []
            self.rows[-1][2].append(self.cell)

    def handle_endtag(self, tag: str) -> None:
        if tag in DROPPED:
            self.skip = max(0, self.skip - 1)
        elif tag in ("td", "th", "tr"):
            self.cell = None
        elif tag == "table" and self.open_tables:
            self.open_tables.pop()
            self.cell = None
        elif tag == "a" and self.href:
            self.links.append((self.href[0], " ".join(self.href[1])))
            self.href = None

    def handle_data(self, data: str) -> None:
        text = " ".join(data.split())
        if text and self.href:
            self.href[1].append(text)
        if text and not self.skip and self.cell is not None:
            self.cell.append(text)


def _read(html: str | None) -> _Reader:
    reader = _Reader()
    reader.feed(html or "")
    reader.close()
    return reader


def by_page(pages: DataFrame, read: Callable[..., Iterable[tuple]], schema: str, chunk: int = 1 << 20) -> DataFrame:
    """The rows that ``read`` makes of each page, called with its columns. Pages of a batch become Python texts one at a time, and rows are
    handed on after ``chunk`` characters or so, so what a worker holds beside the batch doesn't grow with the pages or their rows."""
    from pyspark.sql.pandas.types import to_arrow_schema

    made = to_arrow_schema(pages.sparkSession.createDataFrame([], schema).schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows, size = [], 0
            for i in range(b.num_rows):
                for row in read(*(c[i].as_py() for c in b.columns)):
                    rows.append(row)
                    size += 64 + sum(len(x) for x in row if isinstance(x, str))
                    if size >= chunk:
                        yield packed(rows)
                        rows, size = [], 0
            if rows:
                yield packed(rows)

    def packed(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), made, strict=True)], schema=made)

    return pages.mapInArrow(run, schema)


def html_tables(pages: DataFrame, key: str, html: str) -> DataFrame:
    """(key, table_ix, row_ix, cells) of every row of every table; one pass. A page without tables has no rows."""
    kind = pages.schema[key].dataType.simpleString()

    def rows(k: object, h: str | None) -> Iterator[tuple]:
        return ((k, t, r, [" ".join(c) for c in cells]) for t, r, cells in _read(h).rows)

    return by_page(pages.select(F.col(key).alias("k"), F.col(html).alias("h")), rows, f"k {kind}, table_ix int, row_ix int, cells array<string>").withColumnRenamed("k", key)


def html_links(pages: DataFrame, key: str, html: str, base: str) -> DataFrame:
    """(key, url, label) of every anchor, made absolute against the ``base`` column."""
    kind = pages.schema[key].dataType.simpleString()

    def links(k: object, h: str | None, at: str | None) -> Iterator[tuple]:
        for href, label in _read(h).links:
            try:
                yield k, urljoin(f"{at or ''}/", href), href, label
            except ValueError:  # no address at all, such as an unclosed [
                continue

    out = by_page(pages.select(F.col(key).alias("k"), F.col(html).alias("h"), F.col(base).alias("b")), links, f"k {kind}, url string, href string, label string")
    return out.withColumnRenamed("k", key)


def disclosure_links(links: DataFrame, key: str, pattern: str = DISCLOSURE) -> DataFrame:
    """(key, url, place): distinct links whose address or label matches, PDF files first, then the shortest."""
    from pyspark.sql import Window

    hit = F.col("href").rlike(f"(?i){pattern}") | F.col("label").rlike(f"(?i){pattern}")
    kept = links.where(hit & F.col("url").rlike("^https?://")).select(key, "url").distinct()
    order = Window.partitionBy(key).orderBy(F.lower("url").endswith(".pdf").desc(), F.length("url"), "url")
    return kept.withColumn("place", F.row_number().over(order))


def has_label(cell: Column, aliases: list[str]) -> Column:
    """Whether the cell holds an alias; white space counts on neither side."""
    text, hit = squash(cell), F.lit(False)
    for a in aliases:
        hit = hit | F.contains(text, F.lit("".join(a.lower().split())))
    return hit


def table_kinds(rows: DataFrame, key: str, fee: list[str], result: list[str]) -> DataFrame:
    """(key, table_ix, is_fee, is_result, student_data) of each table: a fee label in its first 12 rows, a result label in
    the first 4, a header in the first 6 that pairs a name with a result column. One aggregation."""
    any_ = lambda test: F.exists("cells", test)
    paired = (F.size("cells") >= 2) & any_(lambda c: c.rlike(f"(?i){NAME_COLUMN}")) & any_(lambda c: c.rlike(f"(?i){RESULT_COLUMN}"))
    return rows.groupBy(key, "table_ix").agg(
        F.max((F.col("row_ix") < 12) & any_(lambda c: has_label(c, fee))).alias("is_fee"),
        F.max((F.col("row_ix") < 4) & any_(lambda c: has_label(c, result))).alias("is_result"),
        F.max((F.col("row_ix") < 6) & paired).alias("student_data"),
    )


def labelled_value(rows: DataFrame, key: str, aliases: list[str]) -> DataFrame:
    """(key, value, evidence): the last cell of the first row whose label matches; a leading serial number is no label."""
    full = F.filter("cells", lambda c: c != "")
    cells = rows.where(F.size("cells") >= 2).select(key, "table_ix", "row_ix", full.alias("full")).where(F.size("full") > 0)
    serial = F.element_at("full", 1).rlike(r"^\s*\d+\.*\s*$") & (F.size("full") > 2)
    label, value = F.when(serial, F.try_element_at("full", F.lit(2))).otherwise(F.element_at("full", 1)), F.trim(F.element_at("full", -1))
    hits = cells.where(has_label(label, aliases) & (value != "") & (value != label))
    found = F.struct(value.alias("value"), F.substring(F.array_join("full", " "), 1, 400).alias("evidence"))
    return hits.groupBy(key).agg(F.min_by(found, F.struct("table_ix", "row_ix")).alias("f")).select(key, "f.*")
