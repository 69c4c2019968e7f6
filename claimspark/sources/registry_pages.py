"""The pages of two registries as tables: lists in two layouts, detail pages, cards; what a page says it holds; claims out of them.

Python only reads markup, as table functions joined laterally: a page gives rows of cells, or cards of parts. Which layout
a row has, what its fields are and what is left out is said in native expressions over these.

Null and empty pages give no rows and no totals. A row or card that cannot be one institution's is kept, marked
``skipped``, so that parsed and skipped rows can be held against what the page states.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import udtf

from claimspark.functions.text import empty_to_null
from claimspark.operators.discovery import page_text
from claimspark.operators.registry_rows import parse_address, row_count_guard, split_labelled

# The level that has a class 12, what detail pages call their fields, what is left out of them, and the words of cards.
SENIOR = "Senior Secondary Level"
DETAIL_FIELDS = {
    "name of institution": "name", "state": "state", "district": "district", "postal address": "address", "pin code": "pincode", "website": "website",
    "year of foundation": "year_founded", "name of principal/ head of institution": "principal_name", "status of the school": "grade_high", "school type": "residential",
    "name of trust/ society/ managing committee": "legal_entity_name",
}
BANNER = r"Total No\.? of Schools affiliated with CBSE"
NO_SITE = ("na", "n/a", "nil", "-")
GENDERS = ("Boys", "Girls", "Co-ed.")
KINDS = ("Day/Residential", "Day/Boarding", "Residential", "Day")
BADGES = ("ICSE", "ISC", "CVE")
CLASS_12_BADGE = "ISC"
CARD_HEAD = r"(?s)^\s*([A-Z]{2,3}\d+)\s*-\s*(.+)$"
VOID = {"br", "img", "input", "hr", "link", "meta", "col", "wbr"}


class _Elements(HTMLParser):
    """Texts of a page with the elements that they stand in: open ones as (tag, classes, number)."""

    def __init__(self) -> None:
        super().__init__()
        self.open: list[tuple[str, frozenset[str], int]] = []
        self.made = 0

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag in ("tr", "td", "th"):  # those before need not be closed
            self.close_to({"tr": ("tr",), "td": ("td", "th"), "th": ("td", "th")}[tag], ("table",))
        self.made += 1
        found = dict(attrs)
        if tag not in VOID:
            self.open.append((tag, frozenset((found.get("class") or "").split()), self.made))
        self.began(tag, found)

    def began(self, tag: str, found: dict) -> None:
        """An element was opened."""

    def close_to(self, tags: tuple[str, ...], within: tuple[str, ...] = ()) -> None:
        for i in range(len(self.open) - 1, -1, -1):
            if self.open[i][0] in tags:
                del self.open[i:]
                return
            if self.open[i][0] in within:
                return

    def handle_endtag(self, tag: str) -> None:
        if any(t == tag for t, _, _ in self.open):
            self.close_to((tag,))


class _Rows(_Elements):
    def __init__(self) -> None:
        super().__init__()
        self.rows: list[list[list[str]]] = []
        self.cell: dict[int, list[str]] = {}

    def began(self, tag: str, found: dict) -> None:
        if tag == "tr":
            self.rows.append([])
        elif tag in ("td", "th") and self.rows:
            self.rows[-1].append([])
            self.cell[self.made] = self.rows[-1][-1]

    def handle_data(self, data: str) -> None:
        text = " ".join(data.split())
        if text and not any(t in ("script", "style") for t, _, _ in self.open):
            for _, _, n in self.open:
                if n in self.cell:
                    self.cell[n].append(text)


class _Cards(_Elements):
    def __init__(self) -> None:
        super().__init__()
        self.cards: list[dict] = []

    def part(self) -> tuple[dict | None, list[tuple[str, frozenset[str], int]]]:
        """The card that is open and the elements open inside of it."""
        at = next((i for i, (_, c, _) in enumerate(self.open) if "school-card" in c), None)
        return (None, []) if at is None or not self.cards else (self.cards[-1], self.open[at + 1 :])

    def began(self, tag: str, found: dict) -> None:
        if "school-card" in (found.get("class") or "").split() and sum("school-card" in c for _, c, _ in self.open) == 1:
            self.cards.append({"head": [], "heads": set(), "badges": {}, "signs": {}, "lines": [[]], "body": None, "href": None, "text": []})
        card, inside = self.part()
        if card is None:
            return
        if tag == "br" and any(t == "p" for t, _, _ in inside):
            card["lines"].append([])
        if tag == "a" and found.get("href") is not None and card["href"] is None and any("text-end" in c for _, c, _ in inside):
            card["href"] = found["href"]

    def handle_data(self, data: str) -> None:
        card, inside = self.part()
        text = " ".join(data.split())
        if card is None or not text:
            return
        card["text"].append(text)
        first = lambda tag: next((n for t, _, n in inside if t == tag), None)
        if (n := first("h6")) is not None and (not card["heads"] or n in card["heads"]):
            card["heads"].add(n)
            card["head"].append(text)
        if (n := first("p")) is not None and card["body"] in (None, n):
            card["body"] = n
            card["lines"][-1].append(text)
        if (n := first("span")) is not None:
            for kind, name in (("top-right-badges", "signs"), ("school-badges", "badges")):
                if any(kind in c for _, c, _ in inside):
                    card[name].setdefault(n, []).append(text)


@udtf(returnType="row_ix int, cells array<string>")
class TableRows:
    """The table rows of a page in order, each as the texts of its cells."""

    def eval(self, html: str) -> Iterator[tuple]:
        reader = _Rows()
        reader.feed(html or "")
        reader.close()
        for i, cells in enumerate(reader.rows):
            yield i, [" ".join(c) for c in cells]


@udtf(returnType="card_ix int, head string, signs array<string>, badges array<string>, lines array<string>, href string, text string")
class Cards:
    """The cards of a page in order, each as its parts."""

    def eval(self, html: str) -> Iterator[tuple]:
        reader = _Cards()
        reader.feed(html or "")
        reader.close()
        for i, c in enumerate(reader.cards):
            lines = [x for x in (re.sub(r"\s+", " ", " ".join(line)).strip().strip(",") for line in c["lines"]) if x]
            yield i, " ".join(c["head"]) if c["heads"] else None, [" ".join(x) for x in c["signs"].values()], [" ".join(x) for x in c["badges"].values()], lines, c["href"], " ".join(c["text"])


def _squeezed(text: Column) -> Column:
    return empty_to_null(F.trim(F.regexp_replace(text, r"\s+", " ")))


def _cell(i: int) -> Column:
    return F.try_element_at("cells", F.lit(i))


def list_rows(pages: DataFrame, key: str, html: str) -> DataFrame:
    """(key, row_ix, layout, skipped, excerpt, fields …) of every row of a list page that has a layout. ``state_wise`` rows say their
    affiliation number by label, ``closed`` ones have nine cells or more; the affiliation number must be one, and ``state_wise`` rows need a name."""
    rows = pages.select(F.col(key).alias("key"), F.col(html).alias("html")).lateralJoin(TableRows(F.col("html").outer())).select("key", "row_ix", "cells")
    header = F.contains(_cell(1), F.lit("S No")) | F.lower(F.trim(_cell(1))).isin("s no", "sno", "s.no")
    joined = F.array_join("cells", " | ")
    layout = F.when(F.contains(joined, F.lit("Aff. No.")), "state_wise").when(F.size("cells") >= 9, "closed")
    rows = rows.where((F.size("cells") >= 6) & ~header).select("key", "row_ix", "cells", layout.alias("layout"), F.substring(joined, 1, 120).alias("excerpt")).where("layout IS NOT NULL")
    part = lambda cell, labels, name: F.try_element_at(split_labelled(_cell(cell), labels), F.lit(name))
    ids, geo, school, contact = (2, ("Aff. No.", "Sch. Code")), (3, ("State", "District")), (5, ("Name", "Head/Principal Name")), (6, ("Address", "Website"))
    of = lambda by_label, cell: F.when(F.col("layout") == "state_wise", part(*by_label[0], by_label[1]) if by_label else None).otherwise(_squeezed(_cell(cell)) if cell else None)
    fields = {
        "affiliation_no": of((ids, "Aff. No."), 2), "school_code": of((ids, "Sch. Code"), 0), "name": of((school, "Name"), 6), "state": of((geo, "State"), 3), "district": of((geo, "District"), 4),
        "status": F.when(F.col("layout") == "state_wise", _squeezed(_cell(4))).otherwise(_squeezed(_cell(5))), "principal_name": of((school, "Head/Principal Name"), 0),
        "address": of((contact, "Address"), 0), "website": of((contact, "Website"), 0), "affiliation_status": of(None, 7), "region": of(None, 8),
    }
    out = rows.select("key", "row_ix", "layout", "excerpt", *[c.cast("string").alias(n) for n, c in fields.items()])
    good = F.coalesce(F.col("affiliation_no").rlike(r"^\d+$") & ((F.col("layout") == "closed") | F.col("name").isNotNull()), F.lit(False))
    site = F.when(F.contains("website", F.lit(".")) & ~F.lower("website").isin(*NO_SITE), F.col("website"))
    return out.withColumns({"skipped": ~good, "website": site, "has_class_12": F.coalesce(F.col("status") == SENIOR, F.lit(False))}).withColumnRenamed("key", key)


def stated_total(html: Column) -> Column:
    """How many rows a list page says it has: the last count that is not the banner's, whatever its label; the banner's where there is no other."""
    found = lambda group: F.regexp_extract_all(html, F.lit(r"(?i)(Total No[^0-9]{0,120}?)(\d[\d,]*)"), F.lit(group))
    pairs = F.arrays_zip(found(1).alias("label"), found(2).alias("n"))
    own = F.filter(pairs, lambda p: ~p["label"].rlike(f"(?i){BANNER}"))
    return F.regexp_replace(F.coalesce(F.try_element_at(own, F.lit(-1))["n"], F.try_element_at(pairs, F.lit(-1))["n"]), ",", "").try_cast("int")


def card_total(html: Column) -> Column:
    """The whole result of which a page of cards shows some."""
    return F.regexp_replace(F.coalesce(empty_to_null(F.regexp_extract(html, r"(?i)of\s*<[^>]*>\s*([\d,]+)", 1)), empty_to_null(F.regexp_extract(html, r"(?i)of\s+([\d,]+)\s+entries", 1))), ",", "").try_cast("int")


def totals(pages: DataFrame, rows: DataFrame, key: str, stated: Column) -> DataFrame:
    """(key, parsed, skipped, stated) of every page, those without rows too."""
    n = rows.groupBy(key).agg(F.count_if(~F.col("skipped")).alias("parsed"), F.count_if("skipped").alias("skipped"))
    return pages.select(key, stated.alias("stated")).join(n, key, "left").select(key, *[F.coalesce(c, F.lit(0)).alias(c) for c in ("parsed", "skipped")], "stated")


def guarded_totals(pages: DataFrame, key: str, html: str) -> DataFrame:
    """``totals`` of list pages, or an error where one does not add up; pages that state nothing raise as well."""
    counts = totals(pages, list_rows(pages, key, html), key, stated_total(F.col(html)))
    return row_count_guard(counts.withColumn("stated", F.coalesce("stated", F.lit(-1))), key, "parsed", "skipped", "stated")


def cards(pages: DataFrame, key: str, html: str) -> DataFrame:
    """(key, card_ix, code, name, affiliations, principal_name, address, district, state, pincode, country, gender, residential, website, has_class_12,
    skipped, excerpt) of every card."""
    parts = pages.select(F.col(key).alias("key"), F.col(html).alias("html")).lateralJoin(Cards(F.col("html").outer())).drop("html")
    line = lambda n: F.try_element_at("lines", F.lit(n))
    place = parse_address(F.array_join(F.slice("lines", 2, 1_000_000), " "))
    last = lambda words: F.try_element_at(F.filter("signs", lambda s: s.isin(*words)), F.lit(-1))
    out = parts.select(
        "key", "card_ix", empty_to_null(F.regexp_extract("head", CARD_HEAD, 1)).alias("code"), _squeezed(F.regexp_extract("head", CARD_HEAD, 2)).alias("name"),
        F.filter("badges", lambda b: b.isin(*BADGES)).alias("affiliations"), line(1).alias("principal_name"), place.alias("at"), last(GENDERS).alias("gender"), last(KINDS).alias("residential"),
        _squeezed(F.col("href")).alias("website"), F.substring("text", 1, 120).alias("excerpt"),
    )
    out = out.select("key", "card_ix", "code", "name", "affiliations", "principal_name", "at.address", "at.district", "at.state", "at.pincode", "at.country", "gender", "residential", "website", "excerpt")
    return out.withColumns({"skipped": F.col("code").isNull() | F.col("name").isNull(), "has_class_12": F.array_contains("affiliations", CLASS_12_BADGE)}).withColumnRenamed("key", key)


def detail_claims(pages: DataFrame, key: str, html: str) -> DataFrame:
    """(key, field, value, evidence) of detail pages: by the label in a row's first cell; of a label that comes again the last counts."""
    rows = pages.select(F.col(key).alias("key"), F.col(html).alias("html")).lateralJoin(TableRows(F.col("html").outer())).select("key", "row_ix", "cells")
    label, value = F.trim(F.rtrim(F.lower(F.trim(_cell(1))), F.lit(":"))), _squeezed(_cell(2))
    known = rows.where((F.size("cells") >= 2) & value.isNotNull()).select("key", "row_ix", label.alias("label"), value.alias("value"), F.trim(_cell(1)).alias("shown"))
    names = F.create_map(*[F.lit(x) for kv in DETAIL_FIELDS.items() for x in kv])
    known = known.withColumn("field", F.element_at(names, F.col("label"))).where("field IS NOT NULL").groupBy("key", "field").agg(F.max_by(F.struct("value", "shown"), "row_ix").alias("x"))
    of = lambda field, value, evidence: F.struct(field.alias("field"), value.alias("value"), evidence.alias("evidence"))
    own = of(F.col("field"), F.col("x.value"), F.concat_ws(": ", "x.shown", "x.value"))
    gate = of(F.lit("has_class_12"), F.when(F.col("x.value") == SENIOR, "true").otherwise("false"), F.concat(F.lit("Status of the School: "), "x.value"))
    said = F.explode(F.when(F.col("field") == "grade_high", F.array(own, gate)).otherwise(F.array(own)))  # both of one reading of the page
    own = known.select("key", said.alias("c")).select("key", "c.*")
    period = r"(?i)From\s*:?\s*(\d{2}/\d{2}/\d{4})\s*To\s*:?\s*(\d{2}/\d{2}/\d{4})"
    text = page_text(F.col(html))
    dates = pages.select(F.col(key).alias("key"), empty_to_null(F.regexp_extract(text, period, 1)).alias("start"), F.regexp_extract(text, period, 2).alias("end")).where("start IS NOT NULL")
    stated = F.concat(F.lit("Affiliation Period: From "), "start", F.lit(" To "), "end")
    pair = F.explode(F.array(F.struct(F.lit("board_valid_from").alias("field"), F.col("start").alias("value")), F.struct(F.lit("board_valid_to").alias("field"), F.col("end").alias("value"))))
    dates = dates.select("key", pair.alias("p"), stated.alias("evidence")).select("key", "p.field", "p.value", "evidence")
    return own.unionByName(dates).withColumnRenamed("key", key)


def _claims(rows: DataFrame, entity: Column, said: list[tuple[str, Column, Column]]) -> DataFrame:
    pairs = F.array(*[F.struct(F.lit(f).alias("field"), v.cast("string").alias("value"), e.alias("evidence")) for f, v, e in said])
    return rows.where("NOT skipped").select(entity.alias("entity_key"), F.explode(pairs).alias("c")).select("entity_key", "c.*").where("value IS NOT NULL AND value <> ''")


def list_claims(rows: DataFrame) -> DataFrame:
    """(entity_key, field, value, evidence): a claim for each field that a list row has. Only a closed list says that one is gone."""
    text = lambda label, c: F.concat(F.lit(f"{label}: "), c)
    said = [(f, F.col(f), text(label, F.col(f))) for f, label in (("name", "Name"), ("state", "State"), ("district", "District"), ("address", "Address"), ("website", "Website"), ("principal_name", "Head/Principal Name"))]
    status, gone = text("Status", F.col("status")), F.lower("affiliation_status").contains("disaffiliat")
    said += [("grade_high", F.col("status"), status), ("has_class_12", F.when(F.col("status").isNotNull(), F.col("has_class_12").cast("string")), status)]
    said += [("status", F.when(gone, "disaffiliated"), text("Affiliation Status", F.col("affiliation_status")))]
    return _claims(rows, F.concat(F.lit("cbse:"), "affiliation_no"), said)


def card_claims(rows: DataFrame) -> DataFrame:
    """(entity_key, field, value, evidence) of cards; the class 12 gate is told by one badge alone."""
    text = lambda label, c: F.concat(F.lit(f"{label}: "), c)
    named = [("name", "Name"), ("state", "State"), ("district", "District"), ("address", "Address"), ("pincode", "Pin Code"), ("website", "Website"), ("principal_name", "Principal"), ("gender", "School Type"), ("residential", "School Classification")]
    said = [(f, F.col(f), text(label, F.col(f))) for f, label in named]
    badges, some = text("Affiliation", F.array_join("affiliations", ", ")), F.size("affiliations") > 0
    said += [("has_class_12", F.when(some, F.col("has_class_12").cast("string")), badges), ("grade_high", F.when(some & F.col("has_class_12"), "12"), badges)]
    return _claims(rows, F.concat(F.lit("cisce:"), "code"), said)
