"""Column functions on who and where: persons, titles, domains, years, map places, agreement of values."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from claimspark import config
from claimspark.functions.text import basic, empty_to_null

HONORIFICS, PLATFORM_TOKENS, TWO_LABEL_SUFFIXES = config.words("honorific"), config.words("platform"), config.words("suffix")
TITLES: dict[str, list[str]] = {}
for _alias, _role in config.pairs("title").items():
    TITLES.setdefault(_role, []).append(_alias)
# Fixed values.
SECOND_LEVEL = ["co", "ac", "edu", "gov", "net", "org", "res", "nic", "com"]
LAT_RANGE, LON_RANGE, CANVAS = (6.0, 37.5), (68.0, 97.5), (760, 820)
STUDENTS_PER_TEACHER, TEACHERS = 25, (3, 500)
FEE_YEAR = r"(20\d{2})\s*[-/]\s*(?:20)?\d{2}\b"


def normalize_person(name: Column) -> Column:
    """Without honorifics; null if nothing is left."""
    return empty_to_null(F.array_join(F.filter(F.split(basic(name), " "), lambda t: (t != "") & ~t.isin(*HONORIFICS)), " "))


def normalize_title(raw: Column) -> Column:
    """The role whose alias, the longest first, stands in the text as whole words; ``other`` if none does."""
    text, out = basic(raw), F.lit("other")
    ranked = sorted(((alias, role) for role, aliases in TITLES.items() for alias in aliases), key=lambda x: -len(x[0]))
    for alias, role in reversed(ranked):
        out = F.when(text.rlike(rf"\b{alias}\b"), role).otherwise(out)
    return out


def _labels(host: Column) -> Column:
    return F.filter(F.split(host, r"\."), lambda x: x != "")


def _own_label(labels: Column, two: Column) -> Column:
    """Where the name that was registered stands, from the end: before a suffix of two labels, of one, or alone."""
    n = F.size(labels)
    return F.when((n >= 3) & F.coalesce(two, F.lit(False)), -3).when(n >= 2, -2).otherwise(-1)


def registrable_domain(url: Column) -> Column:
    """Last two labels of the host, three where the second last is a common second-level suffix."""
    host = F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))
    labels = F.split(host, r"\.")
    at = _own_label(labels, F.try_element_at(labels, F.lit(-2)).isin(*SECOND_LEVEL))
    return F.array_join(F.slice(labels, at, F.lit(3)), ".")


def registrable_token(website: Column) -> Column:
    """An institution's own name in its domain; null where that is short, a number or a platform's. An address in place of a domain
    has the name before its @."""
    typed = F.regexp_extract(F.lower(F.trim(website)), r"^(?:https?:)?(?://)?(?:www\.)?([^/?#@]*)", 1)
    labels = _labels(typed)
    own = F.try_element_at(labels, _own_label(labels, F.array_join(F.slice(labels, -2, 2), ".").isin(*TWO_LABEL_SUFFIXES)))
    token = F.regexp_replace(own, "[^a-z0-9]", "")
    return F.when((F.length(token) >= 4) & ~token.isin(*PLATFORM_TOKENS) & ~token.rlike("^[0-9]+$"), token)


def squash(text: Column) -> Column:
    return F.lower(F.regexp_replace(text, r"\s+", ""))


def fee_year(text: Column) -> Column:
    """First year of a span such as 2024-25; a year alone is ambiguous and gives null."""
    return F.regexp_extract(text, FEE_YEAR, 1).try_cast("int")


def pin_near(text: Column) -> Column:
    """A six-digit PIN beside the word."""
    return empty_to_null(F.regexp_extract(text, r"(?i)pin\s*(?:code)?\s*[:\-]?\s*([1-9]\d{5})\b", 1))


def estimated_enrollment(teachers: Column) -> Column:
    return F.when(teachers.between(*TEACHERS), teachers * STUDENTS_PER_TEACHER)


def values_agree(expected: Column, actual: Column, tolerance: float | None = None) -> Column:
    """Equal but for case and outer blanks, or, with a tolerance, numbers that far apart at most; null never agrees."""
    if tolerance is None:
        same = F.lower(F.trim(expected.cast("string"))) == F.lower(F.trim(actual.cast("string")))
    else:
        e, a = (F.regexp_replace(c.cast("string"), ",", "").try_cast("double") for c in (expected, actual))
        same = F.when(e == 0, a == 0).otherwise(F.abs(a - e) / F.abs(e) <= tolerance)
    return F.coalesce(same, F.lit(False))


def map_point(lat: Column, lon: Column) -> Column:
    """struct(x, y) on the canvas, equirectangular, to a tenth, halves to the even one."""
    x = (lon - LON_RANGE[0]) / (LON_RANGE[1] - LON_RANGE[0]) * CANVAS[0]
    y = (LAT_RANGE[1] - lat) / (LAT_RANGE[1] - LAT_RANGE[0]) * CANVAS[1]
    return F.struct(F.bround(x, 1).alias("x"), F.bround(y, 1).alias("y"))


def bubble_radius(total: Column, largest: Column) -> Column:
    """Area in proportion to ``total``."""
    return F.when((total > 0) & (largest > 0), F.bround(6 + 34 * F.sqrt(total / largest), 1)).otherwise(4.0)
