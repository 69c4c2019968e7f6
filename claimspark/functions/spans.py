"""Where a value stands in a text: names after a label with their offsets and evidence; addresses in their normal form."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from claimspark.functions.identity import normalize_person

# What a head is called, what follows such a word where no name does, what a name looks like, and how far it may be.
HEAD_LABEL = r"(?:principal|head\s*of\s*(?:the\s*)?(?:school|institution)|head\s*master|headmistress)\s*[:\-–]?\s*"
NO_NAME = r"^\W*(?:qualification|experience|signature|photo|contact|email|mobile|phone|desk|message|welcome|speak|corner|note|address|profile|blog|column|name\s*of\s*the\s*school|s\s*desk)"
NAME = r"[A-Z][A-Za-z.'\-]{1,20}(?:\s+[A-Z][A-Za-z.'\-]{1,20}){1,4}"
REACH, AROUND = 120, 60
# Characters that stay as they are beside letters, digits and _.-~, by part of an address.
SAFE_IN_PATH, SAFE_IN_QUERY = "/%:@", "=&%?+"


def name_after_label(text: Column, label: str = HEAD_LABEL, no_name: str = NO_NAME) -> Column:
    """struct(name, given, start, evidence) of the name that follows the first label; null if none does.

    ``given`` stands in the text from ``start`` on (characters, from 0), ``name`` is its normal form, ``evidence`` is cut around it at the same
    offsets. A label that is followed by one of ``no_name`` decides: no later one is looked at, as no name is better than a wrong one."""
    met = F.regexp_extract(text, rf"(?isU)(?:{label}).{{0,{REACH}}}", 0)  # found from left to right once; what follows looks at these few characters alone
    part = lambda i: F.regexp_extract(met, rf"(?isU)^({label})(.{{0,{REACH}}})", i)
    near = rf"(?sU)^(.*?)({NAME})"
    before, given = F.regexp_extract(part(2), near, 1), F.regexp_extract(part(2), near, 2)
    start = F.instr(text, met) - 1 + F.char_length(part(1)) + F.char_length(before)  # no label begins before it, so neither does its text
    low = F.greatest(start - AROUND, F.lit(0))
    window = F.substring(text, low + 1, start - low + F.char_length(given) + AROUND)
    evidence = F.trim(F.regexp_replace(window, r"(?U)\s+", " "))
    found = F.struct(normalize_person(given).alias("name"), given.alias("given"), start.alias("start"), evidence.alias("evidence"))
    return F.when((part(1) != "") & (given != "") & ~part(2).rlike(f"(?iU){no_name}") & normalize_person(given).isNotNull(), found)


def percent_encoded(text: Column, safe: str) -> Column:
    """Bytes of UTF-8 as %XX, but for letters, digits, _.-~ and ``safe``."""
    kept = F.lit("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789_.-~" + safe)
    one = lambda c: F.when(F.contains(kept, c), c).otherwise(F.regexp_replace(F.hex(F.encode(c, "UTF-8")), "(..)", r"%$1"))
    return F.array_join(F.transform(F.split(text, ""), one), "")


def normal_url(url: Column) -> Column:
    """An address that can be asked for: scheme in lower case, path and query encoded but for what is encoded already, no fragment, no
    empty query. Blanks before it, and tabs and ends of lines within, go. Null stays null."""
    plain = F.regexp_replace(F.regexp_replace(url, "^[\\x00-\\x20]+", ""), "[\\t\\r\\n]", "")
    parts = r"(?s)^(?:([A-Za-z][A-Za-z0-9+.\-]*):)?(//[^/?#]*)?([^?#]*)(?:\?([^#]*))?"
    scheme, host, path, query = (F.regexp_extract(plain, parts, i) for i in (1, 2, 3, 4))
    return F.concat(
        F.when(scheme != "", F.concat(F.lower(scheme), F.lit(":"))).otherwise(""), host, percent_encoded(path, SAFE_IN_PATH), F.when(query != "", F.concat(F.lit("?"), percent_encoded(query, SAFE_IN_QUERY))).otherwise(""),
    )
