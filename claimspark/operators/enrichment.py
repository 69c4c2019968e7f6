"""What visits bring: reasons to stay away, tiers of what was read, claims out of it, cases for people, repairs of stamps, a report."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from claimspark.functions.text import denied_by, emails
from claimspark.operators.served import website_twins

# Addresses of those who made a site, what classes are called, and what a sum read from a picture may be.
NOT_THEIRS = r"@(?:example|test|localhost|sentry|wordpress|wixpress|godaddy|cloudflare|gmail\.example)|webmaster@|postmaster@|noreply@|no-reply@"
STREAMS = {
    "PCM": r"\bPCM\b|\bphysics\W{0,3}chemistry\W{0,3}math", "PCB": r"\bPCB\b|\bphysics\W{0,3}chemistry\W{0,3}bio", "PCMB": r"\bPCMB\b",
    "Commerce": r"\bcommerce\b", "Arts": r"\barts\b|\bhumanities\b",
}


def blocked_reason(rows: DataFrame, url: str, learned: DataFrame) -> DataFrame:
    """``reason``: the pattern that a url holds, else that it was learned to be one to stay away from, else null."""
    known = learned.select(F.col("url").alias("known_url")).distinct()
    out = rows.join(known, F.col(url) == F.col("known_url"), "left")
    static = F.concat(F.lit("pattern:"), denied_by(F.col(url)))
    return out.withColumn("reason", F.coalesce(static, F.when(F.col("known_url").isNotNull(), "learned:student_data_detected"))).drop("known_url")


def first_email(text: Column) -> Column:
    return F.try_element_at(F.filter(emails(text), lambda x: ~x.rlike(f"(?i){NOT_THEIRS}")), F.lit(1))


def streams(text: Column) -> Column:
    found = F.array_compact(F.array(*[F.when(text.rlike(f"(?i){p}"), F.lit(n)) for n, p in STREAMS.items()]))
    return F.when(F.size(found) > 0, found)


def window(text: Column, found: Column, around: int = 60) -> Column:
    """The text around what was found in it."""
    at = F.instr(text, found)
    return F.when(at > 0, F.substr(text, F.greatest(at - around, F.lit(1)), F.length(found) + F.least(at - 1, F.lit(around)) + around))


def storage_path(digest: Column) -> Column:
    """Two levels of folders by the first letters of a digest."""
    return F.concat_ws("/", F.substring(digest, 1, 2), F.substring(digest, 3, 2), digest)


def by_tiers(tiers: Sequence[DataFrame], names: Sequence[str], key: str, fields: Sequence[str]) -> DataFrame:
    """Each field from the first tier that has it, and which one that was as ``<field>_tier``; a later tier fills gaps alone."""
    sides = [t.select(key, *[F.col(f).alias(f"{f}__{i}") for f in fields]) for i, t in enumerate(tiers)]
    out = sides[0]
    for s in sides[1:]:
        out = out.join(s, key, "full_outer")
    pick = lambda f: F.coalesce(*[F.col(f"{f}__{i}") for i in range(len(tiers))])
    tier = lambda f: F.coalesce(*[F.when(F.col(f"{f}__{i}").isNotNull(), F.lit(n)) for i, n in enumerate(names)])
    return out.select(key, *[c for f in fields for c in (pick(f).alias(f), tier(f).alias(f"{f}_tier"))])


def to_claims(rows: DataFrame, key: str, fields: Sequence[str]) -> DataFrame:
    """(key, field, value): one claim for each field that holds something; lists joined by commas."""
    kinds = dict(rows.dtypes)
    text = lambda f: F.array_join(f, ",") if kinds[f].startswith("array") else F.col(f).cast("string")
    pairs = F.array(*[F.struct(F.lit(f).alias("field"), text(f).alias("value")) for f in fields])
    return rows.select(key, F.explode(pairs).alias("c")).select(key, "c.*").where("value IS NOT NULL AND value <> ''")


def review_reason(value: Column, edges: Sequence[int], margin: float = 0.1) -> Column:
    """Why a number read from a picture is for a person to see: one wrong digit would put it into another band."""
    near = F.exists(F.array(*map(F.lit, edges)), lambda e: F.abs(value - e) <= e * margin)
    return F.when(near, F.lit("near the edge of a band"))


def outcome(site: Column, status: Column, walled: Column, index: Column, fee: Column) -> Column:
    """What came of a visit, the first that holds: no site, none that answers, a wall, no disclosure, its fee document, the disclosure alone."""
    dead = status.isNull() | (status >= 500)
    return F.when(site.isNull(), "no_website").when(dead, "dead_origin").when(walled, "login_wall").when(index.isNull(), "not_found").when(fee.isNotNull(), "found_fee").otherwise("found_index")


def guessed_pages(rows: DataFrame, base: str, paths: Sequence[str], budget: str) -> DataFrame:
    """Rows with a ``guess`` each: as many paths as the budget allows, one visit kept back for what is found."""
    usable = F.slice(F.array(*map(F.lit, paths)), F.lit(1), F.greatest(F.col(budget) - 1, F.lit(0)))
    return rows.withColumn("guess", F.explode(F.transform(usable, lambda p: F.concat(F.col(base), p))))


def repair_visited(rows: DataFrame, log: DataFrame, key: str = "id") -> DataFrame:
    """``last_enriched_at`` moved forward to the latest fetch from the site's host, where no other row has the site; log: (host, at)."""
    seen = website_twins(rows).join(log.groupBy(F.col("host").alias("website")).agg(F.max("at").alias("seen_at")), "website").select(key, "seen_at")
    out = rows.join(seen, key, "left")
    return out.withColumn("last_enriched_at", F.greatest("last_enriched_at", "seen_at")).select(*rows.columns)


def undo_outage(rows: DataFrame, claims: DataFrame, begin: Column, end: Column, key: str = "id") -> DataFrame:
    """Stamps set within an outage that brought no claim are taken back."""
    some = claims.select(F.col(key).alias("claimed")).distinct()
    lost = F.col("last_enriched_at").between(begin, end) & F.col("claimed").isNull()
    return rows.join(some, F.col(key) == F.col("claimed"), "left").withColumn("last_enriched_at", F.when(~F.coalesce(lost, F.lit(False)), F.col("last_enriched_at"))).select(*rows.columns)


def guessed_counts(rows: DataFrame, value: str, key: str, seed: int = 12) -> DataFrame:
    """``guess`` where the value is not known: a number between the mean and the median of all that are, drawn by the key, so the same
    in each run."""
    s = rows.agg(F.bround(F.avg(value)).cast("long").alias("a"), F.bround(F.median(value)).cast("long").alias("b"))
    low, high = F.least("a", "b"), F.greatest("a", "b")
    draw = low + F.pmod(F.xxhash64(F.lit(seed), F.col(key)), high - low + 1)
    return rows.crossJoin(F.broadcast(s)).withColumn("guess", F.when(F.col(value).isNull(), draw)).drop("a", "b")  # one row


def report(rows: DataFrame, fields: Sequence[str]) -> DataFrame:
    """One row: visited, how many have each field, and the share in percent with one decimal."""
    n = F.count(F.lit(1))
    return rows.agg(n.alias("visited"), *[F.count(f).alias(f) for f in fields], *[F.bround(100 * F.try_divide(F.count(f), n), 1).alias(f"{f}_pct") for f in fields])
