"""Served queries over canonical institutions: what a reader asks for, filtered, ranked by what is known, and cut."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from claimspark import config
from claimspark.functions.text import has_all_words, similarity, tokens

NAME_ALIASES = config.pairs("name")


def direct() -> Column:
    """A phone or an e-mail address is known."""
    return F.col("phone").isNotNull() | F.col("email").isNotNull()


def through_site() -> Column:
    """There is a site, and it has been visited."""
    return F.col("last_enriched_at").isNotNull() & F.col("website").isNotNull()


CONTACT: dict[str, Callable[[], Column]] = {
    "verified": direct,
    "weak": lambda: ~direct() & through_site(),
    "reachable": lambda: direct() | through_site(),
    "none": lambda: ~direct() & ~through_site(),
}
CLASS_12: dict[str, Callable[[], Column]] = {"yes": lambda: F.col("has_class_12"), "unconfirmed": lambda: ~F.col("has_class_12")}


def contact_tier() -> Column:
    return F.when(direct(), "verified").when(through_site(), "weak").otherwise("none")


def known(*columns: str) -> Column:
    """How many of the columns hold something."""
    return sum((F.col(c).isNotNull().cast("int") for c in columns[1:]), F.col(columns[0]).isNotNull().cast("int"))


def _choose(rows: DataFrame, filters: dict[str, Callable[[], Column]], key: str) -> DataFrame:
    """An unknown key filters nothing."""
    return rows.where(filters[key]()) if key in filters else rows


def active(rows: DataFrame) -> DataFrame:
    return rows.where("status = 'active'")


def in_state(rows: DataFrame, state: str, contact: str = "any", class_12: str = "any", limit: int = 200) -> DataFrame:
    """Institutions of a state, those first of which most is known; unknown class 12 ranks before the known."""
    found = active(rows).where(F.lower("state") == state.lower())
    found = _choose(_choose(found, CONTACT, contact), CLASS_12, class_12)
    order = [known("phone", "email", "fee_mid", "total_enrollment", "website").desc(), F.desc_nulls_first("has_class_12"), F.coalesce("fit", F.lit(0.0)).desc(), F.col("id")]
    return found.orderBy(*order).limit(limit)


def in_city(rows: DataFrame, city: str, limit: int = 200) -> DataFrame:
    """By city, district or metro area; part of a district's name is enough."""
    q = city.lower()
    hit = (F.lower("city") == q) | (F.lower("district") == q) | (F.lower(F.coalesce("metro_area", F.lit(""))) == q) | F.lower("district").contains(q)
    return active(rows).where(hit).orderBy(known("phone", "email", "fee_mid").desc(), F.desc_nulls_first("has_class_12"), "id").limit(limit)


def by_name(rows: DataFrame, name: str, limit: int = 200) -> DataFrame:
    """All words of the query in name or place; if there is no such row and the query is one word, names like it.

    An abbreviation stands for the whole name. The second search runs only where the first has nothing: whether it has is one row,
    joined to the second's.
    """
    query = NAME_ALIASES.get(name.strip().lower(), name)
    rows = active(rows)
    words = rows.where(has_all_words(tokens(F.col("canonical_name"), F.col("city"), F.col("district"), F.col("state"), F.col("legal_entity_name")), query))
    found = words
    if len(query.split()) == 1:
        some = words.limit(1).select(F.lit(True).alias("some"))
        like = rows.where(similarity(F.col("canonical_name"), F.lit(query)) >= 0.3).join(F.broadcast(some), F.lit(True), "left_anti")
        found = words.unionByName(like)
    inside = F.coalesce(F.lower("canonical_name").contains(query.lower()), F.lit(False))
    return found.orderBy(inside.desc(), known("phone", "email", "fee_mid").desc(), F.desc_nulls_first("has_class_12"), "id").limit(limit)


def known_places(rows: DataFrame) -> DataFrame:
    """Districts of active rows and metro areas of any, lower case, in order."""
    places = active(rows).select(F.lower("district").alias("place")).union(rows.select(F.lower("metro_area"))).where("place <> ''")
    return places.distinct().orderBy("place")


def place_link(rows: DataFrame, places: DataFrame, base: str, column: str = "city") -> DataFrame:
    """``link``: where a known place is listed elsewhere, else null; an unknown place has no page there."""
    there = places.select(F.col("place").alias("p")).distinct()
    slug = F.regexp_replace(F.initcap(F.col(column)), " ", "-")
    return rows.join(there, F.lower(column) == F.col("p"), "left").withColumn("link", F.when(F.col("p").isNotNull(), F.concat(F.lit(base), slug))).drop("p")


def coverage(rows: DataFrame) -> DataFrame:
    """Eleven measures of active institutions in one row."""
    has = lambda c: F.count(c)
    students = F.col("total_enrollment").isNotNull() | F.col("student_count_guessed").isNotNull()
    return active(rows).agg(
        F.count(F.lit(1)).alias("institutions"), F.count_if("has_class_12").alias("senior_secondary"), has("website").alias("with_website"), has("phone").alias("with_phone"),
        has("email").alias("with_email"), has("fee_mid").alias("with_fee"), has("total_enrollment").alias("with_students"), F.count_if(students).alias("with_students_or_guessed"),
        F.count_if(CONTACT["reachable"]()).alias("contactable"), F.count_if(direct()).alias("strongly_contactable"), F.countDistinct("state").alias("states"),
    )


def profile(rows: DataFrame, roles: DataFrame, boards: DataFrame, scores: DataFrame, columns: Sequence[str]) -> DataFrame:
    """``columns`` of each institution, with the first principal and counsellor, boards, the latest score and the contact tier."""
    first = lambda *titles: F.min_by(F.when(F.col("title").isin(*titles), F.col("full_name")), F.when(F.col("title").isin(*titles), F.col("role_id")))
    people = roles.groupBy("institution_id").agg(first("principal").alias("principal_name"), first("career_counsellor", "academic_coordinator").alias("counsellor_name"))
    listed = boards.groupBy("institution_id").agg(F.array_join(F.array_sort(F.collect_list("board")), ", ").alias("boards"))
    last = scores.groupBy("institution_id").agg(F.max_by(F.struct("fit", "confidence", "flags"), F.struct("computed_at", "fit")).alias("s"))
    out = rows.drop("fit")
    for side in (people, listed, last):
        out = out.join(side, F.col("id") == side["institution_id"], "left").drop("institution_id")
    return out.select(*columns, "principal_name", "counsellor_name", "boards", "s.fit", "s.confidence", "s.flags", contact_tier().alias("contact_tier"))


def export_rows(rows: DataFrame, labels: Sequence[tuple[str, str]], limit: int = 5000) -> DataFrame:
    """Labelled columns as text in their order, nothing for null, flags joined; ``labels``: (column, label)."""
    kinds = dict(rows.dtypes)
    cell = lambda c: F.array_join(c, "; ") if kinds[c].startswith("array") else F.coalesce(F.col(c).cast("string"), F.lit(""))
    return rows.orderBy("id").limit(limit).select(*[F.coalesce(cell(c), F.lit("")).alias(label) for c, label in labels])


def due_targets(rows: DataFrame, now: Column, refresh_days: int = 180, network: str = "kendriya|navodaya|government|govt") -> DataFrame:
    """What is to be visited: active, with a site and a stable id, no state network, never visited or long ago; ``entity_key`` named by
    the first id there is."""
    key = F.coalesce(F.concat(F.lit("cbse:"), "cbse_id"), F.concat(F.lit("cisce:"), "cisce_id"))
    old = F.col("last_enriched_at").isNull() | (F.col("last_enriched_at") < now - F.expr(f"INTERVAL {refresh_days} DAYS"))
    fit = F.coalesce("has_class_12", F.lit(False)) & F.col("website").isNotNull() & key.isNotNull() & ~F.coalesce(F.col("canonical_name").rlike(f"(?i)({network})"), F.lit(False)) & old
    return active(rows).where(fit).select("id", key.alias("entity_key"), "website")


def website_twins(rows: DataFrame) -> DataFrame:
    """Rows whose site no other row has."""
    n = F.count(F.lit(1)).over(Window.partitionBy("website"))
    return rows.where("website IS NOT NULL").withColumn("twins", n).where("twins = 1").drop("twins")
