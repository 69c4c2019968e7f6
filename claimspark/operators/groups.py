"""Groups of institutions on two axes that are kept apart: who owns them (legal entity) and what they are called (brand).

Sharing a normalised legal entity is a published fact: one owner. Sharing a brand is a hint: leading words of the name and the
website's domain together; where legal entities differ or aren't known, it is a possible network of franchises and nothing is merged. Both are keys,
so groups are aggregations, and no pairs are made.

Rows without a name or site have no brand; repeated keys count as often as they stand there; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from claimspark.functions.identity import registrable_domain
from claimspark.functions.text import GENERIC_WORDS, basic, empty_to_null, normalize_legal_entity

# What groups are called, and from how many on they are one.
OWNER, FRANCHISE, LEAST = "verified_single_owner", "possible_franchise_network", 2


def leading_words(name: Column, words: int = 2) -> Column:
    """The first words of a name; null where it has fewer, or all of them are generic."""
    first = F.slice(F.filter(F.split(basic(name), " "), lambda w: w != ""), 1, words)
    return F.when((F.size(first) == words) & F.exists(first, lambda w: ~w.isin(*GENERIC_WORDS)), F.array_join(first, " "))


def owners(rows: DataFrame, qualifies: Column, least: int = LEAST) -> DataFrame:
    """(owner, name, group_type, evidence, campus_count, states_present, hq_state, qualifying_campus_count) of each legal entity of ``least``
    rows or more. hq_state: the commonest, of equal ones the first by name. Rows are counted by state first, so one owner of a third of all
    rows is no hot key."""
    owner = normalize_legal_entity(F.col("legal_entity_name"))
    by_state = rows.select("*", owner.alias("owner"), qualifies.alias("q")).where("owner IS NOT NULL").groupBy("owner", "state").agg(F.count(F.lit(1)).alias("n"), F.min("legal_entity_name").alias("name"), F.count_if("q").alias("q"))
    out = by_state.groupBy("owner").agg(
        F.min("name").alias("name"), F.sum("n").alias("campus_count"), F.array_sort(F.collect_list("state")).alias("states_present"),
        F.min_by("state", F.when(F.col("state").isNotNull(), F.struct(-F.col("n"), "state"))).alias("hq_state"), F.sum("q").alias("qualifying_campus_count"),
    )
    evidence = F.concat(F.lit("shared legal entity: "), F.col("owner"))
    return out.where(F.col("campus_count") >= least).select("owner", "name", F.lit(OWNER).alias("group_type"), evidence.alias("evidence"), "campus_count", "states_present", "hq_state", "qualifying_campus_count")


def brands(rows: DataFrame, words: int = 2, most_names: int = 5, least: int = LEAST) -> DataFrame:
    """(brand, domain, brand_count, entities, unknown) of what shares leading words and domain. A domain that carries more than
    ``most_names`` different leading words is where sites are kept, not a brand: it is ambiguous and left out."""
    named = rows.select(leading_words(F.col("canonical_name"), words).alias("brand"), empty_to_null(registrable_domain(F.col("website"))).alias("domain"), normalize_legal_entity(F.col("legal_entity_name")).alias("owner"))
    by_owner = named.where("brand IS NOT NULL AND domain IS NOT NULL").groupBy("domain", "brand", "owner").agg(F.count(F.lit(1)).alias("n"))
    each = by_owner.groupBy("domain", "brand").agg(F.sum("n").alias("brand_count"), F.count("owner").alias("entities"), F.sum(F.when(F.col("owner").isNull(), F.col("n")).otherwise(0)).alias("unknown"))
    clear = each.groupBy("domain").agg(F.count(F.lit(1)).alias("names")).where(F.col("names") <= most_names)
    return each.join(clear, "domain").where(F.col("brand_count") >= least).select("brand", "domain", "brand_count", "entities", "unknown")


def with_groups(rows: DataFrame, qualifies: Column, words: int = 2, most_names: int = 5) -> DataFrame:
    """``rows`` with what their groups say, written back to each: owner, group_type, campus_count, qualifying_campus_count, hq_state, brand,
    brand_count and is_franchise. An owner outranks a brand; a brand of more than one owner, or of unknown ones, is a possible network all the
    same, and says so. Rows keep their own owner whatever the brand is."""
    own = owners(rows, qualifies).select(F.col("owner").alias("_owner"), "group_type", "campus_count", "qualifying_campus_count", "hq_state")
    shared = brands(rows, words, most_names).select(F.col("brand").alias("_brand"), F.col("domain").alias("_domain"), "brand_count", ((F.col("entities") > 1) | (F.col("unknown") > 0)).alias("mixed"))
    keyed = rows.select("*", normalize_legal_entity(F.col("legal_entity_name")).alias("owner"), leading_words(F.col("canonical_name"), words).alias("_lead"), registrable_domain(F.col("website")).alias("_site"))
    out = keyed.join(own, F.col("owner") == F.col("_owner"), "left").join(shared, (F.col("_lead") == F.col("_brand")) & (F.col("_site") == F.col("_domain")), "left")
    mixed = F.coalesce("mixed", F.lit(False))
    return out.select(*rows.columns, "owner", F.coalesce("group_type", F.when(mixed, FRANCHISE)).alias("group_type"), "campus_count", "qualifying_campus_count", "hq_state", F.col("_brand").alias("brand"), "brand_count", mixed.alias("is_franchise"))
