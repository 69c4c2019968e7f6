"""Record linkage: which rows speak of one institution.

Rows of a PIN meet once. Rows of a city meet in the first other key that they share, of five. Only rows that lack a PIN or city meet all others of a
key, and only keys that such rows have are dealt out for them. What rules a pair out for certain is tried before the names are compared: other
signals too few to reach the lower threshold with equal names, or a hard blocker. What is still above ``tile`` rows is dealt out over pairs of chunks, so no
join partition is larger than two chunks; nothing is left out. Pairs at ``merge_from`` or more are merged, those at ``review_from`` or more are for a
person to decide. Pairs are not shuffled once they are found: a row takes along with whom people compared it.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from claimspark.functions.fuzzy import token_set_ratio
from claimspark.functions.identity import registrable_domain
from claimspark.functions.text import basic, empty_to_null, match_key, normalize_city, normalize_legal_entity, normalize_phones
from claimspark.operators.registry_rows import homepage
from claimspark.operators.staging import staged

# What each signal weighs, from which score on a pair is merged or shown, and words that tell branches apart.
WEIGHTS = {"name": 0.35, "pin": 0.25, "domain": 0.15, "phone": 0.10, "geo": 0.10, "legal": 0.05}
MERGE_FROM, REVIEW_FROM = 0.90, 0.65
NEAR_KM, FAR_KM = 2.0, 25.0
BRANCH_WORDS = (
    "north", "south", "east", "west", "main", "annexe", "annex", "sector", "phase", "campus", "ii", "iii", "2", "3",
    "junior", "senior", "primary", "pre-primary", "boys", "girls",
)
EARTH_KM = 6371.0


def prepared(records: DataFrame, key: str) -> DataFrame:
    """What is compared, one row for each record: records have name, city, district, state, pincode, website, phone, legal_entity, latitude,
    longitude, udise_code and cbse_affiliation_no, any of them null."""
    words = F.array_distinct(F.filter(F.split(basic(F.coalesce("name", F.lit(""))), " "), lambda w: w != ""))
    rows = records.select(
        F.col(key).alias("key"), empty_to_null(match_key(F.col("name"))).alias("name_key"), words.alias("words"), normalize_city(F.col("city")).alias("city"),
        empty_to_null(basic(F.col("district"))).alias("district"), empty_to_null(basic(F.col("state"))).alias("state"), empty_to_null(F.regexp_replace("pincode", r"\D", "")).alias("pin"),
        empty_to_null(registrable_domain(homepage(F.col("website")))).alias("domain"), normalize_phones(F.col("phone")).alias("phones"), normalize_legal_entity(F.col("legal_entity")).alias("legal"),
        F.col("latitude").alias("lat"), F.col("longitude").alias("lon"), empty_to_null(F.trim("udise_code")).alias("udise"), empty_to_null(F.trim("cbse_affiliation_no")).alias("cbse"),
    )
    first_two = F.array_join(F.slice(F.split("name_key", " "), 1, 2), " ")
    tagged = lambda tag, *parts: F.concat(F.lit(tag), *parts)  # noqa: E731 - null where a part is
    keys = F.concat(
        F.array(tagged("p|", "pin"), tagged("n|", "state", F.lit("|"), F.substring("name_key", 1, 6)), tagged("d|", "domain"), tagged("w|", "district", F.lit("|"), first_two)),
        F.transform("phones", lambda x: F.concat(F.lit("t|"), x)),
    )
    return rows.withColumn("blocks", F.array_sort(F.array_distinct(F.array_compact(keys))))


def _met(left: DataFrame, right: DataFrame, tile: int, parts: int) -> DataFrame:
    """Pairs (columns of ``left`` with a_, of ``right`` with b_) of one ``meet``, the lesser key on the left, in ``parts`` partitions: sides that are small
    make many pairs, so they are not to be put together by size. Where a side has more than ``tile`` rows of a
    meet it is cut into chunks, and chunk meets chunk; a row goes out once for each chunk of the other side."""

    def side(rows: DataFrame, own: str, other: str, p: str) -> DataFrame:
        # one row for each chunk's worth of rows at most, so small enough to be sent round
        for df, name in ((rows, own), (left if rows is right else right, other)):
            chunks = df.groupBy("meet").agg(F.ceil(F.count(F.lit(1)) / tile).cast("int").alias(name)).where(F.col(name) > 1)
            rows = rows.join(F.broadcast(chunks), "meet", "left")
        count = lambda c: F.coalesce(c, F.lit(1))
        rows = rows.withColumn(own, F.pmod(F.xxhash64("key", F.lit(5)), count(own)).cast("int")).withColumn(other, F.explode(F.sequence(F.lit(0), count(other) - 1)))
        rows = rows.select("meet", (F.col("i").cast("long") * (1 << 31) + F.col("j")).alias("tile"), *[F.col(c).alias(f"{p}_{c}") for c in left.columns if c != "meet"])
        return rows.repartition(parts, "meet", "tile")

    # sides are many times their small table once dealt out, which its size on disk doesn't tell: never sent whole by the driver
    return side(left, "i", "j", "a").join(side(right, "j", "i", "b").hint("merge"), ["meet", "tile"]).where("a_key < b_key")


def _kilometres(a_lat: Column, a_lon: Column, b_lat: Column, b_lon: Column) -> Column:
    half = F.pow(F.sin(F.radians(b_lat - a_lat) / 2), 2) + F.cos(F.radians(a_lat)) * F.cos(F.radians(b_lat)) * F.pow(F.sin(F.radians(b_lon - a_lon) / 2), 2)
    return 2 * EARTH_KM * F.asin(F.sqrt(F.least(half, F.lit(1.0))))


def candidate_pairs(rows: DataFrame, tile: int = 2000) -> DataFrame:
    """Pairs (columns of the lesser key with a_, of the greater with b_) of ``prepared`` rows that share a key, each once, but for those
    whose PINs and cities both differ, which are two places.

    So rows of a key meet by PIN, which is a key itself, then by city; only rows that lack one of them meet all others of the key. A key that very
    many rows share, such as the domain of a platform, is no group of its own that way.
    """
    loose = F.col("pin").isNull() | F.col("city").isNull()
    columns = [c for c in rows.columns if c != "blocks"]
    parts = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), min(rows.count() // 2000, 4096))

    def by_block(df: DataFrame, blocks: Column, *place: str) -> DataFrame:
        """``before``: the blocks that come before the one met in; two rows meet in the first that they share if they share none of these."""
        df = df.withColumn("blocks", blocks).select("*", F.posexplode("blocks").alias("n", "block"))
        return df.select(*columns, F.slice("blocks", F.lit(1), F.col("n")).alias("before"), F.concat_ws("|", *place, "block").alias("meet"))

    first = ~F.arrays_overlap("a_before", "b_before")
    known = rows.where(~loose)
    by_pin = known.select(*columns, F.col("pin").alias("meet"))
    by_city = by_block(known, F.filter("blocks", lambda x: ~x.startswith("p|")), "city")
    found = [_met(by_pin, by_pin, tile, parts), _met(by_city, by_city, tile, parts).where(first & (F.col("a_pin") != F.col("b_pin")))]
    if not rows.where(loose).isEmpty():
        some = by_block(rows.where(loose), F.col("blocks"))
        meets = some.select("meet").distinct()
        whole = lambda df: by_block(df, F.col("blocks")).join(meets, "meet", "left_semi").select(*some.columns)
        found += [_met(some, whole(rows), tile, parts).where(first), _met(whole(known), some, tile, parts).where(first)]
    pairs = [x.select(*[f"{p}_{c}" for p in "ab" for c in columns]) for x in found]
    return reduce(DataFrame.unionByName, pairs)


def blocked() -> Column:
    """Whether the rows of a pair cannot be one institution, whatever else agrees."""
    differ = lambda c: F.coalesce(F.col(f"a_{c}") != F.col(f"b_{c}"), F.lit(False))  # noqa: E731 - unknown on either side differs from nothing
    odd = F.concat(F.array_except("a_words", "b_words"), F.array_except("b_words", "a_words"))
    branch = differ("pin") & (F.size(odd) > 0) & F.forall(odd, lambda w: w.isin(*BRANCH_WORDS, "pre"))
    return (differ("pin") & differ("city")) | differ("udise") | differ("cbse") | branch


def scored_pairs(pairs: DataFrame, review_from: float = REVIEW_FROM, merge_from: float = MERGE_FROM, weights: dict[str, float] = WEIGHTS) -> DataFrame:
    """(a, b, name, pin, domain, phone, geo, legal, score, decision) of the pairs at ``review_from`` or more and not blocked; signals are 0 to 1."""
    same = lambda c: F.coalesce(F.col(f"a_{c}") == F.col(f"b_{c}"), F.lit(False))
    near = F.coalesce(F.substring("a_pin", 1, 3) == F.substring("b_pin", 1, 3), F.lit(False))
    far = F.abs(F.col("a_lat") - F.col("b_lat")) > 1.001 * FAR_KM / math.radians(EARTH_KM)  # by latitude alone; spares nearly all pairs of a city the rest
    km = F.when(far, FAR_KM).otherwise(_kilometres(*[F.col(c) for c in ("a_lat", "a_lon", "b_lat", "b_lon")]))
    others = {
        "pin": F.when(same("pin"), 1.0).when(near, 0.4).otherwise(0.0), "domain": same("domain").cast("double"), "phone": F.arrays_overlap("a_phones", "b_phones").cast("double"),
        "geo": F.coalesce(F.greatest(F.lit(0.0), F.least(F.lit(1.0), (FAR_KM - km) / (FAR_KM - NEAR_KM))), F.lit(0.0)), "legal": same("legal").cast("double"),
    }
    total = lambda names: sum((F.col(n) * weights[n] for n in names), F.lit(0.0))
    # names are compared only where they can decide
    open_ = pairs.withColumns(others).where(total(others) + weights["name"] >= review_from - 1e-6).where(~blocked())
    named = open_.withColumn("name", F.coalesce(token_set_ratio(F.col("a_name_key"), F.col("b_name_key")) / 100, F.lit(0.0)))
    out = named.withColumn("score", F.round(total(["name", *others]), 6)).where(F.col("score") >= review_from)
    decision = F.when(F.col("score") >= merge_from, "same").otherwise("review")
    return out.select(F.col("a_key").alias("a"), F.col("b_key").alias("b"), "name", *others, "score", decision.alias("decision"))


def matched(records: DataFrame, key: str, decided: DataFrame | None = None, tile: int = 2000, review_from: float = REVIEW_FROM) -> DataFrame:
    """``scored_pairs`` of all records. decided: (a, b, decision) of people, in either order; pairs found different by them are left out,
    those found the same are merged, scored or not. These are scored by themselves, so the pairs found are not dealt out again."""
    rows = prepared(records.repartition(F.col(key)), key)  # a small file is one task's, and there is much to compute for each row
    if decided is None:
        return scored_pairs(candidate_pairs(staged(rows, "matching"), tile), review_from)
    said = decided.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), F.col("decision").alias("said")).groupBy("a", "b").agg(F.min("said").alias("said"))  # different before same
    said = staged(said.where("said IS NOT NULL"), "matching-said")
    partners = said.groupBy(F.col("a").alias("key")).agg(F.collect_set("b").alias("decided"))
    rows = staged(rows.join(partners, "key", "left"), "matching")
    found = scored_pairs(candidate_pairs(rows, tile).where(~F.coalesce(F.array_contains("a_decided", F.col("b_key")), F.lit(False))), review_from)
    said = said.where("said <> 'different'")
    a, b = (rows.select(*[F.col(c).alias(f"{p}_{c}") for c in rows.columns]) for p in "ab")
    pairs = said.join(a, F.col("a") == F.col("a_key")).join(b, F.col("b") == F.col("b_key")).where((F.col("a") < F.col("b")) & F.arrays_overlap("a_blocks", "b_blocks"))
    out = said.join(scored_pairs(pairs), ["a", "b"], "left").where("score IS NOT NULL OR said = 'same'").withColumn("decision", F.col("said"))
    return found.unionByName(out.select(*found.columns))
