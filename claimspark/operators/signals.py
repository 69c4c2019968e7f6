"""What has changed between two snapshots of a registry: one row for each change, of six kinds.

Values are compared as they are normalised, so another way of writing is no change; where one side is unknown nothing is said. A
snapshot with far fewer rows than the one before is a parser that broke, not a country of closed schools: then the whole comparison is an error.

Rows without a key are left out; of rows that repeat a key the greatest by (level, principal, address, legal entity) counts; where there was no
earlier row all keys are new; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from claimspark.functions.identity import normalize_person
from claimspark.functions.text import basic, empty_to_null, normalize_legal_entity

# The kinds of change.
NEW_AFFILIATION, LEVEL_UPGRADE, PRINCIPAL_CHANGE, ADDRESS_CHANGE, DISAFFILIATION, NEW_CAMPUS = "new_affiliation", "level_upgrade", "principal_change", "address_change", "disaffiliation", "new_campus"
LEVELS = ("primary", "middle", "secondary", "senior secondary")


def _known(snapshot: DataFrame, key: str, levels: Sequence[str]) -> DataFrame:
    """(key, level, principal, address, entity) with one struct (text as given, normal form) each."""
    level = F.nullif(F.array_position(F.array(*map(F.lit, levels)), F.lower(F.trim("level"))), F.lit(0))
    normal = {"level": level, "principal": normalize_person(F.col("principal")), "address": empty_to_null(F.trim(basic(F.col("address")))), "entity": normalize_legal_entity(F.col("legal_entity"))}
    given = {"level": "level", "principal": "principal", "address": "address", "entity": "legal_entity"}
    whole = F.struct(*[F.struct(n.alias("normal"), F.col(given[c]).alias("text")).alias(c) for c, n in normal.items()])
    return snapshot.where(F.col(key).isNotNull()).groupBy(F.col(key)).agg(F.max(whole).alias("v"))


def enough(old: DataFrame, new: DataFrame, least: float) -> DataFrame:
    """One row (enough), or an error where ``new`` has fewer rows than ``least`` of ``old``'s."""
    n = F.count(F.lit(1))
    counts = old.agg(n.alias("before")).crossJoin(new.agg(n.alias("now")))  # one row each
    wrong = F.concat_ws(" ", F.lit("the snapshot has"), F.col("now").cast("string"), F.lit("rows, the one before"), F.col("before").cast("string"))
    return counts.select(F.when(F.col("now") >= least * F.col("before"), True).otherwise(F.raise_error(wrong)).alias("enough"))


def signals(old: DataFrame, new: DataFrame, key: str, least: float = 0.5, levels: Sequence[str] = LEVELS) -> DataFrame:
    """(key, signal_type, before, after) between two snapshots with (key, level, principal, address, legal_entity).

    A new key is a new campus if its legal entity stood in the earlier snapshot, else a new affiliation; a key that is gone is a
    disaffiliation; of the others a level that rose, a principal or an address that differ in normal form."""
    a, b = _known(old, key, levels).select(key, F.col("v").alias("a")), _known(new, key, levels).select(key, F.col("v").alias("b"))
    entities = old.where(F.col(key).isNotNull()).select(normalize_legal_entity(F.col("legal_entity")).alias("known")).where("known IS NOT NULL").distinct()
    both = a.join(b, key, "full_outer")
    came = F.when(F.col("a").isNull(), F.col("b.entity.normal"))  # null for all keys that were there
    both = both.withColumn("came", came).join(entities, F.col("came") == F.col("known"), "left")

    def one(when: Column, kind: str, field: str | None = None) -> Column:
        text = lambda side: F.col(f"{side}.{field}.text") if field else F.lit(None).cast("string")
        return F.when(when, F.struct(F.lit(kind).alias("signal_type"), text("a").alias("before"), text("b").alias("after")))

    fresh, gone = F.col("a").isNull(), F.col("b").isNull()
    at = lambda side, field: F.col(f"{side}.{field}.normal")
    found = F.array(
        one(fresh & F.col("known").isNull(), NEW_AFFILIATION), one(fresh & F.col("known").isNotNull(), NEW_CAMPUS, "entity"), one(gone, DISAFFILIATION),
        one(at("b", "level") > at("a", "level"), LEVEL_UPGRADE, "level"), one(at("a", "principal") != at("b", "principal"), PRINCIPAL_CHANGE, "principal"),
        one(at("a", "address") != at("b", "address"), ADDRESS_CHANGE, "address"),
    )
    out = both.crossJoin(F.broadcast(enough(old, new, least))).where("enough")  # one row
    return out.select(key, F.explode(F.array_compact(found)).alias("s")).select(key, "s.*")
