"""From claims to canonical rows: keys pooled over merges, winners cast into columns, ids, boards, people, links back; scores with flags."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from claimspark.functions.identity import normalize_person, normalize_title
from claimspark.functions.text import normalize_city, normalize_domain, normalize_legal_entity, sanitise, to_int

# The registry of a key's prefix, and the board that a row in it implies.
PREFIXES = ("cbse", "cisce", "udise", "ib", "caie")
BOARDS = {"cbse": "CBSE", "cisce": "CISCE_ISC", "ib": "IB_DP", "caie": "CAIE_ALEVEL"}
ESTIMATED = "estimated:"
INTEGERS = ("total_enrollment", "total_teachers", "class_12_total", "pcm_12_count")


def as_bool(text: Column) -> Column:
    return F.when(text.isNotNull(), F.lower(F.trim(text)).isin("true", "yes", "1", "t", "y"))


def as_date(text: Column) -> Column:
    """Day, month and year with slashes; null otherwise."""
    parts = [F.regexp_extract(text, r"^\s*(\d{1,2})/(\d{1,2})/(\d{4})\s*$", n) for n in (3, 2, 1)]
    return F.when(parts[0] != "", F.try_make_timestamp(*[p.cast("int") for p in parts], F.lit(0), F.lit(0), F.lit(0)).cast("date"))


def as_list(text: Column) -> Column:
    items = F.filter(F.transform(F.split(text, ","), lambda x: F.trim(x)), lambda x: x != "")
    return F.when(F.size(items) > 0, items)


def checked(claims: DataFrame, fields: Sequence[str], most_evidence: int = 4000) -> DataFrame:
    """Claims fit to be stored: an unknown field raises, evidence is there and cut, control characters are gone."""
    known = F.when(F.col("field").isin(*fields), F.col("field")).otherwise(F.raise_error(F.concat(F.lit("unknown field "), F.coalesce("field", F.lit("null")))))
    rows = claims.withColumn("field", known).where(F.trim("evidence") != "")
    return rows.withColumns({"value": sanitise(F.col("value")), "evidence": F.substring(sanitise(F.col("evidence")), 1, most_evidence)})


def pool(claims: DataFrame, merged: DataFrame) -> DataFrame:
    """Claims under the key that stands for theirs; merged: (key, primary)."""
    named = merged.select(F.col("key").alias("entity_key"), "primary")
    return claims.join(named, "entity_key", "left").withColumn("entity_key", F.coalesce("primary", "entity_key")).drop("primary")


def canonical(winners: DataFrame, fields: Sequence[str]) -> DataFrame:
    """One typed row for each entity that has a name and a known prefix; winners: (entity_key, field, value, evidence)."""
    rows = winners.groupBy("entity_key").pivot("field", [*fields]).agg(F.first("value").alias("v"), F.first("evidence").alias("e"))
    has = {f: F.col(f"{f}_v") if f in fields else F.lit(None).cast("string") for f in (*fields, "name", "city", "district", "state", "website", "fee_annual_inr", "total_enrollment", "has_class_12", "streams", "status", "legal_entity_name")}
    fee, guess = to_int(has["fee_annual_inr"]), has["total_enrollment"].isNotNull() & F.coalesce((F.col("total_enrollment_e") if "total_enrollment" in fields else F.lit("")).contains(ESTIMATED), F.lit(False))
    prefix = F.substring_index("entity_key", ":", 1)
    kept = rows.where(has["name"].isNotNull() & (has["name"] != "") & prefix.isin(*PREFIXES))
    return kept.select(
        "entity_key", has["name"].alias("canonical_name"), as_bool(has["has_class_12"]).alias("has_class_12"), normalize_legal_entity(has["legal_entity_name"]).alias("legal_entity_norm"),
        F.coalesce(has["status"], F.lit("active")).alias("status"), *[to_int(has[f]).alias(f) for f in INTEGERS if f in fields], fee.alias("fee_annual_inr_min"), fee.alias("fee_annual_inr_max"),
        guess.alias("enrollment_is_estimated"), as_list(has["streams"]).alias("streams"), normalize_city(F.coalesce(F.nullif(has["city"], F.lit("")), has["district"])).alias("city"),
        normalize_city(has["state"]).alias("state"), normalize_city(has["district"]).alias("district"), F.coalesce(normalize_domain(has["website"]), F.nullif(has["website"], F.lit(""))).alias("website"),
        *[F.col(f"{f}_v").alias(f) for f in fields if f in ("principal_name", "principal_title", "counsellor_name", "counsellor_title", "board_valid_from", "board_valid_to")],
    )


def with_ids(rows: DataFrame, given: DataFrame, key: str = "entity_key", buckets: int = 4096) -> DataFrame:
    """``rows`` with an ``id``: that of ``given`` (key, id), or the next free ones for new keys. Numbers are dealt in two levels, so no
    task orders all new keys."""
    old = rows.join(given.select(F.col(key), "id"), key, "left")
    new = old.where("id IS NULL").withColumn("bucket", F.pmod(F.xxhash64(key), F.lit(buckets)))
    sizes = new.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"))
    first = F.coalesce(F.sum("n").over(Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = sizes.select("bucket", first.alias("start")).crossJoin(given.agg(F.coalesce(F.max("id"), F.lit(0)).alias("last")))  # ``buckets`` rows, one row
    numbered = new.withColumn("rn", F.row_number().over(Window.partitionBy("bucket").orderBy(key))).join(F.broadcast(starts), "bucket")
    return old.where("id IS NOT NULL").unionByName(numbered.withColumn("id", F.col("last") + F.col("start") + F.col("rn")).select(*old.columns))


def boards(rows: DataFrame) -> DataFrame:
    """(entity_key, board, status, valid_from, valid_to) where a registry implies a board."""
    prefix = F.substring_index("entity_key", ":", 1)
    board = F.element_at(F.create_map(*[F.lit(x) for kv in BOARDS.items() for x in kv]), prefix)
    date = lambda c: as_date(F.col(c)) if c in rows.columns else F.lit(None).cast("date")
    out = rows.select("entity_key", board.alias("board"), F.when(F.col("status") == "disaffiliated", "expired").otherwise("active").alias("status"), date("board_valid_from").alias("valid_from"), date("board_valid_to").alias("valid_to"))
    return out.where("board IS NOT NULL")


def roles(rows: DataFrame) -> DataFrame:
    """(entity_key, full_name, normalized_name, title_raw, title) of the people named in a row."""
    title = lambda c, default: F.coalesce(F.nullif(F.col(c), F.lit("")), F.lit(default)) if c in rows.columns else F.lit(default)
    held = [F.struct(F.col(n).alias("full_name"), title(t, d).alias("title_raw")) for n, t, d in (("principal_name", "principal_title", "Principal"), ("counsellor_name", "counsellor_title", "Career Counsellor")) if n in rows.columns]
    people = rows.select("entity_key", F.explode(F.array(*held)).alias("p")).select("entity_key", "p.*")
    out = people.withColumn("normalized_name", normalize_person(F.col("full_name"))).where("normalized_name IS NOT NULL")
    return out.select("entity_key", F.substring("full_name", 1, 200).alias("full_name"), F.substring("normalized_name", 1, 200).alias("normalized_name"), F.substring("title_raw", 1, 200).alias("title_raw"), normalize_title(F.col("title_raw")).alias("title"))


def link_back(claims: DataFrame, merged: DataFrame, ids: DataFrame) -> DataFrame:
    """Claims with the ``institution_id`` of the row that they went into."""
    return pool(claims.withColumn("own_key", F.col("entity_key")), merged).join(ids.select("entity_key", F.col("id").alias("institution_id")), "entity_key", "left").withColumn("entity_key", F.col("own_key")).drop("own_key")


def prune(rows: DataFrame, seen: DataFrame, key: str = "entity_key") -> DataFrame:
    """Rows whose key was seen; all rows, if none was: an empty run removes nothing."""
    any_ = seen.limit(1).select(F.lit(True).alias("any_seen"))
    kept = rows.join(seen.select(key).distinct(), key, "left_semi")
    return kept.unionByName(rows.join(F.broadcast(any_), F.lit(True), "left_anti"))


def upsert(existing: DataFrame, rows: DataFrame, key: Sequence[str], order: Column) -> DataFrame:
    """``existing`` with ``rows`` in place of those of the same key; of several new ones that with the greatest ``order``."""
    last = rows.groupBy(*key).agg(F.max_by(F.struct(*existing.columns), order).alias("r")).select("r.*")
    return existing.join(rows.select(*key).distinct(), [*key], "left_anti").select(*existing.columns).unionByName(last)


def replace_scores(existing: DataFrame, new: DataFrame, by: Sequence[str] = ("model_version", "campaign")) -> DataFrame:
    """All scores of the model and campaign at hand give way to the new ones."""
    return existing.join(F.broadcast(new.select(*by).distinct()), [*by], "left_anti").select(*new.columns).unionByName(new)


def add_markers(markers: DataFrame, done: DataFrame, documents: DataFrame, by: Sequence[str] = ("content_hash", "version")) -> DataFrame:
    """Markers of documents that exist, once each."""
    new = done.select(*by).dropDuplicates([*by]).join(documents.select("content_hash").distinct(), "content_hash", "left_semi")
    return markers.select(*by).unionByName(new.join(markers, [*by], "left_anti").select(*by))


def review_rows(rows: DataFrame, kind: str, *payload: str) -> DataFrame:
    """Open cases for people: a kind and a JSON payload."""
    return rows.select(F.lit(kind).alias("kind"), F.to_json(F.struct(*payload)).alias("payload"), F.lit("open").alias("state"))


def assembled(rows: DataFrame, fit: Column, boost: Column, conditions: dict[str, Column]) -> DataFrame:
    """(…, score, insufficient, flags): the fit, moved by a boost within 0 and 100; nothing to go by counts 0 and says so."""
    moved = F.when(F.coalesce(boost, F.lit(0)) != 0, F.greatest(F.lit(0.0), F.least(F.lit(100.0), fit + boost))).otherwise(fit)
    flags = F.array_compact(F.array(*[F.when(c, F.lit(name)) for name, c in conditions.items()], F.when(fit.isNull(), F.lit("insufficient_data"))))
    return rows.select("*", F.coalesce(F.when(fit.isNotNull(), moved), F.lit(0.0)).alias("score"), fit.isNull().alias("insufficient"), flags.alias("flags"))


def histogram(rows: DataFrame, array: str) -> DataFrame:
    return rows.select(F.explode(array).alias("flag")).groupBy("flag").agg(F.count(F.lit(1)).alias("n"))
