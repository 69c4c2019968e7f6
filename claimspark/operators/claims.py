"""Claims: idempotent append, conflict resolution by source priority, disputes, canonical rows, merges, overrides."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def append_new(claims: DataFrame, existing: DataFrame, key: list[str]) -> DataFrame:
    """The claims that are not there yet, one for each key; rows with a null in the key never conflict."""
    whole = F.lit(True)
    for c in key:
        whole = whole & F.col(c).isNotNull()
    keyed = claims.where(whole).dropDuplicates(key).join(existing.select(*key), key, "left_anti")
    return keyed.select(*claims.columns).unionByName(claims.where(~whole))


def resolve(claims: DataFrame, policy: dict[str, list[str]]) -> DataFrame:
    """Every claim with its rank in (entity, field) and a reason: the source's place in the policy decides, then the
    latest observation, then entity and id. A source that the policy doesn't name never wins. Unknown fields raise."""
    places = F.create_map(*[F.lit(x) for f, sources in policy.items() for i, s in enumerate(sources) for x in (f"{f}|{s}", i)])
    known = F.col("field").isin(*policy)
    checked = claims.withColumn("field", F.when(known, F.col("field")).otherwise(F.raise_error(F.concat(F.lit("no policy for field "), F.col("field")))))
    placed = checked.withColumn("place", F.element_at(places, F.concat_ws("|", "field", "source_id")))
    order = Window.partitionBy("entity_key", "field").orderBy(F.col("place").asc_nulls_last(), F.col("observed_at").desc(), "id")
    best = Window.partitionBy("entity_key", "field")
    ranked = placed.withColumn("rk", F.row_number().over(order)).withColumn("top", F.min("place").over(best))
    reason = F.when(F.col("place").isNull(), "source not permitted").when(F.col("rk") == 1, "winner").when(F.col("place") > F.col("top"), "lower priority source").otherwise("older observation")
    return ranked.withColumn("reason", reason).withColumn("won", F.col("place").isNotNull() & (F.col("rk") == 1)).drop("top")


# Fields whose sources are worth a look where they are far apart.
DISPUTED_FIELDS = ("fee_annual_inr", "total_enrollment", "class_12_total", "pcm_12_count")


def disputes(ranked: DataFrame, tolerance: float = 0.2, fields: Sequence[str] = DISPUTED_FIELDS) -> DataFrame:
    """(entity_key, field, disputed) of each winner: whether, in one of ``fields``, a permitted claim of another source is off by more."""
    w = ranked.where("won").select("entity_key", "field", F.col("source_id").alias("w_source"), F.col("value").alias("w"))
    off = F.col("field").isin(*fields) & (F.col("source_id") != F.col("w_source")) & F.col("place").isNotNull() & (F.col("w") != 0) & (F.abs(F.col("value") - F.col("w")) > tolerance * F.abs(F.col("w")))
    return ranked.join(w, ["entity_key", "field"]).groupBy("entity_key", "field").agg(F.max(F.coalesce(off, F.lit(False))).alias("disputed"))


def pivot_winners(ranked: DataFrame, fields: list[str]) -> DataFrame:
    return ranked.where("won").groupBy("entity_key").pivot("field", fields).agg(F.first("value"))


def apply_overrides(rows: DataFrame, overrides: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """Human values last: of several for a field the one with the highest id; expired ones don't count."""
    last = overrides.where("NOT expired").groupBy(F.col("entity").alias("_e")).pivot("field", fields).agg(F.max_by("value", "id"))
    last = last.select("_e", *[F.col(f).alias(f"_{f}") for f in fields])
    out = rows.join(last, F.col(key) == F.col("_e"), "left")
    return out.select(*[F.coalesce(F.col(f"_{c}").cast(rows.schema[c].dataType), F.col(c)).alias(c) if c in fields else F.col(c) for c in rows.columns])


def latest(rows: DataFrame, key: list[str], order: Column, *keep: str) -> DataFrame:
    """One row for each key, that with the greatest ``order``; aggregated before the shuffle, unlike a window."""
    return rows.groupBy(*key).agg(F.max_by(F.struct(*keep), order).alias("_r")).select(*key, "_r.*")


def attributed_once(rows: DataFrame, sites: DataFrame, key: str, url: str, site: str, gram: int = 6) -> DataFrame:
    """(key, site) of the rows whose url holds, anywhere and in any case, exactly one of the sites.

    A site is looked for where its first ``gram`` characters stand: urls meet sites by an equal join on these and ``contains``
    decides. Shorter sites meet on all of their own characters. Empty sites fit nothing.
    """
    s = sites.select(F.col(site).alias("site"), F.lower(site).alias("low")).where("low <> ''").dropDuplicates(["site"])
    s = s.withColumn("head", F.substring("low", 1, gram))
    u = rows.select(F.col(key), F.lower(url).alias("u"))
    pieces = lambda n: F.transform(F.sequence(F.lit(1), F.greatest(F.length("u") - n + 1, F.lit(1))), lambda i: F.substring("u", i, n))
    sizes = sorted(r["size"] for r in s.select(F.length("head").alias("size")).distinct().collect())  # ``gram`` numbers at most
    if not sizes:
        return u.select(key, F.lit(None).cast("string").alias("site")).limit(0)
    heads = u.withColumn("head", F.explode(F.array_distinct(F.concat(*[pieces(n) for n in sizes]))))
    hits = heads.join(s, "head").where(F.contains("u", "low"))
    return hits.groupBy(key).agg(F.count(F.lit(1)).alias("n"), F.min("site").alias("site")).where("n = 1").select(key, "site")


def breaker_opens(log: DataFrame, key: str, order: list[str], bad: Column, times: int = 3) -> DataFrame:
    """Rows at which ``bad`` has held ``times`` times in a row (or a further one) for the key."""
    w = Window.partitionBy(key).orderBy(*order)
    islands = log.withColumn("_bad", bad).withColumn("_good", F.sum(F.when(F.col("_bad"), 0).otherwise(1)).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    run = Window.partitionBy(key, "_good").orderBy(*order)
    counted = islands.withColumn("run", F.sum(F.when(F.col("_bad"), 1).otherwise(0)).over(run.rowsBetween(Window.unboundedPreceding, 0)))
    return counted.where(F.col("_bad") & (F.col("run") >= times)).drop("_bad", "_good")


def queue_step(jobs: DataFrame, now: Column, backoff: tuple[int, ...] = (2, 8, 30), stale_minutes: int = 30) -> DataFrame:
    """The jobs after a sweep, with ``wait_s``: failed ones are pending again from the backoff on, or dead; jobs whose lock is stale are pending
    again at once. Either way the lock is gone."""
    wait = F.element_at(F.array(*map(F.lit, backoff)), F.greatest(F.least(F.col("attempts"), F.lit(len(backoff))), F.lit(1)).cast("int"))
    failed = F.col("state") == "failed"
    dead, again = failed & (F.col("attempts") >= F.col("max_attempts")), failed & (F.col("attempts") < F.col("max_attempts"))
    stale = F.coalesce((F.col("state") == "running") & (F.col("locked_at") < now - F.expr(f"INTERVAL {stale_minutes} MINUTES")), F.lit(False))
    free = lambda c: F.when(~(failed | stale), F.col(c)).alias(c)
    return jobs.withColumns({
        "wait_s": F.when(again, wait).otherwise(F.lit(0)), "not_before": F.when(again, now + F.make_dt_interval(secs=wait)).otherwise(F.col("not_before")),
        "locked_by": free("locked_by"), "locked_at": free("locked_at"), "state": F.when(dead, "dead").when(again | stale, "pending").otherwise(F.col("state")),
    })
