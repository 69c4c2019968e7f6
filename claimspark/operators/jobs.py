"""A queue of jobs as steps on a table, and the evaluation of what was extracted."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def enqueue(jobs: DataFrame, new: DataFrame, dedupe: str = "dedupe_key", order: str = "id") -> DataFrame:
    """``jobs`` with the new ones whose key is not there yet; of several the first. Jobs without a key always go in."""
    keyed = new.where(F.col(dedupe).isNotNull())
    first = keyed.groupBy(dedupe).agg(F.min_by(F.struct(*new.columns), order).alias("r")).select("r.*").join(jobs.select(dedupe), dedupe, "left_anti")
    return jobs.unionByName(first.select(*jobs.columns)).unionByName(new.where(F.col(dedupe).isNull()).select(*jobs.columns))


def claim(jobs: DataFrame, now: Column, worker: str, n: int = 1) -> DataFrame:
    """The jobs after ``n`` due ones, those that wait longest, went to the worker."""
    due = jobs.where((F.col("state") == "pending") & (F.col("not_before") <= now)).orderBy("not_before", "id").limit(n).select("id", F.lit(True).alias("taken"))
    out = jobs.join(F.broadcast(due), "id", "left")
    taken = F.coalesce("taken", F.lit(False))
    return out.withColumns({
        "state": F.when(taken, "running").otherwise(F.col("state")), "locked_by": F.when(taken, worker).otherwise(F.col("locked_by")),
        "locked_at": F.when(taken, now).otherwise(F.col("locked_at")), "attempts": F.col("attempts") + taken.cast("int"),
    }).select(*jobs.columns)


def finish(jobs: DataFrame, ended: DataFrame, now: Column) -> DataFrame:
    """The jobs after ``ended`` (id, error) came back: done without an error, else failed, for ``queue_step`` to decide on; ids that don't run count for nothing."""
    back = ended.groupBy("id").agg(F.max("error").alias("said")).select("id", "said", F.lit(True).alias("came"))
    out = jobs.join(back, "id", "left")
    came = F.coalesce("came", F.lit(False)) & (F.col("state") == "running")
    return out.withColumns({
        "state": F.when(came & F.col("said").isNull(), "done").when(came, "failed").otherwise(F.col("state")), "last_error": F.when(came, F.substring("said", 1, 4000)).otherwise(F.col("last_error")),
        "finished_at": F.when(came & F.col("said").isNull(), now).otherwise(F.col("finished_at")), "locked_by": F.when(~came, F.col("locked_by")), "locked_at": F.when(~came, F.col("locked_at")),
    }).select(*jobs.columns)


def field_scores(gold: DataFrame, claims: DataFrame, agrees: Column) -> DataFrame:
    """(field, gold_count, produced, correct, wrong, missing, precision, recall, coverage): gold (entity_key, field, expected) against the
    most certain, then latest, claim (entity_key, field, value); ``agrees`` of the columns expected and value. Null where nothing divides."""
    best = claims.groupBy("entity_key", "field").agg(F.max_by("value", F.struct("confidence", "observed_at", "id")).alias("value"))
    met = gold.join(best, ["entity_key", "field"], "left").withColumn("hit", F.coalesce(agrees, F.lit(False)))
    there = F.col("value").isNotNull()
    out = met.groupBy("field").agg(F.count(F.lit(1)).alias("gold_count"), F.count_if(there).alias("produced"), F.count_if(there & F.col("hit")).alias("correct"))
    share = lambda a, b: F.bround(F.try_divide(F.col(a), F.col(b)), 3)
    return out.select("field", "gold_count", "produced", "correct", (F.col("produced") - F.col("correct")).alias("wrong"), (F.col("gold_count") - F.col("produced")).alias("missing"), share("correct", "produced").alias("precision"), share("correct", "gold_count").alias("recall"), share("produced", "gold_count").alias("coverage"))


def unknown_keys(gold: DataFrame, claims: DataFrame) -> DataFrame:
    """Entities of the gold set of which there is no claim."""
    return gold.select("entity_key").distinct().join(claims.select("entity_key"), "entity_key", "left_anti")


def with_previous(reports: DataFrame) -> DataFrame:
    """Reports (run_date, extractor, field, recall, …) with the recall of the run before and how far it moved."""
    before = F.lag("recall").over(Window.partitionBy("extractor", "field").orderBy("run_date"))
    return reports.withColumn("previous_recall", before).withColumn("moved", F.col("recall") - F.col("previous_recall"))


def write_reports(reports: DataFrame, path: str) -> None:
    """JSON by run date; a run of the same date is written over, others stay."""
    reports.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("run_date").json(path)
