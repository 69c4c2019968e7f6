"""Exact dedup as a stateful stream: disk-backed keyed state, never expired, then a check of the full bytes.

The state (RocksDB, one entry for each SHA-256 digest of the normalised text) retains the digest, the stable
identifier of the row that stays (largest id; then the latest row) and its content locator (file and row). Digests
that more than one row shares are hits: their full texts are compared, and texts that only share a digest are
grouped anew by their bytes. DataFrame operations only.

Null text counts as empty; a null id ranks below all others; of repeated rows one stays; an empty table gives an
empty result; other columns are not read.
"""

from __future__ import annotations

from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from claimspark.llm.common import ascii_lower, fresh, stage, staged_path, table

STATE_CONF = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
    "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "200",
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",  # else each partition of the state holds 4 MB of disk ahead
}


@contextmanager
def _conf(spark: SparkSession, values: dict[str, str]):
    before = {k: spark.conf.get(k, None) for k in values}
    for k, v in values.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def dedup_state(stream: DataFrame) -> DataFrame:
    """The stateful operator: a streaming (digest, id, row, at) to (digest, keep, n), updated with each micro-batch."""
    return stream.groupBy("digest").agg(F.max(F.struct("id", "row", "at")).alias("keep"), F.count(F.lit(1)).alias("n"))


def run_dedup_stream(spark: SparkSession, path: str, schema, files_per_batch: int = 10_000) -> DataFrame:
    """Drive ``dedup_state`` over the files at ``path`` until all are taken; the last state of each digest."""
    out, log = staged_path(spark, "dedup-state"), staged_path(spark, "dedup-log")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)

    def put(batch: DataFrame, number: int) -> None:  # written over if a micro-batch is replayed
        batch.write.mode("overwrite").parquet(f"{out}/batch={number}")

    with _conf(spark, STATE_CONF):
        query = dedup_state(stream).writeStream.outputMode("update").option("checkpointLocation", log).trigger(availableNow=True).foreachBatch(put).start()
        try:
            query.awaitTermination()
        finally:
            query.stop()
    there = spark.read.schema(f"digest string, keep struct<id:{schema['id'].dataType.simpleString()},row:bigint,at:string>, n bigint, batch int").parquet(out)
    return there.groupBy("digest").agg(F.max_by("keep", "batch").alias("keep"), F.max("n").alias("n"))


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, keep_id, group_size, kept, text_sha256, keep_at) for each row, dropped ones too."""
    spark = docs.sparkSession
    norm = ascii_lower(F.col(text_col))
    slim = docs.select(F.col(id_col).alias("id"), F.monotonically_increasing_id().alias("row"), F.input_file_name().alias("at"), F.sha2(norm, 256).alias("digest"))
    path = staged_path(spark, "digests")
    slim.write.parquet(path)
    rows = spark.read.schema(slim.schema).parquet(path)
    if rows.isEmpty():
        state = spark.createDataFrame([], f"digest string, keep struct<id:{slim.schema['id'].dataType.simpleString()},row:bigint,at:string>, n bigint")
    else:
        state = stage(run_dedup_stream(spark, path, slim.schema), "dedup")
    hits = docs.select(F.sha2(norm, 256).alias("digest"), norm.alias("bytes")).join(state.where("n > 1").select("digest"), "digest")
    clash = stage(hits.groupBy("digest").agg(F.min("bytes").alias("x"), F.max("bytes").alias("y")).where("x <> y").select("digest"), "clash")
    out = rows.join(state, "digest").select("id", F.col("keep.id").alias("keep_id"), F.col("n").alias("group_size"), (F.col("row") == F.col("keep.row")).alias("kept"), F.col("digest").alias("text_sha256"), F.col("keep.at").alias("keep_at"))
    if not clash.isEmpty():
        out = out.join(clash, F.col("text_sha256") == F.col("digest"), "left_anti").unionByName(_by_bytes(docs, clash, id_col, norm))
    return out.withColumnRenamed("id", id_col)


def _by_bytes(docs: DataFrame, clash: DataFrame, id_col: str, norm) -> DataFrame:
    """The same result for rows whose digest several texts share, grouped by the bytes themselves."""
    rows = docs.select(F.col(id_col).alias("id"), F.monotonically_increasing_id().alias("row"), F.input_file_name().alias("at"), F.sha2(norm, 256).alias("digest"), norm.alias("bytes")).join(clash, "digest")
    rows = stage(rows, "clashing")
    group = rows.groupBy("digest", "bytes").agg(F.max(F.struct("id", "row", "at")).alias("keep"), F.count(F.lit(1)).alias("n"))
    return rows.join(group, ["digest", "bytes"]).select("id", F.col("keep.id").alias("keep_id"), F.col("n").alias("group_size"), (F.col("row") == F.col("keep.row")).alias("kept"), F.col("digest").alias("text_sha256"), F.col("keep.at").alias("keep_at"))


def keep_first_of_equal(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, with their own columns whatever their names; of rows equal in id and text one stays."""
    sha, digest, keep = fresh(docs, "sha", "digest", "keep")
    held = exact_dedup(docs, id_col, text_col).where("kept").select(F.col(id_col).alias(keep), F.col("text_sha256").alias(digest))
    rows = docs.withColumn(sha, F.sha2(ascii_lower(F.col(text_col)), 256)).join(held, F.col(sha).eqNullSafe(F.col(digest)) & F.col(id_col).eqNullSafe(F.col(keep)), "left_semi")
    return rows.dropDuplicates([sha, id_col]).select(*docs.columns)


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents")).drop("keep_at")


ORACLE = {
    "op4_exact_dedup": """
WITH n AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
g AS (SELECT t, max(doc_id) AS keep_id, count(*) AS group_size FROM n GROUP BY t)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(t) AS text_sha256 FROM n JOIN g USING (t)"""
}
