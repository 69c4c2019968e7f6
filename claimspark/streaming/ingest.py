"""Claims ingested once each from a file stream: keys that were taken are held as keyed state on disk, not read anew."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

STATE_CONF = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
}


@contextmanager
def _conf(spark: SparkSession, values: dict[str, str]) -> Iterator[None]:
    before = {k: spark.conf.get(k, None) for k in values}
    for k, v in values.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def first_of_each(stream: DataFrame, key: list[str], keep_for: str | None = None) -> DataFrame:
    """The rows of a stream of Parquet files whose ``key`` was not seen before; one with a null in its key is told apart by file and row,
    so it never conflicts.

    ``keep_for``, such as "30 days": how long a key is known after its arrival; None: for ever. Time is that of arrival, so no row is ever
    late, and a micro-batch that is run again has the time of its first run."""
    whole = F.lit(True)
    for c in key:
        whole = whole & F.col(c).isNotNull()
    own = F.when(~whole, F.struct(F.col("_metadata.file_path"), F.col("_metadata.row_index")))
    rows = stream.select("*", own.alias("_own_row"))
    if keep_for is None:
        return rows.dropDuplicates([*key, "_own_row"]).drop("_own_row")
    rows = rows.withColumn("_taken_at", F.current_timestamp()).withWatermark("_taken_at", keep_for)
    return rows.dropDuplicatesWithinWatermark([*key, "_own_row"]).drop("_own_row", "_taken_at")


def ingest_claims(spark: SparkSession, source: str, schema, target: str, log: str, key: list[str], files_per_batch: int = 1000, keep_for: str | None = None):
    """Take the new files at ``source`` into ``target``, a folder for each micro-batch; returns the finished query.

    A claim whose ``key`` was taken is left out. What was taken is state of the stream in RocksDB, partitioned by key and kept with ``log``
    in changes, so a micro-batch costs what it brings, whatever came before. A micro-batch that is run again (its executor or
    the driver was lost) starts from the state before it and writes over its own folder, so the outcome is the same.
    ``log`` and ``target`` belong together: with a new ``log`` all files are taken anew. The number of partitions of the state is that of
    spark.sql.shuffle.partitions at the first run.
    """
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(source)

    def put(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{target}/batch={number}")

    with _conf(spark, STATE_CONF):
        query = first_of_each(stream, key, keep_for).writeStream.option("checkpointLocation", log).trigger(availableNow=True).foreachBatch(put).start()
        query.awaitTermination()
    return query
