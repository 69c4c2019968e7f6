"""Shared plumbing of the training-data operators: staged tables, text rules, connected components."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: A word is a run of anything but space, tab, LF, VT, FF, CR; bytes.split() cuts at exactly these six.
WORD_RE = r"[^\x20\x09-\x0D]+"

_own_dir: str | None = None


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir of the session; a folder of this process only where that is unset and all tasks run here, as in tests."""
    global _own_dir
    there = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if there:
        return there.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if _own_dir is None:
        _own_dir = tempfile.mkdtemp(prefix="claimspark-")
        atexit.register(shutil.rmtree, _own_dir, ignore_errors=True)
    return f"file://{_own_dir}"


def staged_path(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/claimspark/{label}-{uuid.uuid4().hex}"


#: Rows of whole texts, or of blocks of them, that go to Python at once: as many megabytes stand in the executor's JVM and in each worker.
TEXTS, BLOCKS = 1024, 4


@contextmanager
def batches_of(spark: SparkSession, rows: int) -> Iterator[None]:
    """For what is run inside: Python gets at most so many rows at once."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, str(rows))
    try:
        yield
    finally:
        spark.conf.set(key, before)


def stage(df: DataFrame, label: str) -> DataFrame:
    """Cut the lineage: write ``df`` as a table in the shared folder and read it back.

    A lost executor then costs the rows in flight, never the stages before, and values that depend on the
    partitioning (row numbers) stay as they were written.
    """
    path = staged_path(df.sparkSession, label)
    df.write.option("compression", "zstd").parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._staged_at = path
    return out


def drop_staged(*tables: DataFrame) -> None:
    """Remove tables of ``stage`` that no later plan reads."""
    for t in tables:
        jvm, path = t.sparkSession._jvm, t._staged_at
        at = jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(t.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(at, True)


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z only; null counts as empty. lower() does the same, faster, where all characters are ASCII."""
    text = F.coalesce(text, F.lit(""))
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Column names that ``df`` doesn't have, whatever its case rules; one for each of ``names``."""
    there = {c.lower() for c in df.columns}
    out = []
    for n in names:
        n = f"_{n}"
        while n.lower() in there:
            n = "_" + n
        out.append(n)
        there.add(n.lower())
    return out


def parts_for(df: DataFrame, rows_each: int) -> int:
    """Groups of about ``rows_each`` rows that ``df`` needs; one at least."""
    return max(1, -(-df.count() // rows_each))


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root): root is the smallest node reachable over the undirected ``edges``; nodes without edges are absent.

    Alternating large-star and small-star rounds. Only minima and joins on the node are used, so a hub is
    pre-aggregated and its join partition can be split; no component is gathered anywhere. Each round is a table.
    """
    e = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct()
    e = stage(e, "cc")
    mark = None
    while True:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        moved = large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        last, e = e, stage(moved.unionByName(low.withColumnRenamed("m", "v")).distinct(), "cc")
        drop_staged(last)
        now = e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == mark:
            break
        mark = now
    roots = e.select(F.col("v").alias("node")).distinct().select("node", F.col("node").alias("root"))
    return e.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots)
