"""Tables between steps: written to the folder that driver and executors share, read back, removed when spent."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own: list[str] = []


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir of the session. Where that is unset a folder of this process serves, if all tasks run here, as in tests."""
    there = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if there:
        return there.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir is to name a folder that the driver and all executors share")
    if not _own:
        _own.append(tempfile.mkdtemp(prefix="claimspark-"))
        atexit.register(shutil.rmtree, _own[0], ignore_errors=True)
    return f"file://{_own[0]}"


def staged(df: DataFrame, label: str) -> DataFrame:
    """``df`` as a table of its own: later steps start from it, whatever is lost."""
    path = f"{shared_folder(df.sparkSession)}/claimspark/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._staged_path = path
    return out


def discard(*tables: DataFrame) -> None:
    """Remove tables of ``staged`` that no later step reads."""
    for t in tables:
        hadoop = t.sparkSession._jvm.org.apache.hadoop.fs.Path(t._staged_path)
        hadoop.getFileSystem(t.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(hadoop, True)
