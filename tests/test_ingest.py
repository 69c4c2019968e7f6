"""Claims out of a stream: once each, over restarts and replays, at a cost that does not grow with what came before."""

import os
from statistics import median

from claimspark.streaming.ingest import ingest_claims

SCHEMA = "entity string, field string, value long"


def arrive(spark, folder, rows):
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(folder)


def ingest(spark, tmp_path, **how):
    where = [str(tmp_path / x) for x in ("in", "out", "log")]
    return ingest_claims(spark, where[0], spark.createDataFrame([], SCHEMA).schema, where[1], where[2], ["entity", "field", "value"], **how)


def taken(spark, tmp_path):
    return sorted((r.entity, r.field or "", r.value) for r in spark.read.parquet(str(tmp_path / "out")).collect())


def test_restart_and_replay(spark, tmp_path):
    arrive(spark, str(tmp_path / "in"), [("a", "fee", 1), ("a", "fee", 1), ("b", "fee", 2), ("n", None, 4), ("n", None, 4)])
    ingest(spark, tmp_path)
    arrive(spark, str(tmp_path / "in"), [("a", "fee", 1), ("c", "fee", 3), ("n", None, 4)])
    ingest(spark, tmp_path)
    want = [("a", "fee", 1), ("b", "fee", 2), ("c", "fee", 3), ("n", "", 4), ("n", "", 4), ("n", "", 4)]
    assert taken(spark, tmp_path) == want
    last = max(int(f) for f in os.listdir(tmp_path / "log/commits") if f.isdigit())
    for f in (f"{last}", f".{last}.crc"):  # as if the driver was lost after the last folder was written
        if (tmp_path / "log/commits" / f).exists():
            (tmp_path / "log/commits" / f).rename(tmp_path / f"lost{f}")
    ingest(spark, tmp_path)
    assert taken(spark, tmp_path) == want


def test_fifty_batches_cost_the_same(spark, tmp_path):
    for i in range(50):
        arrive(spark, str(tmp_path / "in"), [(f"e{k}", "fee", k) for k in range(20 * i, 20 * i + 40)])
    seen = [p for p in ingest(spark, tmp_path, files_per_batch=1).recentProgress if p["numInputRows"]]
    assert len(seen) == 50 and {p["numInputRows"] for p in seen} == {40}  # nothing is read but what is new
    assert len(taken(spark, tmp_path)) == 1020
    took = [p["durationMs"]["addBatch"] for p in seen]
    assert median(took[-10:]) < 2 * median(took[5:15])
    assert seen[-1]["stateOperators"][0]["numRowsTotal"] == 1020


def test_keys_expire(spark, tmp_path):
    arrive(spark, str(tmp_path / "in"), [("a", "fee", 1)])
    ingest(spark, tmp_path, keep_for="1 hour")
    arrive(spark, str(tmp_path / "in"), [("a", "fee", 1), ("b", "fee", 2)])
    ingest(spark, tmp_path, keep_for="1 hour")
    assert taken(spark, tmp_path) == [("a", "fee", 1), ("b", "fee", 2)]


def test_a_key_is_new_again_when_its_time_is_over(spark, tmp_path):
    for entity in ("a", "b", "c", "a"):
        arrive(spark, str(tmp_path / "in"), [(entity, "fee", 1)])
        ingest(spark, tmp_path, keep_for="0 seconds")
    assert [x[0] for x in taken(spark, tmp_path)] == ["a", "a", "b", "c"]
