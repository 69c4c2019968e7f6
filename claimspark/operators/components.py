"""Merged entities: the connected components of pairwise decisions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from claimspark.operators.staging import discard, staged


def merge_components(pairs: DataFrame, a: str, b: str) -> DataFrame:
    """(key, primary): smallest key reachable, for keys in groups of two or more. Labels spread to neighbours and on
    to the label of one's label, so rounds grow with the logarithm of a chain. Each round is a table, removed when the next is written.
    Joins are by sorted partitions, for a table of whole numbers is small on disk and large when the driver holds it to send it round."""
    edges = pairs.select(F.col(a).alias("x"), F.col(b).alias("y")).where("x <> y")
    edges = staged(edges.unionByName(edges.select(F.col("y").alias("x"), F.col("x").alias("y"))).distinct(), "merge-edges")
    label = staged(edges.groupBy("x").agg(F.min("y").alias("l")).select("x", F.least("x", "l").alias("l")), "merge-labels")
    while True:
        near = edges.join(label.select(F.col("x").alias("y"), "l").hint("merge"), "y").groupBy("x").agg(F.min("l").alias("n"))
        step = label.join(near.hint("merge"), "x").select("x", "l", F.least("l", "n").alias("m"))
        up = label.select(F.col("x").alias("m"), F.col("l").alias("g"))
        new = staged(step.join(up.hint("merge"), "m", "left").select("x", F.col("l").alias("old"), F.least("m", F.coalesce("g", "m")).alias("l")), "merge-labels")
        discard(label)
        if new.where("old <> l").isEmpty():
            discard(edges)
            return new.select(F.col("x").alias("key"), F.col("l").alias("primary"))
        label = new
