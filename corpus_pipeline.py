"""The corpus pipeline: documents through five stages, each a table that the next one reads.

Toxic documents go; of equal texts one stays; of each group of near copies one stays; sources are mixed to their
target weights (a document served twice stands there twice); what is left is packed into sequences.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from claimspark.llm.common import stage, table
from claimspark.llm.exact_dedup import keep_first_of_equal
from claimspark.llm.mixing import mixed_documents
from claimspark.llm.near_documents import keep_one_of_near
from claimspark.llm.packing import pack_documents
from claimspark.llm.tokens import default_tokenizer
from claimspark.llm.toxicity import drop_toxic, train_on


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return drop_toxic(docs, train_on(docs, table(spark, sf_dir, "labels")))


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return keep_first_of_equal(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return keep_one_of_near(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixed_documents(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pack_documents(docs, default_tokenizer())


STAGES = [("toxicity", toxicity), ("exact_dedup", exact_dedup), ("near_dedup", near_dedup), ("mixing", mixing), ("packing", packing)]

#: Components of near copies and best-fit packing are beyond SQL; tests hold the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, step in STAGES[:-1]:
        docs = stage(step(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
