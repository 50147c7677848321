"""Corpus pipeline: toxicity, near duplicates, benchmark decontamination, personal data, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes each stage's result as Parquet in the
shared folder and reads it as the next one's documents. All stages but the last keep the columns of ``documents``.
A row without a doc_id is no document that a verdict could name; it goes with the near duplicates.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rankweave.llm.decontamination import decontaminate
from rankweave.llm.jaccard_join import jaccard_components
from rankweave.llm.packing import pack_documents, word_vocabulary
from rankweave.llm.pii import redact_documents
from rankweave.llm.shared import checked_broadcast, small_batches, table, written
from rankweave.llm.toxicity import toxicity_scores

#: Rows (doc_id) of rejected documents that may be broadcast.
BROADCAST_ROWS = 1_000_000


def _without(docs: DataFrame, rejected: DataFrame) -> DataFrame:
    """Rejected ids are far fewer than documents; beyond the checked size Spark shuffles instead."""
    return docs.join(checked_broadcast(written(rejected.select("doc_id").distinct(), "rejected"), BROADCAST_ROWS), "doc_id", "left_anti").select(*docs.columns)


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return _without(docs, toxicity_scores(docs, table(spark, sf_dir, "labels")).where("predicted = 1"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The smallest doc_id of each group stays; of several rows with one doc_id, the one with the smallest text."""
    small_batches(spark)
    left = _without(docs.where("doc_id IS NOT NULL"), jaccard_components(docs).where(F.col("component_id") != F.col("doc_id")))
    # Only the rows of repeated ids move, in chunks that partial aggregation has made one row a task.
    repeated = written(docs.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").select("doc_id"), "repeated")
    once = left.join(checked_broadcast(repeated, BROADCAST_ROWS), "doc_id", "left_anti")
    rest = [c for c in docs.columns if c != "doc_id"]
    several = left.join(checked_broadcast(repeated, BROADCAST_ROWS), "doc_id", "left_semi").groupBy("doc_id").agg(F.min(F.struct("text", *(c for c in rest if c != "text"))).alias("r"))
    return once.select(*docs.columns).unionByName(several.select("doc_id", "r.*").select(*docs.columns))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate(docs, table(spark, sf_dir, "benchmark"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return redact_documents(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return pack_documents(docs, word_vocabulary())


STAGES = [
    ("toxicity", toxicity),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("personal_data", personal_data),
    ("packing", packing),
]
#: Learned scores and a tokenizer cannot be said in SQL; tests/llm/test_pipeline.py holds each stage against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name)
    return docs
