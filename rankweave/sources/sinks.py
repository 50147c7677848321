"""Writers: a fresh place each time, an append log, and a sink that keeps failures."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.contracts import assert_empty, failure_contract
from .readers import files


def fresh(df: DataFrame, path: str, partition_by: list[str] | None = None) -> None:
    """Fails if the place exists; Spark's commit protocol makes the write all or nothing."""
    df.write.mode("errorifexists").partitionBy(*(partition_by or [])).parquet(path)


def append(df: DataFrame, path: str) -> None:
    df.write.mode("append").parquet(path)


def with_receipt(df: DataFrame, path: str, stage: str, keys: list[str]) -> DataFrame:
    """Write, and return the receipt: one row a file with its digest, and the rows and an order-free digest of the keys
    of the whole. ``readers.verified`` takes it."""
    fresh(df, path)
    spark = df.sparkSession
    n_rows, digest = spark.read.parquet(path).agg(F.count("*").alias("n_rows"), F.sum(F.xxhash64(*keys).cast("decimal(38,0)")).cast("string").alias("digest")).first()
    told = [F.lit(stage).alias("stage"), F.lit("completed").alias("status"), F.lit(n_rows).alias("n_rows"), F.lit(digest).alias("digest")]
    return files(spark, path, "*.parquet").select(*told, "name", F.col("sha256").alias("output_sha256"))


def all_inputs(roster: DataFrame, scores: DataFrame, key: str) -> DataFrame:
    """Every input exactly once: scored, failed with its reason, or failed as not attempted."""
    out = roster.select(key).join(scores, key, "left").withColumn("failure_reason", F.when(F.col("status").isNull(), "not_attempted").otherwise(F.col("failure_reason"))).withColumn("status", F.coalesce("status", F.lit("failed")))
    assert_empty(failure_contract(out), "failure contract")
    return out
