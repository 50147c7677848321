"""How driver tables stand for the engine's relations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scored(spark: SparkSession, sf_dir: str, *more: Column) -> DataFrame:
    """Line items as scored queries: dataset, group, truth y, a heavily tied score_a and a score_b with gaps."""
    return table(spark, sf_dir, "lineitem").select(
        *more,
        F.col("l_returnflag").alias("ds"), F.col("l_suppkey").alias("grp"), F.col("l_linestatus").alias("finding"), F.col("l_linenumber").alias("variant"), (1 - 2 * F.col("l_discount")).alias("y"),
        (1 - 2 * F.col("l_tax")).alias("score_a"), F.when(F.col("l_linenumber") != 7, 1 - F.col("l_quantity") / 50).alias("score_b"),
    )


SCORED_SQL = """scored AS (SELECT l_returnflag AS ds, l_suppkey AS grp, l_linestatus AS finding, l_linenumber AS variant, 1 - 2 * l_discount AS y, 1 - 2 * l_tax AS score_a,
    CASE WHEN l_linenumber <> 7 THEN 1 - l_quantity / 50 END AS score_b FROM lineitem)"""


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Rows of a few bytes dealt out before they grow: a small file is one task, whatever its rows cost.

    The number is given, so adaptive execution leaves it; batches for Python are short, as rasters fill them.
    """
    spark = df.sparkSession
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "500")
    return df.repartition(4 * spark.sparkContext.defaultParallelism, *keys)


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles to six digits: float sums depend on the order of partitions."""
    return df.select(*((F.round(F.col(c), digits) + F.lit(0.0)).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes))


def register(queries: dict, oracles: dict, name: str, sql: str | None = None):
    def keep(f):
        queries[name] = f
        if sql:
            oracles[name] = sql
        return f

    return keep
