"""Paired cluster bootstraps: statistics are summed to groups first, then weighted by how often a group is drawn.

Draw j of replicate b is the index sha2("seed:b:j") mod n into the groups in order; groups without rows count in n. The
draws table has replicates times groups rows at most and is never joined with row-level data.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .align import numbered
from .ranking import same_scope


def hash_draws(groups: DataFrame, strata: list[str], group: str, replicates: int, seed: int = 17) -> DataFrame:
    """(strata, rep, group, w): multiplicities by stratum; ``groups`` has one row per group, also those without rows."""
    # Groups are numbered over all strata in order; a stratum's first number makes its own.
    places = numbered(groups.select(*strata, group), [*strata, group])
    firsts = places.groupBy(*strata).agg(F.min("position").alias("first"), F.count("*").alias("size"))
    joined = places.alias("x").join(firsts.alias("y"), same_scope(strata, "x", "y"))
    numbers = joined.select(*(f"x.{c}" for c in (*strata, group)), (F.col("position") - F.col("first")).alias("k"), "size")
    name = F.concat_ws(":", *strata, F.lit(str(seed)), F.col("rep"), F.col("k"))
    drawn = numbers.select(*strata, "k", "size", F.explode(F.sequence(F.lit(0), F.lit(replicates - 1))).alias("rep"))
    picks = drawn.select(*strata, "rep", F.pmod(F.conv(F.substring(F.sha2(name, 256), 1, 12), 16, 10).cast("long"), F.col("size")).alias("k"))
    return picks.groupBy(*strata, "rep", "k").agg(F.count("*").alias("w")).join(numbers.select(*strata, "k", group), [*strata, "k"]).select(*strata, "rep", group, "w")


def generator_draws(spark: SparkSession, n_groups: int, replicates: int, seed: int = 17) -> DataFrame:
    """(rep, k, w) from numpy's default generator: the multiplicities of ``integers(0, n, n)`` for each replicate.

    The stream is sequential, so it is made on the driver: replicates times groups numbers, for parity runs only.
    """
    rng = np.random.default_rng(seed)
    rows = []
    for rep in range(replicates):
        k, w = np.unique(rng.integers(0, n_groups, n_groups), return_counts=True)
        rows += list(zip([rep] * len(k), k.tolist(), w.tolist(), strict=True))
    return spark.createDataFrame(rows, "rep int, k long, w long")


def regression_statistics(df: DataFrame, by: list[str], truth: str, score: str) -> DataFrame:
    """Sufficient statistics of MAE and RMSE per group."""
    e = F.col(truth) - F.col(score)
    return df.where(F.col(truth).isNotNull() & F.col(score).isNotNull()).groupBy(*by).agg(F.count("*").alias("n"), F.sum(F.abs(e)).alias("a"), F.sum(e * e).alias("q"))


def intervals(values: DataFrame, by: list[str], value: str, low: float = 0.025, high: float = 0.975) -> DataFrame:
    """Exact linear-interpolated percentiles over replicates, with how many were defined."""
    return values.groupBy(*by).agg(
        F.percentile(value, F.lit(low)).alias("low"), F.percentile(value, F.lit(high)).alias("high"), F.count(value).alias("n_valid"), F.count_if(F.col(value).isNull()).alias("n_undefined")
    )


def bootstrap_regression(df: DataFrame, strata: list[str], group: str, truth: str, score: str, replicates: int, groups: DataFrame | None = None) -> DataFrame:
    """(strata, rep, mae, rmse); a replicate whose drawn groups hold no row is NULL."""
    statistics = regression_statistics(df, [*strata, group], truth, score)
    groups = df.select(*strata, group).distinct() if groups is None else groups
    draws = hash_draws(groups, strata, group, replicates)
    joined = draws.join(statistics, [*strata, group], "left")
    total = joined.groupBy(*strata, "rep").agg(*(F.sum(F.col("w") * F.col(c)).alias(c) for c in "naq"))
    return total.select(*strata, "rep", F.try_divide("a", F.col("n").cast("double")).alias("mae"), F.sqrt(F.try_divide("q", F.col("n").cast("double"))).alias("rmse"))
