"""Fit-only standardisation and simple regressors."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GBTRegressor, LinearRegression
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def standardiser(fit: DataFrame, columns: list[str], least: float = 1e-6) -> dict[str, tuple[float, float]]:
    """Population mean and scale of each column on the fit split; a scale under ``least`` becomes 1. Never refit."""
    row = fit.agg(*(f(c).alias(f"{n}_{c}") for c in columns for n, f in (("m", F.avg), ("s", F.stddev_pop)))).first()
    return {c: (row[f"m_{c}"], row[f"s_{c}"] if row[f"s_{c}"] >= least else 1.0) for c in columns}


def standardised(df: DataFrame, moments: dict[str, tuple[float, float]]) -> DataFrame:
    return df.withColumns({c: (F.col(c) - m) / s for c, (m, s) in moments.items()})


def _vector(df: DataFrame, columns: list[str]) -> DataFrame:
    return VectorAssembler(inputCols=columns, outputCol="features").transform(df)


#: Rows of one part of what boosted trees keep in memory over their rounds.
PART_ROWS = 500_000


def dealt(df: DataFrame) -> DataFrame:
    """``df`` in parts of about ``PART_ROWS`` rows: a packed file opens to many times its size once rows are vectors."""
    return df.repartition(max(df.sparkSession.sparkContext.defaultParallelism, -(-df.count() // PART_ROWS)))


def ridge(df: DataFrame, columns: list[str], label: str, alpha: float = 1.0):
    """Ridge of penalty ``alpha`` on standardised columns. Spark scales the penalty by the label's spread."""
    n, sd = df.agg(F.count("*"), F.stddev_pop(label)).first()
    return LinearRegression(featuresCol="features", labelCol=label, solver="normal", elasticNetParam=0.0, standardization=False, regParam=alpha / n * sd).fit(_vector(df, columns))


def boosted(df: DataFrame, columns: list[str], label: str, depth: int = 4, rounds: int = 20):
    """Gradient boosted trees: the same kind of model as the vendor ones, not the same trees."""
    return GBTRegressor(featuresCol="features", labelCol=label, maxDepth=depth, maxIter=rounds, seed=17).fit(_vector(dealt(df.select(*columns, label)), columns))


def combination(df: DataFrame, columns: list[str], label: str, group: str, c: float = 1.0):
    """Weighted logistic combination: a row weighs 1 / its group's size, weights have mean 1."""
    sizes = df.groupBy(group).agg(F.count("*").alias("size"))
    rows, groups = df.count(), sizes.count()
    weighted = df.join(sizes, group).withColumn("w", F.lit(rows / groups) / F.col("size"))
    return LogisticRegression(featuresCol="features", labelCol=label, weightCol="w", standardization=False, regParam=1.0 / (c * rows)).fit(_vector(weighted, columns))


def predict(model, df: DataFrame, columns: list[str]) -> DataFrame:
    """Clipped to [0, 1]; a row with a missing feature keeps its place with a NULL prediction."""
    able = df.na.drop(subset=columns)
    out = model.transform(_vector(able, columns)).drop("features", "rawPrediction")
    scored = out.withColumn("prediction", F.least(F.greatest(F.col("prediction"), F.lit(0.0)), F.lit(1.0)))
    return scored.unionByName(df.where(F.greatest(*(F.col(c).isNull().cast("int") for c in columns)) == 1), allowMissingColumns=True)


def memberwise_l1(df: DataFrame, members: list[str], truth: str, beta: float | None = None) -> DataFrame:
    """Mean over members and rows of |error|, or of the smooth L1 with ``beta``."""
    e = [F.abs(F.col(m) - F.col(truth)) for m in members]
    parts = [F.when(x < beta, 0.5 * x * x / beta).otherwise(x - 0.5 * beta) for x in e] if beta else e
    return df.agg(F.avg(sum(parts[1:], parts[0]) / len(parts)).alias("loss"))


#: Regressors by name; each takes (fit rows, columns, label).
REGRESSORS: dict[str, Callable] = {"ridge": ridge, "gbt_shallow": boosted, "gbt_deep": lambda df, columns, label: boosted(df, columns, label, depth=6)}
