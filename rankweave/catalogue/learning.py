"""Learners on line items."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import learn
from . import bind

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}

#: The closed form for two standardised columns, with both penalties on the diagonal.
_RIDGE = """WITH s AS (SELECT (l_tax - avg(l_tax) OVER ()) / stddev_pop(l_tax) OVER () AS a, (l_quantity - avg(l_quantity) OVER ()) / stddev_pop(l_quantity) OVER () AS b, 1 - 2 * l_discount AS y FROM lineitem),
m AS (SELECT count(*) AS n, sum(a * a) + 1.0::DOUBLE AS aa, sum(b * b) + 1.0::DOUBLE AS bb, sum(a * b) AS ab, sum(a * y) AS ay, sum(b * y) AS byy, avg(y) AS my FROM s)
SELECT 'l_tax' AS feature, round((ay * bb - byy * ab) / (aa * bb - ab * ab), 6) AS weight, round(my, 6) AS intercept FROM m UNION ALL SELECT 'l_quantity', round((byy * aa - ay * ab) / (aa * bb - ab * ab), 6), round(my, 6) FROM m"""


def _rows(spark, sf_dir: str) -> DataFrame:
    return bind.table(spark, sf_dir, "lineitem").select("l_suppkey", "l_tax", "l_quantity", (1 - 2 * F.col("l_discount")).alias("y"))


@bind.register(QUERIES, ORACLE_SQL, "ridge_fit", _RIDGE)
def ridge_fit(spark, sf_dir: str) -> DataFrame:
    columns = ["l_tax", "l_quantity"]
    rows = _rows(spark, sf_dir)
    model = learn.ridge(learn.standardised(rows, learn.standardiser(rows, columns)), columns, "y")
    return bind.rounded(spark.createDataFrame([(c, float(w), float(model.intercept)) for c, w in zip(columns, model.coefficients, strict=True)], "feature string, weight double, intercept double"))


@bind.register(QUERIES, ORACLE_SQL, "gbt_fit")
def gbt_fit(spark, sf_dir: str) -> DataFrame:
    """Error of boosted trees against the constant prediction."""
    columns = ["l_tax", "l_quantity"]
    rows = _rows(spark, sf_dir)
    out = learn.predict(learn.boosted(rows, columns, "y", rounds=5), rows, columns)
    return out.agg(F.count("*").alias("n"), F.avg(F.abs(F.col("y") - F.col("prediction"))).alias("mae"))


@bind.register(QUERIES, ORACLE_SQL, "logistic_combo")
def logistic_combo(spark, sf_dir: str) -> DataFrame:
    rows = _rows(spark, sf_dir).withColumn("bad", (F.col("y") < 0.9).cast("double"))
    model = learn.combination(rows, ["l_tax", "l_quantity"], "bad", "l_suppkey")
    return spark.createDataFrame([(c, float(w)) for c, w in zip(["l_tax", "l_quantity", "bias"], [*model.coefficients, model.intercept], strict=True)], "feature string, weight double")


@bind.register(QUERIES, ORACLE_SQL, "memberwise_l1", f"WITH {bind.SCORED_SQL} SELECT round(avg((abs(score_a - y) + abs(1 - score_a - y)) / 2), 6) AS loss FROM scored")
def memberwise_l1(spark, sf_dir: str) -> DataFrame:
    q = bind.scored(spark, sf_dir).withColumn("score_c", 1 - F.col("score_a"))
    return bind.rounded(learn.memberwise_l1(q, ["score_a", "score_c"], "y"))
