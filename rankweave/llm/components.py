"""Connected components of an edge table by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import discard, written

#: Into so many parts a hub's neighbours are split when they meet its smallest one; adaptive execution splits further.
SALTS = 8


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Link each node's larger (large) or smaller (not large) neighbours with the smallest of its neighbourhood."""
    if large:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    else:
        both = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"), F.explode(F.expr(f"sequence(0L, {SALTS - 1}L)")).alias("salt"))
    joined = both.withColumn("salt", F.pmod(F.xxhash64("v"), F.lit(SALTS))).join(least, ["u", "salt"])
    if large:
        out = joined.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(joined.select("u", F.col("m").alias("v")))
    return out.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of ``edges`` (u, v); component is the smallest node reachable.

    Every round is written to the shared folder, so nothing is recomputed and a lost executor costs one task. Rounds
    end when all edges are (node, smallest node) stars; their number grows with the logarithm of a component's width.
    An empty edge table gives an empty result.
    """
    now = written(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    while not _all_stars(now):
        last, now = now, written(_star(_star(now, True), False), "stars")
        discard(last)
    stars = now.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return stars.unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())


def _all_stars(edges: DataFrame) -> bool:
    """Whether every node is either the centre of its star (only a smaller end) or has one edge, to its centre."""
    ends = edges.select(F.col("u").alias("node"), F.lit(1).alias("up")).unionByName(edges.select(F.col("v").alias("node"), F.lit(0).alias("up")))
    # Partial sums first, so a hub is one row a task.
    return ends.groupBy("node").agg(F.sum("up").alias("up"), F.count("*").alias("n")).where("up > 0 AND n > 1").isEmpty()
