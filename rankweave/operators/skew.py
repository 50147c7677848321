"""Joins that stay even when one key holds a large share of the rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def sized_join(left: DataFrame, right: DataFrame, keys: list[str], size: str, most: int = 100_000) -> DataFrame:
    """Left join with a (written) table of one row a key, whose column ``size`` says how many left rows hold the key.

    Keys of over ``most`` rows, of which there are rows / ``most`` at the utmost, are broadcast, so their rows stay where
    they are; the other keys meet by a shuffle in which no key is hot.
    """
    hot, cold = right.where(F.col(size) > most).drop(size), right.where(F.col(size) <= most).drop(size)
    if hot.isEmpty():
        return left.join(cold, keys, "left")
    here = left.join(F.broadcast(hot.withColumn("is_hot", F.lit(True))), keys, "left")
    named = here.where("is_hot").drop("is_hot")
    return named.unionByName(left.join(F.broadcast(hot.select(*keys)), keys, "left_anti").join(cold, keys, "left"))


def salted_join(left: DataFrame, right: DataFrame, keys: list[str], size: str, most: int = 100_000, broadcast_rows: int = 1_000_000) -> DataFrame:
    """Left join with a table of one row a key, whose column ``size`` says how many left rows hold the key.

    A key of over ``most`` rows gets one salt for every ``most`` of them: its right row is repeated a salt, its left
    rows are dealt over the salts, so no task meets more than about ``most`` rows of one key. Only the hot keys and
    their number of salts are broadcast (there are rows / ``most`` at the utmost), and that only up to
    ``broadcast_rows`` of them; the payload never is.
    """
    salts = F.ceil(F.col(size) / most).cast("long")
    hot = right.where(F.col(size) > most).select(*keys, salts.alias("__salts"))
    payload = right.withColumn("__salt", F.explode(F.sequence(F.lit(0).cast("long"), salts - 1))).drop(size)
    found = hot.count()
    if not found:
        return left.join(right.drop(size), keys, "left")
    marked = left.join(F.broadcast(hot) if found <= broadcast_rows else hot, keys, "left")
    dealt = marked.withColumn("__salt", F.coalesce(F.pmod(F.monotonically_increasing_id(), F.col("__salts")), F.lit(0).cast("long"))).drop("__salts")
    return dealt.join(payload, [*keys, "__salt"], "left").drop("__salt")
