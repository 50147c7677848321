"""Spans inside a text, by folds that carry a place and a result, never a growing array."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def containing_piece(pieces: Column, gap: int, start: int, end: int) -> Column:
    """struct(a, b) of the piece that holds [start, end), null if none does; pieces stand ``gap`` code points apart."""
    nothing = F.lit(None).cast("int")
    first = F.struct(F.lit(0).alias("at"), nothing.alias("a"), nothing.alias("b"))

    def step(s: Column, x: Column) -> Column:
        until = s["at"] + F.length(x)
        here = (s["at"] <= start) & (until >= end) & s["a"].isNull()
        return F.struct((until + gap).alias("at"), F.when(here, s["at"]).otherwise(s["a"]).alias("a"), F.when(here, until).otherwise(s["b"]).alias("b"))

    return F.aggregate(pieces, first, step, lambda s: F.when(s["a"].isNotNull(), F.struct(s["a"].alias("a"), s["b"].alias("b"))))


def overlapping_sum(pieces: Column, gap: int, start: int, end: int, value: Callable[[Column], Column]) -> Column:
    """struct(n, total): pieces that overlap [start, end) and the sum of their values."""
    first = F.struct(F.lit(0).alias("at"), F.lit(0).cast("long").alias("n"), F.lit(0.0).alias("total"))

    def step(s: Column, x: Column) -> Column:
        until = s["at"] + F.length(x)
        here = (until > start) & (s["at"] < end)
        return F.struct((until + gap).alias("at"), (s["n"] + here.cast("long")).alias("n"), (s["total"] + F.when(here, value(x)).otherwise(0.0)).alias("total"))

    return F.aggregate(pieces, first, step, lambda s: F.struct(s["n"].alias("n"), s["total"].alias("total")))
