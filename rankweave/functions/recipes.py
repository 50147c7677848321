"""Seeded augmentation recipes as column expressions: thirteen slots a source, drawn from named digests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .boxes import SIDES
from .ids import hash_uniform, json_string, stable_hash

#: The fractions' range, the limit of an axis, and which edges each slot cuts (slots 5 and 6 draw theirs).
LOW, WIDE, AXIS = 0.02, 0.26, 0.4
EDGES = ((), *((s,) for s in SIDES), None, None, ("top", "left"), ("top", "right"), ("bottom", "left"), ("bottom", "right"), ("top", "bottom"), ("left", "right"))
FAMILIES = ("original", *["single_edge"] * 6, *["adjacent_edges"] * 4, *["opposed_edges"] * 2)
CORNERS = ("top_left", "top_right", "bottom_left", "bottom_right")


def named_uniform(version: str, seed: int, source: Column, digest: Column, slot: Column, name: str) -> Column:
    return hash_uniform(stable_hash(json_string(F.lit(version)), F.lit(str(seed)), json_string(source), json_string(digest), slot.cast("string"), json_string(F.lit(name))))


def recipes(df: DataFrame, version: str, width: str, height: str, source: str, digest: str, seed: int = 17) -> DataFrame:
    """Thirteen rows for each of ``df``: its columns, and slot, family, edges, x0, y0, x1, y1, nuisance, amount, corner.

    Each cut edge loses a drawn fraction, at least one pixel; opposite edges share the axis' limit in proportion. Sizes
    under 32 are an error. Slots are opened first, so one expression serves them all.
    """
    good = (F.col(width) >= 32) & (F.col(height) >= 32)
    opened = df.where(F.when(good, True).otherwise(F.raise_error(F.lit("a recipe needs both sizes to be 32 or more")).cast("boolean"))).select("*", F.explode(F.sequence(F.lit(0), F.lit(12))).alias("slot"))
    slot = F.col("slot")
    u = lambda name: named_uniform(version, seed, F.col(source), F.col(digest), slot, name)
    pick = lambda values, name: F.element_at(F.array(*map(F.lit, values)), (F.floor(u(name) * len(values)) + 1).cast("int"))
    fixed = F.array(*(F.array(*map(F.lit, e or ())).cast("array<string>") for e in EDGES))
    cut = opened.withColumn("family", F.element_at(F.array(*map(F.lit, FAMILIES)), slot + 1)).withColumn("edges", F.when(slot.isin(5, 6), F.array(pick(SIDES, "edge"))).otherwise(F.element_at(fixed, slot + 1)))
    cut = cut.withColumns({f"__{s}": F.when(F.array_contains("edges", s), F.lit(LOW) + F.lit(WIDE) * u(s)) for s in SIDES})
    total = {s: F.col(f"__{a}") + F.col(f"__{b}") for a, b in (("top", "bottom"), ("left", "right")) for s in (a, b)}
    size = {"top": height, "bottom": height, "left": width, "right": width}
    capped = {s: F.when((F.col("family") == "opposed_edges") & (total[s] > AXIS), F.col(f"__{s}") * (F.lit(AXIS) / total[s])).otherwise(F.col(f"__{s}")) for s in SIDES}
    gone = {s: F.coalesce(F.greatest(F.lit(1), F.floor(capped[s] * F.col(size[s])).cast("int")), F.lit(0)) for s in SIDES}
    gone = {s: F.when(F.col(f"__{s}").isNotNull(), x).otherwise(0) for s, x in gone.items()}
    fill = (slot == 11) & (u("padding_mode") < 0.5)
    return cut.select(
        *df.columns, "slot", "family", "edges", gone["left"].alias("x0"), gone["top"].alias("y0"), (F.col(width) - gone["right"]).cast("int").alias("x1"), (F.col(height) - gone["bottom"]).cast("int").alias("y1"),
        F.when(slot == 3, "brightness").when(slot == 7, "blur").when(fill, "padding_fill").when(slot == 11, "padding_offset").otherwise("none").alias("nuisance"),
        F.when(slot == 3, pick((0.8, 1.2), "brightness")).when(slot == 7, 1.0).when(fill, 63.0).alias("amount"), F.when((slot == 11) & ~fill, pick(CORNERS, "corner")).otherwise("center").alias("corner"),
    )
