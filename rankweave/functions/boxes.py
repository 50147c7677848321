"""Crop and viewport boxes as column expressions; sizes are rounded half to even."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SIDES = ("top", "bottom", "left", "right")
#: name -> removed share at (left, top, right, bottom); fixed values.
CROPS = {
    "original": (0.0, 0.0, 0.0, 0.0),
    **{f"{s}_{round(100 * f)}": tuple(f if s == k else 0.0 for k in ("left", "top", "right", "bottom")) for s in SIDES for f in (0.1, 0.2)},
    **{f"{v}_{h}_15": tuple(0.15 if k in (v, h) else 0.0 for k in ("left", "top", "right", "bottom")) for v in ("top", "bottom") for h in ("left", "right")},
}
UNSEEN = {
    "original": (0.0, 0.0, 0.0, 0.0),
    **{f"{s}_{p:02d}": tuple(p / 100 if s == k else 0.0 for k in ("left", "top", "right", "bottom")) for s in SIDES for p in (5, 30)},
    "left07_right23": (0.07, 0.0, 0.23, 0.0), "left23_right07": (0.23, 0.0, 0.07, 0.0), "top07_bottom23": (0.0, 0.07, 0.0, 0.23), "top23_bottom07": (0.0, 0.23, 0.0, 0.07),
}
#: Outer and inner crop of each side: a nested pair, the inner one never shows more.
NESTED = tuple(x for s in SIDES for x in (("original", f"{s}_05"), (f"{s}_05", f"{s}_30")))


def crop_table(w: Column, h: Column, crops: dict[str, tuple]) -> Column:
    """One array of (slot, name, x0, y0, x1, y1); explode it."""

    def box(slot: int, name: str, left: float, top: float, right: float, bottom: float) -> Column:
        cut = lambda share, size: F.bround(F.lit(share) * size).cast("int")
        return F.struct(
            F.lit(slot).alias("slot"), F.lit(name).alias("name"), cut(left, w).alias("x0"), cut(top, h).alias("y0"),
            (w - cut(right, w)).cast("int").alias("x1"), (h - cut(bottom, h)).cast("int").alias("y1"),
        )

    return F.array(*(box(k, name, *shares) for k, (name, shares) in enumerate(crops.items())))


def viewport(x0: Column, y0: Column, x1: Column, y1: Column, side: int = 518) -> Column:
    """The part of the source that a processor shows: shorter edge resized to ``side``, centre crop, mapped back."""
    cw, ch = x1 - x0, y1 - y0
    rw = F.when(cw <= ch, F.lit(side)).otherwise(F.floor(F.lit(side) * cw / ch))
    rh = F.when(cw <= ch, F.floor(F.lit(side) * ch / cw)).otherwise(F.lit(side))
    left, top, sx, sy = F.floor((rw - side) / 2), F.floor((rh - side) / 2), rw / cw, rh / ch
    return F.struct((x0 + left / sx).alias("vx0"), (y0 + top / sy).alias("vy0"), (x0 + (left + side) / sx).alias("vx1"), (y0 + (top + side) / sy).alias("vy1"))


def intersection_area(a: tuple, b: tuple) -> Column:
    wide = F.greatest(F.lit(0.0), F.least(a[2], b[2]).cast("double") - F.greatest(a[0], b[0]))
    return wide * F.greatest(F.lit(0.0), F.least(a[3], b[3]).cast("double") - F.greatest(a[1], b[1]))


def rle_runs(text: Column) -> Column:
    """'start length start length ...' as an array of structs; 1-based starts."""
    numbers = F.transform(F.filter(F.split(F.trim(text), r"\s+"), lambda x: x != ""), lambda x: x.cast("long"))
    return F.transform(F.sequence(F.lit(0), F.floor(F.size(numbers) / 2).cast("int") - 1), lambda k: F.struct(F.get(numbers, 2 * k).alias("start"), F.get(numbers, 2 * k + 1).alias("length")))


def rle_area(text: Column) -> Column:
    return F.when(F.trim(text) == "", F.lit(0).cast("long")).otherwise(F.aggregate(rle_runs(text), F.lit(0).cast("long"), lambda s, x: s + x["length"]))


def rle_violation(text: Column, height: Column, width: Column) -> Column:
    """An odd count of numbers, an empty run or one outside the image."""
    odd = F.size(F.filter(F.split(F.trim(text), r"\s+"), lambda x: x != "")) % 2 == 1
    return odd | F.exists(rle_runs(text), lambda x: (x["start"] < 1) | (x["length"] < 1) | (x["start"] - 1 + x["length"] > height * width))
