"""Array and scalar expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def l2_normalised(x: Column) -> Column:
    """Unit length; a zero or null vector is NULL (the caller treats it as a violation)."""
    norm = F.sqrt(dot(x, x))
    return F.when(norm > 0, F.transform(x, lambda v: v.cast("double") / norm))


def one_hot(index: Column, size: int) -> Column:
    return F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda i: (i == index).cast("float"))


def prompt_margin(image: Column, negative: Column, positive: Column) -> Column:
    return dot(image, negative) - dot(image, positive)


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def logit(p: Column, epsilon: float = 1e-6) -> Column:
    q = F.least(F.greatest(p, F.lit(epsilon)), F.lit(1 - epsilon))
    return F.log(q / (1 - q))


def absence(logit_: Column) -> Column:
    return 1 - sigmoid(logit_)


def clipped(x: Column) -> Column:
    return F.least(F.greatest(x, F.lit(0.0)), F.lit(1.0))


def binary_entropy(p: Column, epsilon: float = 1e-15) -> Column:
    q = F.least(F.greatest(p, F.lit(epsilon)), F.lit(1 - epsilon))
    return -(q * F.log2(q) + (1 - q) * F.log2(1 - q))


def log_softmax_at(logits: Column, index: Column) -> Column:
    """log p of the 0-based ``index``, by the stable max-shifted sum."""
    top = F.array_max(logits)
    return F.get(logits, index) - top - F.log(F.aggregate(logits, F.lit(0.0), lambda s, x: s + F.exp(x - top)))


def zeroed(x: Column, ranges: list[tuple[int, int]]) -> Column:
    """Features of the half-open ranges set to zero (ablation)."""
    hit = lambda i: F.array_contains(F.array(*(F.lit(k) for a, b in ranges for k in range(a, b))), i)
    return F.transform(x, lambda v, i: F.when(hit(i), F.lit(0.0).cast("float")).otherwise(v.cast("float")))


def joined_items(items: Column, connector: str = "or") -> Column:
    """'a', 'a or b', 'a, b, or c'."""
    n = F.size(items)
    return F.when(n < 3, F.array_join(items, f" {connector} ")).otherwise(F.concat(F.array_join(F.slice(items, 1, n - 1), ", "), F.lit(f", {connector} "), F.element_at(items, -1)))


def intensity(gray: Column) -> Column:
    """Bytes 0..255 to -1024..1024."""
    return F.transform(gray, lambda g: (g / 255.0 * 2 - 1) * 1024)


def channel_normalised(gray: Column, mean: list[float], std: list[float]) -> Column:
    return F.transform(F.array(*(F.struct(F.lit(m).alias("m"), F.lit(s).alias("s")) for m, s in zip(mean, std, strict=True))), lambda c: F.transform(gray, lambda g: (g / 255.0 - c["m"]) / c["s"]))
