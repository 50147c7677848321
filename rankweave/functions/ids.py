"""Content-addressed ids, hash splits and named hash uniforms, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def json_string(x: Column) -> Column:
    """A string as canonical JSON. Ids must not hold control characters other than \\n \\t \\r \\b \\f."""
    return F.regexp_extract(F.to_json(F.array(x)), r"(?s)\A\[(.*)\]\z", 1)


def json_list(*parts: Column) -> Column:
    """Canonical JSON of a flat list; strings are quoted by ``json_string``, numbers are cast."""
    return F.concat(F.lit("["), F.concat_ws(",", *parts), F.lit("]"))


def stable_hash(*parts: Column) -> Column:
    return F.sha2(json_list(*parts), 256)


def hash_mod(digest: Column, m: int) -> Column:
    """A 256-bit hex digest modulo ``m`` (up to 2**31): a fold over its ten leading-zero-padded groups of seven digits."""
    padded = F.lpad(digest, 70, "0")
    groups = F.array(*(F.conv(F.substring(padded, 1 + 7 * k, 7), 16, 10).cast("long") for k in range(10)))
    return F.aggregate(groups, F.lit(0).cast("long"), lambda s, x: F.pmod(s * F.lit(1 << 28) + x, F.lit(m)))


def hash_uniform(digest: Column) -> Column:
    """The first 53 bits of a digest as a double in [0, 1)."""
    return F.shiftrightunsigned(F.conv(F.substring(digest, 1, 16), 16, -10).cast("long"), 11) / F.lit(float(2**53))


def hash_choice(values: list, digest: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, values)), (F.floor(hash_uniform(digest) * len(values)) + 1).cast("int"))


def sampling_seed(digest: Column, index: Column, base: int = 20260922) -> Column:
    return F.pmod(F.lit(base) + index + F.conv(F.substring(digest, 1, 8), 16, 10).cast("long"), F.lit(2**31 - 1))


def claim_id(version: str, text: Column, start: Column, end: Column, finding: Column) -> Column:
    zero = F.lit("\0")
    named = F.concat(F.lit(version), zero, text, zero, start.cast("string"), F.lit(":"), end.cast("string"), F.lit(":"), finding)
    return F.concat(F.lit("claim_"), F.substring(F.sha2(named, 256), 1, 24))


def partition_of(source: Column, official: Column, seed: str) -> Column:
    """Train: a tenth to test, else fit. Val: halves to dev and calibration. Anything else is NULL (a violation)."""
    digest = F.sha2(F.concat(F.lit(seed), source), 256)
    return F.when(official == "Train", F.when(hash_mod(digest, 10) == 0, "test").otherwise("fit")).when(official == "Val", F.when(hash_mod(digest, 2) == 0, "dev").otherwise("calibration"))


def family_key(filename: Column, otherwise: Column) -> Column:
    """``person12_...`` and ``IM-0001-...`` names by family, others by their own key."""
    stem = F.regexp_extract(filename, r"([^/]*?)(?:\.[^./]*)?\z", 1)
    person, image = F.regexp_extract(stem, r"\A(person\d+)_", 1), F.regexp_extract(stem, r"\A((?:NORMAL2-)?IM-\d+)-", 1)
    return F.when(person != "", F.concat(F.lit("family:"), person)).when(image != "", F.concat(F.lit("family:"), image)).otherwise(F.concat(F.lit("image:"), otherwise))
