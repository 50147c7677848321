"""Checks that return their violations as rows: an empty frame means the contract holds."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SHA256 = r"\A[0-9a-f]{64}\z"


class ContractError(ValueError):
    pass


def assert_empty(violations: DataFrame, what: str) -> None:
    found = violations.limit(5).collect()
    if found:
        raise ContractError(f"{what}: {found}")


def duplicate_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def leaking_groups(df: DataFrame, key: str, split: str) -> DataFrame:
    """Keys that occur in more than one split; one partial aggregate before the shuffle."""
    return df.groupBy(key).agg(F.min(split).alias("first_split"), F.max(split).alias("last_split")).where("first_split <> last_split")


def overlapping(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Values of each key that occur on both sides."""
    return reduce(DataFrame.unionByName, [left.select(F.lit(k).alias("key"), F.col(k).cast("string").alias("value")).intersect(right.select(F.lit(k).alias("key"), F.col(k).cast("string").alias("value"))) for k in keys])


def roster_difference(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of one side only, with the side; multiplicities count."""
    a, b = left.select(*keys), right.select(*keys)
    return a.exceptAll(b).withColumn("side", F.lit("left")).unionByName(b.exceptAll(a).withColumn("side", F.lit("right")))


def not_in_plan(found: DataFrame, plan: DataFrame, keys: list[str]) -> DataFrame:
    return found.join(plan, keys, "left_anti")


def incomplete(df: DataFrame, key: str, slot: Column, expected: int) -> DataFrame:
    """Keys without exactly ``expected`` rows in as many different slots; ``slot`` numbers a row's part from 0 to 63.

    Slots are bits of one number, so partial aggregation sends one row a key and task, and repeats change nothing. A
    slot outside that range is an error, as its bit would stand for another.
    """
    number = F.when(slot.between(0, 63), slot).otherwise(F.raise_error(F.lit("a slot is no number from 0 to 63")).cast("int"))
    bits = F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), number.cast("int")))
    found = df.groupBy(key).agg(F.count("*").alias("n_rows"), F.bit_count(bits).cast("long").alias("n_parts"))
    return found.where((F.col("n_rows") != expected) | (F.col("n_parts") != expected))


def differing(left: DataFrame, right: DataFrame, keys: list[str], fields: list[str]) -> DataFrame:
    """Key matches whose listed fields are not all equal (null-safe)."""
    same = reduce(Column.__and__, [F.col(f"l.{c}").eqNullSafe(F.col(f"r.{c}")) for c in fields])
    return left.alias("l").join(right.alias("r"), [F.col(f"l.{k}") == F.col(f"r.{k}") for k in keys]).where(~same).select(*(F.col(f"l.{k}") for k in keys))


def failure_contract(df: DataFrame, score: str = "score", status: str = "status", reason: str = "failure_reason") -> DataFrame:
    """Rows that break: success has a finite score in [0, 1] and no reason, failed has no score and a reason."""
    finite = F.col(score).isNotNull() & ~F.isnan(score) & F.col(score).between(0.0, 1.0)
    good = ((F.col(status) == "success") & finite & F.col(reason).isNull()) | ((F.col(status) == "failed") & F.col(score).isNull() & (F.length(F.trim(F.col(reason))) > 0))
    return df.where(~F.coalesce(good, F.lit(False)))


def out_of_range(df: DataFrame, columns: list[str], low: float = 0.0, high: float = 1.0) -> DataFrame:
    bad = reduce(Column.__or__, [F.col(c).isNull() | F.isnan(c) | ~F.col(c).between(low, high) for c in columns])
    return df.where(bad)


def closed_schema(df: DataFrame, expected: list[str]) -> None:
    """Exactly these columns in any order, else ContractError; extra columns are as wrong as missing ones."""
    if sorted(df.columns) != sorted(expected):
        raise ContractError(f"columns {sorted(df.columns)}, expected {sorted(expected)}")


def manifest_violations(df: DataFrame, aliases: dict[str, str], digests: list[str], paths: list[str]) -> DataFrame:
    """Rows whose ids do not fullmatch their pattern, whose digests are no lower-case SHA-256 or whose paths leave the root."""
    checks = [F.col(c).rlike(rf"\A(?:{p})\z") for c, p in aliases.items()] + [F.col(c).rlike(SHA256) for c in digests]
    checks += [~F.col(c).startswith("/") & ~F.col(c).rlike(r"(?:^|/)\.\.(?:/|\z)") & (F.length(c) > 0) for c in paths]
    return df.where(~F.coalesce(reduce(Column.__and__, checks), F.lit(False)))


def reads_only(df: DataFrame, forbidden: list[str]) -> bool:
    """Whether the optimized plan reads none of ``forbidden``: the label-blind guarantee, asked of Catalyst."""
    plan = df._jdf.queryExecution().optimizedPlan()
    leaves = plan.collectLeaves()
    read = {leaves.apply(i).output().apply(j).name() for i in range(leaves.size()) for j in range(leaves.apply(i).output().size())}
    return not read & set(forbidden)
