"""Truth, predictions, claims and reports on one complete denominator, failures kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..staging import written


def align_scores(truth: DataFrame, predictions: DataFrame, keys: list[str]) -> DataFrame:
    """Full outer match with its state: matched, missing (truth only), unknown (prediction only), duplicate.

    The caller requires every state but ``matched`` (and a null score, a kept failure) to be absent.
    """
    p = predictions.select(*keys, "score").groupBy(*keys).agg(F.min("score").alias("score"), F.count("*").alias("n_predictions"))
    t = truth.withColumn("in_truth", F.lit(True))
    state = F.when(F.col("in_truth").isNull(), "unknown").when(F.col("n_predictions").isNull(), "missing").when(F.col("n_predictions") > 1, "duplicate").otherwise("matched")
    return t.join(p, keys, "full_outer").withColumn("state", state).drop("in_truth")


def coverage_accounting(df: DataFrame, by: list[str], methods: dict[str, str]) -> DataFrame:
    """Per scope and method: nominal, scored, failed and coverage, and the rows scored by all methods (common)."""
    common = F.lit(True)
    for column in methods.values():
        common &= F.col(column).isNotNull()
    rows = df.withColumn("common", common).select(*by, "common", F.explode(F.create_map(*(x for m, c in methods.items() for x in (F.lit(m), F.col(c).cast("double"))))).alias("method", "score"))
    return rows.groupBy(*by, "method").agg(F.count("*").alias("nominal"), F.count("score").alias("scored"), F.count_if(F.col("score").isNull()).alias("failed"), (F.count("score") / F.count("*")).alias("coverage"), F.count_if("common").alias("common"))


def failure_histogram(df: DataFrame, by: list[str], reason: str = "failure_reason") -> DataFrame:
    """Per scope a map from failure reason to count."""
    counts = df.where(F.col(reason).isNotNull()).groupBy(*by, reason).agg(F.count("*").alias("n"))
    return counts.groupBy(*by).agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct(reason, "n")))).alias("reasons"))


def left_reports(reports: DataFrame, claims: DataFrame, key: str) -> DataFrame:
    """Every report with its number of claims and the claims' least confidence; a missing score makes it missing.

    Claims are reduced to their report before the join, so the join is one row to one row.
    """
    sums = claims.groupBy(key).agg(F.count("*").alias("n"), F.count_if(F.col("score").isNull()).alias("n_missing"), F.min("score").alias("least"), F.max(F.col("truth") < 0.9).alias("any_bad"))
    joined = reports.join(sums, key, "left")
    return joined.select(*reports.columns, F.coalesce("n", F.lit(0)).alias("n_claims"), F.when(F.col("n_missing") == 0, F.col("least")).alias("confidence"), F.coalesce("any_bad", F.lit(False)).alias("any_bad"))


def latest(df: DataFrame, key: list[str], order: list) -> DataFrame:
    """The last record of each key. A max over structs, so partial aggregation leaves one row per key and task."""
    rest = [c for c in df.columns if c not in key]
    return df.groupBy(*key).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("r")).select(*key, *(F.col(f"r.{c}").alias(c) for c in rest))


def pending(plan: DataFrame, cache: DataFrame, key: str, order: list, retry_errors: bool = False) -> DataFrame:
    """Planned keys still to run: never tried, or last tried with an error when errors are retried."""
    done = latest(cache, [key], order)
    done = done.where("status = 'success'") if retry_errors else done
    return plan.join(done.select(key), key, "left_anti")


def recover_slots(inputs: DataFrame, attempts: DataFrame, key: str, slots: int = 10) -> DataFrame:
    """input x slot with its first attempt; a failed slot stays failed, an untouched one is to run."""
    planned = inputs.select(key, F.explode(F.sequence(F.lit(0), F.lit(slots - 1))).alias("slot"))
    first = attempts.groupBy(key, "slot").agg(F.min_by("status", "attempt").alias("status"))
    return planned.join(first, [key, "slot"], "left").withColumn("status", F.coalesce("status", F.lit("pending")))


def chunked(df: DataFrame, order: list[str], size: int, by: list[str] | None = None) -> DataFrame:
    """Fixed-size batches in order. Without ``by`` rows are numbered by sorted partitions and offsets, not in one task."""
    if by:
        return df.withColumn("batch", F.floor((F.row_number().over(Window.partitionBy(*by).orderBy(*order)) - 1) / size).cast("long"))
    return numbered(df, order).withColumn("batch", F.floor(F.col("position") / size).cast("long"))


def numbered(df: DataFrame, order: list[str]) -> DataFrame:
    """0-based global positions: a range-partitioned sort, written once, and running sums of the sizes of its ranges.

    Bounds of ranges are sampled anew in each run of a shuffle, so what gives the sizes and what gives the places must
    be one table: rows are written with their range and their place inside it. The sums are one row a range. Rows with
    equal ``order`` get different positions, in no order to rely on.
    """
    ranges = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    row = F.monotonically_increasing_id()  # the partition in the bits from 33 on, the row in those below
    spread = df.repartitionByRange(ranges, *order).sortWithinPartitions(*order)
    ranked = written(spread.select("*", F.shiftright(row, 33).alias("__part"), row.bitwiseAND(F.lit((1 << 33) - 1)).alias("__within")), "numbered")
    sizes = ranked.groupBy("__part").agg(F.count("*").alias("__size"))
    before = F.coalesce(F.sum("__size").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    bases = sizes.select("__part", before.alias("__base"))
    return ranked.join(F.broadcast(bases), "__part").withColumn("position", F.col("__base") + F.col("__within")).drop("__part", "__within", "__base")
