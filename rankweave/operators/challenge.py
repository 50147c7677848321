"""Challenge evaluation: the scope cube over fixed retention bins, input states, rosters and score faults."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Retention bins, and the input states: ineligible, construction failed, not attempted, scored, inference
#: failed, no upstream result.
BINS = ("[0,.5)", "[.5,.9)", "[.9,1]")
INELIGIBLE, BUILD_FAILED, OPEN, SCORED, RUN_FAILED, NO_UPSTREAM = range(6)


def retention_bin(target: Column) -> Column:
    """The bin of a target in [0, 1]; null for a missing target or one outside."""
    inside = target.between(0.0, 1.0) & ~F.isnan(target)
    return F.when(inside, F.when(target < 0.5, BINS[0]).when(target < 0.9, BINS[1]).otherwise(BINS[2]))


def challenge_cube(df: DataFrame, dataset: str, family: str, region: str, target: str, scores: list[str], families: list, regions: list) -> DataFrame:
    """Per dataset and every (family or all, region or all, bin or all): nominal rows of the scope, rows of the base
    scope (without bin) and those of it whose bin is unknown, rows scored, rows that all methods score, and each
    method's MAE on those. Scopes without a row are there with zeros.

    Rows are summed to the finest cells first; the cube then adds up at most 7 x 4 x 4 cells a dataset.
    """
    common = reduce(Column.__and__, (F.col(s).isNotNull() for s in scores)) & F.col("bin").isNotNull()
    sums = [F.sum(F.when(common, F.abs(F.col(target) - F.col(s)))).alias(f"sum_{s}") for s in scores] + [F.count_if(F.col(s).isNotNull() & F.col("bin").isNotNull()).alias(f"n_{s}") for s in scores]
    fine = df.withColumn("bin", retention_bin(F.col(target))).groupBy(dataset, family, region, "bin").agg(F.count("*").alias("nominal"), F.count_if(common).alias("common"), *sums)
    spread = lambda c: F.explode(F.array(F.col(c).cast("string"), F.lit("all")))
    cells = fine.withColumn("family", spread(family)).withColumn("region", spread(region))
    named = [f"sum_{s}" for s in scores] + [f"n_{s}" for s in scores]
    base = cells.groupBy(dataset, "family", "region").agg(F.sum("nominal").alias("base_nominal"), F.sum(F.when(F.col("bin").isNull(), F.col("nominal")).otherwise(0)).alias("unknown_bin"))
    binned = cells.withColumn("bin", F.explode(F.array(F.coalesce("bin", F.lit("unknown")), F.lit("all")))).where("bin <> 'unknown'")
    found = binned.groupBy(dataset, "family", "region", "bin").agg(*(F.sum(c).alias(c) for c in ("nominal", "common", *named)))
    axis = lambda values: F.explode(F.array(*(F.lit(str(v)) for v in ("all", *values))))
    spine = df.select(dataset).distinct().withColumn("family", axis(families)).withColumn("region", axis(regions)).withColumn("bin", axis(BINS))
    out = spine.join(found, [dataset, "family", "region", "bin"], "left").join(base, [dataset, "family", "region"], "left")
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return out.select(dataset, "family", "region", "bin", *map(zero, ("nominal", "base_nominal", "unknown_bin", "common")), *(zero(f"n_{s}") for s in scores), *(F.try_divide(F.col(f"sum_{s}"), F.col("common").cast("double")).alias(f"mae_{s}") for s in scores))


def state_faults(df: DataFrame, state: str, valid: str, targets: list[str], scores: list[str]) -> DataFrame:
    """Rows that break the rules of states, with the first rule they break."""
    s, eligible = F.col(state), F.col(state).isin(OPEN, SCORED, RUN_FAILED, NO_UPSTREAM)
    good = lambda c: F.col(c).isNotNull() & ~F.isnan(c) & F.col(c).between(0.0, 1.0)
    every = lambda columns, test: reduce(Column.__and__, map(test, columns))
    missing = lambda c: F.col(c).isNull() | F.isnan(c)
    fault = (
        F.when(~F.coalesce(s.between(INELIGIBLE, NO_UPSTREAM), F.lit(False)), "unknown state").when(~F.col(valid).eqNullSafe(eligible), "eligibility differs from state")
        .when(eligible & ~every(targets, good), "target missing or outside").when(~eligible & ~every(targets, missing), "target of an ineligible input")
        .when((s == SCORED) & ~every(scores, good), "score missing or outside").when((s != SCORED) & ~every(scores, missing), "score without success")
    )
    return df.withColumn("fault", fault).where("fault IS NOT NULL")


def state_counts(df: DataFrame, state: str) -> DataFrame:
    """Inputs by what became of them, and the queries of the scored ones (three an input)."""
    n = lambda k: F.count_if(F.col(state) == k)
    return df.agg(
        n(SCORED).alias("successful_inputs"), (3 * n(SCORED)).alias("successful_queries"), n(RUN_FAILED).alias("failed_inference_inputs"), n(OPEN).alias("unattempted_eligible_inputs"),
        n(NO_UPSTREAM).alias("upstream_unavailable_eligible_inputs"), n(INELIGIBLE).alias("construction_ineligible_inputs"), n(BUILD_FAILED).alias("construction_failed_inputs"),
    )


def roster_faults(sources: DataFrame, variants: list[str], records: DataFrame, same: list[str]) -> DataFrame:
    """(source_id, variant, fault): planned rows (source x variant) without exactly one record, records not planned, and
    records whose fields ``same`` differ from their source's."""
    plan = sources.select("source_id", *(F.col(c).alias(f"plan_{c}") for c in same), F.explode(F.array(*map(F.lit, variants))).alias("variant"))
    found = records.groupBy("source_id", "variant").agg(F.count("*").alias("n"), *(F.min(c).alias(c) for c in same), *(F.max(c).alias(f"last_{c}") for c in same))
    differs = reduce(Column.__or__, (~F.col(c).eqNullSafe(F.col(f"plan_{c}")) | ~F.col(f"last_{c}").eqNullSafe(F.col(f"plan_{c}")) for c in same))
    both = plan.withColumn("planned", F.lit(True)).join(found, ["source_id", "variant"], "full_outer")
    fault = F.when(F.col("planned").isNull(), "not planned").when(F.col("n").isNull(), "missing").when(F.col("n") > 1, "repeated").when(differs, "source identity differs")
    return both.select("source_id", "variant", fault.alias("fault")).where("fault IS NOT NULL")


def claims_with_truth(claims: DataFrame, truth: DataFrame, keys: list[str], same: list[str]) -> tuple[DataFrame, DataFrame]:
    """(claims with their truth, faults): every claim has exactly one truth row, whose fields ``same`` agree."""
    one = truth.groupBy(*keys).agg(F.count("*").alias("n_truth"), *(F.first(c).alias(f"truth_{c}") for c in truth.columns if c not in keys))
    both = claims.join(one, keys, "left")
    differs = reduce(Column.__or__, (~F.col(c).eqNullSafe(F.col(f"truth_{c}")) for c in same), F.lit(False))
    fault = F.when(F.col("n_truth").isNull(), "claim without truth").when(F.col("n_truth") > 1, "repeated truth").when(differs, "source identity differs")
    marked = both.withColumn("fault", fault)
    return marked.where("fault IS NULL").drop("fault", "n_truth"), marked.where("fault IS NOT NULL").select(*keys, "fault")


def score_faults(roster: DataFrame, scores: DataFrame, keys: list[str], same: list[str]) -> DataFrame:
    """(keys, fault): scores must name the exact roster, once each, with equal fields ``same``, and be a finite number
    with success or null without."""
    told = scores.groupBy(*keys).agg(F.count("*").alias("n"), F.first("score").alias("score"), F.first("status").alias("status"), *(F.first(c).alias(f"score_{c}") for c in same))
    both = roster.select(*keys, *same, F.lit(True).alias("planned")).join(told, keys, "full_outer")
    differs = reduce(Column.__or__, (~F.col(c).eqNullSafe(F.col(f"score_{c}")) for c in same), F.lit(False))
    success = F.coalesce(F.col("status") == "success", F.lit(False))
    fault = (
        F.when(F.col("planned").isNull(), "unexpected").when(F.col("n").isNull(), "missing").when(F.col("n") > 1, "repeated").when(differs, "identity differs")
        .when(F.col("score").isNull() & success, "successful null").when(F.col("score").isNotNull() & (~success | F.isnan("score") | F.abs("score").isin(float("inf"))), "invalid score")
    )
    return both.select(*keys, fault.alias("fault")).where("fault IS NOT NULL")


def matched_coverage(roster: DataFrame, by: list[str], scores: dict[str, DataFrame], keys: list[str]) -> DataFrame:
    """Per scope and method: claims nominal, scored, and scored by every method (common)."""
    rows = roster
    for name, df in scores.items():
        rows = rows.join(df.select(*keys, F.col("score").alias(f"score_{name}")), keys, "left")
    common = reduce(Column.__and__, (F.col(f"score_{name}").isNotNull() for name in scores))
    named = F.explode(F.array(*(F.struct(F.lit(name).alias("method"), F.col(f"score_{name}").isNotNull().alias("has")) for name in scores))).alias("m")
    return rows.select(*by, common.alias("common"), named).groupBy(*by, "m.method").agg(F.count("*").alias("nominal"), F.count_if("m.has").alias("scored"), F.count_if("common").alias("common"))
