"""Tie-aware ranking metrics over tie blocks.

A tie block holds all rows of one scope with one score, reduced to counts and sums before any window runs. Windows see
one row per distinct score and never a whole scope: a scope's scores are cut into buckets at approximate quantiles, sums
of whole buckets are added up first, and a window runs inside each bucket. "Bad" is a truth under ``CUT``. Labels never
break ties: expectations inside a block are closed forms with harmonic numbers, which are column expressions, so no
table of them is joined. A truth or score that is no finite number is an error; one that is null leaves its row out.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..staging import written

CUT = 0.9
#: Buckets of a scope's scores; a window sees about one in so many of its distinct values.
BUCKETS = 128
#: Scopes whose cuts (a kilobyte each) and sums of buckets (``BUCKETS`` rows each) are broadcast; more meet by a shuffle.
BROADCAST_SCOPES = 1_000
COVERAGES = (0.5, 0.6, 0.7, 0.8, 0.9, 1.0)


def harmonic(k: Column) -> Column:
    """H(k) = 1 + 1/2 + ... + 1/k: summed up to 32, the Euler-Maclaurin series (error under 1e-14) beyond."""
    x = F.greatest(k, F.lit(1)).cast("double")
    series = F.log(x) + F.lit(0.5772156649015329) + 1 / (2 * x) - 1 / (12 * x**2) + 1 / (120 * x**4) - 1 / (252 * x**6)
    short = F.aggregate(F.sequence(F.lit(1), F.least(F.greatest(k, F.lit(1)), F.lit(32)).cast("int")), F.lit(0.0), lambda s, i: s + 1 / i.cast("double"))
    return F.when(k <= 0, 0.0).when(k <= 32, short).otherwise(series)


def only_finite(df: DataFrame, *columns: str) -> DataFrame:
    """The same rows; a task that meets NaN or an infinity in one of ``columns`` fails and names it. Nulls pass."""
    checks = []
    for c in columns:
        x = F.col(c).cast("double")
        odd = F.isnan(x) | (F.abs(x) == float("inf"))
        checks.append(F.when(F.coalesce(odd, F.lit(False)), F.raise_error(F.lit(f"{c} holds a value that is not finite")).cast("boolean")).otherwise(True))
    return df.where(reduce(Column.__and__, checks))


def tie_blocks(df: DataFrame, by: list[str], truth: str, score: str, weight: str | None = None) -> DataFrame:
    """(by, score): n rows, bad rows, sums of |error|, error^2. Rows without a score or truth are left out."""
    w = F.col(weight) if weight else F.lit(1)
    error = F.col(truth) - F.col(score)
    return (
        only_finite(df, truth, score).where(F.col(truth).isNotNull() & F.col(score).isNotNull() & (w > 0))
        .groupBy(*by, F.col(score).alias("score"))
        .agg(F.sum(w).cast("long").alias("n"), F.sum(F.when(F.col(truth) < CUT, w).otherwise(0)).cast("long").alias("bad"), F.sum(F.abs(error) * w).alias("abs_sum"), F.sum(error * error * w).alias("sq_sum"))
    )


def same_scope(by: list[str], left: str, right: str) -> Column | bool:
    """Null-safe equality of the scope columns of two aliased frames."""
    return reduce(Column.__and__, (F.col(f"{left}.{c}").eqNullSafe(F.col(f"{right}.{c}")) for c in by), F.lit(True))


def running(blocks: DataFrame, by: list[str], value: str, sums: list[str]) -> DataFrame:
    """``blocks`` with, for each of ``sums``, ``<c>_before`` over the rows of the scope with a larger value and
    ``<c>_total`` over the scope. ``value`` is a number, not null, and differs from row to row of a scope.

    Equal values never part. Cuts are approximate and hang on the order in which partial sketches meet, so rows are
    written with their bucket once, and all that follows reads that table. Rows meet the cuts where they are: a shuffle by
    scope would bring a whole scope to one task.
    """
    edges = [k / BUCKETS for k in range(1, BUCKETS)]
    cuts = written(blocks.groupBy(*by).agg(F.percentile_approx(F.col(value).cast("double"), edges, 1000).alias("cuts")), "cuts")
    near = F.broadcast if cuts.count() <= BROADCAST_SCOPES else lambda df: df
    at = F.size(F.filter("cuts", lambda c: c > F.col(value))).alias("bucket")
    placed = written(blocks.alias("x").join(near(cuts).alias("y"), same_scope(by, "x", "y")).select("x.*", at), "placed")
    whole = placed.groupBy(*by, "bucket").agg(*(F.sum(c).alias(f"{c}_own") for c in sums))
    # One row a bucket: at most BUCKETS rows of a scope meet here.
    order = Window.partitionBy(*by).orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    base = whole.select(*by, "bucket", *(F.coalesce(F.sum(f"{c}_own").over(order), F.lit(0)).alias(f"{c}_base") for c in sums), *(F.sum(f"{c}_own").over(Window.partitionBy(*by)).alias(f"{c}_total") for c in sums))
    joined = placed.alias("x").join(near(base).alias("y"), same_scope([*by, "bucket"], "x", "y")).select("x.*", *(f"y.{c}_{k}" for c in sums for k in ("base", "total")))
    within = Window.partitionBy(*by, "bucket").orderBy(F.desc(value)).rowsBetween(Window.unboundedPreceding, -1)
    before = [(F.col(f"{c}_base") + F.coalesce(F.sum(c).over(within), F.lit(0))).alias(f"{c}_before") for c in sums]
    return joined.select(*blocks.columns, *before, *(f"{c}_total" for c in sums))


def prefixed(blocks: DataFrame, by: list[str]) -> DataFrame:
    """Blocks with what ranks before them: best scores first (before) and worst first (under), and scope totals."""
    b = running(blocks, by, "score", ["n", "bad"])
    under = lambda c: (F.col(f"{c}_total") - F.col(f"{c}_before") - F.col(c)).alias(f"{c}_under")
    return b.select(*blocks.columns, "n_before", "bad_before", under("n"), under("bad"), F.col("n_total").alias("total"), F.col("bad_total").alias("total_bad"))


def rank_metrics(df: DataFrame, by: list[str], truth: str, score: str, weight: str | None = None) -> DataFrame:
    return block_metrics(tie_blocks(df, by, truth, score, weight), by)


def block_metrics(blocks: DataFrame, by: list[str]) -> DataFrame:
    """Counts, MAE, RMSE, AUROC of bad, average precision, AURC and excess AURC per scope; undefined ones are NULL."""
    b = prefixed(blocks, by)
    good = F.col("n") - F.col("bad")
    good_above = F.col("n_before") - F.col("bad_before")
    span = harmonic(F.col("n_before") + F.col("n")) - harmonic(F.col("n_before"))
    share = F.col("bad") / F.col("n")
    area = (F.col("bad_before") - F.col("n_before") * share) * span + F.col("bad")
    out = b.groupBy(*by).agg(
        F.sum("n").alias("n_rows"), F.sum("bad").alias("n_bad"), F.sum("abs_sum").alias("a"), F.sum("sq_sum").alias("q"),
        F.sum(F.col("bad") * (good_above + good / 2)).alias("u"), F.sum(F.col("bad") * (F.col("bad_under") + F.col("bad")) / (F.col("n_under") + F.col("n"))).alias("p"), F.sum(area).alias("r"),
    )
    n, bad = F.col("n_rows"), F.col("n_bad")
    ideal = (bad - (n - bad) * (harmonic(n) - harmonic(n - bad))) / n
    return out.select(
        *by, n, bad, (F.col("a") / n).alias("mae"), F.sqrt(F.col("q") / n).alias("rmse"), F.try_divide(F.col("u"), (bad * (n - bad)).cast("double")).alias("auroc"),
        F.try_divide(F.col("p"), bad.cast("double")).alias("ap"), (F.col("r") / n).alias("aurc"), (F.col("r") / n - ideal).alias("eaurc"),
    )


def risk_coverage(df: DataFrame, by: list[str], truth: str, score: str, coverages=COVERAGES) -> DataFrame:
    """At each coverage: rows kept (ceil), expected bad kept, good lost, and the risk among the kept."""
    b = prefixed(tie_blocks(df, by, truth, score), by)
    grid = F.explode(F.array(*(F.lit(float(c)) for c in coverages))).alias("coverage")
    at = b.select("*", grid).withColumn("kept", F.ceil(F.col("total") * F.col("coverage") - F.lit(1e-9)))
    at = at.where((F.col("n_before") < F.col("kept")) & (F.col("kept") <= F.col("n_before") + F.col("n")))
    bad_kept = F.col("bad_before") + (F.col("kept") - F.col("n_before")) * F.col("bad") / F.col("n")
    return at.select(*by, "coverage", F.col("kept").cast("long").alias("kept"), bad_kept.alias("bad_kept"), ((F.col("total") - F.col("total_bad")) - (F.col("kept") - bad_kept)).alias("good_lost"), (bad_kept / F.col("kept")).alias("risk"))


def curve_points(df: DataFrame, by: list[str], truth: str, score: str, resolution: int = 201) -> DataFrame:
    """ROC, precision-recall and risk values at ``resolution`` even coverages of the worst-first ranking."""
    b = prefixed(tie_blocks(df, by, truth, score), by)
    at = b.select("*", F.explode(F.sequence(F.lit(1), F.lit(resolution - 1))).alias("k")).withColumn("taken", F.col("total") * F.col("k") / F.lit(float(resolution - 1)))
    at = at.where((F.col("n_under") < F.col("taken")) & (F.col("taken") <= F.col("n_under") + F.col("n")))
    hit = F.col("bad_under") + (F.col("taken") - F.col("n_under")) * F.col("bad") / F.col("n")
    return at.select(
        *by, "k", F.try_divide(hit, F.col("total_bad").cast("double")).alias("recall"), F.try_divide(F.col("taken") - hit, (F.col("total") - F.col("total_bad")).cast("double")).alias("false_rate"), (hit / F.col("taken")).alias("precision"),
    )


def spearman(df: DataFrame, by: list[str], truth: str, score: str) -> DataFrame:
    """Pearson correlation of average ranks; NULL where a side is constant (``corr`` would raise under ANSI).

    Ranks come from per-value counts, added up in buckets; rows meet their ranks by equi-joins.
    """
    rows = only_finite(df, truth, score).where(F.col(truth).isNotNull() & F.col(score).isNotNull())
    pairs = written(rows.groupBy(*by, F.col(truth).alias("t"), F.col(score).alias("s")).agg(F.count("*").alias("n")), "pairs")

    def ranks(value: str) -> DataFrame:
        counts = running(pairs.groupBy(*by, value).agg(F.sum("n").alias("m")), by, value, ["m"])
        return counts.select(*by, value, (F.col("m_total") - F.col("m_before") - F.col("m") + (F.col("m") + 1) / 2).alias(f"r_{value}"))

    x, y, n = F.col("r_t"), F.col("r_s"), F.col("n")
    def ranked(left: DataFrame, value: str) -> DataFrame:
        return left.alias("x").join(ranks(value).alias("y"), same_scope([*by, value], "x", "y")).select("x.*", f"y.r_{value}")

    moments = ranked(ranked(pairs, "t"), "s").groupBy(*by).agg(
        F.sum("n").alias("n"), F.sum(n * x).alias("x"), F.sum(n * y).alias("y"), F.sum(n * x * x).alias("xx"), F.sum(n * y * y).alias("yy"), F.sum(n * x * y).alias("xy")
    )
    n, x, y = F.col("n").cast("double"), F.col("x"), F.col("y")
    below = F.sqrt(F.greatest(F.col("xx") / n - (x / n) ** 2, F.lit(0.0))) * F.sqrt(F.greatest(F.col("yy") / n - (y / n) ** 2, F.lit(0.0)))
    return moments.select(*by, F.when(below > 1e-9, F.try_divide(F.col("xy") / n - x * y / n / n, below)).alias("spearman"))


def method_ranks(metrics: DataFrame, by: list[str], metric: str, ascending: bool = True) -> DataFrame:
    """Competition ranks, 1 + the strictly better ones; a missing metric has no rank."""
    order = Window.partitionBy(*by).orderBy(F.asc_nulls_last(metric) if ascending else F.desc_nulls_last(metric))
    return metrics.withColumn("rank", F.when(F.col(metric).isNotNull(), F.rank().over(order)))


def budget_curves(df: DataFrame, by: list[str], truth: str, score: str, budgets=(0.05, 0.1, 0.2, 0.3, 0.5), weight: str | None = None) -> DataFrame:
    """Review budgets: missing scores (null or NaN) are reviewed first, then ascending ones with fractional picks inside ties."""
    df = only_finite(df.withColumn(score, F.when(~F.isnan(F.col(score).cast("double")), F.col(score))), truth, score)
    w = F.col(weight) if weight else F.lit(1)
    bad = F.when(F.col(truth) < CUT, w).otherwise(0)
    b = df.where(w > 0).groupBy(*by, F.col(score).alias("score")).agg(F.sum(w).cast("double").alias("w"), F.sum(bad).cast("double").alias("bad"))
    scopes = b.groupBy(*by).agg(F.sum("w").alias("total"), F.sum("bad").alias("total_bad"), F.sum(F.when(F.col("score").isNull(), F.col("w")).otherwise(0.0)).alias("missing"))
    ranked = running(b.where("score IS NOT NULL"), by, "score", ["w"])
    placed = ranked.select(*b.columns, (F.col("w_total") - F.col("w_before") - F.col("w")).alias("lower")).unionByName(b.where("score IS NULL").withColumn("lower", F.lit(0.0)))
    b = placed.alias("x").join(scopes.alias("y"), same_scope(by, "x", "y")).select("x.*", "y.total", "y.total_bad", "y.missing")
    at = b.select("*", F.explode(F.array(*(F.lit(float(x)) for x in budgets))).alias("budget"))
    quota = F.greatest(F.lit(0.0), F.col("budget") * F.col("total") - F.col("missing"))
    picked = F.when(F.col("score").isNull(), 1.0).otherwise(F.least(F.greatest(quota - F.col("lower"), F.lit(0.0)), F.col("w")) / F.col("w"))
    return at.groupBy(*by, "budget").agg(F.sum(picked * F.col("w")).alias("reviewed"), F.sum(picked * F.col("bad")).alias("bad_reviewed"), F.first("total").alias("total"), F.first("total_bad").alias("total_bad")).select(
        *by, "budget", "reviewed", "bad_reviewed", F.try_divide("bad_reviewed", "total_bad").alias("recall"), F.try_divide(F.col("total_bad") - F.col("bad_reviewed"), F.col("total") - F.col("reviewed")).alias("risk_left")
    )


def review_accounting(df: DataFrame, by: list[str], truth: str, score: str) -> DataFrame:
    """At the fixed rule (review a missing score or one under the cut): counts, recall and retained risk."""
    review = F.col(score).isNull() | (F.col(score) < CUT)
    bad = F.col(truth) < CUT
    out = df.groupBy(*by).agg(
        F.count("*").alias("n_rows"), F.count_if(review).alias("reviewed"), F.count_if(~review).alias("retained"), F.count_if(bad & review).alias("bad_reviewed"), F.count_if(bad & ~review).alias("bad_retained"), F.count_if(F.col(score).isNull()).alias("missing")
    )
    d = lambda a, b: F.try_divide(F.col(a).cast("double"), b)
    return out.select("*", d("bad_reviewed", F.col("bad_reviewed") + F.col("bad_retained")).alias("recall"), d("bad_retained", F.col("retained")).alias("risk"))
