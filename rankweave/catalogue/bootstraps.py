"""Case and stratified bootstraps with a thousand replicates, and the same on tie blocks in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import replicates as rep
from . import bind

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}
REPLICATES, WORKLOAD_REPLICATES, EVALUATION_REPLICATES = 1000, 1000, 1000


def draws_sql(pool: str, n: int, seed: int = 17) -> str:
    """CTEs up to ``wts`` (ds, grp, rep, w): the multiplicities of ``pool`` (ds, grp), with rep -1 for the sample itself."""
    two64 = "18446744073709551616::UHUGEINT"
    step = lambda z, by, times: f"(xor({z}, {z} // {by}::UHUGEINT) * {times}::UHUGEINT) % {two64}"
    first, second = (1 << 30, 0xBF58476D1CE4E5B9), (1 << 27, 0x94D049BB133111EB)
    last = lambda z: f"xor({z}, {z} // {1 << 31}::UHUGEINT)"
    return f"""pool AS ({pool}), places AS (SELECT ds, grp, row_number() OVER (PARTITION BY ds ORDER BY grp) - 1 AS k FROM pool),
sizes AS (SELECT ds, count(*) AS size, ('0x' || substr(sha256(ds || ':{seed}'), 1, 12))::UHUGEINT AS key FROM pool GROUP BY ds),
a0 AS (SELECT ds, size, r.range AS rep, (key + r.range::UHUGEINT) AS z FROM sizes, range({n}) r WHERE size > 1),
a1 AS (SELECT ds, size, rep, {step("z", *first)} AS z FROM a0), a2 AS (SELECT ds, size, rep, {step("z", *second)} AS z FROM a1), a3 AS (SELECT ds, size, rep, {last("z")} AS z FROM a2),
b0 AS (SELECT ds, size, rep, (z + j::UHUGEINT) % {two64} AS z FROM a3, LATERAL (SELECT unnest(range(size)) AS j)),
b1 AS (SELECT ds, size, rep, {step("z", *first)} AS z FROM b0), b2 AS (SELECT ds, size, rep, {step("z", *second)} AS z FROM b1),
picks AS (SELECT ds, rep, CAST({last("z")} % size::UHUGEINT AS BIGINT) AS k, count(*) AS w FROM b2 GROUP BY ALL),
wts AS (SELECT ds, grp, rep, w FROM picks JOIN places USING (ds, k) UNION ALL SELECT ds, grp, -1, 1 FROM pool)"""


_CASES = "SELECT DISTINCT l_returnflag AS ds, l_suppkey AS grp FROM lineitem"
_RANKED = f"""WITH {bind.SCORED_SQL}, {draws_sql(_CASES, REPLICATES)},
x AS (SELECT ds, grp, y, unnest(['a', 'b']) AS "method", unnest([score_a, score_b]) AS s FROM scored JOIN supplier ON s_suppkey = grp WHERE s_acctbal >= 0),
cells AS (SELECT ds, "method", grp, s, count(*)::DOUBLE AS n, count(*) FILTER (WHERE y < 0.9::DOUBLE)::DOUBLE AS bad, sum(abs(y - s)) AS a, sum((y - s) * (y - s)) AS q FROM x WHERE s IS NOT NULL GROUP BY ALL),
k AS (SELECT ds, "method", rep, s, sum(w * n) AS L, sum(w * bad) AS c FROM cells JOIN wts USING (ds, grp) GROUP BY ALL),
e AS (SELECT ds, "method", rep, sqrt(sum(w * q) / sum(w * n)) AS rmse, sum(w * a) / sum(w * n) AS mae FROM cells JOIN wts USING (ds, grp) GROUP BY ALL),
kw AS (SELECT *, sum(L) OVER d AS upto, sum(c) OVER d AS cum, sum(L) OVER u AS re, sum(c) OVER u AS rb, sum(L) OVER t AS n, sum(c) OVER t AS b
    FROM k WINDOW d AS (PARTITION BY ds, "method", rep ORDER BY s DESC), u AS (PARTITION BY ds, "method", rep ORDER BY s), t AS (PARTITION BY ds, "method", rep)),
h AS (SELECT 0.0::DOUBLE AS i, 0.0::DOUBLE AS h UNION ALL SELECT i::DOUBLE, sum(1 / i::DOUBLE) OVER (ORDER BY i) FROM range(1, (SELECT max(n)::BIGINT + 1 FROM kw)) r(i)),
m AS (SELECT ds, "method", rep, any_value(n) AS n, any_value(b) AS b, sum(c * ((upto - L) - (cum - c) + (L - c) / 2)) AS u, sum(c * rb / re) AS p,
    sum((cum - c - (upto - L) * c / L) * (h1.h - h0.h) + c) AS area, {", ".join(f"sum(CASE WHEN upto - L < ceil(n * {c}::DOUBLE - 1e-9) AND ceil(n * {c}::DOUBLE - 1e-9) <= upto THEN (cum - c + (ceil(n * {c}::DOUBLE - 1e-9) - (upto - L)) * c / L) / ceil(n * {c}::DOUBLE - 1e-9) END) AS risk_{round(100 * c)}" for c in rep.COVERAGES)}
    FROM kw JOIN h h1 ON h1.i = upto JOIN h h0 ON h0.i = upto - L GROUP BY ALL),
f AS (SELECT m.*, CASE WHEN b > 0 AND n > b THEN u / (b * (n - b)) END AS auroc, CASE WHEN b > 0 AND n > b THEN p / b END AS ap, area / n AS aurc, (area - (b - (n - b) * (hn.h - hg.h))) / n AS eaurc FROM m JOIN h hn ON hn.i = n JOIN h hg ON hg.i = n - b),
every AS (SELECT ds, "method", r.range AS rep FROM (SELECT DISTINCT ds, "method" FROM cells), range(-1, {REPLICATES}) r),
v AS (SELECT every.ds, every."method", every.rep, {", ".join([*rep.RANKING, *rep.REGRESSION])} FROM every LEFT JOIN f USING (ds, "method", rep) LEFT JOIN e USING (ds, "method", rep))"""
_METRICS = (*rep.RANKING, *rep.REGRESSION)


def _case_bootstrap(spark, sf_dir: str) -> DataFrame:
    """Suppliers in debt score nothing, but stay among the cases that are drawn."""
    q = bind.scored(spark, sf_dir)
    solvent = bind.table(spark, sf_dir, "supplier").where("s_acctbal >= 0").select(F.col("s_suppkey").alias("grp"))
    rows = q.join(solvent, "grp").select("ds", "grp", "y", F.explode(F.create_map(F.lit("a"), F.col("score_a"), F.lit("b"), F.col("score_b"))).alias("method", "s"))
    return rep.ranking_bootstrap(rows, q.select("ds", "grp"), ["ds", "method"], ["ds"], "grp", "y", "s", REPLICATES)


@bind.register(QUERIES, ORACLE_SQL, "case_ranking_replicates", _RANKED + f""" SELECT ds, "method", CAST(rep AS INT) AS rep, {", ".join(f"round({c}, 6) AS {c}" for c in _METRICS)} FROM v""")
def case_ranking_replicates(spark, sf_dir: str) -> DataFrame:
    """Every metric of every replicate, and of the sample (rep -1)."""
    return bind.rounded(rep.long_form(_case_bootstrap(spark, sf_dir), ["ds", "method"], _METRICS))


_INTERVAL = "round(any_value(v) FILTER (WHERE rep = -1), 6) AS point, round(quantile_cont(v, 0.025) FILTER (WHERE rep >= 0), 6) AS low, round(quantile_cont(v, 0.975) FILTER (WHERE rep >= 0), 6) AS high, count(v) FILTER (WHERE rep >= 0) AS n_valid, count(*) FILTER (WHERE rep >= 0) - count(v) FILTER (WHERE rep >= 0) AS n_undefined"


@bind.register(QUERIES, ORACLE_SQL, "case_ranking_intervals", _RANKED + f""", o AS (SELECT ds, "method" AS side, rep, {", ".join(f"{c} AS {c}" for c in _METRICS)} FROM v
    UNION ALL SELECT a.ds, 'a minus ' || b."method", rep, {", ".join(f"a.{c} - b.{c}" for c in _METRICS)} FROM v a JOIN v b USING (ds, rep) WHERE a."method" = 'a' AND b."method" <> 'a'),
l AS (SELECT ds, side, rep, unnest({list(_METRICS)}) AS metric, unnest([{", ".join(_METRICS)}]) AS v FROM o) SELECT ds, side, metric, {_INTERVAL} FROM l GROUP BY ds, side, metric""")
def case_ranking_intervals(spark, sf_dir: str) -> DataFrame:
    """Points and percentile intervals of both methods, and of their paired difference under shared draws."""
    found = _case_bootstrap(spark, sf_dir)
    apart = rep.paired(found, ["ds", "method"], "method", "a", _METRICS).withColumn("method", F.concat(F.lit("a minus "), "method"))
    both = found.select("ds", "method", *_METRICS).unionByName(apart).withColumnRenamed("method", "side")
    return bind.rounded(rep.vector_intervals(both, ["ds", "side"], _METRICS))


_WORK = f"""WITH {bind.SCORED_SQL.replace("l_suppkey AS grp", "l_suppkey AS grp, l_orderkey AS report")}, {draws_sql(_CASES, WORKLOAD_REPLICATES)},
claims AS (SELECT ds, grp, report, y < 0.9::DOUBLE AS low, score_a AS a, score_b AS b FROM scored WHERE finding = 'O'),
reports AS (SELECT ds, grp, bool_or(low) AS low, CASE WHEN count(a) = count(*) THEN min(a) END AS a, CASE WHEN count(b) = count(*) THEN min(b) END AS b FROM claims GROUP BY ds, grp, report),
units AS (SELECT 'claim' AS level, ds, grp, low, a, b FROM claims UNION ALL SELECT 'report', * FROM reports),
x AS (SELECT level, ds, grp, low, unnest(['a', 'b']) AS "method", unnest([a, b]) AS s, a IS NOT NULL AND b IS NOT NULL AS common FROM units),
z AS (SELECT *, 'full_failure_first' AS policy FROM x UNION ALL SELECT *, 'common_valid' FROM x WHERE common),
cells AS (SELECT level, policy, "method", ds, grp, s, count(*)::DOUBLE AS n, count(*) FILTER (WHERE low)::DOUBLE AS bad FROM z GROUP BY ALL),
k AS (SELECT level, policy, "method", rep, s, sum(w * n) AS L, sum(w * bad) AS c FROM cells JOIN wts USING (ds, grp) GROUP BY ALL),
t AS (SELECT *, sum(L) OVER p AS total, sum(c) OVER p AS total_bad, coalesce(sum(L) FILTER (WHERE s IS NULL) OVER p, 0) AS missing,
    coalesce(sum(L) FILTER (WHERE s IS NOT NULL) OVER (PARTITION BY level, policy, "method", rep ORDER BY s NULLS FIRST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM k WINDOW p AS (PARTITION BY level, policy, "method", rep)),
u AS (SELECT *, CASE WHEN s IS NULL THEN 1 ELSE least(greatest(greatest(0, budget * total - missing) - before, 0), L) / L END AS pick FROM t, (VALUES {", ".join(f"({b}::DOUBLE)" for b in rep.BUDGETS)}) g(budget)),
r AS (SELECT level, policy, "method", budget, rep, sum(pick * L) AS reviewed, sum(pick * c) AS hit, any_value(total) AS total, any_value(total_bad) AS bad FROM u GROUP BY ALL),
asked AS (SELECT rep, sum(w) AS asked FROM (SELECT DISTINCT ds, grp, report FROM scored) JOIN wts USING (ds, grp) GROUP BY rep),
v AS (SELECT level, policy, "method", budget, rep, hit / nullif(bad, 0) AS bad_recall, greatest(0, bad - hit) / nullif(greatest(0, total - reviewed), 0) AS risk_left, greatest(0, reviewed - hit) / nullif(reviewed, 0) AS unnecessary_share,
    greatest(0, reviewed - hit) / nullif(total - bad, 0) AS good_review_rate, CASE WHEN level = 'report' THEN reviewed / asked END AS all_report_share FROM r JOIN asked USING (rep)),
o AS (SELECT level, policy, "method" AS side, budget, rep, {", ".join(rep.WORKLOAD)} FROM v UNION ALL SELECT a.level, a.policy, 'a minus b', a.budget, a.rep, {", ".join(f"a.{c} - b.{c}" for c in rep.WORKLOAD)}
    FROM v a JOIN v b ON a.level = b.level AND a.policy = b.policy AND a.budget = b.budget AND a.rep = b.rep AND a."method" = 'a' AND b."method" = 'b'),
l AS (SELECT level, policy, side, budget, rep, unnest({list(rep.WORKLOAD)}) AS metric, unnest([{", ".join(rep.WORKLOAD)}]) AS v FROM o)
SELECT level, policy, side, budget, metric, {_INTERVAL} FROM l WHERE level = 'report' OR metric <> 'all_report_share' GROUP BY level, policy, side, budget, metric"""


@bind.register(QUERIES, ORACLE_SQL, "workload_intervals", _WORK)
def workload_intervals(spark, sf_dir: str) -> DataFrame:
    """Review workload over claims and reports, both failure policies, five budgets: points, intervals, paired differences."""
    q = bind.scored(spark, sf_dir, F.col("l_orderkey").alias("report"))
    by = ["level", "policy", "method", "budget"]
    found = rep.workload_bootstrap(q.where("finding = 'O'"), q.select("ds", "grp", "report").distinct(), ["ds"], "grp", ["ds", "grp", "report"], "y", {"a": "score_a", "b": "score_b"}, WORKLOAD_REPLICATES)
    apart = rep.paired(found, by, "method", "a", rep.WORKLOAD).withColumn("method", F.lit("a minus b"))
    both = found.unionByName(apart).withColumnRenamed("method", "side")
    out = rep.vector_intervals(both, ["level", "policy", "side", "budget"], rep.WORKLOAD)
    return bind.rounded(out.where("level = 'report' OR metric <> 'all_report_share'"))


_KEYED = """q AS (SELECT l_returnflag AS ds, CASE WHEN l_returnflag = 'A' THEN 'group:' || l_suppkey ELSE 'source:' || l_orderkey END AS grp, 1 - 2 * l_discount AS y, 1 - 2 * l_tax AS s FROM lineitem)"""


@bind.register(QUERIES, ORACLE_SQL, "public_evaluation", f"""WITH {_KEYED}, {draws_sql("SELECT DISTINCT ds, grp FROM q", EVALUATION_REPLICATES)}, st AS (SELECT ds, grp, count(*) AS n, sum(abs(y - s)) AS a, sum((y - s) * (y - s)) AS e FROM q GROUP BY ds, grp),
v AS (SELECT ds, rep, sum(w * a) / sum(w * n) AS mae, sqrt(sum(w * e) / sum(w * n)) AS rmse FROM st JOIN wts USING (ds, grp) GROUP BY ds, rep), l AS (SELECT ds, rep, unnest(['mae', 'rmse']) AS metric, unnest([mae, rmse]) AS v FROM v)
SELECT ds, metric, {_INTERVAL} FROM l GROUP BY ds, metric""")
def public_evaluation(spark, sf_dir: str) -> DataFrame:
    """Errors by dataset with intervals over its own unit: families in one dataset, sources in the others."""
    rows = bind.table(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("ds"), "l_orderkey", "l_suppkey", (1 - 2 * F.col("l_discount")).alias("y"), (1 - 2 * F.col("l_tax")).alias("s"))
    keyed = rep.evaluation_groups(rows, "ds", "l_orderkey", "l_suppkey", ["A"])
    found = rep.regression_bootstrap(keyed, keyed, ["ds"], ["ds"], "case", "y", "s", EVALUATION_REPLICATES)
    return bind.rounded(rep.vector_intervals(found, ["ds"], rep.REGRESSION))
