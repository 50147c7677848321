"""Ranking, coverage, budget and bootstrap queries on the scored binding."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import align, challenge, ranking, resample
from . import bind

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}

#: Row-level forms: i = place, rk = first place of the tie block, L and c its rows and bad ones, cum = bad up to its end.
_ROWS = """r AS (SELECT {by}, y, s, count(*) OVER d AS i, 0 AS z FROM q WINDOW d AS (PARTITION BY {by} ORDER BY s DESC ROWS UNBOUNDED PRECEDING)),
k AS (SELECT {by}, s, count(*) AS L, count(*) FILTER (WHERE y < 0.9::DOUBLE) AS c FROM q GROUP BY {by}, s),
kw AS (SELECT *, sum(L) OVER d AS upto, sum(c) OVER d AS cum, sum(L) OVER a AS re, sum(c) OVER a AS rb, sum(L) OVER (PARTITION BY {by}) AS n, sum(c) OVER (PARTITION BY {by}) AS b
       FROM k WINDOW d AS (PARTITION BY {by} ORDER BY s DESC), a AS (PARTITION BY {by} ORDER BY s)),
area AS (SELECT {by_r}, avg((w.cum - w.c + (r.i - (w.upto - w.L)) * w.c / w.L::DOUBLE) / r.i) AS aurc, avg(greatest(0, r.i - (w.n - w.b)) / r.i::DOUBLE) AS best
         FROM r JOIN kw w ON {on} AND r.s = w.s GROUP BY {by_r}),
m AS (SELECT {by}, max(n) AS n, max(b) AS b, sum(c * ((upto - L) - (cum - c) + (L - c) / 2.0::DOUBLE)) AS u, sum(c * rb / re::DOUBLE) AS p FROM kw GROUP BY {by})"""


def metrics_sql(by: list[str], prefix: str, source: str) -> str:
    keys = ", ".join(by)
    body = _ROWS.format(by=keys, by_r=", ".join(f"r.{x}" for x in by), on=" AND ".join(f"r.{x} = w.{x}" for x in by))
    using = f"USING ({keys})"
    errors = f"e AS (SELECT {keys}, avg(abs(y - s)) AS mae, sqrt(avg((y - s) * (y - s))) AS rmse FROM q GROUP BY {keys})"
    return f"""WITH {prefix}, q AS ({source}), {body}, {errors}
SELECT {keys}, CAST(n AS BIGINT) AS n_rows, CAST(b AS BIGINT) AS n_bad, round(mae, 6) AS mae, round(rmse, 6) AS rmse, round(CASE WHEN b * (n - b) > 0 THEN u / (b * (n - b)) END, 6) AS auroc,
       round(CASE WHEN b > 0 THEN p / b END, 6) AS ap, round(aurc, 6) AS aurc, round(aurc - best, 6) AS eaurc FROM m JOIN area {using} JOIN e {using}"""


_PLAIN = "SELECT ds, y, score_a AS s FROM scored"


@bind.register(QUERIES, ORACLE_SQL, "rank_metrics_by_dataset", metrics_sql(["ds"], bind.SCORED_SQL, _PLAIN))
def rank_metrics_by_dataset(spark, sf_dir: str) -> DataFrame:
    return bind.rounded(ranking.rank_metrics(bind.scored(spark, sf_dir), ["ds"], "y", "score_a"))


_FINE = "SELECT l_returnflag AS ds, 1 - 2 * l_discount AS y, (1 - l_quantity / 50) * 0.5 + l_extendedprice / 1e6 AS s FROM lineitem"


@bind.register(QUERIES, ORACLE_SQL, "rank_metrics_continuous", metrics_sql(["ds"], bind.SCORED_SQL, _FINE))
def rank_metrics_continuous(spark, sf_dir: str) -> DataFrame:
    """Scores with nearly as many values as rows: buckets, not scopes, meet in a task."""
    q = bind.table(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("ds"), (1 - 2 * F.col("l_discount")).alias("y"), ((1 - F.col("l_quantity") / 50) * 0.5 + F.col("l_extendedprice") / 1e6).alias("s"))
    return bind.rounded(ranking.rank_metrics(q, ["ds"], "y", "s"))


@bind.register(QUERIES, ORACLE_SQL, "subgroup_cube", metrics_sql(["scope", "ds", "part"], bind.SCORED_SQL, """SELECT x.scope, ds, CASE x.scope WHEN 'finding' THEN finding WHEN 'variant' THEN variant::VARCHAR
    WHEN 'finding_variant' THEN finding || '|' || variant ELSE '' END AS part, y, score_a AS s FROM scored, (VALUES ('all'), ('finding'), ('variant'), ('finding_variant')) x(scope)"""))  # fmt: skip
def subgroup_cube(spark, sf_dir: str) -> DataFrame:
    """All scopes from one scan: rows fall to tie blocks of the finest scope first, coarser ones sum those blocks."""
    q = bind.scored(spark, sf_dir)
    fine = ranking.tie_blocks(q, ["ds", "finding", "variant"], "y", "score_a")
    scopes = F.array(
        F.struct(F.lit("all").alias("scope"), F.lit("").alias("part")), F.struct(F.lit("finding").alias("scope"), F.col("finding").alias("part")),
        F.struct(F.lit("variant").alias("scope"), F.col("variant").cast("string").alias("part")), F.struct(F.lit("finding_variant").alias("scope"), F.concat_ws("|", "finding", "variant").alias("part")),
    )
    blocks = fine.select("ds", F.explode(scopes).alias("x"), "score", "n", "bad", "abs_sum", "sq_sum").select("ds", "x.scope", "x.part", "score", "n", "bad", "abs_sum", "sq_sum")
    merged = blocks.groupBy("scope", "ds", "part", "score").agg(*(F.sum(c).alias(c) for c in ("n", "bad", "abs_sum", "sq_sum")))
    return bind.rounded(ranking.block_metrics(merged, ["scope", "ds", "part"]))


_DRAWS = """draws AS (SELECT rep, grp, count(*) AS w FROM (
    SELECT rep.range AS rep, CAST('0x' || substr(sha256('17:' || rep.range || ':' || g.k), 1, 12) AS BIGINT) % size AS k
    FROM (SELECT row_number() OVER (ORDER BY grp) - 1 AS k, count(*) OVER () AS size FROM (SELECT DISTINCT grp FROM scored)) g, range({reps}) rep) p
    JOIN (SELECT grp, row_number() OVER (ORDER BY grp) - 1 AS k FROM (SELECT DISTINCT grp FROM scored)) n USING (k) GROUP BY rep, grp)"""
_WEIGHTED = """SELECT rep, ds, y, score_a AS s FROM scored JOIN draws USING (grp), range(w)"""


@bind.register(QUERIES, ORACLE_SQL, "rank_metrics_weighted", metrics_sql(["rep", "ds"], bind.SCORED_SQL + ", " + _DRAWS.format(reps=3), _WEIGHTED))
def rank_metrics_weighted(spark, sf_dir: str) -> DataFrame:
    """Metrics of bootstrap replicates: (group, score) blocks are weighted, rows are never expanded."""
    q = bind.scored(spark, sf_dir)
    fine = ranking.tie_blocks(q, ["ds", "grp"], "y", "score_a")
    draws = resample.hash_draws(q.select("grp").distinct(), [], "grp", 3)
    blocks = fine.join(draws, "grp").groupBy(F.col("rep").cast("long").alias("rep"), "ds", "score").agg(*(F.sum(F.col(c) * F.col("w")).alias(c) for c in ("n", "bad", "abs_sum", "sq_sum")))
    return bind.rounded(ranking.block_metrics(blocks, ["rep", "ds"]))


@bind.register(QUERIES, ORACLE_SQL, "risk_coverage_curve", f"""WITH {bind.SCORED_SQL}, k AS (SELECT ds, score_a AS s, count(*) AS L, count(*) FILTER (WHERE y < 0.9::DOUBLE) AS c FROM scored GROUP BY ALL),
w AS (SELECT *, sum(L) OVER d AS upto, sum(c) OVER d AS cum, sum(L) OVER (PARTITION BY ds) AS n, sum(c) OVER (PARTITION BY ds) AS b FROM k WINDOW d AS (PARTITION BY ds ORDER BY s DESC)),
g AS (SELECT *, ceil(n * coverage - 1e-9) AS kept FROM w, (VALUES (0.5::DOUBLE), (0.6), (0.7), (0.8), (0.9), (1.0)) v(coverage))
SELECT ds, coverage, CAST(kept AS BIGINT) AS kept, round(cum - c + (kept - (upto - L)) * c / L, 6) AS bad_kept, round((n - b) - (kept - (cum - c + (kept - (upto - L)) * c / L)), 6) AS good_lost,
       round((cum - c + (kept - (upto - L)) * c / L) / kept, 6) AS risk FROM g WHERE upto - L < kept AND kept <= upto""")  # fmt: skip
def risk_coverage_curve(spark, sf_dir: str) -> DataFrame:
    return bind.rounded(ranking.risk_coverage(bind.scored(spark, sf_dir), ["ds"], "y", "score_a"))


@bind.register(QUERIES, ORACLE_SQL, "curve_grid", f"""WITH {bind.SCORED_SQL}, k AS (SELECT ds, score_a AS s, count(*) AS L, count(*) FILTER (WHERE y < 0.9::DOUBLE) AS c FROM scored GROUP BY ALL),
w AS (SELECT *, sum(L) OVER d - L AS before, sum(c) OVER d - c AS cum, sum(L) OVER (PARTITION BY ds) AS n, sum(c) OVER (PARTITION BY ds) AS b FROM k WINDOW d AS (PARTITION BY ds ORDER BY s)),
g AS (SELECT *, n * k / 200.0::DOUBLE AS t FROM w, range(1, 201) x(k)), h AS (SELECT *, cum + (t - before) * c / L AS hit FROM g WHERE before < t AND t <= before + L)
SELECT ds, CAST(k AS INT) AS k, round(hit / b, 6) AS recall, round((t - hit) / (n - b), 6) AS false_rate, round(hit / t, 6) AS "precision" FROM h""")  # fmt: skip
def curve_grid(spark, sf_dir: str) -> DataFrame:
    return bind.rounded(ranking.curve_points(bind.scored(spark, sf_dir), ["ds"], "y", "score_a"))


@bind.register(QUERIES, ORACLE_SQL, "spearman_by_dataset", f"""WITH {bind.SCORED_SQL}, r AS (SELECT ds, rank() OVER (PARTITION BY ds ORDER BY y) + (count(*) OVER (PARTITION BY ds, y) - 1) / 2.0::DOUBLE AS a,
    rank() OVER (PARTITION BY ds ORDER BY score_a) + (count(*) OVER (PARTITION BY ds, score_a) - 1) / 2.0::DOUBLE AS b FROM scored) SELECT ds, round(corr(a, b), 6) AS spearman FROM r GROUP BY ds""")  # fmt: skip
def spearman_by_dataset(spark, sf_dir: str) -> DataFrame:
    return bind.rounded(ranking.spearman(bind.scored(spark, sf_dir), ["ds"], "y", "score_a"))


_BUDGET = """b AS (SELECT {by}, score_b AS s, sum({w})::DOUBLE AS w, sum(CASE WHEN y < 0.9::DOUBLE THEN {w} ELSE 0 END)::DOUBLE AS bad FROM {src} GROUP BY {by}, score_b),
t AS (SELECT *, sum(w) OVER (PARTITION BY {by}) AS total, sum(bad) OVER (PARTITION BY {by}) AS total_bad, coalesce(sum(CASE WHEN s IS NULL THEN w END) OVER (PARTITION BY {by}), 0) AS missing,
      coalesce(sum(CASE WHEN s IS NOT NULL THEN w END) OVER (PARTITION BY {by} ORDER BY s NULLS FIRST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM b),
p AS (SELECT *, CASE WHEN s IS NULL THEN 1.0 ELSE least(greatest(greatest(0, budget * total - missing) - before, 0), w) / w END AS pick FROM t, (VALUES (0.05::DOUBLE), (0.1), (0.2), (0.3), (0.5)) v(budget))
SELECT {by}, budget, round(sum(pick * w), 6) AS reviewed, round(sum(pick * bad), 6) AS bad_reviewed, round(sum(pick * bad) / any_value(total_bad), 6) AS recall,
       round((any_value(total_bad) - sum(pick * bad)) / (any_value(total) - sum(pick * w)), 6) AS risk_left FROM p GROUP BY {by}, budget"""


@bind.register(QUERIES, ORACLE_SQL, "budget_curves", f"WITH {bind.SCORED_SQL}, " + _BUDGET.format(by="ds", w="1", src="scored"))
def budget_curves(spark, sf_dir: str) -> DataFrame:
    return bind.rounded(ranking.budget_curves(bind.scored(spark, sf_dir), ["ds"], "y", "score_b"))


@bind.register(QUERIES, ORACLE_SQL, "stratified_budget_bootstrap", f"""WITH {bind.SCORED_SQL}, g AS (SELECT ds, grp, row_number() OVER (PARTITION BY ds ORDER BY grp) - 1 AS k, count(*) OVER (PARTITION BY ds) AS size FROM (SELECT DISTINCT ds, grp FROM scored)),
draws AS (SELECT ds, rep, n.grp, count(*) AS w FROM (SELECT ds, rep.range AS rep, CAST('0x' || substr(sha256(ds || ':17:' || rep.range || ':' || k), 1, 12) AS BIGINT) % size AS k FROM g, range(2) rep) p JOIN g n USING (ds, k) GROUP BY ALL),
q AS (SELECT rep, ds, y, score_b, w FROM scored JOIN draws USING (ds, grp)), """ + _BUDGET.format(by="rep, ds", w="w", src="q"))  # fmt: skip
def stratified_budget_bootstrap(spark, sf_dir: str) -> DataFrame:
    q = bind.scored(spark, sf_dir)
    draws = resample.hash_draws(q.select("ds", "grp").distinct(), ["ds"], "grp", 2)
    fine = q.groupBy("ds", "grp", "score_b", "y").agg(F.count("*").alias("rows")).join(draws, ["ds", "grp"])
    weighted = fine.select(F.col("rep").cast("long").alias("rep"), "ds", "y", "score_b", (F.col("rows") * F.col("w")).alias("w"))
    return bind.rounded(ranking.budget_curves(weighted, ["rep", "ds"], "y", "score_b", weight="w"))


@bind.register(QUERIES, ORACLE_SQL, "review_accounting", f"""WITH {bind.SCORED_SQL}, r AS (SELECT *, score_b IS NULL OR score_b < 0.9::DOUBLE AS v, y < 0.9::DOUBLE AS bad FROM scored)
SELECT ds, count(*) AS n_rows, count(*) FILTER (WHERE v) AS reviewed, count(*) FILTER (WHERE NOT v) AS retained, count(*) FILTER (WHERE bad AND v) AS bad_reviewed, count(*) FILTER (WHERE bad AND NOT v) AS bad_retained,
       count(*) FILTER (WHERE score_b IS NULL) AS missing, round(count(*) FILTER (WHERE bad AND v) / count(*) FILTER (WHERE bad)::DOUBLE, 6) AS recall, round(count(*) FILTER (WHERE bad AND NOT v) / count(*) FILTER (WHERE NOT v)::DOUBLE, 6) AS risk FROM r GROUP BY ds""")  # fmt: skip
def review_accounting(spark, sf_dir: str) -> DataFrame:
    return bind.rounded(ranking.review_accounting(bind.scored(spark, sf_dir), ["ds"], "y", "score_b"))


@bind.register(QUERIES, ORACLE_SQL, "coverage_accounting", f"""WITH {bind.SCORED_SQL}, m AS (SELECT ds, 'a' AS "method", score_a AS s, score_a IS NOT NULL AND score_b IS NOT NULL AS c FROM scored UNION ALL SELECT ds, 'b', score_b, score_a IS NOT NULL AND score_b IS NOT NULL FROM scored)
SELECT ds, "method", count(*) AS nominal, count(s) AS scored, count(*) - count(s) AS failed, round(count(s) / count(*)::DOUBLE, 6) AS coverage, count(*) FILTER (WHERE c) AS common FROM m GROUP BY ds, "method" """)
def coverage_accounting(spark, sf_dir: str) -> DataFrame:
    return bind.rounded(align.coverage_accounting(bind.scored(spark, sf_dir), ["ds"], {"a": "score_a", "b": "score_b"}))


@bind.register(QUERIES, ORACLE_SQL, "retention_cube", f"""WITH {bind.SCORED_SQL}, x AS (SELECT *, CASE WHEN y < 0.85::DOUBLE THEN 'low' WHEN y < 0.9::DOUBLE THEN 'middle' ELSE 'high' END AS bin, abs(y - score_b) AS e FROM scored)
SELECT coalesce(ds, 'all') AS ds, coalesce(finding, 'all') AS finding, coalesce(bin, 'all') AS bin, count(*) AS nominal, count(score_b) AS scored, round(avg(e), 6) AS mae FROM x GROUP BY CUBE (ds, finding, bin)""")  # fmt: skip
def retention_cube(spark, sf_dir: str) -> DataFrame:
    """Counts and MAE over every combination of scope, or all of it; missing scores count in nominal."""
    bin_ = F.when(F.col("y") < 0.85, "low").when(F.col("y") < 0.9, "middle").otherwise("high")
    q = bind.scored(spark, sf_dir).withColumn("bin", bin_)
    out = q.cube("ds", "finding", "bin").agg(F.count("*").alias("nominal"), F.count("score_b").alias("scored"), F.avg(F.abs(F.col("y") - F.col("score_b"))).alias("mae"))
    return bind.rounded(out.na.fill("all", ["ds", "finding", "bin"]))


_BY_METHOD = f"""WITH {bind.SCORED_SQL}, m AS (SELECT "method", ds, CASE WHEN count(s) > 0 THEN avg(abs(y - s)) END AS mae FROM (SELECT 'a' AS "method", ds, y, score_a AS s FROM scored UNION ALL SELECT 'b', ds, y, score_b FROM scored
    UNION ALL SELECT 'c', ds, y, CASE WHEN ds <> 'A' THEN score_a * 0.9 END FROM scored) GROUP BY ALL)"""


def _by_method(spark, sf_dir: str) -> DataFrame:
    q = bind.scored(spark, sf_dir)
    named = F.create_map(F.lit("a"), F.col("score_a"), F.lit("b"), F.col("score_b"), F.lit("c"), F.when(F.col("ds") != "A", F.col("score_a") * 0.9))
    return q.select("ds", "y", F.explode(named).alias("method", "s")).groupBy("method", "ds").agg(F.avg(F.abs(F.col("y") - F.col("s"))).alias("mae"))


@bind.register(QUERIES, ORACLE_SQL, "macro_metrics", _BY_METHOD + """ SELECT "method", count(*) AS n_datasets, round(CASE WHEN count(mae) = count(*) THEN avg(mae) END, 6) AS macro_mae FROM m GROUP BY "method" """)
def macro_metrics(spark, sf_dir: str) -> DataFrame:
    """Equal weight over datasets; a method that lacks one has no macro value."""
    return bind.rounded(_by_method(spark, sf_dir).groupBy("method").agg(F.count("*").alias("n_datasets"), F.when(F.count("mae") == F.count("*"), F.avg("mae")).alias("macro_mae")))


@bind.register(QUERIES, ORACLE_SQL, "method_ranks", _BY_METHOD + """ SELECT "method", ds, round(mae, 6) AS mae, CASE WHEN mae IS NOT NULL THEN CAST(rank() OVER (PARTITION BY ds ORDER BY mae NULLS LAST) AS INT) END AS "rank" FROM m""")
def method_ranks(spark, sf_dir: str) -> DataFrame:
    return bind.rounded(ranking.method_ranks(_by_method(spark, sf_dir), ["ds"], "mae"))


_REGRESSION = f"""WITH {bind.SCORED_SQL}, {_DRAWS.format(reps=200)}, st AS (SELECT ds, grp, count(*) AS n, sum(abs(y - score_a)) AS a, sum(abs(y - score_b)) AS ab, count(score_b) AS nb FROM scored GROUP BY ds, grp),
v AS (SELECT ds, rep, sum(w * a) / sum(w * n) AS mae, sum(w * a) / sum(w * n) - sum(w * ab) / sum(w * nb) AS diff FROM draws JOIN st USING (grp) GROUP BY ds, rep)"""


@bind.register(QUERIES, ORACLE_SQL, "group_regression_bootstrap", _REGRESSION + " SELECT ds, round(quantile_cont(mae, 0.025), 6) AS low, round(quantile_cont(mae, 0.975), 6) AS high, count(mae) AS n_valid, count(*) - count(mae) AS n_undefined FROM v GROUP BY ds")
def group_regression_bootstrap(spark, sf_dir: str) -> DataFrame:
    q = bind.scored(spark, sf_dir)
    statistics = resample.regression_statistics(q, ["ds", "grp"], "y", "score_a")
    draws = resample.hash_draws(q.select("grp").distinct(), [], "grp", 200)
    values = draws.join(statistics, "grp").groupBy("ds", "rep").agg((F.sum(F.col("w") * F.col("a")) / F.sum(F.col("w") * F.col("n"))).alias("mae"))
    return bind.rounded(resample.intervals(values, ["ds"], "mae"))


@bind.register(QUERIES, ORACLE_SQL, "case_bootstrap_paired_diff", _REGRESSION + " SELECT ds, round(quantile_cont(diff, 0.025), 6) AS low, round(quantile_cont(diff, 0.975), 6) AS high, count(diff) AS n_valid, count(*) - count(diff) AS n_undefined FROM v GROUP BY ds")
def case_bootstrap_paired_diff(spark, sf_dir: str) -> DataFrame:
    """Both methods share each replicate's draws; an undefined side makes the difference NULL."""
    q = bind.scored(spark, sf_dir)
    s = lambda c: F.abs(F.col("y") - F.col(c))
    statistics = q.groupBy("ds", "grp").agg(F.count("*").alias("n"), F.sum(s("score_a")).alias("a"), F.sum(s("score_b")).alias("ab"), F.count("score_b").alias("nb"))
    draws = resample.hash_draws(q.select("grp").distinct(), [], "grp", 200)
    total = lambda c: F.sum(F.col("w") * F.col(c)).cast("double")
    values = draws.join(statistics, "grp").groupBy("ds", "rep").agg((F.try_divide(total("a"), total("n")) - F.try_divide(total("ab"), total("nb"))).alias("diff"))
    return bind.rounded(resample.intervals(values, ["ds"], "diff"))


@bind.register(QUERIES, ORACLE_SQL, "token_scores", """WITH t AS (SELECT conv_id, turn, unnest(string_split(trim(regexp_replace(text, '\\s+', ' ', 'g')), ' ')) AS tok FROM conversations),
s AS (SELECT *, -CAST('0x' || substr(sha256(tok), 1, 4) AS BIGINT) / 65536.0::DOUBLE AS lp FROM t) SELECT conv_id, turn, count(*) AS n_tokens, round(avg(lp), 6) AS mean_lp, round(-avg(lp), 6) AS mean_nll, round(sum(lp), 6) AS sum_lp FROM s GROUP BY conv_id, turn""")  # fmt: skip
def token_scores(spark, sf_dir: str) -> DataFrame:
    """Token to report: mean and sum of log probabilities, here hashed from the tokens."""
    t = bind.table(spark, sf_dir, "conversations").select("conv_id", "turn", F.explode(F.split(F.trim(F.regexp_replace("text", r"\s+", " ")), " ")).alias("tok"))
    s = t.withColumn("lp", -F.conv(F.substring(F.sha2("tok", 256), 1, 4), 16, 10).cast("long") / 65536.0)
    return bind.rounded(s.groupBy("conv_id", "turn").agg(F.count("*").alias("n_tokens"), F.avg("lp").alias("mean_lp"), (-F.avg("lp")).alias("mean_nll"), F.sum("lp").alias("sum_lp")))


@bind.register(QUERIES, ORACLE_SQL, "population_moments", """WITH x AS (SELECT generate_subscripts(embedding, 1) - 1 AS k, unnest(embedding)::DOUBLE AS v FROM embeddings)
SELECT CAST(k AS INT) AS k, round(avg(v), 6) AS mean, round(CASE WHEN stddev_pop(v) < 1e-6 THEN 1 ELSE stddev_pop(v) END, 6) AS scale FROM x GROUP BY k""")
def population_moments(spark, sf_dir: str) -> DataFrame:
    x = bind.table(spark, sf_dir, "embeddings").select(F.posexplode("embedding").alias("k", "v")).withColumn("v", F.col("v").cast("double"))
    sd = F.stddev_pop("v")
    return bind.rounded(x.groupBy("k").agg(F.avg("v").alias("mean"), F.when(sd < 1e-6, 1.0).otherwise(sd).alias("scale")))


@bind.register(QUERIES, ORACLE_SQL, "weighted_moments", f"""WITH {bind.SCORED_SQL}, w AS (SELECT ds, score_a AS x, 1.0::DOUBLE / count(*) OVER (PARTITION BY ds, grp) AS w FROM scored)
SELECT ds, round(sum(w * x) / sum(w), 6) AS mean, round(sum(w * x * x) / sum(w) - (sum(w * x) / sum(w)) ** 2, 6) AS variance FROM w GROUP BY ds""")
def weighted_moments(spark, sf_dir: str) -> DataFrame:
    """Rows weigh 1 / their group's size: groups are averaged first, so no window over rows is needed."""
    g = bind.scored(spark, sf_dir).groupBy("ds", "grp").agg(F.avg("score_a").alias("m"), F.avg(F.col("score_a") ** 2).alias("q"))
    return bind.rounded(g.groupBy("ds").agg(F.avg("m").alias("mean"), (F.avg("q") - F.avg("m") ** 2).alias("variance")))



_CHALLENGE = """q AS (SELECT l_returnflag AS ds, l_linenumber AS f, l_suppkey % 3 AS g, CASE WHEN l_partkey % 13 <> 0 THEN l_quantity / 50 END AS y, 1 - l_tax * 5 AS a, CASE WHEN l_linenumber <> 7 THEN 1 - l_discount * 5 END AS b FROM lineitem),
c AS (SELECT *, CASE WHEN y < 0.5::DOUBLE THEN '[0,.5)' WHEN y < 0.9::DOUBLE THEN '[.5,.9)' WHEN y <= 1 THEN '[.9,1]' END AS bin FROM q),
x AS (SELECT c.*, u.fam, v.reg FROM c, LATERAL (VALUES (f::VARCHAR), ('all')) u(fam), LATERAL (VALUES (g::VARCHAR), ('all')) v(reg)),
base AS (SELECT ds, fam, reg, count(*) AS base_nominal, count(*) FILTER (WHERE bin IS NULL) AS unknown_bin FROM x GROUP BY ALL),
found AS (SELECT ds, fam, reg, w.b2, count(*) AS nominal, count(*) FILTER (WHERE bin IS NOT NULL AND b IS NOT NULL) AS common, count(*) FILTER (WHERE bin IS NOT NULL) AS n_a, count(*) FILTER (WHERE bin IS NOT NULL AND b IS NOT NULL) AS n_b,
    avg(abs(y - a)) FILTER (WHERE bin IS NOT NULL AND b IS NOT NULL) AS mae_a, avg(abs(y - b)) FILTER (WHERE bin IS NOT NULL AND b IS NOT NULL) AS mae_b FROM x, LATERAL (VALUES (bin), ('all')) w(b2) WHERE w.b2 IS NOT NULL GROUP BY ALL),
spine AS (SELECT * FROM (SELECT DISTINCT ds FROM q), (VALUES ('all'), ('1'), ('2'), ('3'), ('4'), ('5'), ('6'), ('7')) a(fam), (VALUES ('all'), ('0'), ('1'), ('2')) b(reg), (VALUES ('all'), ('[0,.5)'), ('[.5,.9)'), ('[.9,1]')) c(b2))"""


@bind.register(QUERIES, ORACLE_SQL, "challenge_cube", f"""WITH {_CHALLENGE} SELECT ds, fam AS family, reg AS region, b2 AS bin, coalesce(nominal, 0) AS nominal, coalesce(base_nominal, 0) AS base_nominal, coalesce(unknown_bin, 0) AS unknown_bin, coalesce(common, 0) AS common,
    coalesce(n_a, 0) AS n_a, coalesce(n_b, 0) AS n_b, round(mae_a, 6) AS mae_a, round(mae_b, 6) AS mae_b FROM spine LEFT JOIN found USING (ds, fam, reg, b2) LEFT JOIN base USING (ds, fam, reg)""")
def challenge_cube(spark, sf_dir: str) -> DataFrame:
    """Every scope of family, region and retention bin, with rows whose target is missing."""
    q = bind.table(spark, sf_dir, "lineitem").select(
        F.col("l_returnflag").alias("ds"), F.col("l_linenumber").alias("f"), (F.col("l_suppkey") % 3).alias("g"), F.when(F.col("l_partkey") % 13 != 0, F.col("l_quantity") / 50).alias("y"),
        (1 - F.col("l_tax") * 5).alias("a"), F.when(F.col("l_linenumber") != 7, 1 - F.col("l_discount") * 5).alias("b"),
    )
    return bind.rounded(challenge.challenge_cube(q, "ds", "f", "g", "y", ["a", "b"], list(range(1, 8)), [0, 1, 2]))


@bind.register(QUERIES, ORACLE_SQL, "score_faults", """WITH s AS (SELECT event_id AS k, user_id, CASE WHEN event_id % 11 = 0 THEN NULL ELSE value END AS score, CASE WHEN event_id % 11 = 0 AND event_id % 3 <> 0 THEN 'failed' ELSE 'success' END AS status FROM events WHERE event_id % 17 <> 0
    UNION ALL SELECT event_id, user_id, value, 'success' FROM events WHERE event_id % 23 = 1 UNION ALL SELECT -1 - event_id, user_id, value, 'success' FROM events WHERE event_id % 101 = 0),
t AS (SELECT k, count(*) AS n, max(score) AS score, max(status) AS status FROM s GROUP BY k)
SELECT coalesce(event_id, k) AS k, CASE WHEN event_id IS NULL THEN 'unexpected' WHEN k IS NULL THEN 'missing' WHEN n > 1 THEN 'repeated' ELSE 'successful null' END AS fault
FROM events FULL JOIN t ON event_id = k WHERE event_id IS NULL OR k IS NULL OR n > 1 OR (score IS NULL AND status = 'success')""")
def score_faults(spark, sf_dir: str) -> DataFrame:
    """Scores against their roster: missing, unexpected and repeated ones, and successes without a score."""
    e = bind.table(spark, sf_dir, "events").withColumn("k", F.col("event_id"))
    none = F.col("event_id") % 11 == 0
    s = e.where("event_id % 17 <> 0").select("k", "user_id", F.when(~none, F.col("value")).alias("score"), F.when(none & (F.col("event_id") % 3 != 0), "failed").otherwise("success").alias("status"))
    extra = lambda rows, key: rows.select(key.alias("k"), "user_id", F.col("value").alias("score"), F.lit("success").alias("status"))
    s = s.unionByName(extra(e.where("event_id % 23 = 1"), F.col("k"))).unionByName(extra(e.where("event_id % 101 = 0"), -1 - F.col("k")))
    return challenge.score_faults(e, s, ["k"], ["user_id"])
