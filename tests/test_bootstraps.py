"""Bootstraps by vectors against rows that are repeated as often as their group is drawn."""

import math
import random

import numpy as np
import pytest

from rankweave.operators import align, ranking
from rankweave.operators import replicates as rep


def drawn(strata_groups, replicates, seed=17):
    """{(stratum, group): [1, multiplicities]} by the stated rule, in Python numbers."""
    import hashlib

    def mix(x):
        x = (x ^ (x >> 30)) * 0xBF58476D1CE4E5B9 % 2**64
        x = (x ^ (x >> 27)) * 0x94D049BB133111EB % 2**64
        return x ^ (x >> 31)

    out = {}
    for stratum, groups in strata_groups.items():
        n = len(groups)
        name = ":".join([*([stratum] if stratum is not None else []), str(seed)])
        key = int(hashlib.sha256(name.encode()).hexdigest()[:12], 16)
        counts = np.zeros((n, replicates + 1), int)
        counts[:, 0] = 1
        for r in range(replicates if n > 1 else 0):
            for j in range(n):
                counts[mix((mix(key + r) + j) % 2**64) % n, r + 1] += 1
        out |= {(stratum, g): counts[k] for k, g in enumerate(sorted(groups))}
    return out


def metrics(y, s):
    """The definitions, on expanded rows: labels do not break ties, expectations inside a tie."""
    n = len(y)
    out = dict.fromkeys([*rep.RANKING, *rep.REGRESSION])
    if not n:
        return out
    bad = y < 0.9
    b, g = int(bad.sum()), int((~bad).sum())
    order = np.argsort(-s, kind="stable")
    prefix = []
    for value in sorted(set(s.tolist()), reverse=True):
        here = s == value
        before = float((bad & (s > value)).sum())
        prefix += [before + (k + 1) * bad[here].mean() for k in range(int(here.sum()))]
    assert len(prefix) == len(order)
    prefix, i = np.array(prefix), np.arange(1, n + 1)
    out["aurc"] = (prefix / i).mean()
    out["eaurc"] = out["aurc"] - (np.maximum(0, i - g) / i).mean()
    if b and g:
        pairs = (s[bad][:, None] < s[~bad][None, :]) + 0.5 * (s[bad][:, None] == s[~bad][None, :])
        out["auroc"] = pairs.mean()
        out["ap"] = sum((bad & (s == v)).sum() * (bad & (s <= v)).sum() / (s <= v).sum() for v in set(s.tolist())) / b
    for c in ranking.COVERAGES:
        kept = math.ceil(n * c - 1e-9)
        out[f"risk_{round(100 * c)}"] = prefix[kept - 1] / kept
    out["mae"], out["rmse"] = np.abs(y - s).mean(), np.sqrt(((y - s) ** 2).mean())
    return out


def rows_of(seed=1):
    rng = random.Random(seed)
    pool = {"d": [f"g{k}" for k in range(9)], None: [f"h{k}" for k in range(5)], "one": ["solo"], "bare": ["x", "y", "z"]}
    rows = [(d, g, rng.choice([0.5, 0.8, 0.95, 1.0]), rng.choice([0.1, 0.4, 0.4, 0.9, rng.random()])) for d, gs in pool.items() if d != "bare" for g in gs[: max(1, len(gs) - 2)] for _ in range(rng.randint(1, 6))]
    return pool, [*rows, ("d", "g0", None, 0.3), ("d", "g1", 0.7, None), ("bare", "x", 0.2, 0.4), ("bare", "x", 0.3, 0.1)]


@pytest.mark.parametrize("part_bytes", [1 << 26, 700])
def test_ranking_bootstrap_by_expanded_rows(spark, monkeypatch, part_bytes):
    monkeypatch.setattr(rep, "PART_BYTES", part_bytes)  # the small one: many parts, many flushes
    replicates = 40
    pool, rows = rows_of()
    df = spark.createDataFrame(rows, "ds string, grp string, y double, s double").repartition(3)
    groups = spark.createDataFrame([(d, g) for d, gs in pool.items() for g in gs] * 2, "ds string, grp string")
    found = rep.ranking_bootstrap(df, groups, ["ds"], ["ds"], "grp", "y", "s", replicates)
    got = {(r.ds, r.rep): r for r in rep.long_form(found, ["ds"], (*rep.RANKING, *rep.REGRESSION)).collect()}
    weights = drawn({d: gs for d, gs in pool.items()}, replicates)
    assert set(got) == {(d, r) for d in pool for r in range(-1, replicates)}
    for d in pool:
        own = [(g, y, s) for e, g, y, s in rows if e == d and y is not None and s is not None]
        for r in range(-1, replicates):
            y, s = (np.array([x[k] for x in own for _ in range(weights[d, x[0]][r + 1])]) for k in (1, 2))
            want = metrics(y, s)
            for c, v in want.items():
                x = got[d, r][c]
                assert (x is None) == (v is None) and (v is None or x == pytest.approx(v, abs=1e-12)), (d, r, c, x, v)


def test_zero_row_cases_shared_draws_and_intervals(spark):
    """Equal scores of two methods differ by nothing in every replicate; draws without the scored case are undefined."""
    rows = [("d", "a", 0.5, 0.4, m) for m in ("ours", "same")]
    df = spark.createDataFrame(rows, "ds string, grp string, y double, s double, method string")
    pool = spark.createDataFrame([("d", g) for g in "abc"], "ds string, grp string")
    found = rep.ranking_bootstrap(df, pool, ["ds", "method"], ["ds"], "grp", "y", "s", 100)
    one = {(r.method, r.metric): r for r in rep.vector_intervals(found, ["ds", "method"], (*rep.RANKING, *rep.REGRESSION)).collect()}
    weights = drawn({"d": ["a", "b", "c"]}, 100)["d", "a"][1:]
    assert one["ours", "aurc"].n_undefined == int((weights == 0).sum()) > 0 and one["ours", "aurc"].point == 1.0
    assert one["ours", "auroc"].n_valid == 0 and one["ours", "auroc"].low is None
    apart = rep.vector_intervals(rep.paired(found, ["ds", "method"], "method", "ours", ("aurc", "mae")), ["ds", "method"], ("aurc", "mae")).collect()
    assert {(r.metric, r.point, r.low, r.high) for r in apart} == {("aurc", 0.0, 0.0, 0.0), ("mae", 0.0, 0.0, 0.0)}


def test_scored_group_outside_the_pool_and_odd_values_are_errors(spark):
    df = spark.createDataFrame([("d", "a", 0.5, 0.4), ("d", "q", 0.5, 0.4)], "ds string, grp string, y double, s double")
    pool = spark.createDataFrame([("d", g) for g in "abc"], "ds string, grp string")
    with pytest.raises(Exception, match="not in the pool"):
        rep.ranking_bootstrap(df, pool, ["ds"], ["ds"], "grp", "y", "s", 5).collect()
    odd = spark.createDataFrame([("d", "a", 0.5, math.nan)], df.schema)
    for f in (lambda: rep.ranking_bootstrap(odd, pool, ["ds"], ["ds"], "grp", "y", "s", 5), lambda: ranking.rank_metrics(odd, ["ds"], "y", "s"), lambda: ranking.spearman(odd, ["ds"], "s", "y")):
        with pytest.raises(Exception, match="s holds a value that is not finite"):
            f().collect()


def brute_budget(units, weights, budget, policy):
    """units: (key, low, score or None); the reference rule on expanded units."""
    x = [(low, s) for key, low, s in units for _ in range(weights[key])]
    total, bad = len(x), sum(low for low, _ in x)
    missing = [low for low, s in x if s is None]
    reviewed, hit = float(len(missing)), float(sum(missing))
    quota = max(0.0, budget * total - len(missing))
    for value in sorted({s for _, s in x if s is not None}):
        tie = [low for low, s in x if s == value]
        take = min(max(quota, 0), len(tie)) / len(tie)
        reviewed, hit, quota = reviewed + take * len(tie), hit + take * sum(tie), quota - len(tie)
    d = lambda a, b: a / b if b > 0 else None
    return [d(hit, bad), d(max(0, bad - hit), max(0, total - reviewed)), d(reviewed - hit, reviewed), d(reviewed - hit, total - bad), reviewed]


@pytest.mark.parametrize("part_bytes", [1 << 26, 700])
def test_workload_bootstrap_by_expanded_units(spark, monkeypatch, part_bytes):
    monkeypatch.setattr(rep, "PART_BYTES", part_bytes)
    rng = random.Random(6)
    pool = {"d": [f"g{k}" for k in range(6)], "e": [f"h{k}" for k in range(4)]}
    reports = [(d, g, f"{g}r{k}") for d, gs in pool.items() for g in gs for k in range(rng.randint(1, 3))]
    claims = [(d, g, r, rng.choice([0.5, 0.95]), rng.choice([0.1, 0.4, 0.9, None, math.nan]), rng.choice([0.2, 0.3, 0.7])) for d, g, r in reports if g != "g5" for _ in range(rng.randint(0, 3))]
    found = rep.workload_bootstrap(
        spark.createDataFrame(claims, "ds string, grp string, report string, y double, a double, b double"), spark.createDataFrame(reports, "ds string, grp string, report string"), ["ds"], "grp", ["ds", "grp", "report"], "y", {"a": "a", "b": "b"}, 25
    )
    got = {(r.level, r.policy, r.method, r.budget, r.rep): r for r in rep.long_form(found, ["level", "policy", "method", "budget"], rep.WORKLOAD).collect()}
    weights = drawn(pool, 25)
    none = lambda v: None if v is None or math.isnan(v) else v
    by_report = {}
    for d, g, r, y, a, b in claims:
        by_report.setdefault((d, g, r), []).append((y < 0.9, none(a), none(b)))
    units = {"claim": [((d, g), y < 0.9, none(a), none(b)) for d, g, _, y, a, b in claims]}
    units["report"] = [((d, g), any(x[0] for x in xs), *(min(x[k] for x in xs) if all(x[k] is not None for x in xs) else None for k in (1, 2))) for (d, g, _), xs in by_report.items()]
    assert {k[:3] for k in got} == {(x, y, z) for x in ("claim", "report") for y in ("common_valid", "full_failure_first") for z in "ab"} and len(got) == 2 * 2 * 2 * 5 * 26
    for (level, policy, method, budget, r), row in got.items():
        own = [(key, low, (a, b)[method == "b"]) for key, low, a, b in units[level] if policy == "full_failure_first" or (a is not None and b is not None)]
        w = {k: v[r + 1] for k, v in weights.items()}
        *want, reviewed = brute_budget(own, w, budget, policy)
        want.append(reviewed / sum(w[d, g] for d, g, _ in reports) if level == "report" and sum(w[d, g] for d, g, _ in reports) else None)
        assert [row[c] for c in rep.WORKLOAD] == [pytest.approx(x, abs=1e-12) if x is not None else None for x in want], (level, policy, method, budget, r)


def test_positions_are_right_with_other_columns_at_size(spark):
    """Two runs of a range shuffle sample other bounds: sizes and places must come from one table."""
    from pyspark.sql import functions as F

    n = 3_000_000
    df = spark.range(n, numPartitions=8).select(F.xxhash64("id").alias("k"), F.concat(F.lit("t"), F.col("id").cast("string")).alias("text"))
    found = align.numbered(df, ["k"])
    assert found.columns == ["k", "text", "position"]
    # In order, next to each other: the keys' order is that of the positions, which run from 0 without a gap.
    s = found.agg(F.count("*").alias("n"), F.count_distinct("position").alias("d"), F.min("position").alias("lo"), F.max("position").alias("hi")).first()
    assert tuple(s) == (n, n, 0, n - 1)
    other = df.select("k").sort("k").rdd.map(lambda r: r.k).zipWithIndex().map(lambda x: (x[0], x[1])).toDF("k long, p long")
    assert found.join(other, "k").where("position <> p").count() == 0


def test_spearman_keeps_a_null_scope(spark):
    rows = [(None, 0.1, 0.2), (None, 0.2, 0.4), (None, 0.3, 0.3), ("d", 0.1, 0.2), ("d", 0.2, 0.4)]
    got = {r.ds: r.spearman for r in ranking.spearman(spark.createDataFrame(rows, "ds string, y double, s double"), ["ds"], "y", "s").collect()}
    assert got == {None: pytest.approx(0.5), "d": pytest.approx(1.0)}


def test_a_vector_goes_to_python_once_a_group(spark, monkeypatch):
    monkeypatch.setattr(rep, "PART_BYTES", 1 << 14)
    rows = spark.range(4000).selectExpr("'x' AS ds", "id % 200 AS grp", "CAST(id % 4 AS double) / 4 AS y", "CAST(id % 2 AS double) AS s")
    got = rep.ranking_bootstrap(rows, rows.select("ds", "grp"), ["ds"], ["ds"], "grp", "y", "s", 20).first()
    cells = rep._cells(rows, ["ds"], ["ds"], "grp", rows.y < 0.9, "s")
    plan = rep.weighted_sums(cells, rep.draw_vectors(rows, ["ds"], "grp", 20), ["ds"], "grp", ["ds", "score"], ["n", "bad"], 21)._jdf.queryExecution().sparkPlan().toString()
    assert "Join" not in plan and got.mae[0] == pytest.approx(0.5 * (0.0 + 0.5) / 2 + 0.5 * (0.75 + 0.25) / 2)


@pytest.mark.parametrize("sum_block", [1 << 14, 4])
def test_regression_alone_by_expanded_rows(spark, monkeypatch, sum_block):
    """No vector a group is made, memory is by block, and draws and errors are those of the vectors."""
    monkeypatch.setattr(rep, "SUM_BLOCK", sum_block)
    monkeypatch.setattr(rep, "PICKS", 4)
    monkeypatch.setattr(rep, "PART_BYTES", 60)
    monkeypatch.setattr(rep, "draw_vectors", lambda *_: pytest.fail("a vector a group"))
    pool, rows = rows_of()
    both = [(m, d, g, y, s if m == "a" or s is None else 1 - s) for d, g, y, s in rows for m in "ab"]
    df = spark.createDataFrame(both, "method string, ds string, grp string, y double, s double").repartition(3)
    groups = spark.createDataFrame([(d, g) for d, gs in pool.items() for g in gs] * 2, "ds string, grp string")
    weights = drawn(pool, 40)
    for by in (["ds", "method"], ["method"], []):
        found = rep.regression_bootstrap(df, groups, by, ["ds"], "grp", "y", "s", 40)
        got = {(*(r[c] for c in by), r.rep): r for r in rep.long_form(found, by, rep.REGRESSION).collect()}
        scopes = {tuple({"ds": d, "method": m}[c] for c in by) for d in pool for m in "ab"}
        assert set(got) == {(*x, r) for x in scopes for r in range(-1, 40)}
        for *scope, r in got:
            own = [(weights[d, g][r + 1], y - s) for m, d, g, y, s in both if y is not None and s is not None and [{"ds": d, "method": m}[c] for c in by] == scope]
            n = sum(w for w, _ in own)
            want = [sum(w * abs(e) for w, e in own) / n, math.sqrt(sum(w * e * e for w, e in own) / n)] if n else [None, None]
            assert [got[*scope, r][c] for c in rep.REGRESSION] == [None if x is None else pytest.approx(x, abs=1e-12) for x in want], (scope, r)
    with pytest.raises(Exception, match="not in the pool"):
        rep.regression_bootstrap(df, groups.where("grp <> 'g0'"), ["ds"], ["ds"], "grp", "y", "s", 5).collect()


def test_intervals_take_the_references_thousand_replicates():
    from rankweave.catalogue import bootstraps

    assert bootstraps.EVALUATION_REPLICATES == 1000 and "range(1000) r" in bootstraps.ORACLE_SQL["public_evaluation"]
    assert bootstraps.WORKLOAD_REPLICATES == 1000 and "range(1000) r" in bootstraps.ORACLE_SQL["workload_intervals"]
