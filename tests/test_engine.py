"""Golden cases of the engine and the SQL twins on the smallest tables."""

import math

import duckdb
import pytest
from pyspark.sql import functions as F

from rankweave import catalogue
from rankweave.functions import claims, ids, raster, shapes
from rankweave.operators import align, challenge, contracts, dedup, ranking, reports

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def plain(x):
    if isinstance(x, float):
        return round(x, 5) + 0.0
    return tuple(map(plain, x)) if isinstance(x, (list, tuple)) else x


@pytest.mark.parametrize("name", sorted(catalogue.ORACLE_SQL))
def test_query_equals_sql(spark, duck, name):
    df = catalogue.QUERIES[name](spark, SF)
    cursor = duck.execute(catalogue.ORACLE_SQL[name])
    columns = [c[0] for c in cursor.description]
    assert sorted(columns) == sorted(df.columns)
    want = sorted(repr(plain([r[columns.index(c)] for c in df.columns])) for r in cursor.fetchall())
    assert sorted(repr(plain(list(r))) for r in df.collect()) == want


def metrics(spark, truth, score):
    rows = spark.createDataFrame([("d", float(t), float(s)) for t, s in zip(truth, score, strict=True)], "ds string, y double, s double")
    return ranking.rank_metrics(rows, ["ds"], "y", "s").first()


def test_metric_goldens(spark):
    tied = metrics(spark, [1, 0, 1, 0], [2, 2, 2, 2])
    assert tied.aurc == tied.auroc == tied.ap == 0.5
    perfect = metrics(spark, [1, 0.4, 1, 0.6], [1, 0.1, 0.9, 0.2])
    assert perfect.auroc == perfect.ap == 1 and abs(perfect.eaurc) < 1e-12
    error = metrics(spark, [0, 0.5, 1], [0.1, 0.5, 0.9])
    assert math.isclose(error.mae, 0.2 / 3) and math.isclose(error.rmse, math.sqrt(0.02 / 3))
    good, bad = metrics(spark, [1, 1], [0.2, 0.1]), metrics(spark, [0.1, 0.2], [0.3, 0.4])
    assert good.aurc == 0 and bad.aurc == 1 and good.auroc is None and bad.auroc is None and bad.eaurc == 0


#: Sentences and why their mentions may not be touched.
HAZARDS = {
    "History of pneumothorax.": "history", "The pleural effusion has resolved.": "resolved", "Cannot exclude consolidation.": "uncertain", "Pleural effusion is not excluded.": "uncertain",
    "No interval change in pleural effusion.": "comparison", "No new pneumothorax.": "comparison", "No significant pleural effusion.": "qualified_assertion", "No large pneumothorax.": "qualified_assertion",
    "No pleural effusion with adjacent consolidation.": "ambiguous_scope", "No left pleural effusion or pneumothorax.": "ambiguous_modifier_scope", "No focal consolidation or atelectasis.": "ambiguous_modifier_scope",
    "No airspace consolidation or atelectasis.": "ambiguous_modifier_scope", "No pleural effusion and pneumothorax.": "ambiguous_scope", "No pleural effusion or pneumothorax and a left basilar opacity is present.": "ambiguous_scope",
    "Pneumothorax is present.": "not_explicit_negative", "Pleural effusion or pneumothorax is absent.": "ambiguous_scope", "No pleural effusion, consolidation is present.": "ambiguous_scope", "Neither pneumothorax is seen.": "ambiguous_scope",
}
SAFE = [
    "There is no evidence of consolidation, pulmonary edema, pleural effusion, or pneumothorax.", "No focal consolidation, pleural effusion, or pneumothorax.", "No pleural effusions or pneumothorax are identified.",
    "Neither pleural effusion nor pneumothorax is seen.", "Pleural effusion and pneumothorax are absent.", "WITHOUT pleural\u00a0effusion or Pneumothorax.",
]


def test_claims(spark):
    odd = "  FINDINGS:\n  α😀 Small left pleural effusion.\r\nNo pneumothorax!  "
    rows = [(k, x) for k, x in enumerate([*HAZARDS, *SAFE, odd, "No effusion or opacity.", "", None, "No pneumothorax, but small left pleural effusion is present."])]
    texts = dict(rows)
    found = {}
    for r in claims.extract_claims(spark.createDataFrame(rows, "k long, text string"), "k", "text").collect():
        x = texts[r.k]
        assert x[r.start : r.end] == r.claim_text and x[r.sentence_start : r.sentence_end] == r.sentence_text
        found.setdefault(x, []).append((r.start, r.finding, r.eligible, r.skip_reason, r.polarity, r.laterality))
    for x, why in HAZARDS.items():
        assert {c[2:4] for c in found[x]} == {(False, why)}, x
    for x in SAFE:
        assert all(c[2] and c[4] == "negative" for c in found[x]), x
    assert [c[1:] for c in sorted(found[odd])] == [("pleural_effusion", False, "qualified_assertion", "positive", "left"), ("pneumothorax", True, None, "negative", "unspecified")]
    assert [c[1:3] for c in sorted(found[rows[-1][1]])] == [("pneumothorax", True), ("pleural_effusion", False)]
    assert set(found) == {*HAZARDS, *SAFE, odd, rows[-1][1]}


def decided(spark, rows, findings=None, **more):
    df = spark.createDataFrame(rows, "k long, text string")
    d = claims.extract_claims(df, "k", "text").withColumns({"abstain": F.col("finding").isin(*findings) if findings else F.lit(True), "support_score": F.lit(0.15), "reason": F.lit("low")})
    return df, d


def test_edits(spark):
    end = "the current image does not support confident exclusion of"
    rows = [(1, "No pleural effusion or pneumothorax."), (2, "É. No consolidation, pulmonary edema, pleural effusion, or pneumothorax are seen.\nTube is unchanged."), (3, "No pleural effusion or pneumothorax, but left atelectasis is present."), (4, "Lungs clear."), (5, None)]
    df, d = decided(spark, rows, ["pleural_effusion"])
    out = {r.k: r for r in reports.edit_reports(df, d, "k", "text").collect()}
    assert out[1].edited_findings == f"No pneumothorax; {end} pleural effusion."
    assert out[2].edited_findings == f"É. No consolidation, pulmonary edema, or pneumothorax are seen; {end} pleural effusion.\nTube is unchanged."
    assert out[3].edited_findings == f"No pneumothorax; {end} pleural effusion, but left atelectasis is present."
    assert out[4].edited_findings == "Lungs clear." and out[5].edited_findings is None and [len(out[k].edits) for k in range(1, 6)] == [1, 1, 1, 0, 0] and not out[1].skipped_edits
    df, d = decided(spark, rows[:2] + [(6, "No large pneumothorax.")])
    stale = d.where("k = 1").limit(1).withColumn("claim_id", F.lit("stale"))
    wrong = d.where("k = 2 AND finding = 'consolidation'").withColumn("start", F.col("start") + 1)
    twice = d.where("k = 1 AND finding = 'pneumothorax'")
    scored = d.where("k = 2 AND finding = 'pneumothorax'").withColumn("support_score", F.lit(1.5))
    rest = d.where("NOT (k = 2 AND finding IN ('consolidation', 'pneumothorax'))")
    out = {r.k: r for r in reports.edit_reports(df, rest.unionByName(stale).unionByName(wrong).unionByName(twice).unionByName(scored), "k", "text").collect()}
    why = {k: sorted(x.reason for x in r.skipped_edits) for k, r in out.items()}
    assert why == {1: ["duplicate_decision", "duplicate_decision", "unknown_or_stale_claim"], 2: ["claim_metadata_mismatch", "invalid_support_score"], 6: ["qualified_assertion"]}
    assert out[6].edited_findings == "No large pneumothorax."


def test_geometry_review(spark):
    rows = [(1, "No pleural effusion or pneumothorax."), (2, "Lungs clear.")]
    df, d = decided(spark, rows)
    d = d.withColumns({"trigger": F.lit("predicted_anatomical_retention"), "proxy_retention_score": F.lit(0.2)})
    out = reports.geometry_review(df, d, "k", "text")
    stored = {r.k: r for r in out.collect()}
    assert stored[1].edited_findings.startswith("Predicted lung-field retention is low; review pleural effusion on the complete image; predicted") and stored[1].unchanged_utf8_bytes == 1 and stored[2].changed_groups == 0
    assert reports.audit_review(df, out, "k", "text").count() == 0
    assert reports.audit_review(df, out.withColumn("edited_findings", F.lit("x")), "k", "text").count() == 2
    for bad in (d.withColumn("trigger", F.lit("other")), d.withColumn("claim_id", F.lit("stale")), d.withColumn("trigger", F.lit("ranking_only"))):
        with pytest.raises(contracts.ContractError):
            reports.geometry_review(df, bad, "k", "text")


def test_rasters():
    import numpy as np

    rng = np.random.default_rng(2)
    mask = rng.random((14, 11)) < 0.6
    y, x = np.nonzero(~np.pad(mask, 1))
    want = np.array([[np.sqrt(((y - 1 - i) ** 2 + (x - 1 - j) ** 2).min()) if mask[i, j] else 0 for j in range(11)] for i in range(14)])
    assert np.allclose(raster.distance_to_background(mask), want)
    box = np.array([[1.3, 2.2, 9.7, 12.9]])
    wx, wy = np.clip(np.minimum(np.arange(11) + 1, 9.7) - np.maximum(np.arange(11), 1.3), 0, 1), np.clip(np.minimum(np.arange(14) + 1, 12.9) - np.maximum(np.arange(14), 2.2), 0, 1)
    assert np.isclose(raster.Summed(mask).areas(box)[0], (mask * wy[:, None] * wx).sum())
    lungs = np.zeros((2, 80, 100), bool)
    lungs[0, 10:70, 10:40], lungs[1, 10:70, 60:90] = True, True
    assert raster.retention(lungs, [[0, 0, 100, 80], [0, 0, 1, 1], [0, 0, 50, 80]]).tolist() == [[1, 1, 1], [0, 0, 0], [0, 0, 0]]
    assert (shapes.split_lungs(lungs.any(0)) == lungs).all() and shapes.geometry_block(lungs[None]).shape == (1, 3, 75) and len(shapes.block_names()) == 75
    assert raster.rasterize(raster.polygon_contour([(1, 1), (5, 1), (5, 4), (1, 4), (1, 1)]), 6, 6).sum() == 12
    with pytest.raises(ValueError):
        raster.polygon_contour([(0, 0), (4, 4), (4, 0), (0, 4)])
    assert raster.decode_rle("1 2 5 1", 2, 3).tolist() == [[True, True, False], [False, True, False]]


def test_ids_and_contracts(spark):
    import hashlib
    import json

    rows = [("a\"b\\c",), ("é😀",), ("x\ny",)]
    df = spark.createDataFrame(rows, "s string").select("s", ids.stable_hash(ids.json_string(F.lit("t")), ids.json_string(F.col("s"))).alias("h"))
    for r in df.collect():
        assert r.h == hashlib.sha256(json.dumps(["t", r.s], ensure_ascii=False, separators=(",", ":")).encode()).hexdigest()
    for m in (2, 10, 13, 2**31 - 1):
        assert all(r.m == int(r.h, 16) % m for r in df.select("h", ids.hash_mod(F.col("h"), m).alias("m")).collect())
    with pytest.raises(contracts.ContractError):
        contracts.assert_empty(contracts.duplicate_keys(spark.createDataFrame([(1,), (1,)], "k int"), ["k"]), "keys")
    states = align.align_scores(spark.createDataFrame([(1,), (2,)], "k int"), spark.createDataFrame([(2, 0.5), (3, 0.1)], "k int, score double"), ["k"])
    assert {r.k: r.state for r in states.collect()} == {1: "missing", 2: "matched", 3: "unknown"}


def test_shapes_by_definition(spark):
    """Measures of random masks from their pixels, one by one."""
    import numpy as np

    rng = np.random.default_rng(3)
    masks = rng.random((6, 9, 12)) > 0.5
    masks[5] = False
    got = shapes.measures(masks)
    for k, m in enumerate(masks[:5]):
        ys, xs = np.nonzero(m)
        inside = lambda y, x, m=m: 0 <= y < 9 and 0 <= x < 12 and m[y, x]
        outline = sum(not inside(y + dy, x + dx) for y, x in zip(ys, xs) for dy, dx in ((0, 1), (1, 0), (0, -1), (-1, 0)))
        want = {
            "area_fraction": m.mean(), "bbox_x0": xs.min() / 12, "bbox_y0": ys.min() / 9, "bbox_width": (xs.max() + 1 - xs.min()) / 12, "bbox_height": (ys.max() + 1 - ys.min()) / 9, "centroid_x": (xs + 0.5).mean() / 12,
            "centroid_y": (ys + 0.5).mean() / 9, "compactness": 4 * np.pi * m.sum() / outline**2, "contact_top": m[0].mean(), "contact_right": m[:, -1].mean(), "mass_middle_third": m[3:6].sum() / m.sum(), "empty": 0,
        }
        assert all(np.isclose(got[name][k], v) for name, v in want.items())
    assert got["empty"][5] == 1 and got["centroid_x"][5] == 0
    pair = np.zeros((1, 2, 20, 30))
    pair[0, 1, 4:16, 3:12], pair[0, 0, 4:16, 18:27] = 0.9, 0.8
    out = shapes.bilateral(pair)
    assert np.isclose(out["image_left_foreground_probability_mean"][0], 0.9) and np.isclose(out["bilateral_reflected_dice"][0], 1) and out["bilateral_overlap_fraction"][0] == 0
    rim = shapes.parts(pair > 0.5)[1][0, 1]
    assert rim.sum() == 12 * 9 - 10 * 7
    bits = raster.pack(pair[0, 0] > 0.5)
    rows = shapes.geometry_blocks(spark.createDataFrame([(1, bits, raster.pack(pair[0, 1] > 0.5), 20, 30), (2, None, bits, 20, 30)], "k long, a binary, b binary, h int, w int"), "k", "a", "b", "h", "w").collect()
    assert [r.k for r in rows] == [1, 1, 1] and np.allclose([r.features for r in rows], shapes.geometry_block(pair > 0.5)[0])


@pytest.mark.parametrize("local_rows", [0, 10**6])
def test_greedy_is_sequential(spark, local_rows):
    """Groups of any size, seeds outside the cohort and a long chain against the scan one by one."""
    import random

    rng = random.Random(4)
    groups = [rng.sample(range(60), rng.choice([2, 2, 2, 3, 7])) for _ in range(40)] + [[k, k + 1] for k in range(60, 72)] + [[-5, 61], [-6, 3, 4, 90]]
    taken, kept = {g for g, x in enumerate(groups) if -5 in x or -6 in x}, set()
    for k in range(75):
        own = {g for g, x in enumerate(groups) if k in x}
        if not own & taken:
            kept.add(k)
            taken |= own
    members = spark.createDataFrame([(str(g), k) for g, x in enumerate(groups) for k in x], "group string, node long")
    nodes = spark.createDataFrame([(k,) for k in [*range(75), 3, None]], "node long")
    got = dedup.greedy_keep(members, nodes, spark.createDataFrame([(-5,), (-6,)], "node long"), local_rows).collect()
    assert sorted((r.node, r.kept) for r in got) == [(k, k in kept) for k in range(75)]
    assert dedup.greedy_keep(members.limit(0), nodes, None, local_rows).where("kept").count() == 75


def test_near_matches_by_brute_force(spark, monkeypatch):
    """Codes within eight bits whose thumbnails agree, and equal hashes, also where a band is common to many codes."""
    import random

    monkeypatch.setattr(dedup, "BLOCK", 5)
    rng = random.Random(17)
    rows = []
    for k in range(90):
        code, thumb, digest = (rng.getrandbits(256), bytes(rng.randrange(256) for _ in range(16)), f"h{k}") if k < 30 else list(rows[rng.randrange(len(rows))][1:])
        code = int(code, 16) if isinstance(code, str) else code
        for _ in range(rng.choice([0, 0, 3, 8, 9])):
            code ^= 1 << rng.randrange(256)
        code &= (1 << 228) - 1 if k % 3 else (1 << 256) - 1
        rows.append((k, f"{code:064x}", bytes(min(255, x + rng.choice([0, 0, 10, 30])) for x in thumb), digest if rng.random() < 0.3 else f"d{k}"))
    df = spark.createDataFrame([*rows, (None, rows[0][1], rows[0][2], "h0"), (90, None, None, None)], "k long, code string, thumb binary, digest string")

    def match(x, y):
        apart = bin(int(x[1], 16) ^ int(y[1], 16)).count("1")
        return x[3] == y[3] or (apart <= 8 and sum(abs(p - q) for p, q in zip(x[2], y[2])) / 16 <= 12)

    near = {(r.a, r.b): r.distance for r in dedup.near_pairs(df, "k", "code").collect()}
    first = {}
    for k, code, *_ in rows:
        first.setdefault(code, k)
    classes = sorted((k, c) for c, k in first.items())
    want = {(a, b): bin(int(x, 16) ^ int(y, 16)).count("1") for a, x in classes for b, y in classes if a < b}
    assert near == {p: d for p, d in want.items() if d <= 8}
    groups = {}
    for r in dedup.memberships(df.where("k IS NOT NULL"), "k", ["digest"], "code", "thumb").collect():
        groups.setdefault(r.group, set()).add(r.node)
    found = {(a, b) for g in groups.values() for a in g for b in g if a < b}
    assert found == {(x[0], y[0]) for x in rows for y in rows if x[0] < y[0] and match(x, y)}


def test_retention_of_every_part(spark):
    sf = "/root/testdata/sf0.001"
    got = catalogue.QUERIES["retention_rectangles_all"](spark, sf)
    assert got.count() == 13 * spark.read.parquet(f"{sf}/part.parquet").count()


def test_report_scores_with_five_faults(spark):
    """Thirteen reports: a dropped report, an extra claim, a wrong finding, a changed report and a missing score."""
    truth = spark.createDataFrame([(f"i{k}", f, f"s{k}", 0.5 + k / 30) for k in range(13) for f in ("a", "b", "c")], "input string, finding string, source string, y double")
    claims_ = spark.createDataFrame([("i0", "a", "c1", "s0", "d0"), ("i0", "b", "c2", "s0", "d0"), ("i0", "c", "c3", "s0", "d0")], "input string, finding string, claim string, source string, digest string")
    joined, faults = challenge.claims_with_truth(claims_, truth, ["input", "finding"], ["source"])
    assert joined.count() == 3 and faults.count() == 0 and {r.truth_y for r in joined.collect()} == {0.5}
    scores = claims_.select("input", "claim", "finding", "digest", F.when(F.col("claim") != "c3", F.lit(0.4)).alias("score"), F.when(F.col("claim") == "c3", "failed").otherwise("success").alias("status"))
    check = lambda s, c=claims_: {(r.claim, r.fault) for r in challenge.score_faults(c, s, ["input", "claim"], ["finding", "digest"]).collect()}
    assert check(scores) == set()
    assert check(scores.where("claim <> 'c1'")) == {("c1", "missing")}
    assert check(scores.unionByName(scores.where("claim = 'c1'").withColumn("claim", F.lit("c9")))) == {("c9", "unexpected")}
    assert check(scores.withColumn("finding", F.when(F.col("claim") == "c2", "a").otherwise(F.col("finding")))) == {("c2", "identity differs")}
    assert check(scores.withColumn("digest", F.lit("other"))) == {(f"c{k}", "identity differs") for k in (1, 2, 3)}
    assert check(scores.withColumn("score", F.lit(float("nan")))) == {(f"c{k}", "invalid score") for k in (1, 2, 3)}
    assert {r.fault for r in challenge.claims_with_truth(claims_.withColumn("finding", F.lit("z")), truth, ["input", "finding"], ["source"])[1].collect()} == {"claim without truth"}
    out = {r.method: (r.nominal, r.scored, r.common) for r in challenge.matched_coverage(claims_, [], {"x": scores, "y": scores.where("claim = 'c1'")}, ["input", "claim"]).collect()}
    assert out == {"x": (3, 2, 1), "y": (3, 1, 1)}


def test_challenge_states_and_roster(spark):
    rows = [(0, False, None, None), (3, True, 0.5, 0.4), (2, True, 0.5, None), (3, True, 0.5, None), (4, True, 0.5, 0.1), (0, True, None, None), (9, False, None, None), (3, True, 1.5, 0.4), (1, False, 0.2, None)]
    df = spark.createDataFrame(rows, "state int, valid boolean, y double, s double")
    faults = [r.fault for r in challenge.state_faults(df, "state", "valid", ["y"], ["s"]).orderBy("state", "s").collect()]
    assert sorted(faults) == sorted(["eligibility differs from state", "target of an ineligible input", "score missing or outside", "target missing or outside", "score without success", "unknown state"])
    assert challenge.state_counts(df, "state").first().successful_queries == 9
    sources, variants = spark.createDataFrame([("p", "d1"), ("q", "d2")], "source_id string, dataset string"), ["u", "v"]
    records = spark.createDataFrame([("p", "u", "d1"), ("p", "v", "d1"), ("p", "v", "d1"), ("q", "u", "d1"), ("r", "u", "d1")], "source_id string, variant string, dataset string")
    assert {(r.source_id, r.variant, r.fault) for r in challenge.roster_faults(sources, variants, records, ["dataset"]).collect()} == {("p", "v", "repeated"), ("q", "u", "source identity differs"), ("q", "v", "missing"), ("r", "u", "not planned")}


def test_a_text_is_parsed_once_however_many_reports_hold_it(spark):
    from rankweave.functions import claims

    df = spark.createDataFrame([(k, t) for k in range(40) for t in ("No pneumothorax.", None, "No consolidation or pleural effusion.")], "k long, text string")
    assert claims.text_clauses(df, "text").count() == 2
    assert claims.extract_claims(df, "k", "text").count() == 120
