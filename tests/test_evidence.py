"""What a checkpoint changed, figures of a validation pass, and errors bootstrapped by each dataset's own unit."""

import math

import pytest

from rankweave.operators import evidence
from rankweave.operators import replicates as rep
from rankweave.operators.contracts import ContractError


def test_parameter_updates(spark):
    schema = "component string, name string, values array<float>"
    a = spark.createDataFrame([("head", "w", [1.0, 2.0, 2.0]), ("head", "b", [0.0]), ("stem", "c", [3.0, 4.0])], schema)
    b = spark.createDataFrame([("head", "w", [1.0, 5.0, -2.0]), ("head", "b", [0.0]), ("stem", "c", [3.0, 4.0]), ("other", "x", [1.0])], schema)
    got = {r.component: r for r in evidence.update_evidence(evidence.parameter_updates(a, b), 5, 3).collect()}
    head = got["head"]
    assert (head.n_parameters, head.n_changed, head.elements, head.changed_elements, head.l2, head.largest, head.status) == (2, 1, 4, 2, 5.0, 4.0, "passed")
    assert head.relative_l2 == pytest.approx(5 / 3) and got["stem"].status == "failed" and got["stem"].relative_l2 == 0 and set(got) == {"head", "stem"}
    with pytest.raises(ContractError, match="another size"):
        evidence.parameter_updates(a, b.where("name <> 'c'"))
    with pytest.raises(ContractError, match="another size"):
        evidence.parameter_updates(a, spark.createDataFrame([("head", "w", [1.0]), ("head", "b", [0.0]), ("stem", "c", [3.0, 4.0])], schema))
    for steps, selected in ((3, 0), (3, 4)):
        with pytest.raises(ContractError):
            evidence.update_evidence(evidence.parameter_updates(a, b), steps, selected)


def test_validation_metrics(spark):
    masks = spark.createDataFrame([("d", 1, 7, 0, 0b1100, 0b0110), ("d", 1, 7, 1, 0b1, 0), ("d", 2, 7, 0, 0, 0), ("d", 2, 7, 1, 3, 0), ("e", 3, 8, 0, -1, -1)], "ds string, input long, source long, lung int, target long, predicted long")
    scores = spark.createDataFrame([("d", 1, 0.5, 0.75, 2.0), ("d", 1, 0.5, math.nan, 2.0), ("d", 2, 0.5, None, 4.0), ("d", 2, 1.0, math.inf, 4.0)], "ds string, input long, target double, prediction double, loss double")
    got = {r.ds: r for r in evidence.validation_metrics(masks, scores, ["ds"]).collect()}
    d = got["d"]
    assert (d.inputs, d.targets, d.unique_sources, d.mae, d.finite_score_rate, d.mean_loss) == (2, 4, 1, 0.25, 0.25, 3.0)
    assert d.mask_dice == pytest.approx((0.5 + 0 + 1 + 0) / 4) and (d.empty_masks, d.mask_denominator, d.inputs_with_any_empty, d.inputs_with_both_empty) == (3, 4, 2, 1)
    assert got["e"].mask_dice == 1.0 and got["e"].mae is None and got["e"].targets is None


def test_public_evaluation_draws_each_datasets_unit(spark):
    rows = [("fam", f"s{k}", f"g{k // 3}", 0.5 + k / 40, 0.4) for k in range(12)] + [("own", f"s{k}", "g", 0.3, k / 20) for k in range(9)]
    keyed = rep.evaluation_groups(spark.createDataFrame(rows, "ds string, source string, grp string, y double, s double"), "ds", "source", "grp", ["fam"])
    assert {r.ds: r.n for r in keyed.groupBy("ds").agg({"case": "count"}).withColumnRenamed("count(case)", "n").collect()} == {"fam": 12, "own": 9}
    assert keyed.select("ds", "case").distinct().groupBy("ds").count().collect().__len__() == 2 and keyed.where("ds = 'fam'").select("case").distinct().count() == 4
    alone = rep.regression_bootstrap(keyed, keyed, ["ds"], ["ds"], "case", "y", "s", 20)
    whole = rep.ranking_bootstrap(keyed, keyed, ["ds"], ["ds"], "case", "y", "s", 20)
    take = lambda df: {(r.ds, r.rep): (r.mae, r.rmse) for r in rep.long_form(df, ["ds"], rep.REGRESSION).collect()}
    assert take(alone) == take(whole.select("ds", *rep.REGRESSION)) and len(take(alone)) == 42
