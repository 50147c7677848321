"""Evidence of training: what a checkpoint changed, and running figures of a validation pass."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .contracts import ContractError, assert_empty


def parameter_updates(initial: DataFrame, selected: DataFrame) -> DataFrame:
    """(component, name, elements, changed, squared_change, squared_initial, largest) of each initial parameter.

    Both: (component, name, values). A parameter that the selected checkpoint lacks, or has in another size, is an
    error. Arrays are compared where they lie; only names move.
    """
    both = initial.alias("a").join(selected.alias("b"), ["component", "name"], "left")
    assert_empty(both.where("b.values IS NULL OR size(a.values) <> size(b.values)").select("component", "name"), "parameters missing or of another size")
    delta = F.zip_with("a.values", "b.values", lambda x, y: y.cast("double") - x.cast("double"))
    total = lambda values, of: F.aggregate(values, F.lit(0.0), lambda s, x: s + of(x))
    held = both.select("component", "name", delta.alias("d"), F.col("a.values").alias("v"))
    return held.select(
        "component", "name", F.size("d").cast("long").alias("elements"), F.size(F.filter("d", lambda x: x != 0)).cast("long").alias("changed"), total("d", lambda x: x * x).alias("squared_change"),
        total("v", lambda x: x.cast("double") * x.cast("double")).alias("squared_initial"), F.aggregate("d", F.lit(0.0), lambda s, x: F.greatest(s, F.abs(x))).alias("largest"),
    )


def update_evidence(updates: DataFrame, optimizer_steps: int, selected_steps: int) -> DataFrame:
    """(component, n_parameters, n_changed, elements, changed_elements, l2, relative_l2, largest, status): a component passes if any element changed."""
    if not 0 < selected_steps <= optimizer_steps:
        raise ContractError("the selected checkpoint has taken some of the steps, at least one")
    out = updates.groupBy("component").agg(
        F.count("*").alias("n_parameters"), F.count_if(F.col("changed") > 0).alias("n_changed"), F.sum("elements").alias("elements"), F.sum("changed").alias("changed_elements"),
        F.sum("squared_change").alias("d"), F.sum("squared_initial").alias("v"), F.max("largest").alias("largest"),
    )
    status = F.when(F.col("changed_elements") > 0, "passed").otherwise("failed").alias("status")
    return out.select("component", "n_parameters", "n_changed", "elements", "changed_elements", F.sqrt("d").alias("l2"), F.sqrt(F.try_divide("d", "v")).alias("relative_l2"), "largest", status)


def validation_metrics(masks: DataFrame, scores: DataFrame, by: list[str]) -> DataFrame:
    """Figures of a validation pass by scope, each from one aggregate before the join of one row a scope.

    ``masks``: (by, input, source, lung, target, predicted), masks as the bits of a long. ``scores``: (by, input, target,
    prediction, loss), one row a target, ``loss`` the same in an input's rows. A prediction that is not finite counts
    against the finite rate and in nothing else; two empty masks have a Dice of one.
    """
    area = lambda c: F.bit_count(F.col(c))
    shared = F.bit_count(F.col("target").bitwiseAND(F.col("predicted")))
    dice = F.coalesce(F.try_divide(2 * shared, (area("target") + area("predicted")).cast("double")), F.lit(1.0))
    empty = F.col("predicted") == 0
    inputs = masks.groupBy(*by, "input").agg(F.min("source").alias("source"), F.count("*").alias("lungs"), F.sum(dice).alias("dice"), F.count_if(empty).alias("empty"))
    per_scope = inputs.groupBy(*by).agg(
        F.count("*").alias("inputs"), F.count_distinct("source").alias("unique_sources"), F.sum("lungs").alias("mask_denominator"), F.sum("empty").alias("empty_masks"), F.sum("dice").alias("dice"),
        F.count_if(F.col("empty") > 0).alias("inputs_with_any_empty"), F.count_if(F.col("empty") == F.col("lungs")).alias("inputs_with_both_empty"),
    )
    finite = F.col("prediction").isNotNull() & ~F.isnan("prediction") & (F.abs("prediction") != float("inf"))
    own = scores.groupBy(*by, "input").agg(F.count("*").alias("targets"), F.count_if(finite).alias("finite"), F.sum(F.when(finite, F.abs(F.col("prediction") - F.col("target")))).alias("error"), F.max("loss").alias("loss"))
    told = own.groupBy(*by).agg(F.sum("targets").alias("targets"), F.sum("finite").alias("finite_targets"), F.sum("error").alias("error"), F.avg("loss").alias("mean_loss"))
    d = lambda a, b: F.try_divide(F.col(a).cast("double"), F.col(b).cast("double"))
    return per_scope.join(told, by, "left").select(
        *by, "inputs", "targets", "unique_sources", d("error", "finite_targets").alias("mae"), d("finite_targets", "targets").alias("finite_score_rate"), d("dice", "mask_denominator").alias("mask_dice"),
        d("empty_masks", "mask_denominator").alias("empty_mask_rate"), "empty_masks", "mask_denominator", "inputs_with_any_empty", "inputs_with_both_empty", "mean_loss",
    )
