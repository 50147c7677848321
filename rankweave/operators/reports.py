"""Local abstentions in reports, all or nothing per claim, and everything else as it was."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import claims
from .contracts import assert_empty

EDITOR = "local-abstention-v1"
#: The words before and after a withdrawn noun.
ABSTENTION = ("The current image does not support confident exclusion of ", ".")
REVIEW = ("Predicted lung-field retention is low; review ", " on the complete image.")
TRIGGERS = ("predicted_anatomical_retention", "ranking_only", "truth_oracle", "missing_geometry")
PLURALS = ("effusions", "pneumothoraces", "consolidations", "fractures", "abnormalities")


def _listed(items: Column) -> Column:
    """``x``, ``x or y``, ``x, y, or z``."""
    head = F.array_join(F.slice(items, 1, F.greatest(F.size(items) - 1, F.lit(0))), ", ")
    last = F.try_element_at(items, F.lit(-1))
    return F.when(F.size(items) < 2, last).when(F.size(items) == 2, F.concat(head, F.lit(" or "), last)).otherwise(F.concat(head, F.lit(", or "), last))


def _reworded(wording: tuple[str, str]) -> Column:
    """The clause with the nouns of ``removed`` withdrawn: what is left of the list, then a statement for each."""
    kept = F.filter(F.transform("nouns", lambda x, i: F.when(~F.array_contains("removed", i), x)), lambda x: x.isNotNull())
    lead = F.when(F.col("absent") | F.lower("lead").startswith("neither"), F.lit("No ")).otherwise(F.col("lead"))
    rest = F.concat(lead, _listed(kept), F.when(F.col("absent"), "").otherwise(F.col("tail")))
    # One noun left: the verb agrees with it.
    verb = lambda v: F.regexp_replace(rest, rf"(?iU)\s+(?:is|are)\s+(?=(?:{'|'.join(claims.OBSERVED)}))", f" {v} ")
    one = F.try_element_at(kept, F.lit(1))
    agreed = F.when((F.size(kept) != 1) | (F.col("tail") == ""), rest).when(one.rlike(rf"(?iU)\b(?:{'|'.join(PLURALS)})\z"), verb("are")).otherwise(verb("is"))
    gone = F.transform(F.array_sort("removed"), lambda i: F.concat(F.lit(wording[0]), F.get("nouns", i), F.lit(wording[1][:-1])))
    low = lambda x: F.concat(F.lower(F.substring(x, 1, 1)), F.substring(x, F.lit(2), F.length(x)))
    following = F.transform(gone, lambda x, i: F.when((i > 0) | (F.size(kept) > 0), low(x)).otherwise(x))
    return F.array_join(F.concat(F.when(F.size(kept) > 0, F.array(agreed)).otherwise(F.array().cast("array<string>")), following), "; ")


def checked_decisions(found: DataFrame, decisions: DataFrame, key: str) -> DataFrame:
    """``decisions`` with their claim and ``why`` a wanted abstention cannot be done; a plain ``false`` asks for nothing."""
    times = decisions.groupBy(key, "claim_id").agg(F.count("*").alias("times"))
    echoed = [c for c in claims.FIELDS[1:] if c in decisions.columns]
    d = decisions.select(key, "claim_id", "abstain", "support_score", "reason", *(F.col(c).alias(f"said_{c}") for c in echoed))
    both = d.join(times, [key, "claim_id"], "left").join(found, [key, "claim_id"], "left")
    other = F.lit(False)
    for c in echoed:
        other = other | ~F.col(f"said_{c}").eqNullSafe(F.col(c))
    score = F.col("support_score")
    why = (
        F.when(F.col("abstain").isNull(), "invalid_abstain").when(~F.col("abstain"), None).when(F.col("finding").isNull(), "unknown_or_stale_claim").when(F.col("times") != 1, "duplicate_decision")
        .when(other, "claim_metadata_mismatch").when(~F.col("eligible") | (F.col("polarity") != "negative"), F.coalesce("skip_reason", F.lit("ineligible_claim")))
        .when(score.isNotNull() & (F.isnan(score) | ~score.between(0.0, 1.0)), "invalid_support_score").when(F.length(F.trim(F.coalesce("reason", F.lit("")))) == 0, "missing_reason")
    )
    return both.withColumn("why", why)


def edit_reports(reports: DataFrame, decisions: DataFrame, key: str, text: str, wording: tuple[str, str] = ABSTENTION) -> DataFrame:
    """(key, edited_findings, edits, skipped_edits, changed_groups, changed_bytes) for every report.

    ``decisions``: (key, claim_id, abstain, support_score, reason) and any claim fields, which must agree with the text.
    Text outside the clauses of valid abstentions stays as it is. A null text stays null.
    """
    texts = claims.text_clauses(reports, text)
    held = reports.select(key, F.col(text).alias("text"))
    claimed = held.join(claims.claims_of(texts, "text"), "text").drop("text")
    clauses = held.join(texts, "text")
    checked = checked_decisions(claimed, decisions, key)
    edit = F.struct("start", "end", "claim_id", "finding", "claim_text", "noun", "support_score", "reason")
    wanted = checked.where("abstain AND why IS NULL").groupBy(key, "a").agg(F.collect_set("noun").alias("removed"), F.sort_array(F.collect_list(edit)).alias("wanted"))
    patched = clauses.select(key, "a", "clause", "lead", "nouns", "tail", "absent").join(wanted, [key, "a"]).withColumn("new", _reworded(wording))
    said = lambda e: F.concat(F.lit(wording[0]), F.get("nouns", e["noun"]), F.lit(wording[1]))
    span = lambda a, b: F.array(a.cast("int"), b.cast("int"))
    edits = F.transform("wanted", lambda e: F.struct(
        e["claim_id"].alias("claim_id"), e["finding"].alias("finding"), span(e["start"], e["end"]).alias("original_span"), e["claim_text"].alias("original_claim"), F.lit("abstain").alias("action"), said(e).alias("new_text"),
        e["support_score"].alias("support_score"), e["reason"].alias("reason"), span(F.col("a"), F.col("a") + F.length("clause")).alias("replacement_span"), F.col("clause").alias("original_group"), F.col("new").alias("replacement_text"), F.lit(EDITOR).alias("editor_version"),
    ))
    patch = F.struct(F.col("a").alias("a"), F.length("clause").alias("n"), "new", edits.alias("edits"), F.octet_length("clause").alias("bytes"))
    by_report = patched.groupBy(key).agg(F.sort_array(F.collect_list(patch)).alias("p"))
    skipped = checked.where("why IS NOT NULL").groupBy(key).agg(F.sort_array(F.collect_list(F.struct("claim_id", F.col("why").alias("reason")))).alias("skipped"))
    joined = reports.select(key, text).join(by_report, key, "left").join(skipped, key, "left")
    # What stands between one patch and the next, and the patches.
    after = lambda k: F.coalesce(F.get("p", k - 1)["a"] + F.get("p", k - 1)["n"], F.lit(0))
    pieces = F.transform("p", lambda x, k: F.concat(F.substring(F.col(text), after(k) + 1, x["a"] - after(k)), x["new"]))
    edited = F.when(F.col("p").isNull(), F.col(text)).otherwise(F.concat(F.array_join(pieces, ""), F.substring(F.col(text), after(F.size("p")) + 1, F.length(text))))
    none = lambda kind: F.array().cast(f"array<struct<{kind}>>")
    kind = "claim_id: string, finding: string, original_span: array<int>, original_claim: string, action: string, new_text: string, support_score: double, reason: string, replacement_span: array<int>, original_group: string, replacement_text: string, editor_version: string"
    return joined.select(
        key, edited.alias("edited_findings"), F.coalesce(F.flatten(F.transform("p", lambda x: x["edits"])), none(kind)).alias("edits"), F.coalesce("skipped", none("claim_id: string, reason: string")).alias("skipped_edits"),
        F.coalesce(F.size("p"), F.lit(0)).alias("changed_groups"), F.coalesce(F.aggregate("p", F.lit(0), lambda s, x: s + x["bytes"]), F.lit(0)).alias("changed_bytes"),
    )


def geometry_review(reports: DataFrame, decisions: DataFrame, key: str, text: str) -> DataFrame:
    """Strict editing: any invalid decision is an error. The audit says what stayed untouched.

    ``decisions``: (key, claim_id, abstain, reason, trigger, proxy_retention_score); only the first trigger has a score.
    """
    trigger, score = F.coalesce("trigger", F.lit(TRIGGERS[0])), F.col("proxy_retention_score")
    good = trigger.isin(*TRIGGERS) & F.col("abstain").isNotNull() & (score.isNull() | ((trigger == TRIGGERS[0]) & ~F.isnan(score) & score.between(0.0, 1.0)))
    assert_empty(decisions.where(~F.coalesce(good, F.lit(False))), "invalid review decisions")
    plain = decisions.withColumn("support_score", F.lit(None).cast("double"))
    out = edit_reports(reports, plain, key, text, REVIEW)
    assert_empty(out.where(F.size("skipped_edits") > 0), "review decisions that cannot be done")
    return audited(reports, out, key, text)


def audited(reports: DataFrame, edited: DataFrame, key: str, text: str) -> DataFrame:
    """Edited reports with digests of both texts and the bytes that did not change."""
    joined = edited.join(reports.select(key, F.col(text).alias("original")), key)
    return joined.select(
        key, "edited_findings", "edits", F.sha2("original", 256).alias("original_sha256"), F.sha2("edited_findings", 256).alias("edited_sha256"), "changed_groups",
        (F.octet_length("original") - F.col("changed_bytes")).alias("unchanged_utf8_bytes"),
    )


def audit_review(reports: DataFrame, stored: DataFrame, key: str, text: str) -> DataFrame:
    """Stored results of ``geometry_review`` that their own edits, done anew on the reports, do not give."""
    said = stored.select(key, F.explode("edits").alias("e")).select(key, "e.claim_id", F.lit(True).alias("abstain"), "e.support_score", "e.reason", "e.finding")
    again = audited(reports, edit_reports(reports, said, key, text, REVIEW), key, text)
    fields = ["edited_findings", "edits", "original_sha256", "edited_sha256", "changed_groups", "unchanged_utf8_bytes"]
    digest = lambda df: df.select(key, F.sha2(F.to_json(F.struct(*fields)), 256).alias("digest"))
    both = digest(stored).alias("x").join(digest(again).alias("y"), F.col(f"x.{key}") == F.col(f"y.{key}"), "full_outer")
    return both.where(~F.col("x.digest").eqNullSafe(F.col("y.digest")) & F.col(f"x.{key}").isNotNull()).select(F.col(f"x.{key}"))
