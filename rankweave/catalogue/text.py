"""Report claims, edits and sentence containment; a report is one of a few templates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import claims, spans
from ..operators import reports
from . import bind

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}

#: (text, claims as (finding, polarity, eligible, skip_reason, laterality, region), text after all abstentions)
TEMPLATES = (
    ("Lungs are clear.", (), "Lungs are clear."),
    ("No pleural effusion or pneumothorax.", (("pleural_effusion", "negative", True, None, "unspecified", "unspecified"), ("pneumothorax", "negative", True, None, "unspecified", "unspecified")),
     "The current image does not support confident exclusion of pleural effusion; the current image does not support confident exclusion of pneumothorax."),
    ("No left pleural effusion or right apical pneumothorax. No bibasilar consolidation.",
     (("pleural_effusion", "negative", True, None, "left", "unspecified"), ("pneumothorax", "negative", True, None, "right", "apical"), ("consolidation", "negative", True, None, "bilateral", "basilar")),
     "The current image does not support confident exclusion of left pleural effusion; the current image does not support confident exclusion of right apical pneumothorax. The current image does not support confident exclusion of bibasilar consolidation."),
    ("History of pneumothorax.", (("pneumothorax", "positive", False, "history", "unspecified", "unspecified"),), "History of pneumothorax."),
    ("Cannot exclude a small pleural effusion.", (("pleural_effusion", "uncertain", False, "uncertain", "unspecified", "unspecified"),), "Cannot exclude a small pleural effusion."),
    ("Consolidation is absent.", (("consolidation", "negative", True, None, "unspecified", "unspecified"),), "The current image does not support confident exclusion of Consolidation."),
    ("No large pneumothorax.", (("pneumothorax", "uncertain", False, "qualified_assertion", "unspecified", "unspecified"),), "No large pneumothorax."),
    ("No consolidation and pneumothorax.", (("consolidation", "uncertain", False, "ambiguous_scope", "unspecified", "unspecified"), ("pneumothorax", "uncertain", False, "ambiguous_scope", "unspecified", "unspecified")), "No consolidation and pneumothorax."),
    *((t, ((f, p, False, why, side, "unspecified"),), t) for t, f, p, why, side in (
        ("The pleural effusion has resolved.", "pleural_effusion", "uncertain", "resolved", "unspecified"), ("No interval change in pleural effusion.", "pleural_effusion", "uncertain", "comparison", "unspecified"),
        ("Pleural effusion is not excluded.", "pleural_effusion", "uncertain", "uncertain", "unspecified"), ("No new pneumothorax.", "pneumothorax", "uncertain", "comparison", "unspecified"),
        ("No focal consolidation or atelectasis.", "consolidation", "uncertain", "ambiguous_modifier_scope", "unspecified"), ("Left pneumothorax is present.", "pneumothorax", "positive", "not_explicit_negative", "left"),
    )),
    ("Neither pneumothorax nor consolidation is seen.", (("pneumothorax", "negative", True, None, "unspecified", "unspecified"), ("consolidation", "negative", True, None, "unspecified", "unspecified")),
     "The current image does not support confident exclusion of pneumothorax; the current image does not support confident exclusion of consolidation."),
)
_text = lambda x: "'" + x.replace("'", "''") + "'" if isinstance(x, str) else "NULL" if x is None else str(x).upper()
_CLAIMS = ", ".join(f"({k}, {', '.join(map(_text, c))})" for k, (_, found, _) in enumerate(TEMPLATES) for c in found)
_TEXTS = ", ".join(f"({k}, {_text(t)}, {_text(e)}, {sum(c[2] for c in f)}, {sum(not c[2] for c in f)})" for k, (t, f, e) in enumerate(TEMPLATES))


def _reports(spark, sf_dir: str) -> DataFrame:
    o = bind.table(spark, sf_dir, "orders")
    return o.select("o_orderkey", "o_orderstatus", F.element_at(F.array(*(F.lit(t) for t, _, _ in TEMPLATES)), (1 + F.col("o_orderkey") % len(TEMPLATES)).cast("int")).alias("report"))


@bind.register(QUERIES, ORACLE_SQL, "claims_extract", f"SELECT o_orderkey, finding, polarity, eligible, skip_reason, laterality, region FROM orders JOIN (VALUES {_CLAIMS}) v(k, finding, polarity, eligible, skip_reason, laterality, region) ON o_orderkey % {len(TEMPLATES)} = k")
def claims_extract(spark, sf_dir: str) -> DataFrame:
    return claims.extract_claims(_reports(spark, sf_dir), "o_orderkey", "report").select("o_orderkey", "finding", "polarity", "eligible", "skip_reason", "laterality", "region")


@bind.register(QUERIES, ORACLE_SQL, "claims_summary", f"SELECT o_orderstatus, finding, count(*) AS n, count(*) FILTER (WHERE eligible) AS n_eligible FROM orders JOIN (VALUES {_CLAIMS}) v(k, finding, polarity, eligible, skip_reason, laterality, region) ON o_orderkey % {len(TEMPLATES)} = k GROUP BY ALL")
def claims_summary(spark, sf_dir: str) -> DataFrame:
    """Distinct texts are parsed once: reports are counted by text before the grammar runs."""
    counted = _reports(spark, sf_dir).groupBy("o_orderstatus", "report").agg(F.count("*").alias("n"))
    texts = claims.extract_claims(counted.select("report").distinct().withColumn("key", F.col("report")), "key", "report").select(F.col("key").alias("report"), "finding", "eligible")
    return counted.join(texts, "report").groupBy("o_orderstatus", "finding").agg(F.sum("n").alias("n"), F.sum(F.when(F.col("eligible"), F.col("n")).otherwise(0)).alias("n_eligible"))


@bind.register(QUERIES, ORACLE_SQL, "apply_edits", f"SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN e ELSE t END AS edited, CAST(CASE WHEN o_orderkey % 3 = 0 THEN n ELSE 0 END AS INT) AS n_edits, CAST(CASE WHEN o_orderkey % 3 = 0 THEN m ELSE 0 END AS INT) AS n_skipped FROM orders JOIN (VALUES {_TEXTS}) v(k, t, e, n, m) ON o_orderkey % {len(TEMPLATES)} = k")
def apply_edits(spark, sf_dir: str) -> DataFrame:
    """Every claim of every third report is to be withdrawn; what cannot be is listed with its reason."""
    r = _reports(spark, sf_dir)
    d = claims.extract_claims(r, "o_orderkey", "report").withColumns({"abstain": F.col("o_orderkey") % 3 == 0, "support_score": F.lit(None).cast("double"), "reason": F.lit("low retention")})
    out = reports.edit_reports(r, d, "o_orderkey", "report")
    return out.select("o_orderkey", F.col("edited_findings").alias("edited"), F.size("edits").alias("n_edits"), F.size("skipped_edits").alias("n_skipped"))


_PARTIAL = """CASE o_orderkey % 15 WHEN 1 THEN 'No pleural effusion; the current image does not support confident exclusion of pneumothorax.'
    WHEN 2 THEN 'No left pleural effusion; the current image does not support confident exclusion of right apical pneumothorax. No bibasilar consolidation.'
    WHEN 14 THEN 'No consolidation is seen; the current image does not support confident exclusion of pneumothorax.' ELSE t END"""


@bind.register(QUERIES, ORACLE_SQL, "partial_edits", f"SELECT o_orderkey, {_PARTIAL} AS edited, CAST(CASE WHEN o_orderkey % 15 IN (1, 2, 14) THEN 1 ELSE 0 END AS INT) AS n_edits FROM orders JOIN (VALUES {_TEXTS}) v(k, t, e, n, m) ON o_orderkey % {len(TEMPLATES)} = k")
def partial_edits(spark, sf_dir: str) -> DataFrame:
    """Only pneumothorax is withdrawn; the other nouns of its lists keep their statement."""
    r = _reports(spark, sf_dir)
    found = claims.extract_claims(r, "o_orderkey", "report").where("eligible")
    d = found.withColumns({"abstain": F.col("finding") == "pneumothorax", "support_score": F.lit(0.1), "reason": F.lit("low retention")})
    out = reports.edit_reports(r, d, "o_orderkey", "report")
    return out.select("o_orderkey", F.col("edited_findings").alias("edited"), F.size("edits").alias("n_edits"))


@bind.register(QUERIES, ORACLE_SQL, "sentence_containment", r"""WITH s AS (SELECT conv_id, turn, unnest(string_split(text, '. ')) AS sentence, generate_subscripts(string_split(text, '. '), 1) AS k FROM conversations),
o AS (SELECT *, sum(length(sentence) + 2) OVER (PARTITION BY conv_id, turn ORDER BY k) - length(sentence) - 2 AS a FROM s)
SELECT conv_id, turn, CAST(a AS INT) AS a, CAST(a + length(sentence) AS INT) AS b FROM o WHERE a <= 40 AND 50 <= a + length(sentence)""")
def sentence_containment(spark, sf_dir: str) -> DataFrame:
    """The sentence that holds a claim at [40, 50): containment by filtering a report's own spans, no range join."""
    s = spans.containing_piece(F.split("text", r"\. "), 2, 40, 50)
    return bind.table(spark, sf_dir, "conversations").select("conv_id", "turn", s.alias("s")).where("s IS NOT NULL").select("conv_id", "turn", "s.a", "s.b")


@bind.register(QUERIES, ORACLE_SQL, "token_sentence_scores", r"""WITH t AS (SELECT conv_id, turn, unnest(string_split(text, ' ')) AS tok, generate_subscripts(string_split(text, ' '), 1) AS k FROM conversations),
o AS (SELECT *, sum(length(tok) + 1) OVER (PARTITION BY conv_id, turn ORDER BY k) - length(tok) - 1 AS a, -CAST('0x' || substr(sha256(tok), 1, 4) AS BIGINT) / 65536.0::DOUBLE AS lp FROM t)
SELECT conv_id, turn, count(*) AS n_tokens, round(avg(lp), 6) AS mean_lp FROM o WHERE a + length(tok) > 10 AND a < 60 GROUP BY conv_id, turn""")
def token_sentence_scores(spark, sf_dir: str) -> DataFrame:
    """Mean log probability of the tokens that overlap [10, 60): an interval overlap inside each row."""
    lp = lambda x: -F.conv(F.substring(F.sha2(x, 256), 1, 4), 16, 10).cast("long") / 65536.0
    s = spans.overlapping_sum(F.split("text", " "), 1, 10, 60, lp)
    t = bind.table(spark, sf_dir, "conversations").select("conv_id", "turn", s.alias("s")).where("s.n > 0")
    return bind.rounded(t.select("conv_id", "turn", F.col("s.n").alias("n_tokens"), (F.col("s.total") / F.col("s.n")).alias("mean_lp")))
