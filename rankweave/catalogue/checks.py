"""Contracts, alignment, set operations, incremental runs and duplicates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators import align, contracts, dedup
from . import bind
from .identity import _EXPANDED, FINDINGS, _sources, expanded

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


@bind.register(QUERIES, ORACLE_SQL, "duplicate_keys", "SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY ALL HAVING count(*) > 1")
def duplicate_keys(spark, sf_dir: str) -> DataFrame:
    return contracts.duplicate_keys(bind.table(spark, sf_dir, "lineitem"), ["l_orderkey", "l_linenumber"])


@bind.register(QUERIES, ORACLE_SQL, "leakage_groups", "SELECT o_custkey, min(o_orderstatus) AS first_split, max(o_orderstatus) AS last_split FROM orders GROUP BY o_custkey HAVING min(o_orderstatus) <> max(o_orderstatus)")
def leakage_groups(spark, sf_dir: str) -> DataFrame:
    return contracts.leaking_groups(bind.table(spark, sf_dir, "orders"), "o_custkey", "o_orderstatus")


@bind.register(QUERIES, ORACLE_SQL, "disjoint_check", """SELECT 'o_custkey' AS "key", value FROM (SELECT o_custkey::VARCHAR AS value FROM orders WHERE o_orderstatus = 'F' INTERSECT SELECT o_custkey::VARCHAR FROM orders WHERE o_orderstatus = 'P')
UNION ALL SELECT 'o_orderpriority', value FROM (SELECT o_orderpriority AS value FROM orders WHERE o_orderstatus = 'F' INTERSECT SELECT o_orderpriority FROM orders WHERE o_orderstatus = 'P')""")
def disjoint_check(spark, sf_dir: str) -> DataFrame:
    o = bind.table(spark, sf_dir, "orders")
    return contracts.overlapping(o.where("o_orderstatus = 'F'"), o.where("o_orderstatus = 'P'"), ["o_custkey", "o_orderpriority"])


@bind.register(QUERIES, ORACLE_SQL, "roster_diff", "SELECT doc_id, 'left' AS side FROM (SELECT doc_id FROM documents EXCEPT ALL SELECT doc_id FROM labels) UNION ALL SELECT doc_id, 'right' FROM (SELECT doc_id FROM labels EXCEPT ALL SELECT doc_id FROM documents)")
def roster_diff(spark, sf_dir: str) -> DataFrame:
    return contracts.roster_difference(bind.table(spark, sf_dir, "documents"), bind.table(spark, sf_dir, "labels"), ["doc_id"])


@bind.register(QUERIES, ORACLE_SQL, "subset_check", "SELECT c_custkey FROM customer ANTI JOIN orders ON c_custkey = o_custkey")
def subset_check(spark, sf_dir: str) -> DataFrame:
    plan = bind.table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey"))
    return contracts.not_in_plan(bind.table(spark, sf_dir, "customer").select("c_custkey"), plan, ["c_custkey"])


@bind.register(QUERIES, ORACLE_SQL, "completeness_39", "WITH " + _EXPANDED + """ SELECT source_id, count(*) AS n_rows, count(DISTINCT (variant_index, finding)) AS n_parts FROM e
WHERE NOT (CAST(substr(source_id, 2) AS BIGINT) % 97 = 5 AND variant_index = 4 AND finding = 'pneumothorax') GROUP BY source_id HAVING count(*) <> 39 OR count(DISTINCT (variant_index, finding)) <> 39""")
def completeness_39(spark, sf_dir: str) -> DataFrame:
    """Sources without all 39 (variant, finding) rows; one row of some sources is taken away to be found."""
    gap = (F.pmod(F.substring("source_id", 2, 20).cast("long"), F.lit(97)) == 5) & (F.col("variant_index") == 4) & (F.col("finding") == "pneumothorax")
    slot = F.col("variant_index") * 3 + F.array_position(F.array(*map(F.lit, FINDINGS)), F.col("finding")).cast("int") - 1
    return contracts.incomplete(expanded(_sources(spark, sf_dir)).where(~gap), "source_id", slot, 39)


@bind.register(QUERIES, ORACLE_SQL, "identity_differences", "SELECT a.doc_id FROM documents a JOIN documents b USING (doc_id) WHERE a.lang IS DISTINCT FROM b.lang OR a.source IS DISTINCT FROM CASE WHEN b.doc_id % 50 = 7 THEN 'changed' ELSE b.source END")
def identity_differences(spark, sf_dir: str) -> DataFrame:
    d = bind.table(spark, sf_dir, "documents").select("doc_id", "lang", "source")
    changed = d.withColumn("source", F.when(F.col("doc_id") % 50 == 7, "changed").otherwise(F.col("source")))
    return contracts.differing(d, changed, ["doc_id"], ["lang", "source"])


@bind.register(QUERIES, ORACLE_SQL, "failure_contract", """WITH p AS (SELECT event_id, CASE WHEN event_id % 11 = 0 THEN NULL ELSE least(value / 100, 1.5) END AS score, CASE WHEN event_id % 11 = 0 THEN 'failed' ELSE 'success' END AS status, CASE WHEN event_id % 22 = 0 THEN 'timeout' END AS failure_reason FROM events)
SELECT event_id FROM p WHERE NOT coalesce((status = 'success' AND score BETWEEN 0 AND 1 AND failure_reason IS NULL) OR (status = 'failed' AND score IS NULL AND length(trim(failure_reason)) > 0), FALSE)""")
def failure_contract(spark, sf_dir: str) -> DataFrame:
    failed = F.col("event_id") % 11 == 0
    p = bind.table(spark, sf_dir, "events").select("event_id", F.when(~failed, F.least(F.col("value") / 100, F.lit(1.5))).alias("score"), F.when(failed, "failed").otherwise("success").alias("status"), F.when(F.col("event_id") % 22 == 0, "timeout").alias("failure_reason"))
    return contracts.failure_contract(p).select("event_id")


@bind.register(QUERIES, ORACLE_SQL, "truth_prediction_align", """SELECT d.doc_id, l.quality::DOUBLE AS score, coalesce(count(l.doc_id), 0) AS n_predictions, CASE WHEN count(l.doc_id) = 0 THEN 'missing' WHEN count(l.doc_id) > 1 THEN 'duplicate' ELSE 'matched' END AS state
FROM documents d LEFT JOIN labels l USING (doc_id) GROUP BY d.doc_id, l.quality""")
def truth_prediction_align(spark, sf_dir: str) -> DataFrame:
    truth = bind.table(spark, sf_dir, "documents").select("doc_id")
    out = align.align_scores(truth, bind.table(spark, sf_dir, "labels").select("doc_id", F.col("quality").cast("double").alias("score")), ["doc_id"])
    return out.select("doc_id", "score", F.coalesce("n_predictions", F.lit(0)).alias("n_predictions"), "state")


@bind.register(QUERIES, ORACLE_SQL, "zero_claim_left_join", """WITH c AS (SELECT l_orderkey AS k, count(*) AS n, count(*) FILTER (WHERE l_linenumber = 7) AS m, min(CASE WHEN l_linenumber <> 7 THEN 1 - l_quantity / 50 END) AS least, bool_or(1 - 2 * l_discount < 0.9::DOUBLE) AS bad FROM lineitem GROUP BY l_orderkey)
SELECT o_orderkey AS report, coalesce(n, 0) AS n_claims, round(CASE WHEN m = 0 THEN least END, 6) AS confidence, coalesce(bad, FALSE) AS any_bad FROM orders LEFT JOIN c ON o_orderkey = k""")
def zero_claim_left_join(spark, sf_dir: str) -> DataFrame:
    reports = bind.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("report"))
    claims = bind.table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("report"), F.when(F.col("l_linenumber") != 7, 1 - F.col("l_quantity") / 50).alias("score"), (1 - 2 * F.col("l_discount")).alias("truth"))
    return bind.rounded(align.left_reports(reports, claims, "report"))


@bind.register(QUERIES, ORACLE_SQL, "failure_histogram", """SELECT o_orderstatus, sum(n) AS n_failed, string_agg(reason || '=' || n, ',' ORDER BY reason) AS reasons FROM (SELECT o_orderstatus, 'r' || o_orderkey % 5 AS reason, count(*)::BIGINT AS n FROM orders WHERE o_orderkey % 3 = 0 GROUP BY ALL) GROUP BY o_orderstatus""".replace("sum(n)", "CAST(sum(n) AS BIGINT)"))
def failure_histogram(spark, sf_dir: str) -> DataFrame:
    o = bind.table(spark, sf_dir, "orders").select("o_orderstatus", F.when(F.col("o_orderkey") % 3 == 0, F.concat(F.lit("r"), (F.col("o_orderkey") % 5).cast("string"))).alias("failure_reason"))
    h = align.failure_histogram(o, ["o_orderstatus"])
    entries = F.map_entries("reasons")
    return h.select("o_orderstatus", F.aggregate(entries, F.lit(0).cast("long"), lambda s, x: s + x["value"]).alias("n_failed"), F.array_join(F.transform(entries, lambda x: F.concat_ws("=", x["key"], x["value"].cast("string"))), ",").alias("reasons"))


_CACHE = "c AS (SELECT user_id || ':' || event_type AS cache_key, ts, event_id, CASE WHEN event_id % 4 = 0 THEN 'error' ELSE 'success' END AS status, value FROM events)"


def _cache(spark, sf_dir: str) -> DataFrame:
    e = bind.table(spark, sf_dir, "events")
    return e.select(F.concat_ws(":", F.col("user_id").cast("string"), "event_type").alias("cache_key"), "ts", "event_id", F.when(F.col("event_id") % 4 == 0, "error").otherwise("success").alias("status"), "value")


@bind.register(QUERIES, ORACLE_SQL, "latest_wins", f"WITH {_CACHE} SELECT cache_key, event_id, status, round(value, 6) AS value FROM (SELECT *, row_number() OVER (PARTITION BY cache_key ORDER BY ts DESC, event_id DESC) AS k FROM c) WHERE k = 1")
def latest_wins(spark, sf_dir: str) -> DataFrame:
    return bind.rounded(align.latest(_cache(spark, sf_dir), ["cache_key"], ["ts", "event_id"]).select("cache_key", "event_id", "status", "value"))


@bind.register(QUERIES, ORACLE_SQL, "resume_pending", f"""WITH {_CACHE}, l AS (SELECT cache_key FROM (SELECT *, row_number() OVER (PARTITION BY cache_key ORDER BY ts DESC, event_id DESC) AS k FROM c) WHERE k = 1 AND status = 'success')
SELECT cache_key FROM (SELECT DISTINCT u.user_id || ':' || t.event_type AS cache_key FROM events u, (SELECT DISTINCT event_type FROM events) t) ANTI JOIN l USING (cache_key)""")
def resume_pending(spark, sf_dir: str) -> DataFrame:
    e = bind.table(spark, sf_dir, "events")
    types = F.broadcast(e.agg(F.sort_array(F.collect_set("event_type")).alias("types")))  # one row: the few event types
    plan = e.select("user_id").distinct().join(types).select("user_id", F.explode("types").alias("t")).select(F.concat_ws(":", F.col("user_id").cast("string"), "t").alias("cache_key"))
    return align.pending(plan, _cache(spark, sf_dir), "cache_key", ["ts", "event_id"], retry_errors=True)


@bind.register(QUERIES, ORACLE_SQL, "slot_recovery", """WITH a AS (SELECT user_id, event_id % 10 AS slot, arg_min(CASE WHEN event_id % 3 = 0 THEN 'failed' ELSE 'success' END, event_id) AS status FROM events WHERE event_id % 7 <> 0 GROUP BY ALL)
SELECT u.user_id, CAST(s.range AS INT) AS slot, coalesce(status, 'pending') AS status FROM (SELECT DISTINCT user_id FROM events) u CROSS JOIN range(10) s LEFT JOIN a ON a.user_id = u.user_id AND a.slot = s.range""")
def slot_recovery(spark, sf_dir: str) -> DataFrame:
    e = bind.table(spark, sf_dir, "events")
    attempts = e.where("event_id % 7 <> 0").select("user_id", (F.col("event_id") % 10).cast("int").alias("slot"), F.col("event_id").alias("attempt"), F.when(F.col("event_id") % 3 == 0, "failed").otherwise("success").alias("status"))
    return align.recover_slots(e.select("user_id").distinct(), attempts, "user_id")


@bind.register(QUERIES, ORACLE_SQL, "population_hash", "SELECT o_orderstatus, sha256(string_agg(o_orderkey::VARCHAR, ',' ORDER BY o_orderkey)) AS digest FROM orders GROUP BY o_orderstatus")
def population_hash(spark, sf_dir: str) -> DataFrame:
    """A content hash of each scope's keys in order (the ids meet in one row by definition of the hash)."""
    keys = F.transform(F.sort_array(F.collect_list("o_orderkey")), lambda x: x.cast("string"))
    return bind.table(spark, sf_dir, "orders").groupBy("o_orderstatus").agg(F.sha2(F.array_join(keys, ","), 256).alias("digest"))


@bind.register(QUERIES, ORACLE_SQL, "exact_dups", "SELECT sha256(text) AS digest, count(*) AS n, min(doc_id) AS first_doc FROM documents GROUP BY sha256(text) HAVING count(*) > 1")
def exact_dups(spark, sf_dir: str) -> DataFrame:
    d = bind.table(spark, sf_dir, "documents").select("doc_id", F.sha2("text", 256).alias("digest"))
    return d.groupBy("digest").agg(F.count("*").alias("n"), F.min("doc_id").alias("first_doc")).where("n > 1")


def fingerprint(key: Column) -> Column:
    """A 256-bit code as 64 hex digits; keys of one family of ten differ in a few bits of the last digits."""
    base = F.sha2(F.concat(F.lit("code:"), F.floor(key / 10).cast("string")), 256)
    return F.concat(F.substring(base, 1, 62), F.lpad(F.lower(F.hex(F.pmod(key, F.lit(10)) * 3)), 2, "0"))


_CODES = "f AS (SELECT o_orderkey AS k, substr(sha256('code:' || (o_orderkey // 10)), 1, 62) || lpad(lower(hex(o_orderkey % 10 * 3)), 2, '0') AS code FROM orders)"
_PAIRS = f"WITH {_CODES}, p AS (SELECT a.k AS a, b.k AS b, bit_count(CAST('0x' || right(a.code, 2) AS BIGINT) ^ CAST('0x' || right(b.code, 2) AS BIGINT)) AS d FROM f a JOIN f b ON left(a.code, 62) = left(b.code, 62) AND a.k < b.k)".replace(" ^ CAST", " # CAST")


@bind.register(QUERIES, ORACLE_SQL, "near_dup_pairs", _PAIRS.replace("bit_count(CAST('0x' || right(a.code, 2) AS BIGINT) # CAST('0x' || right(b.code, 2) AS BIGINT))", "bit_count(xor(CAST('0x' || right(a.code, 2) AS BIGINT), CAST('0x' || right(b.code, 2) AS BIGINT)))") + " SELECT a, b, CAST(d AS INT) AS distance FROM p WHERE d <= 8")
def near_dup_pairs(spark, sf_dir: str) -> DataFrame:
    """All pairs of 256-bit codes within eight bits, by nine bands."""
    f = bind.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"), fingerprint(F.col("o_orderkey")).alias("code"))
    return dedup.near_pairs(f, "k", "code")


@bind.register(QUERIES, ORACLE_SQL, "greedy_dedup", "SELECT o_orderkey AS node, o_orderkey % 10 = 0 AS kept FROM orders")
def greedy_dedup(spark, sf_dir: str) -> DataFrame:
    """Keep in order what no earlier kept row matches; here each family's first row."""
    f = bind.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"), fingerprint(F.col("o_orderkey")).alias("code"))
    return dedup.greedy_keep(dedup.pair_groups(dedup.near_pairs(f, "k", "code")), f.select(F.col("k").alias("node")))


#: Decisions in order, each from the five before it (bits of ``w``) and the protected rows.
_CHAIN = """WITH RECURSIVE o AS (SELECT o_orderkey AS k, row_number() OVER (ORDER BY o_orderkey) AS i FROM orders),
r AS (SELECT k, i, NOT (k % 1009 = 7) AS kept, CASE WHEN k % 1009 = 7 THEN 0 ELSE 1 END AS w FROM o WHERE i = 1
    UNION ALL SELECT o.k, o.i, x.kept, CAST((w * 2) % 32 + CASE WHEN x.kept THEN 1 ELSE 0 END AS INT)
    FROM r JOIN o ON o.i = r.i + 1, LATERAL (SELECT NOT (o.k % 1009 = 7 OR (o.k % 3 <> 0 AND w & 1 = 1) OR (o.k % 5 = 1 AND w & 2 = 2) OR (o.k % 4 = 2 AND w & 16 = 16)) AS kept) x)
SELECT k AS node, kept FROM r"""


@bind.register(QUERIES, ORACLE_SQL, "greedy_chain", _CHAIN)
def greedy_chain(spark, sf_dir: str) -> DataFrame:
    """One chain of all orders, each matching some of the five before it, with protected rows outside the cohort."""
    o = bind.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"))
    back = F.array(*(F.when(c, F.col("k") - d) for d, c in ((1, F.col("k") % 3 != 0), (2, F.col("k") % 5 == 1), (5, F.col("k") % 4 == 2))))
    pairs = o.select("k", F.explode(back).alias("early")).where("early >= 0")
    guarded = o.where("k % 1009 = 7").select(F.lit(-1).cast("long").alias("early"), "k")
    members = dedup.pair_groups(pairs.select("early", "k").unionByName(guarded), "early", "k")
    return dedup.greedy_keep(members, o.withColumnRenamed("k", "node"), o.agg(F.lit(-1).cast("long").alias("node")))


@bind.register(QUERIES, ORACLE_SQL, "state_counts", "SELECT o_orderstatus, o_orderpriority, count(*) AS n, CAST(bit_and(o_orderkey) AS BIGINT) AS low FROM orders GROUP BY ALL")
def state_counts(spark, sf_dir: str) -> DataFrame:
    return bind.table(spark, sf_dir, "orders").groupBy("o_orderstatus", "o_orderpriority").agg(F.count("*").alias("n"), F.bit_and("o_orderkey").alias("low"))
