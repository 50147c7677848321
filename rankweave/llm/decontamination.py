"""Benchmark decontamination: size-partitioned MinHash containment search, verified by exact shingle containment.

Items are partitioned by the size of their shingle set (classes of a factor two). Each item gets a one-permutation
MinHash sketch with as many slots as its class asks for: its smallest hash in each slot. Containment is asymmetric, so
a long document needs no sketch of its own, in which a short item would drown: a slot counts as met when the document
holds the item's minimum. A document that contains a share c of an item meets a slot with probability c, and one that
holds it whole meets all of them. Pairs that meet the share of slots their class asks for are candidates; for those the
exact share of the item's distinct 5-word shingles found in the document is computed, and 0.75 or more is a match.

Only DataFrame functions; items are few but their number is checked before they are broadcast, else they are shuffled.
Null and empty texts, on either side, match nothing. Items with under five words are one shingle and match documents
that are just those words. Texts of one doc_id count as one document, whose shingles are those of all of them. Other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import checked_broadcast, table, written

SIZE = 5
THRESHOLD = 0.75
#: A candidate meets at least this share of its item's slots; expected is 0.75 at the threshold.
MEET = 0.25
#: Rows (24 bytes) of item sketches or shingles that may be broadcast.
BROADCAST_ROWS = 1_000_000


def shingles(text: Column | str) -> Column:
    """Hashes of all 5-word windows of a text in order, lower-cased in A-Z; null for none."""
    text = F.col(text) if isinstance(text, str) else text
    lowered = F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    tokens = F.filter(F.split(lowered, r"[\x20\x09-\x0D]+"), lambda x: x != "")
    return F.transform(
        F.array(F.transform(tokens, lambda x: F.xxhash64(x))),
        lambda h: F.when(F.size(h) >= SIZE, F.transform(F.sequence(F.lit(0), F.greatest(F.size(h) - SIZE, F.lit(0))), lambda i: F.xxhash64(*(F.get(h, i + k) for k in range(SIZE)))))
        .when(F.size(h) > 0, F.array(F.xxhash64(h)))
        .otherwise(F.array().cast("array<bigint>")),
    )[0]


def sketches(items: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Per item its distinct shingles (item_id, n, h) and its sketch (item_id, slots, h), slots by size class."""
    own = items.select("item_id", F.array_distinct(shingles("text")).alias("s")).where(F.size("s") > 0).dropDuplicates(["item_id"])
    rows = written(own.select("item_id", F.size("s").cast("long").alias("n"), F.explode("s").alias("h")), "item-shingles")
    # Slots: 8 for sets under 16, then 16, 32, ... up to 64; a class's slots keep its chance of a miss alike.
    classed = rows.withColumn("slots", F.expr("CAST(least(64, greatest(8, shiftleft(1, CAST(floor(log2(n)) AS INT)))) AS BIGINT)"))
    minima = classed.groupBy("item_id", "slots", F.pmod(F.col("h"), F.col("slots")).alias("slot")).agg(F.min(F.shiftrightunsigned("h", 1)).alias("least"), F.min_by("h", F.shiftrightunsigned("h", 1)).alias("h"))
    filled = minima.groupBy("item_id").agg(F.count("*").alias("filled"))
    return rows, written(minima.select("item_id", "h").join(filled, "item_id"), "item-sketches")


def contamination(docs: DataFrame, items: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, item_id, n_shared, n_item, containment) for all pairs at or over ``threshold``."""
    rows, sketch = sketches(items)
    docs = docs.select("doc_id", "text")
    opened = docs.select("doc_id", F.explode(shingles("text")).alias("h"))
    met = opened.join(checked_broadcast(sketch, BROADCAST_ROWS), "h").groupBy("doc_id", "item_id").agg(F.count_distinct("h").alias("met"), F.first("filled").alias("filled"))
    candidates = written(met.where(F.col("met") >= F.greatest(F.lit(1), F.floor(F.col("filled") * MEET))).select("doc_id", "item_id"), "candidates")
    suspects = written(candidates.select("doc_id").distinct(), "suspects")
    # Only texts with a candidate are opened again, now against whole item sets.
    again = docs.join(checked_broadcast(suspects, BROADCAST_ROWS), "doc_id", "left_semi").select("doc_id", F.explode(F.array_distinct(shingles("text"))).alias("h"))
    counted = again.join(checked_broadcast(rows, BROADCAST_ROWS), "h").groupBy("doc_id", "item_id", "n").agg(F.count_distinct("h").alias("n_shared"))
    exact = counted.join(candidates, ["doc_id", "item_id"], "left_semi").where(F.col("n_shared") >= F.lit(threshold) * F.col("n"))
    return exact.select("doc_id", "item_id", "n_shared", F.col("n").alias("n_item"), F.round(F.col("n_shared") / F.col("n"), 6).alias("containment"))


def decontaminate(docs: DataFrame, items: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` without the documents that contain an item; all their columns stay. Rows without a doc_id, which no match
    could name, go too."""
    hit = written(contamination(docs, items, threshold).select("doc_id").distinct(), "contaminated")
    return docs.where("doc_id IS NOT NULL").join(checked_broadcast(hit, BROADCAST_ROWS), "doc_id", "left_anti").select(*docs.columns)


def op7_decontamination(spark, sf_dir: str) -> DataFrame:
    return contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


ORACLE_SQL = r"""
WITH words AS (
    SELECT doc_id AS id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w, TRUE AS d FROM documents
    UNION ALL
    SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+'), FALSE FROM benchmark
), s AS (
    SELECT DISTINCT d, id, unnest(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))
                                       WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS g FROM words
), sizes AS (SELECT id, count(*) AS n FROM s WHERE NOT d GROUP BY id)
SELECT a.id AS doc_id, b.id AS item_id, count(*) AS n_shared, z.n AS n_item, round(count(*)::DOUBLE / z.n, 6) AS containment
FROM s a JOIN s b ON a.g = b.g AND a.d AND NOT b.d JOIN sizes z ON z.id = b.id
GROUP BY a.id, b.id, z.n HAVING count(*) >= 0.75 * z.n
"""
