"""Multi-party perspective rotation of conversations.

For every participant of a conversation the dialogue is rendered once with that speaker as the assistant and all others
as named users; the mask marks the assistant's words, the only ones that bear loss. System turns are nobody's
perspective: they stay system turns in every rendering.

Only DataFrame functions. The unit of output is one rendering, so a conversation's turns meet in one row; nothing else
is gathered by a key, and no pairs of turns are made. Turns are ordered by (turn, role, text), which settles ties;
repeated rows stay. A null role is ``unknown``, a null text is empty, a null turn comes first. A row with a null conv_id
belongs to no dialogue and is left out. A conversation of system turns only has no perspective and gives no row. Other
columns are ignored. An empty table gives an empty result.

Places are linear in a conversation's turns: turns are numbered and a window sums the sizes of those before each, so no
array is copied turn by turn.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import table

ASSISTANT = "<|assistant|>\n"


def rotate_perspectives(turns: DataFrame) -> DataFrame:
    """One row per (conv_id, speaker): text, mask_starts and mask_ends (code points, end exclusive), counts.

    A turn's head is as long for every speaker but its own, so places need one running sum over the turns (as others see
    them) and one over the speaker's own turns before: both are sums within a conversation, joined per turn, not per
    pair of turns.
    """
    clean = turns.where("conv_id IS NOT NULL").select("conv_id", "turn", F.coalesce("role", F.lit("unknown")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    whole = Window.partitionBy("conv_id").orderBy("turn", "role", "text").rowsBetween(Window.unboundedPreceding, -1)
    mine = Window.partitionBy("conv_id", "role").orderBy("turn", "text").rowsBetween(Window.unboundedPreceding, -1)
    system = F.col("role") == "system"
    head = F.when(system, F.lit("<|system|>\n")).otherwise(F.concat(F.lit("<|user name="), "role", F.lit("|>\n")))
    size = F.length("head") + F.length("text") + 1
    # What a speaker's own head is shorter (or longer) than the head that others see.
    less = F.length("head") - F.lit(len(ASSISTANT))
    placed = clean.withColumn("head", head).withColumn("k", F.row_number().over(Window.partitionBy("conv_id").orderBy("turn", "role", "text")))
    placed = placed.withColumn("seen", F.coalesce(F.sum(size).over(whole), F.lit(0))).withColumn("own", F.coalesce(F.sum(less).over(mine), F.lit(0)))
    start = F.col("seen") - F.col("own") + len(ASSISTANT)
    turn = F.struct("k", "role", "head", "text", start.alias("a"), (start + F.length("text")).alias("b"))
    grouped = placed.groupBy("conv_id").agg(F.sort_array(F.collect_list(turn)).alias("t"))
    speakers = F.array_sort(F.filter(F.array_distinct(F.transform("t", lambda x: x["role"])), lambda r: r != "system"))
    opened = grouped.select("conv_id", "t", F.explode(speakers).alias("speaker")).withColumn("p", F.filter("t", lambda x: x["role"] == F.col("speaker")))
    lines = F.transform("t", lambda x: F.concat(F.when(x["role"] == F.col("speaker"), F.lit(ASSISTANT)).otherwise(x["head"]), x["text"], F.lit("\n")))
    return opened.select(
        "conv_id", "speaker", F.array_join(lines, "").alias("text"), F.array_join(F.transform("p", lambda x: x["a"].cast("string")), ",").alias("mask_starts"),
        F.array_join(F.transform("p", lambda x: x["b"].cast("string")), ",").alias("mask_ends"), F.size("t").cast("long").alias("n_turns"), F.size("p").cast("long").alias("n_own_turns"),
        F.aggregate("p", F.lit(0).cast("long"), lambda s, x: s + x["b"] - x["a"]).alias("n_loss_chars"),
    )


def op10_chat_format(spark, sf_dir: str) -> DataFrame:
    return rotate_perspectives(table(spark, sf_dir, "conversations"))


ORACLE_SQL = """
WITH t AS (
    SELECT conv_id, turn, coalesce(role, 'unknown') AS role, coalesce(text, '') AS text,
           row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, 'unknown'), coalesce(text, '')) AS k FROM conversations WHERE conv_id IS NOT NULL
), r AS (
    SELECT t.*, s.role AS speaker, CASE WHEN t.role = 'system' THEN '<|system|>' || chr(10) WHEN t.role = s.role THEN '<|assistant|>' || chr(10)
                                        ELSE '<|user name=' || t.role || '|>' || chr(10) END AS head
    FROM t JOIN (SELECT DISTINCT conv_id, role FROM t WHERE role <> 'system') s ON s.conv_id = t.conv_id
), p AS (
    SELECT *, sum(length(head) + length(text) + 1) OVER (PARTITION BY conv_id, speaker ORDER BY k) - length(text) - 1 AS a FROM r
)
SELECT conv_id, speaker, string_agg(head || text || chr(10), '' ORDER BY k) AS text,
       coalesce(string_agg(CAST(CAST(a AS BIGINT) AS VARCHAR), ',' ORDER BY k) FILTER (WHERE role = speaker), '') AS mask_starts,
       coalesce(string_agg(CAST(CAST(a + length(text) AS BIGINT) AS VARCHAR), ',' ORDER BY k) FILTER (WHERE role = speaker), '') AS mask_ends,
       count(*) AS n_turns, count(*) FILTER (WHERE role = speaker) AS n_own_turns,
       CAST(sum(CASE WHEN role = speaker THEN length(text) ELSE 0 END) AS BIGINT) AS n_loss_chars
FROM p GROUP BY conv_id, speaker
"""
