"""Boxes, run lengths, packed masks and vectors; part sizes stand for image sizes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import arrays, boxes, raster
from . import bind

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}

_SIZES = "z AS (SELECT p_partkey, 64 + p_size * 7 AS w, 64 + p_partkey % 500 AS h FROM part)"


def _sizes(spark, sf_dir: str) -> DataFrame:
    return bind.spread(bind.table(spark, sf_dir, "part").select("p_partkey", (64 + F.col("p_size") * 7).alias("w"), (64 + F.col("p_partkey") % 500).alias("h")), "p_partkey")


def _crops(spark, sf_dir: str, crops: dict) -> DataFrame:
    opened = _sizes(spark, sf_dir).select("p_partkey", "w", "h", F.explode(boxes.crop_table(F.col("w"), F.col("h"), crops)).alias("b"))
    return opened.select("p_partkey", "w", "h", "b.*")


def _crops_sql(crops: dict) -> str:
    rows = ", ".join(f"({k}, '{n}', {a}::DOUBLE, {b}::DOUBLE, {c}::DOUBLE, {d}::DOUBLE)" for k, (n, (a, b, c, d)) in enumerate(crops.items()))
    cut = lambda s, z: f"CAST(round_even({s} * {z}, 0) AS INT)"
    return f"""{_SIZES}, b AS (SELECT p_partkey, w, h, slot, name, {cut("l", "w")} AS x0, {cut("t", "h")} AS y0, CAST(w - {cut("r", "w")} AS INT) AS x1, CAST(h - {cut("o", "h")} AS INT) AS y1 FROM z, (VALUES {rows}) v(slot, name, l, t, r, o))"""


@bind.register(QUERIES, ORACLE_SQL, "crop_boxes_13", "WITH " + _crops_sql(boxes.CROPS) + " SELECT p_partkey, slot, name, x0, y0, x1, y1 FROM b")
def crop_boxes_13(spark, sf_dir: str) -> DataFrame:
    return _crops(spark, sf_dir, boxes.CROPS).drop("w", "h")


@bind.register(QUERIES, ORACLE_SQL, "crop_boxes_unseen", "WITH " + _crops_sql(boxes.UNSEEN) + " SELECT p_partkey, slot, name, x0, y0, x1, y1 FROM b")
def crop_boxes_unseen(spark, sf_dir: str) -> DataFrame:
    return _crops(spark, sf_dir, boxes.UNSEEN).drop("w", "h")


@bind.register(QUERIES, ORACLE_SQL, "viewport_boxes", "WITH " + _crops_sql(boxes.CROPS) + """, s AS (SELECT *, x1 - x0 AS cw, y1 - y0 AS ch FROM b),
r AS (SELECT *, CASE WHEN cw <= ch THEN 518 ELSE floor(518 * cw / ch) END AS rw, CASE WHEN cw <= ch THEN floor(518 * ch / cw) ELSE 518 END AS rh FROM s)
SELECT p_partkey, slot, round(x0 + floor((rw - 518) / 2) / (rw / cw), 6) AS vx0, round(y0 + floor((rh - 518) / 2) / (rh / ch), 6) AS vy0,
       round(x0 + (floor((rw - 518) / 2) + 518) / (rw / cw), 6) AS vx1, round(y0 + (floor((rh - 518) / 2) + 518) / (rh / ch), 6) AS vy1 FROM r""")
def viewport_boxes(spark, sf_dir: str) -> DataFrame:
    b = _crops(spark, sf_dir, boxes.CROPS)
    return bind.rounded(b.select("p_partkey", "slot", boxes.viewport(*(F.col(c) for c in ("x0", "y0", "x1", "y1"))).alias("v")).select("p_partkey", "slot", "v.*"))


@bind.register(QUERIES, ORACLE_SQL, "box_intersection", "WITH " + _crops_sql(boxes.CROPS) + """ SELECT p_partkey, slot, round(greatest(0, least(x1, w * 0.75::DOUBLE) - greatest(x0, w * 0.25::DOUBLE)) * greatest(0, least(y1, h * 0.9::DOUBLE) - greatest(y0, h * 0.5::DOUBLE)) / (w * 0.5::DOUBLE * h * 0.4::DOUBLE), 6) AS share FROM b""")
def box_intersection(spark, sf_dir: str) -> DataFrame:
    """The share of a fixed region that each crop shows."""
    w, h = F.col("w").cast("double"), F.col("h").cast("double")
    area = boxes.intersection_area(tuple(F.col(c) for c in ("x0", "y0", "x1", "y1")), (w * 0.25, h * 0.5, w * 0.75, h * 0.9))
    return bind.rounded(_crops(spark, sf_dir, boxes.CROPS).select("p_partkey", "slot", (area / (w * 0.5 * h * 0.4)).alias("share")))


_SHARES = _crops_sql(boxes.UNSEEN) + ", s AS (SELECT p_partkey, name, (x1 - x0) * (y1 - y0) / (w * h)::DOUBLE AS share FROM b)"


def _shares(spark, sf_dir: str) -> DataFrame:
    return _crops(spark, sf_dir, boxes.UNSEEN).select("p_partkey", "name", ((F.col("x1") - F.col("x0")) * (F.col("y1") - F.col("y0")) / (F.col("w") * F.col("h"))).alias("share"))


def _by_name(shares: DataFrame) -> DataFrame:
    """All variants of a part in one row as a map: pairs become lookups instead of a self-join."""
    return shares.groupBy("p_partkey").agg(F.map_from_entries(F.collect_list(F.struct("name", "share"))).alias("m"))


@bind.register(QUERIES, ORACLE_SQL, "nested_monotonicity", "WITH " + _SHARES + f""" SELECT a.name AS "outer", b.name AS "inner", count(*) AS n, count(*) FILTER (WHERE b.share > a.share + 1e-6) AS violations, round(avg(greatest(0, b.share - a.share)), 6) AS mean_increase
FROM s a JOIN s b USING (p_partkey) JOIN (VALUES {", ".join(f"('{a}', '{b}')" for a, b in boxes.NESTED)}) v(x, y) ON a.name = x AND b.name = y GROUP BY a.name, b.name""")
def nested_monotonicity(spark, sf_dir: str) -> DataFrame:
    pairs = F.explode(F.array(*(F.struct(F.lit(a).alias("outer"), F.lit(b).alias("inner")) for a, b in boxes.NESTED))).alias("p")
    rows = _by_name(_shares(spark, sf_dir)).select(pairs, "m").select("p.outer", "p.inner", (F.element_at("m", F.col("p.inner")) - F.element_at("m", F.col("p.outer"))).alias("up"))
    return bind.rounded(rows.groupBy("outer", "inner").agg(F.count("*").alias("n"), F.count_if(F.col("up") > 1e-6).alias("violations"), F.avg(F.greatest(F.lit(0.0), F.col("up"))).alias("mean_increase")))


@bind.register(QUERIES, ORACLE_SQL, "pair_shift", "WITH " + _SHARES + """ SELECT b.name, count(*) AS n, round(avg(b.share - a.share), 6) AS signed_shift, round(avg(abs(b.share - a.share)), 6) AS abs_shift, round(avg(CASE WHEN (a.share < 0.9::DOUBLE) <> (b.share < 0.9::DOUBLE) THEN 1.0 ELSE 0.0 END), 6) AS flips
FROM s a JOIN s b USING (p_partkey) WHERE a.name = 'original' AND b.name <> 'original' GROUP BY b.name""")
def pair_shift(spark, sf_dir: str) -> DataFrame:
    m = _by_name(_shares(spark, sf_dir)).select(F.element_at("m", "original").alias("base"), F.explode("m").alias("name", "share")).where("name <> 'original'")
    d = F.col("share") - F.col("base")
    return bind.rounded(m.groupBy("name").agg(F.count("*").alias("n"), F.avg(d).alias("signed_shift"), F.avg(F.abs(d)).alias("abs_shift"), F.avg(((F.col("base") < 0.9) != (F.col("share") < 0.9)).cast("double")).alias("flips")))


@bind.register(QUERIES, ORACLE_SQL, "rle_area", """WITH r AS (SELECT p_partkey, unnest(range(1 + p_size % 5)) AS k, p_size FROM part) SELECT p_partkey, CAST(sum(2 + (p_partkey + k) % 9) AS BIGINT) AS area, bool_or(1 + k * 40 - 1 + 2 + (p_partkey + k) % 9 > 150) AS outside FROM r GROUP BY p_partkey""")
def rle_area(spark, sf_dir: str) -> DataFrame:
    runs = F.transform(F.sequence(F.lit(0), F.col("p_size") % 5), lambda k: F.concat_ws(" ", (1 + k * 40).cast("string"), (2 + (F.col("p_partkey") + k) % 9).cast("string")))
    p = bind.table(spark, sf_dir, "part").select("p_partkey", F.array_join(runs, " ").alias("rle"))
    return p.select("p_partkey", boxes.rle_area(F.col("rle")).alias("area"), boxes.rle_violation(F.col("rle"), F.lit(10), F.lit(15)).alias("outside"))


@bind.register(QUERIES, ORACLE_SQL, "mask_dice_audit", """WITH b AS (SELECT p_brand, p_partkey % 2 AS lung, CAST('0x' || substr(sha256('t' || p_partkey), 1, 15) AS BIGINT) AS t, CASE WHEN p_partkey % 19 = 0 THEN 0 ELSE CAST('0x' || substr(sha256('t' || p_partkey), 1, 15) AS BIGINT) & CAST('0x' || substr(sha256('p' || p_partkey), 1, 15) AS BIGINT) END AS p FROM part)
SELECT coalesce(p_brand, 'all') AS p_brand, coalesce(lung, -1) AS lung, count(*) AS n, CAST(sum(bit_count(t & p)) AS BIGINT) AS shared, round(2 * sum(bit_count(t & p)) / (sum(bit_count(t)) + sum(bit_count(p)))::DOUBLE, 6) AS dice, round(sum(bit_count(t & p)) / sum(bit_count(t | p))::DOUBLE, 6) AS iou, count(*) FILTER (WHERE p = 0 AND t <> 0) AS false_empty
FROM b GROUP BY ROLLUP (p_brand, lung)""")
def mask_dice_audit(spark, sf_dir: str) -> DataFrame:
    """Dice, IoU and false empties of packed masks, by lane popcounts, over brand, lung and all."""
    lane = lambda s: F.conv(F.substring(F.sha2(F.concat(F.lit(s), F.col("p_partkey").cast("string")), 256), 1, 15), 16, 10).cast("long")
    b = bind.table(spark, sf_dir, "part").select("p_brand", (F.col("p_partkey") % 2).alias("lung"), lane("t").alias("t"), F.when(F.col("p_partkey") % 19 == 0, F.lit(0).cast("long")).otherwise(lane("t").bitwiseAND(lane("p"))).alias("p"))
    bits = lambda c: F.sum(F.bit_count(c))
    shared, t, p = F.col("t").bitwiseAND(F.col("p")), F.col("t"), F.col("p")
    out = b.rollup("p_brand", "lung").agg(F.count("*").alias("n"), bits(shared).alias("shared"), F.try_divide(2 * bits(shared), (bits(t) + bits(p)).cast("double")).alias("dice"), F.try_divide(bits(shared), bits(t.bitwiseOR(p)).cast("double")).alias("iou"), F.count_if((p == 0) & (t != 0)).alias("false_empty"))
    return bind.rounded(out.select(F.coalesce("p_brand", F.lit("all")).alias("p_brand"), F.coalesce("lung", F.lit(-1)).alias("lung"), "n", "shared", "dice", "iou", "false_empty"))


def _retention(sizes: DataFrame) -> DataFrame:
    """Retention of real rasters (two rectangles a part): masks are drawn, prepared once per part and read at 13 boxes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for key, w, h, crops in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                masks = np.zeros((2, h, w), bool)
                for k in (0, 1):
                    masks[k, int(h * 0.1) : int(h * 0.9), int(w * (0.1 + 0.5 * k)) : int(w * (0.4 + 0.5 * k))] = True
                shares = raster.retention(masks, np.array([[b["x0"], b["y0"], b["x1"], b["y1"]] for b in crops]), ("consolidation", "pleural_effusion"))
                rows += [(key, b["slot"], *s) for b, s in zip(crops, shares, strict=True)]
            yield pa.record_batch([pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.int64(), pa.int32(), pa.float64(), pa.float64()))], ["p_partkey", "slot", "consolidation", "pleural_effusion"])

    crops = sizes.select("p_partkey", "w", "h", boxes.crop_table(F.col("w"), F.col("h"), boxes.CROPS).alias("crops"))
    return bind.rounded(crops.mapInArrow(run, "p_partkey long, slot int, consolidation double, pleural_effusion double"))


@bind.register(QUERIES, ORACLE_SQL, "retention_rectangles_all", "WITH " + _crops_sql(boxes.CROPS) + """, l AS (SELECT *, v.k AS lung, floor(w * (0.1::DOUBLE + 0.5::DOUBLE * v.k)) AS a, floor(w * (0.4::DOUBLE + 0.5::DOUBLE * v.k)) AS c, floor(h * 0.1::DOUBLE) AS t, floor(h * 0.9::DOUBLE) AS u FROM b, (VALUES (0), (1)) v(k)),
m AS (SELECT p_partkey, slot, lung, greatest(0, least(x1, c) - greatest(x0, a)) * greatest(0, least(y1, u) - greatest(y0, t)) / ((c - a) * (u - t)) AS whole,
      greatest(0, least(x1, c) - greatest(x0, a)) * greatest(0, least(y1, u) - greatest(y0, t + 0.75::DOUBLE * (u - t))) / ((c - a) * 0.25::DOUBLE * (u - t)) AS basal FROM l)
SELECT p_partkey, slot, round(min(whole), 6) AS consolidation, round(min(basal), 6) AS pleural_effusion FROM m GROUP BY p_partkey, slot""")
def retention_rectangles_all(spark, sf_dir: str) -> DataFrame:
    return _retention(_sizes(spark, sf_dir))


@bind.register(QUERIES, ORACLE_SQL, "l2_normalise", "WITH n AS (SELECT vec_id, label, sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE))) AS n, embedding FROM embeddings) SELECT vec_id, round(n, 6) AS norm, round(embedding[1]::DOUBLE / n, 6) AS first, round(list_sum(list_transform(embedding, lambda x: x::DOUBLE / n)), 6) AS total FROM n")
def l2_normalise(spark, sf_dir: str) -> DataFrame:
    e = bind.table(spark, sf_dir, "embeddings")
    u = e.select("vec_id", F.sqrt(arrays.dot(F.col("embedding"), F.col("embedding"))).alias("norm"), arrays.l2_normalised(F.col("embedding")).alias("u"))
    return bind.rounded(u.select("vec_id", "norm", F.element_at("u", 1).alias("first"), F.aggregate("u", F.lit(0.0), lambda s, x: s + x).alias("total")))


@bind.register(QUERIES, ORACLE_SQL, "onehot_features", "SELECT vec_id, label % 3 AS finding, list_transform([0, 1, 2], lambda i: CASE WHEN i = label % 3 THEN 1.0::FLOAT ELSE 0.0::FLOAT END) AS onehot FROM embeddings")
def onehot_features(spark, sf_dir: str) -> DataFrame:
    return bind.table(spark, sf_dir, "embeddings").select("vec_id", (F.col("label") % 3).alias("finding"), arrays.one_hot(F.col("label") % 3, 3).alias("onehot"))


@bind.register(QUERIES, ORACLE_SQL, "prompt_margin", """WITH p AS (SELECT max(embedding) FILTER (WHERE vec_id = 0) AS neg, max(embedding) FILTER (WHERE vec_id = 1) AS pos FROM embeddings)
SELECT vec_id, round(list_sum(list_transform(list_zip(embedding, neg), lambda z: z[1]::DOUBLE * z[2]::DOUBLE)) - list_sum(list_transform(list_zip(embedding, pos), lambda z: z[1]::DOUBLE * z[2]::DOUBLE)), 6) AS margin FROM embeddings, p""")
def prompt_margin(spark, sf_dir: str) -> DataFrame:
    e = bind.table(spark, sf_dir, "embeddings")
    prompts = e.where("vec_id < 2").agg(F.max_by("embedding", -F.col("vec_id")).alias("neg"), F.max_by("embedding", "vec_id").alias("pos"))  # one row
    return bind.rounded(e.join(F.broadcast(prompts)).select("vec_id", arrays.prompt_margin(F.col("embedding"), F.col("neg"), F.col("pos")).alias("margin")))


@bind.register(QUERIES, ORACLE_SQL, "log_softmax_gather", "WITH m AS (SELECT vec_id, label, list_max(embedding)::DOUBLE AS top, embedding FROM embeddings) SELECT vec_id, round(embedding[label % 64 + 1]::DOUBLE - top - ln(list_sum(list_transform(embedding, lambda x: exp(x::DOUBLE - top)))), 6) AS logp FROM m")
def log_softmax_gather(spark, sf_dir: str) -> DataFrame:
    x = F.transform("embedding", lambda v: v.cast("double"))
    return bind.rounded(bind.table(spark, sf_dir, "embeddings").select("vec_id", arrays.log_softmax_at(x, F.col("label") % 64).alias("logp")))
