"""Contours, challenge slots and rasters made from the rows of the driver tables."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import ids, raster, recipes
from ..operators import packed, slots
from ..operators.align import numbered
from ..sources import pfs
from . import bind

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def _contour_text() -> Column:
    """Parts as contour files of two rectangles, some of them faulty by their key."""
    k, size = F.col("p_partkey") % 7, F.col("p_size")
    point = lambda x, y: F.concat(F.lit("{ "), x.cast("string"), F.lit(", "), y.cast("string"), F.lit(" },\n"))
    box = lambda x0, y0, x1, y1, cross: F.concat(point(x0, y0), point(x1, y0), F.when(cross, point(x0, y1)).otherwise(point(x1, y1)), F.when(cross, point(x1 - 1, y1 - 1)).otherwise(point(x0, y1)), F.when(k == 3, point(x0, y0)).otherwise(""))
    no = F.lit(False)
    right = F.concat(F.lit("{\n[Label="), F.when(k == 0, "spleen").otherwise("right lung"), F.lit("]\n[LineMode=ClosedContour]\n"), box(F.lit(10), F.lit(100), 10 + size * 5, 100 + size * 10, no), F.lit("},\n"))
    left = F.concat(F.lit("{\n[Label=left lung]\n[LineMode="), F.when(k == 1, "Open").otherwise("ClosedContour"), F.lit("]\n"), box(F.lit(600), F.lit(100), 600 + size * 6, 102 + size * 10, k == 2), F.lit("},\n"))
    return F.concat(F.lit("; part\n"), right, left, F.when(k == 4, F.lit("tail\n")).otherwise(""))


@bind.register(QUERIES, ORACLE_SQL, "pfs_contours", """SELECT p_partkey, CASE p_partkey % 7 WHEN 0 THEN 'unknown label' WHEN 1 THEN 'left lung is no closed contour' WHEN 2 THEN 'left lung: edges cross, touch or turn back' WHEN 4 THEN 'line outside a block' END AS fault,
    CASE WHEN p_partkey % 7 NOT IN (0, 1, 2, 4) THEN 4 END AS n_right, CASE WHEN p_partkey % 7 NOT IN (0, 1, 2, 4) THEN CAST(50 * p_size * p_size AS DOUBLE) END AS right_area, CASE WHEN p_partkey % 7 NOT IN (0, 1, 2, 4) THEN CAST(6 * p_size * (10 * p_size + 2) AS DOUBLE) END AS left_area,
    CASE WHEN p_partkey % 7 NOT IN (0, 1, 2, 4) THEN CASE WHEN p_partkey % 7 = 3 THEN '4' ELSE '' END END AS right_removed FROM part""")  # fmt: skip
def pfs_contours(spark, sf_dir: str) -> DataFrame:
    """Contour texts parsed: faults, areas by the shoelace sum, and places of the points that went."""
    rows = pfs.parsed(bind.spread(bind.table(spark, sf_dir, "part").select("p_partkey", "p_size"), "p_partkey").select("p_partkey", _contour_text().alias("content")), ["p_partkey"], "content")
    turned = lambda c: F.zip_with(c, F.concat(F.slice(c, 2, F.size(c)), F.slice(c, 1, 1)), lambda a, b: a["x"] * b["y"] - b["x"] * a["y"])
    area = lambda c: F.abs(F.aggregate(turned(c), F.lit(0.0), lambda s, x: s + x)) / 2
    size = F.when(F.col("right_lung").isNotNull(), F.size("right_lung"))
    return rows.select("p_partkey", "fault", size.alias("n_right"), area("right_lung").alias("right_area"), area("left_lung").alias("left_area"), F.array_join("right_removed", ",").alias("right_removed"))


def _pictures(spark, sf_dir: str) -> DataFrame:
    """Parts as pictures of two greys with a box for each lung; the margin m decides what can be cut away."""
    w, h, m = (40 + F.col("p_size")).cast("int"), (36 + F.col("p_partkey") % 30).cast("int"), (F.col("p_partkey") % 4).cast("int")
    row = F.concat(F.expr("repeat(chr(20 + p_size), w DIV 2)"), F.expr("repeat(chr(100), w - w DIV 2)"))
    # A part is a few bytes, its picture some thousand; parts of one picture are dealt out together, one after another.
    kind = ["p_size", "h", "m"]
    p = bind.spread(bind.table(spark, sf_dir, "part").select("p_partkey", "p_size", w.alias("w"), h.alias("h"), m.alias("m")), *kind).sortWithinPartitions(*kind)
    third = F.expr("CAST(w DIV 3 AS INT)")
    right = slots.box_mask(F.col("w"), F.col("h"), F.col("m"), F.col("m"), F.col("m") + third, F.col("h") - F.col("m"))
    left = slots.box_mask(F.col("w"), F.col("h"), F.col("w") - F.col("m") - third, F.col("m"), F.col("w") - F.col("m"), F.col("h") - F.col("m"))
    return p.select("p_partkey", "m", F.col("w").alias("width"), F.col("h").alias("height"), F.repeat(row, F.col("h")).cast("binary").alias("pixels"), right.alias("right_mask"), left.alias("left_mask"))


_PICTURES = "p AS (SELECT p_partkey, 40 + p_size AS w, 36 + p_partkey % 30 AS h, p_partkey % 4 AS m, (40 + p_size) // 3 AS t, 20 + p_size AS grey FROM part)"
_SLOT_ROWS = ", ".join(f"({k}, '{name}', '{family}', " + ", ".join(f"{v}::DOUBLE" for v in slots.UNSEEN.get(name, slots.UNSEEN["left_30" if name.startswith("left30") else "top_30" if name.startswith("top30") else "original"])) + ")" for k, (name, family) in enumerate(slots.SLOTS))


@bind.register(QUERIES, ORACLE_SQL, "challenge_slots", f"""WITH {_PICTURES}, s(slot, variant, family, l, t0, r, b) AS (VALUES {_SLOT_ROWS}),
x AS (SELECT *, CASE family WHEN 'background' THEN greatest(0, m - ceil(0.02::DOUBLE * w)) ELSE round_even(l * w, 0) END AS x0, CASE family WHEN 'background' THEN greatest(0, m - ceil(0.02::DOUBLE * h)) ELSE round_even(t0 * h, 0) END AS y0,
    CASE family WHEN 'background' THEN least(w, w - m + ceil(0.02::DOUBLE * w)) ELSE w - round_even(r * w, 0) END AS x1, CASE family WHEN 'background' THEN least(h, h - m + ceil(0.02::DOUBLE * h)) ELSE h - round_even(b * h, 0) END AS y1 FROM p, s),
f AS (SELECT *, greatest(1, round_even((x1 - x0) * (256 / greatest(x1 - x0, y1 - y0)), 0)) AS nw, greatest(1, round_even((y1 - y0) * (256 / greatest(x1 - x0, y1 - y0)), 0)) AS nh,
    greatest(0, least(x1, m + t) - greatest(x0, m)) * greatest(0, least(y1, h - m) - greatest(y0, m)) / (t * (h - 2 * m)) AS right_share, greatest(0, least(x1, w - m) - greatest(x0, w - m - t)) * greatest(0, least(y1, h - m) - greatest(y0, m)) / (t * (h - 2 * m)) AS left_share FROM x),
g AS (SELECT *, CASE WHEN family = 'background' AND x0 = 0 AND y0 = 0 AND x1 = w AND y1 = h THEN 'no_removable_background_margin' WHEN variant LIKE '%gray127' AND nw = 256 AND nh = 256 THEN 'no_padding_to_modify'
    WHEN variant LIKE '%topleft' AND floor((256 - nw) / 2) = 0 AND floor((256 - nh) / 2) = 0 THEN 'no_padding_offset_to_move' END AS reason FROM f)
SELECT p_partkey, CAST(slot AS INT) AS slot, variant, family, CASE WHEN reason IS NULL THEN 'eligible' ELSE 'construction_ineligible' END AS status, reason, CAST(x0 AS INT) AS x0, CAST(y0 AS INT) AS y0, CAST(x1 AS INT) AS x1, CAST(y1 AS INT) AS y1,
    CASE WHEN reason IS NULL THEN round(least(right_share, left_share), 6) END AS consolidation FROM g""")  # fmt: skip
def challenge_slots(spark, sf_dir: str) -> DataFrame:
    """Every picture's 21 slots: what each shows, and why some cannot be."""
    out = slots.challenge_slots(_pictures(spark, sf_dir), ["p_partkey"])
    return bind.rounded(out.select("p_partkey", "slot", "variant", "family", "status", "reason", "x0", "y0", "x1", "y1", F.get("targets", F.lit(2)).alias("consolidation")))


@bind.register(QUERIES, ORACLE_SQL, "raster_fingerprints", f"""WITH {_PICTURES}, q AS (SELECT *, repeat(chr(CAST(grey AS INT)), CAST(w * h AS INT)) AS px FROM p) SELECT p_partkey, sha256(px) AS raster_sha256, sha256('{{"rgb":"' || sha256(repeat(px, 3)) || '","size":[' || w || ',' || h || ']}}') AS decoded_sha256,
    sha256(repeat(chr(CAST(grey AS INT)), 65536)) AS gray256_sha256, repeat('0', 64) AS dhash256, sha256(repeat(chr(CAST(grey AS INT)), 1024)) AS thumbnail_sha256 FROM q""")
def raster_fingerprints(spark, sf_dir: str) -> DataFrame:
    """Fingerprints of pictures of one grey each; resampling must keep it."""
    p = bind.table(spark, sf_dir, "part").select("p_partkey", (40 + F.col("p_size")).cast("int").alias("width"), (36 + F.col("p_partkey") % 30).cast("int").alias("height"), "p_size")
    pictures = bind.spread(p, "p_partkey").select("p_partkey", "width", "height", F.expr("CAST(repeat(chr(20 + p_size), width * height) AS BINARY)").alias("pixels"))
    return slots.fingerprints(pictures, ["p_partkey"]).select("p_partkey", "raster_sha256", "decoded_sha256", "gray256_sha256", "dhash256", F.sha2("thumbnail", 256).alias("thumbnail_sha256"))


@bind.register(QUERIES, ORACLE_SQL, "presented_masks", f"""WITH {_PICTURES}, c AS (SELECT *, w - m AS cw, h AS ch FROM p), r AS (SELECT *, CASE WHEN cw <= ch THEN 64 ELSE 64 * cw // ch END AS rw, CASE WHEN cw <= ch THEN 64 * ch // cw ELSE 64 END AS rh FROM c),
k AS (SELECT p_partkey, (SELECT count(*) FROM range(64) i WHERE least((2 * (i.range + (rw - 64) // 2) + 1) * cw // (2 * rw), cw - 1) BETWEEN m AND m + t - 1) AS nx, (SELECT count(*) FROM range(64) i WHERE least((2 * (i.range + (rh - 64) // 2) + 1) * ch // (2 * rh), ch - 1) BETWEEN m AND h - m - 1) AS ny FROM r)
SELECT p_partkey, nx * ny AS presented_pixels FROM k""")
def presented_masks(spark, sf_dir: str) -> DataFrame:
    """The right lung as a processor of side 64 would show it, after a cut of the right margin."""
    df = _pictures(spark, sf_dir).select("p_partkey", "width", "height", F.col("right_mask").alias("mask"), F.lit(0).alias("x0"), F.lit(0).alias("y0"), (F.col("width") - F.col("m")).alias("x1"), F.col("height").alias("y1"))
    return slots.presented_masks(df, ["p_partkey"], 64).select("p_partkey", "presented_pixels")


@bind.register(QUERIES, ORACLE_SQL, "soft_regions", f"""WITH {_PICTURES}, a AS (SELECT *, h - 2 * m AS hh, CASE WHEN p_partkey % 5 = 0 THEN 0.25 ELSE 0.75 END AS v FROM p), b AS (SELECT *, greatest(1, ceil(0.02::DOUBLE * least(t, hh))) AS r, (SELECT count(*) FROM range(h) y WHERE y.range >= m + 0.75::DOUBLE * hh AND y.range < h - m) AS low FROM a),
f AS (SELECT p_partkey, v, unnest(['pleural_effusion', 'pneumothorax', 'consolidation']) AS finding, unnest([t * low, t * hh - greatest(0, t - 2 * r) * greatest(0, hh - 2 * r), t * hh]) AS pixels, v * t * hh / (w * h) AS mean, v AS peak FROM b)
SELECT p_partkey, finding, round(CASE WHEN v >= 0.5 THEN v * pixels ELSE 0 END, 6) AS mass, v >= 0.5 AND pixels > 0 AS valid, round(mean::DOUBLE, 6) AS lung_mean, peak::DOUBLE AS peak FROM f""")
def soft_regions(spark, sf_dir: str) -> DataFrame:
    """Soft lungs of one probability each: masses of the regions of the right one, empty under a half."""
    df = _pictures(spark, sf_dir)

    @F.arrow_udf("binary")
    def soft(width, height, right, left, key):
        out = []
        for w, h, a, b, k in zip(*(x.to_pylist() for x in (width, height, right, left, key)), strict=True):
            masks = np.stack([raster.unpack(a, h, w), raster.unpack(b, h, w)])
            out.append((masks * (0.25 if k % 5 == 0 else 0.75)).astype("<f4").tobytes())
        return pa.array(out, pa.binary())

    rows = slots.soft_regions(df.select("p_partkey", "width", "height", soft("width", "height", "right_mask", "left_mask", "p_partkey").alias("probabilities")), ["p_partkey"])
    return bind.rounded(rows.where("lung = 'right'").select("p_partkey", "finding", "mass", "valid", F.get("summary", F.lit(0)).alias("lung_mean"), F.get("summary", F.lit(1)).alias("peak")))


def _recipe_sql() -> str:
    """Each slot's box with the uniforms of its edges, on customers as sources."""
    u = lambda k, name: f"(CAST('0x' || substr(sha256('[\"recipe-v1\",17,\"' || id || '\",\"' || sha || '\",{k},\"' || {name} || '\"]'), 1, 16) AS UBIGINT) >> 11) / 9007199254740992::DOUBLE"
    parts = []
    for k, edges in enumerate(recipes.EDGES):
        drawn = f"['top', 'bottom', 'left', 'right'][1 + CAST(floor(({u(k, chr(39) + 'edge' + chr(39))}) * 4) AS INT)]"
        fraction = {s: f"(0.02::DOUBLE + 0.26::DOUBLE * ({u(k, chr(39) + s + chr(39))}))" for s in recipes.SIDES if edges is None or s in edges}
        if k >= 11:
            total = " + ".join(fraction.values())
            fraction = {s: f"(CASE WHEN {total} > 0.4::DOUBLE THEN {x} * (0.4::DOUBLE / ({total})) ELSE {x} END)" for s, x in fraction.items()}
        cut = {s: f"greatest(1, floor({x} * {'h' if s in ('top', 'bottom') else 'w'}))" for s, x in fraction.items()}
        if edges is None:
            cut = {s: f"(CASE WHEN {drawn} = '{s}' THEN {x} ELSE 0 END)" for s, x in cut.items()}
        c = lambda s, cut=cut: cut.get(s, "0")
        corner = f"CASE WHEN ({u(k, chr(39) + 'padding_mode' + chr(39))}) < 0.5 THEN 'center' ELSE {list(recipes.CORNERS)}[1 + CAST(floor(({u(k, chr(39) + 'corner' + chr(39))}) * 4) AS INT)] END" if k == 11 else "'center'"
        amount = f"[0.8::DOUBLE, 1.2][1 + CAST(floor(({u(k, chr(39) + 'brightness' + chr(39))}) * 2) AS INT)]" if k == 3 else "1.0::DOUBLE" if k == 7 else f"CASE WHEN ({u(k, chr(39) + 'padding_mode' + chr(39))}) < 0.5 THEN 63.0::DOUBLE END" if k == 11 else "NULL::DOUBLE"
        parts.append(f"SELECT c_custkey, {k} AS slot, '{recipes.FAMILIES[k]}' AS family, CAST({c('left')} AS INT) AS x0, CAST({c('top')} AS INT) AS y0, CAST(w - {c('right')} AS INT) AS x1, CAST(h - {c('bottom')} AS INT) AS y1, {amount} AS amount, {corner} AS corner FROM c")
    return "WITH c AS (SELECT c_custkey, c_name AS id, sha256(c_name) AS sha, 40 + c_custkey % 700 AS w, 32 + c_custkey % 500 AS h FROM customer) " + " UNION ALL ".join(parts)


@bind.register(QUERIES, ORACLE_SQL, "augmentation_recipes", _recipe_sql())
def augmentation_recipes(spark, sf_dir: str) -> DataFrame:
    """Customers as sources: thirteen seeded recipes each, under the limits of every axis."""
    c = bind.spread(bind.table(spark, sf_dir, "customer").select("c_custkey", "c_name"), "c_custkey").select("c_custkey", "c_name", F.sha2("c_name", 256).alias("sha"), (40 + F.col("c_custkey") % 700).cast("int").alias("w"), (32 + F.col("c_custkey") % 500).cast("int").alias("h"))
    return recipes.recipes(c, "recipe-v1", "w", "h", "c_name", "sha").select("c_custkey", "slot", "family", "x0", "y0", "x1", "y1", "amount", "corner")


@bind.register(QUERIES, ORACLE_SQL, "packed_order_faults", """WITH c AS (SELECT *, row_number() OVER (ORDER BY c_custkey) - 1 AS k FROM customer), s AS (SELECT k, c_custkey, c_name, c_mktsegment AS ds, range AS slot FROM c, range(39)),
f AS (SELECT 39 * k + slot AS position, unnest(['pleural_effusion', 'pneumothorax', 'consolidation']) AS x, generate_subscripts(['pleural_effusion', 'pneumothorax', 'consolidation'], 1) - 1 AS fi, * FROM s)
SELECT position, 'variant' AS fault FROM f WHERE fi = 0 AND c_custkey % 50 = 7 AND slot // 3 IN (3, 4) UNION ALL SELECT position, 'input_id' FROM f WHERE fi = 0 AND c_custkey % 50 = 7 AND slot // 3 IN (3, 4)
UNION ALL SELECT position, 'row_id' FROM f WHERE fi = 0 AND ((c_custkey % 50 = 7 AND slot // 3 IN (3, 4)) OR (c_custkey % 70 = 11 AND slot = 5)) UNION ALL SELECT position, 'split' FROM f WHERE fi = 0 AND c_custkey % 110 = 3 AND slot = 8
UNION ALL SELECT 39 * k, 'source differs' FROM c WHERE c_custkey % 110 = 3 UNION ALL SELECT 39 * k, 'image twice' FROM c WHERE c_custkey % 90 = 13 AND (SELECT count(*) FROM c WHERE c_custkey % 90 = 13) > 1""")
def packed_order_faults(spark, sf_dir: str) -> DataFrame:
    """Customers as packed sources of 39 rows, with planted swaps, wrong ids, a stray split and shared images."""
    # Each source is 39 rows with digests; numbered sources lie in few small files, so they are dealt out before they grow.
    c = bind.spread(numbered(bind.table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_mktsegment"), ["c_custkey"]).withColumnRenamed("position", "k"), "k")
    s = c.select("*", F.explode(F.sequence(F.lit(0), F.lit(38))).alias("slot"))
    at = F.floor(F.col("slot") / 3).cast("long")
    variant = F.when((F.col("c_custkey") % 50 == 7) & at.isin(3, 4), 7 - at).otherwise(at)
    finding = F.element_at(F.array(*map(F.lit, raster.FINDINGS)), F.col("slot") % 3 + 1)
    key = [ids.json_string(F.col("c_mktsegment")), ids.json_string(F.col("c_name")), variant.cast("string")]
    row_id = ids.stable_hash(ids.json_string(F.lit("q-v1")), *key, ids.json_string(finding))
    rows = s.select(
        (F.col("k") * 39 + F.col("slot")).alias("position"), variant.alias("variant_index"), finding.alias("finding"), ids.stable_hash(ids.json_string(F.lit("i-v1")), *key).alias("input_id"),
        F.when((F.col("c_custkey") % 70 == 11) & (F.col("slot") == 5), "other").otherwise(row_id).alias("row_id"), F.col("c_mktsegment").alias("dataset"), F.col("c_name").alias("source_id"),
        F.sha2(F.when(F.col("c_custkey") % 90 == 13, "shared").otherwise(F.col("c_name")), 256).alias("source_image_sha256"), F.col("c_name").alias("split_group_id"), F.when((F.col("c_custkey") % 110 == 3) & (F.col("slot") == 8), "dev").otherwise("fit").alias("split"),
    )
    return packed.identity_faults(rows, "fit", "i-v1", "q-v1")
