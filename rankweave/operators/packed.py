"""Order and identity of packed rows: what lies at place p of a packed array must be the query that place p stands for.

Nothing is sorted. A Parquet reader tells each row's index in its file, so rows of a file are in order without a gap
exactly if position minus index is the same for all of them, which is one aggregate a file; and files follow each other
if their ranges tile the whole, which is a look at one row a file.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.ids import json_string, stable_hash
from ..functions.raster import FINDINGS

VARIANTS = 13
SLOTS = VARIANTS * len(FINDINGS)
#: What all rows of a source must share.
SOURCE = ("dataset", "source_id", "source_image_sha256", "split_group_id", "split")


def storage_faults(scan: DataFrame, position: str) -> DataFrame:
    """(file, position, fault) of a table as read from its files, the columns of the scan untouched.

    ``out of place``: a row whose position is not its file's first plus its index there. ``gap`` and ``overlap``: the
    first position of a file (as most of its rows tell it) that does not follow the file before it; the first file
    starts at 0.
    """
    rows = scan.select(F.col("_metadata.file_path").alias("file"), F.col(position).alias("position"), (F.col(position) - F.col("_metadata.row_index")).alias("base"))
    files = rows.groupBy("file").agg(F.percentile_approx("base", 0.5, 10_000).alias("first"), F.count("*").alias("n"), F.min("base").alias("low"), F.max("base").alias("high"))
    # Rows of sound files are not looked at again; the join holds one row a file.
    unsound = files.where("low <> high OR low IS NULL").select("file", "first")
    moved = rows.join(F.broadcast(unsound), "file").where(~F.col("base").eqNullSafe(F.col("first"))).select("file", "position", F.lit("out of place").alias("fault"))
    order = Window.orderBy("first", "file")
    edges = files.withColumn("due", F.coalesce(F.lag(F.col("first") + F.col("n")).over(order), F.lit(0)))
    torn = edges.where("first <> due").select("file", F.col("first").alias("position"), F.when(F.col("first") > F.col("due"), "gap").otherwise("overlap").alias("fault"))
    return moved.unionByName(torn)


def identity_faults(rows: DataFrame, split: str, input_version: str, query_version: str) -> DataFrame:
    """(position, fault) of rows (position, variant_index, finding, input_id, row_id, and the columns of ``SOURCE``).

    Place p is finding p mod 3 of variant p div 3 mod 13 of source p div 39. Faults: ``variant``, ``finding``,
    ``split``, ``input_id``, ``row_id`` (not the digest of what they name), ``source differs`` (a source's 39 rows do
    not agree), ``rows`` (not 39, told at the source's first place), ``source twice`` and ``image twice`` (told at the
    first place of every source that shares the key or image).
    """
    p = F.col("position")
    source = F.floor(p / SLOTS).cast("long")
    variant = F.floor(p / len(FINDINGS)).cast("long") % VARIANTS
    finding = F.element_at(F.array(*map(F.lit, FINDINGS)), (p % len(FINDINGS) + 1).cast("int"))
    named = [json_string(F.col("dataset")), json_string(F.col("source_id")), variant.cast("string")]
    wrong = {
        "variant": ~F.col("variant_index").eqNullSafe(variant), "finding": ~F.col("finding").eqNullSafe(finding), "split": ~F.col("split").eqNullSafe(F.lit(split)),
        "input_id": ~F.col("input_id").eqNullSafe(stable_hash(json_string(F.lit(input_version)), *named)), "row_id": ~F.col("row_id").eqNullSafe(stable_hash(json_string(F.lit(query_version)), *named, json_string(finding))),
    }
    told = F.filter(F.array(*(F.when(test, F.lit(name)) for name, test in wrong.items())), lambda x: x.isNotNull())
    each = rows.select("position", F.explode(told).alias("fault"))
    same = reduce(lambda a, b: a & b, (F.min(c).eqNullSafe(F.max(c)) & ((F.count(c) == 0) | (F.count(c) == F.count("*"))) for c in SOURCE))
    sources = rows.groupBy(source.alias("source")).agg(F.count("*").alias("n"), same.alias("same"), F.min("dataset").alias("dataset"), F.min("source_id").alias("source_id"), F.min("source_image_sha256").alias("image"))
    place = (F.col("source") * SLOTS).alias("position")
    found = [each, sources.where("n <> 39").select(place, F.lit("rows").alias("fault")), sources.where(~F.coalesce(F.col("same"), F.lit(False))).select(place, F.lit("source differs").alias("fault"))]
    for keys, fault in ((["dataset", "source_id"], "source twice"), (["image"], "image twice")):
        repeated = sources.groupBy(*keys).agg(F.count("*").alias("uses")).where("uses > 1").select(*keys)
        found.append(sources.join(repeated, keys).select(place, F.lit(fault).alias("fault")))
    return reduce(DataFrame.unionByName, found)
