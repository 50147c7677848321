"""How work is dealt out: what a plan must not broadcast, and how many tasks share it."""

from pyspark.sql import functions as F

from rankweave.operators import dedup


def test_near_pairs_are_not_sent_through_the_driver(spark):
    df = spark.range(40).select(F.col("id").alias("k"), F.sha2(F.col("id").cast("string"), 256).alias("code"))
    plan = dedup.near_pairs(df, "k", "code")._jdf.queryExecution().sparkPlan().toString()
    joins = [line for line in plan.splitlines() if "Join" in line and "Inner" in line]
    assert joins and all("SortMergeJoin" in line for line in joins)


def test_small_tables_are_dealt_out_before_their_rows_grow(spark, tmp_path):
    from rankweave import catalogue

    spark.range(1, 9).select(F.col("id").alias("p_partkey"), F.lit(3).alias("p_size")).coalesce(1).write.parquet(str(tmp_path / "part.parquet"))
    spark.range(1, 9).select(F.col("id").alias("c_custkey"), F.concat(F.lit("c"), "id").alias("c_name")).coalesce(1).write.parquet(str(tmp_path / "customer.parquet"))
    for name in ("retention_rectangles_all", "box_intersection", "pfs_contours", "raster_fingerprints", "soft_regions", "augmentation_recipes"):
        assert catalogue.QUERIES[name](spark, str(tmp_path)).rdd.getNumPartitions() == 4 * spark.sparkContext.defaultParallelism, name


def test_tables_span_the_foreground_alone_and_pixels_stay_in_the_task(spark, monkeypatch):
    import numpy as np

    from rankweave.functions import raster
    from rankweave.operators import slots

    mask = np.zeros((2, 60, 80), bool)
    mask[0, 10:20, 5:25], mask[1, 12:30, 40:70] = True, True
    spans, make = [], raster.Summed.__init__
    monkeypatch.setattr(raster.Summed, "__init__", lambda self, x: spans.append(x.shape) or make(self, x))
    boxes = np.array([[0, 0, 80, 60], [8.5, 3.25, 50.0, 19.0]])
    found = raster.retention(mask, boxes, ("consolidation", "pleural_effusion"))
    assert spans == [(10, 20), (18, 30)]
    assert np.allclose(found[0], 1) and np.isclose(found[1, 0], min(16.5 * 9 / 200, 10 * 7 / 540)) and found[1, 1] == 0
    df = spark.createDataFrame([(1, 8, 8, b"", b"", b"")], "k int, width int, height int, pixels binary, right_mask binary, left_mask binary")
    plan = slots.challenge_slots(df, ["k"])._jdf.queryExecution().optimizedPlan().toString()
    assert "pixels#" not in plan.split("MapInArrow")[1].splitlines()[0].split("[", 1)[1]


def test_vectors_of_weights_are_not_sent_through_the_driver(spark):
    from rankweave.operators import replicates

    vectors = spark.createDataFrame([("x", 1, b"ab")], "ds string, grp int, weights binary")
    plan = replicates.with_weights(vectors.select("ds", "grp"), vectors, ["ds"], "grp")._jdf.queryExecution().sparkPlan().toString()
    assert "SortMergeJoin" in plan and "BroadcastHashJoin" not in plan


def test_boosted_trees_keep_parts_of_bounded_size(spark, monkeypatch):
    from rankweave.operators import learn

    monkeypatch.setattr(learn, "PART_ROWS", 100)
    rows = spark.range(0, 1000, 1, 1)
    assert learn.dealt(rows).rdd.getNumPartitions() == 10 and learn.dealt(rows).count() == 1000


def test_packed_sources_are_dealt_out_before_they_grow(spark, tmp_path):
    from rankweave.catalogue import rasters

    spark.createDataFrame([(k, f"c{k}", "s") for k in range(60)], "c_custkey long, c_name string, c_mktsegment string").write.parquet(str(tmp_path / "customer.parquet"))
    plan = rasters.packed_order_faults(spark, str(tmp_path))._jdf.queryExecution().optimizedPlan().toString()
    assert "RepartitionByExpression [k#" in plan and f"], {4 * spark.sparkContext.defaultParallelism}" in plan


def test_a_whole_scope_is_not_shuffled_to_one_task(spark, monkeypatch):
    from rankweave.operators import ranking

    plans, written = {}, ranking.written
    monkeypatch.setattr(ranking, "written", lambda df, name: plans.setdefault(name, df._jdf.queryExecution().sparkPlan().toString()) and written(df, name))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        rows = spark.range(500).select(F.substring(F.concat(F.lit("a"), "id"), 1, 1).alias("ds"), F.col("id").cast("double").alias("s"), F.lit(2).alias("n"))
        out = ranking.running(rows, ["ds"], "s", ["n"])
        assert "BroadcastHashJoin" in plans["placed"] and "SortMergeJoin" not in plans["placed"] + out._jdf.queryExecution().sparkPlan().toString()
        want = {(float(k), 2 * (499 - k), 1000) for k in range(500)}
        assert {(r.s, r.n_before, r.n_total) for r in out.collect()} == want
        monkeypatch.setattr(ranking, "BROADCAST_SCOPES", 0)
        assert {(r.s, r.n_before, r.n_total) for r in ranking.running(rows, ["ds"], "s", ["n"]).collect()} == want
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_expanded_digests_take_little_disk(spark, tmp_path):
    from rankweave import catalogue

    spark.range(2000).select(F.col("id").alias("o_orderkey"), F.lit("O").alias("o_orderstatus")).coalesce(1).write.parquet(str(tmp_path / "orders.parquet"))
    before = spark.conf.get("spark.sql.parquet.compression.codec")
    try:
        catalogue.QUERIES["query_expansion_ids"](spark, str(tmp_path)).write.parquet(str(tmp_path / "out"))
    finally:
        spark.conf.set("spark.sql.parquet.compression.codec", before)
    assert sum(x.stat().st_size for x in (tmp_path / "out").glob("*.parquet")) < 55 * 2000 * 39
    assert spark.read.parquet(str(tmp_path / "out")).distinct().count() == 2000 * 39


def test_a_chain_of_close_rows_ends_in_few_rounds(spark, monkeypatch):
    rounds, written = [], dedup.written
    monkeypatch.setattr(dedup, "written", lambda df, name: rounds.append(name) or written(df, name))
    nodes = spark.range(60).withColumnRenamed("id", "node")
    pairs = nodes.where("node > 0").select((F.col("node") - 1).alias("a"), F.col("node").alias("b"))
    members = dedup.pair_groups(pairs).unionByName(spark.createDataFrame([("hot", k) for k in (20, 30, 40, 51)] + [(None, 0), (None, 2)], "group string, node long"))
    for most in (100_000, 3):
        monkeypatch.setattr(dedup, "HOT_GROUP", most)
        rounds.clear()
        got = {r.node: r.kept for r in dedup.greedy_keep(members, nodes, None, 50).collect()}
        want: dict = {}
        for k in range(60):
            want[k] = not want.get(k - 1, False) and not (k in (30, 40, 51) and any(want[j] for j in (20, 30, 40) if j < k))
        assert got == want and len(rounds) <= 7


def test_codes_of_a_band_are_shuffled_once(spark, monkeypatch):
    df = spark.range(60).select(F.col("id").alias("k"), F.concat(F.lpad(F.hex(F.col("id") % 20), 2, "0"), F.repeat(F.lit("0"), F.lit(62))).alias("code"))
    found = dedup.near_pairs(df, "k", "code")
    pairs = {(r.a, r.b, r.distance) for r in found.collect()}
    assert pairs == {(a, b, (a ^ b).bit_count()) for a in range(20) for b in range(a + 1, 20)}
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        assert "ReusedExchange [p#" in dedup.near_pairs(df, "k", "code")._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    monkeypatch.setattr(dedup, "BLOCK", 4)
    assert {(r.a, r.b, r.distance) for r in dedup.near_pairs(df, "k", "code").collect()} == pairs
