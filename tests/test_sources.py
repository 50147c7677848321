"""Readers, sinks and streams on small files."""

import gzip
import zipfile

import pytest
from pyspark.sql import functions as F

from rankweave.operators.contracts import ContractError
from rankweave.sources import readers, sinks
from rankweave.streaming import events

SCHEMA = "k int, score double, status string, failure_reason string"


def test_json_lines(spark, tmp_path):
    from pyspark.sql import types as T

    schema = T.StructType([T.StructField("k", T.LongType()), T.StructField("x", T.DoubleType())])
    (tmp_path / "a.jsonl").write_text('{"k": 1, "x": 0.5}\n\n{"k": 2, "x": null}\n')
    with gzip.open(tmp_path / "b.jsonl.gz", "wt") as f:
        f.write('{"k": 3, "x": 1.5}\n')
    (tmp_path / "bad.jsonl").write_text('{"k": 1, "x": NaN}\n')
    assert sorted(r.k for r in readers.jsonl(spark, str(tmp_path / "a.jsonl"), schema).collect()) == [1, 2]
    assert readers.jsonl(spark, str(tmp_path / "b.jsonl.gz"), schema).first().x == 1.5
    with pytest.raises(Exception, match="(?i)malformed|FAILFAST"):
        readers.jsonl(spark, str(tmp_path / "bad.jsonl"), schema).collect()


def test_files_and_archives(spark, tmp_path):
    import hashlib

    with zipfile.ZipFile(tmp_path / "a.zip", "w") as z:
        z.writestr("one.txt", "first")
        z.writestr("two.txt", "second")
    index = readers.files(spark, str(tmp_path), "*.zip")
    assert index.first().name == "a.zip"
    found = {r.sha256: bytes(r.content) for r in readers.zip_members(index).collect()}
    assert found == {hashlib.sha256(x).hexdigest(): x for x in (b"first", b"second")}
    with pytest.raises(ContractError):
        readers.resolved(index, spark.createDataFrame([("a.zip", "0" * 64)], "name string, sha256 string"))


def test_sinks(spark, tmp_path):
    rows = spark.createDataFrame([(1, 0.5, "success", None), (2, None, "failed", "too dark")], SCHEMA)
    receipt = sinks.with_receipt(rows.coalesce(1), str(tmp_path / "out"), "scores", ["k"]).first()
    assert (receipt.stage, receipt.status, receipt.n_rows) == ("scores", "completed", 2)
    written = readers.files(spark, str(tmp_path / "out"), "*.parquet")
    receipts = sinks.with_receipt(rows, str(tmp_path / "more"), "scores", ["k"]).unionByName(spark.createDataFrame([receipt]))
    assert readers.verified(written, receipts, "scores").count() == written.count()
    with pytest.raises(ContractError):
        readers.verified(written, receipts.where(F.col("output_sha256") != receipt.output_sha256), "scores")
    with pytest.raises(ContractError):
        readers.verified(written, receipts, "another stage")
    with pytest.raises(Exception, match="(?i)exists"):
        sinks.fresh(rows, str(tmp_path / "out"))
    assert readers.parquet(spark, str(tmp_path / "out"), rows.columns, 2).count() == 2
    with pytest.raises(ContractError):
        readers.parquet(spark, str(tmp_path / "out"), rows.columns, 3)
    out = {r.k: (r.status, r.failure_reason) for r in sinks.all_inputs(spark.range(1, 4).withColumnRenamed("id", "k"), rows, "k").collect()}
    assert out == {1: ("success", None), 2: ("failed", "too dark"), 3: ("failed", "not_attempted")}


def test_streams(spark, tmp_path):
    rows = spark.createDataFrame([("a", 1, 10), ("a", 2, 20), ("b", 1, 5)], "k string, t long, v int").withColumn("at", F.timestamp_seconds(F.col("t") * 60))
    rows.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    for name, df, mode in (("latest", events.latest_state(stream, ["k"], ["t"], "v"), "complete"), ("counts", events.windowed_counts(stream, "at", ["k"]), "complete")):
        df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start().awaitTermination(60)
    assert {r.k: r.v for r in spark.table("latest").collect()} == {"a": 20, "b": 5}
    assert {r.k: r.n for r in spark.table("counts").collect()} == {"a": 2, "b": 1}
    assert events.sessions(rows, "at", ["k"]).count() == 2
