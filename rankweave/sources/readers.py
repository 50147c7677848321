"""Readers with closed schemas; anything unexpected fails."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.contracts import ContractError, assert_empty, closed_schema


def jsonl(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Strict JSON lines (plain or .gz): explicit schema, FAILFAST; NaN and Infinity are no numbers."""
    return spark.read.schema(schema).option("mode", "FAILFAST").option("allowNonNumericNumbers", "false").json(path)


def json_document(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    return spark.read.schema(schema).option("mode", "FAILFAST").option("multiLine", "true").json(path)


def parquet(spark: SparkSession, path: str, columns: list[str], rows: int | None = None) -> DataFrame:
    """Exactly these columns, and that many rows if given."""
    df = spark.read.parquet(path)
    closed_schema(df, columns)
    if rows is not None and df.count() != rows:
        raise ContractError(f"{path}: expected {rows} rows")
    return df


def features(spark: SparkSession, path: str) -> DataFrame:
    """Feature rows without labels: ``y`` lives in a table of its own and is pruned even if present."""
    return spark.read.parquet(path).select("row_id", "X", "available")


def rle_table(spark: SparkSession, path: str, wanted: DataFrame, key: str) -> DataFrame:
    return spark.read.option("header", "true").csv(path).join(wanted.select(key), key, "left_semi")


def files(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """Recursive file index: name, digest, size and content."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(path)
    return raw.select(F.regexp_extract("path", r"([^/]*)\z", 1).alias("name"), "path", F.sha2("content", 256).alias("sha256"), "length", "content")


def resolved(index: DataFrame, wanted: DataFrame) -> DataFrame:
    """Wanted (name, sha256) with their one file; a name without such content is a violation."""
    found = index.dropDuplicates(["name", "sha256"]).select("name", "sha256", "path", "content")
    assert_empty(wanted.join(found, ["name", "sha256"], "left_anti"), "files not found by name and digest")
    return wanted.join(found, ["name", "sha256"])


def zip_members(index: DataFrame) -> DataFrame:
    """(archive, member, sha256, content) of ZIP files; members are chosen by digest, not by name."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import hashlib
        import io
        import zipfile

        for batch in batches:
            for path, content in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                with zipfile.ZipFile(io.BytesIO(content)) as archive:
                    for member in archive.namelist():
                        data = archive.read(member)
                        yield pa.record_batch([pa.array([path]), pa.array([member]), pa.array([hashlib.sha256(data).hexdigest()]), pa.array([data], pa.binary())], ["archive", "member", "sha256", "content"])

    return index.select("path", "content").mapInArrow(run, "archive string, member string, sha256 string, content binary")


def verified(data: DataFrame, receipts: DataFrame, stage: str) -> DataFrame:
    """Rows of files whose completed receipt of ``stage`` names their digest; others are violations."""
    good = receipts.where((F.col("stage") == stage) & (F.col("status") == "completed")).select(F.col("output_sha256").alias("sha256")).distinct()
    assert_empty(data.select("sha256").distinct().join(good, "sha256", "left_anti"), f"no completed receipt of {stage}")
    return data
