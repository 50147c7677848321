"""Small helpers that several operators share."""

from __future__ import annotations

import contextlib
import gc
import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.skew import sized_join  # noqa: F401


def shared_folder(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir.

    Where it is unset, a session whose executors are this very process (tests) gets a temporary one; on a cluster there
    is no place that all executors see, which is an error.
    """
    context = spark.sparkContext
    named = context.getConf().get("spark.checkpoint.dir") or context.getCheckpointDir()
    if not named:
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        named = "file://" + tempfile.mkdtemp(prefix="rankweave-")
        context.setCheckpointDir(named)
    return named


def written(df: DataFrame, name: str) -> DataFrame:
    """Write to a fresh folder under the shared one and read it again: lineage ends there, and lost executors cost nothing."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.folder = path
    return out


def discard(*frames: DataFrame) -> None:
    """Delete what ``written`` has written, once all that reads it is written itself."""
    for df in frames:
        context = df.sparkSession.sparkContext
        path = context._jvm.org.apache.hadoop.fs.Path(df.folder)
        path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)


def forget_shuffles(spark: SparkSession) -> None:
    """Executors delete the files of shuffles that the driver no longer refers to."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def checked_broadcast(df: DataFrame, rows: int) -> DataFrame:
    """A broadcast hint only if the (already written) frame has at most ``rows`` rows; beyond that Spark shuffles.

    The count reads file footers. Rows hold a few numbers each, so ``rows`` bounds the bytes.
    """
    return F.broadcast(df) if df.count() <= rows else df


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def trimmed(run):
    """A map over Arrow batches after which the (reused) Python worker gives its free memory back to the machine."""

    def inner(batches):
        import ctypes

        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            with contextlib.suppress(OSError, AttributeError):
                ctypes.CDLL(None).malloc_trim(0)

    return inner


def crc_text(column: str) -> Column:
    return F.crc32(F.col(column).cast("string"))


def small_batches(spark: SparkSession, rows: int = 500) -> None:
    """Arrow batches of few rows: with long texts their bytes, in the JVM and in Python, are what fills an executor."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
