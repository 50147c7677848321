"""Session settings that the engine expects; a cluster's own settings win."""

from __future__ import annotations

from pyspark.sql import SparkSession


def session(master: str = "local[*]", shuffle_partitions: int = 8, **more: str) -> SparkSession:
    """ANSI, AQE with skew handling, Arrow and UTC; shuffle partitions fit local runs and are a parameter for others."""
    builder = SparkSession.builder.master(master).appName("rankweave")
    settings = {
        "spark.sql.shuffle.partitions": str(shuffle_partitions), "spark.sql.adaptive.enabled": "true", "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true", "spark.sql.session.timeZone": "UTC", "spark.ui.enabled": "false", **more,
    }
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()
