"""A session with the settings this engine is written for."""

from __future__ import annotations

from pyspark.sql import SparkSession


def session(name: str = "gridlore", **conf: str) -> SparkSession:
    """AQE on, UTC, Arrow on. Sizes (shuffle partitions, split bytes) are the cluster's to set."""
    wanted = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.sql.sources.partitionOverwriteMode": "dynamic",
        **conf,
    }
    return SparkSession.builder.appName(name).config(map=wanted).getOrCreate()
