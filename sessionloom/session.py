"""The Spark session the engine expects."""

from __future__ import annotations

from pyspark.sql import SparkSession


def get_session(name: str = "sessionloom", **conf: str) -> SparkSession:
    """Time zone UTC and adaptive plans; other settings are the cluster's own."""
    builder = SparkSession.builder.appName(name).config("spark.sql.session.timeZone", "UTC")
    builder = builder.config("spark.sql.adaptive.enabled", "true").config("spark.sql.adaptive.skewJoin.enabled", "true")
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()
