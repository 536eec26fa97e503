"""Spark session with the settings the engine is written for."""

from __future__ import annotations

from pyspark.sql import SparkSession


def session(app: str = "quarry", **conf: str) -> SparkSession:
    """AQE on, UTC, skewed joins split; ``conf`` adds to it or overrides."""
    base = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
    }
    return SparkSession.builder.appName(app).config(map=base | conf).getOrCreate()
