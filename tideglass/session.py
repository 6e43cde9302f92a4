"""Session settings that the engine relies on."""

from __future__ import annotations

from pyspark.sql import SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
}


def session(app: str = "tideglass", **settings: str) -> SparkSession:
    """A session with UTC time and adaptive execution; sizes are left to the cluster."""
    return SparkSession.builder.appName(app).config(map=SETTINGS | settings).getOrCreate()
