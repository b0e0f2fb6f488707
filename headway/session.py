"""Session defaults."""

from __future__ import annotations

from pyspark.sql import SparkSession


def session(app: str = "headway", **options: str) -> SparkSession:
    """A session with the settings the library expects; options override them."""
    builder = SparkSession.builder.appName(app)
    settings = {"spark.sql.session.timeZone": "UTC", "spark.sql.adaptive.enabled": "true", "spark.sql.ansi.enabled": "true", "spark.cleaner.referenceTracking.cleanCheckpoints": "true"} | options
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()
