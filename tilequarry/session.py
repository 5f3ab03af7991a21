"""A session with the settings the engine is tuned for."""

from __future__ import annotations

from pyspark.sql import SparkSession


def session(app: str = "tilequarry", **conf: str) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    defaults = {"spark.sql.adaptive.enabled": "true", "spark.sql.session.timeZone": "UTC", "spark.sql.execution.arrow.pyspark.enabled": "true"}
    for key, value in (defaults | conf).items():
        builder = builder.config(key, value)
    return builder.getOrCreate()
