"""A session with the settings that results depend on, and those that suit large inputs."""

from __future__ import annotations

from pyspark.sql import SparkSession


def session(master: str | None = None, app: str = "lexspan", **conf: str) -> SparkSession:
    """conf: further settings, with _ for the dots."""
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
    } | {k.replace("_", "."): v for k, v in conf.items()}
    for k, v in settings.items():
        b = b.config(k, v)
    return b.getOrCreate()
