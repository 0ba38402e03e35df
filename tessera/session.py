"""A session with the settings the engine counts on."""

from __future__ import annotations

from pyspark.sql import SparkSession


def get_session(app: str = "tessera", master: str | None = None, **settings: str) -> SparkSession:
    """The running session, or a new one: adaptive execution on, UTC, ANSI left as it is (casts here are all ``try_``)."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for k, v in {
        "spark.sql.adaptive.enabled": "true", "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC", "spark.sql.execution.arrow.pyspark.enabled": "true", **settings,
    }.items():
        builder = builder.config(k, v)
    return builder.getOrCreate()
