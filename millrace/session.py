"""Session factory with the settings that every query of this library assumes."""

from __future__ import annotations

from pyspark.sql import SparkSession


def session(name: str = "millrace", master: str | None = None, **conf: str) -> SparkSession:
    """A session in UTC with adaptive execution; keyword ``conf`` uses ``__`` for dots."""
    builder = SparkSession.builder.appName(name)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.ui.enabled": "false",
    } | {k.replace("__", "."): v for k, v in conf.items()}
    return builder.config(map=settings).getOrCreate()
