"""A session with the settings that the library is written for."""

from __future__ import annotations

from pyspark.sql import SparkSession


def session(name: str = "onomast", master: str | None = None, **conf: str) -> SparkSession:
    """AQE on, UTC, Arrow for Python, as many shuffle partitions as the cluster has cores unless set."""
    builder = SparkSession.builder.appName(name)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        **{k.replace("__", "."): v for k, v in conf.items()},
    }
    return builder.config(map=settings).getOrCreate()
