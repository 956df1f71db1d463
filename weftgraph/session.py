"""A session with the settings the library counts on."""

from __future__ import annotations

from pyspark.sql import SparkSession


def session(master: str | None = None, app: str = "weftgraph", shared: str | None = None, **conf: str) -> SparkSession:
    """UTC, adaptive execution with skew joins, Arrow; conf overrides. shared: the checkpoint folder that all executors see."""
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
    } | ({"spark.checkpoint.dir": shared} if shared else {}) | conf
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    return builder.config(map=settings).getOrCreate()
