"""Spark sessions with the settings the engine expects."""

from __future__ import annotations

from pyspark.sql import SparkSession

DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.sources.partitionOverwriteMode": "dynamic",
}


def _conf_name(argument: str) -> str:
    return argument.replace("_", ".")


def session(name: str = "lakeloom", master: str | None = None, **conf: str) -> SparkSession:
    """A session with DEFAULTS; conf (underscores for dots) comes on top. On a cluster, leave master unset."""
    builder = SparkSession.builder.appName(name)
    if master:
        builder = builder.master(master)
    for key, value in (DEFAULTS | {_conf_name(k): v for k, v in conf.items()}).items():
        builder = builder.config(key, value)
    return builder.getOrCreate()
