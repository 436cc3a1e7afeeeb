"""Session with the settings that every query of the library relies on."""

from __future__ import annotations

from pyspark.sql import SparkSession

#: UTC makes naive timestamps and epoch arithmetic agree; adaptive execution re-plans joins and splits skewed ones.
DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def session(name: str = "tracefold", master: str | None = None, conf: dict[str, str] | None = None) -> SparkSession:
    builder = SparkSession.builder.appName(name)
    if master:
        builder = builder.master(master)
    for key, value in (DEFAULTS | (conf or {})).items():
        builder = builder.config(key, value)
    return builder.getOrCreate()
