"""The session settings that the operators are written for."""

from __future__ import annotations

from pyspark.sql import SparkSession


def session(name: str = "corpusloom", **conf: str) -> SparkSession:
    """A session in UTC with adaptive execution and Arrow transfer; ``conf`` overrides (dots as ``__``)."""
    builder = SparkSession.builder.appName(name)
    settings = {"spark.sql.session.timeZone": "UTC", "spark.sql.adaptive.enabled": "true", "spark.sql.execution.arrow.pyspark.enabled": "true", "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}
    for k, v in (settings | {k.replace("__", "."): v for k, v in conf.items()}).items():
        builder = builder.config(k, v)
    return builder.getOrCreate()
