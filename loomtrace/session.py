"""Session defaults: UTC, ANSI, adaptive execution, Arrow."""

from __future__ import annotations

from pyspark.sql import SparkSession

DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
}


def session(name: str = "loomtrace", master: str | None = None, **more: str) -> SparkSession:
    """A session with these defaults; ``more`` takes configuration with dots written as double underscores."""
    b = SparkSession.builder.appName(name)
    if master:
        b = b.master(master)
    for k, v in (DEFAULTS | {k.replace("__", "."): v for k, v in more.items()}).items():
        b = b.config(k, v)
    return b.getOrCreate()
