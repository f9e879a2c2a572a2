"""Session builder with the settings the operators rely on."""

from __future__ import annotations

from pyspark.sql import SparkSession

#: Settings that change results (time zone, ANSI) or plans (adaptive execution); sizes are left to the cluster.
DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.ansi.enabled": "true",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def build_session(app: str = "evidentia", master: str | None = None, **conf: str) -> SparkSession:
    """A session with DEFAULTS; `conf` keys use '__' for '.', and win over the defaults."""
    builder = SparkSession.builder.appName(app).config(map=DEFAULTS)
    if master:
        builder = builder.master(master)
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()
