"""Session settings: AQE with skew joins, UTC; shuffle partitions follow the machine unless they are given."""

from __future__ import annotations

from pyspark.sql import SparkSession


def session(master: str | None = None, **conf: str) -> SparkSession:
    b = SparkSession.builder.appName("strataquill")
    if master:
        b = b.master(master)
    settings = {"spark.sql.session.timeZone": "UTC", "spark.sql.adaptive.enabled": "true", "spark.sql.adaptive.skewJoin.enabled": "true", "spark.ui.enabled": "false"}
    for k, v in {**settings, **conf}.items():
        b = b.config(k, v)
    return b.getOrCreate()
