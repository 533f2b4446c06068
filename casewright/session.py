"""Session settings the jobs rely on."""

from __future__ import annotations

from pyspark.sql import SparkSession


def build_session(app: str = "casewright", master: str | None = None, **settings: str) -> SparkSession:
    """A session with adaptive execution and UTC; cluster sizes stay the cluster's.

    AQE merges small shuffle partitions and splits skewed ones, so the number of
    shuffle partitions is set for the largest stage and not for the test data.
    """
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    if master:
        builder = builder.master(master)
    for name, value in settings.items():
        builder = builder.config(name, value)
    return builder.getOrCreate()
