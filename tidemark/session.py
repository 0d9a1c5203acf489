"""The session settings this library expects."""

from __future__ import annotations

from pyspark.sql import SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.sources.partitionOverwriteMode": "dynamic",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.ansi.enabled": "true",
}


def build_session(app: str = "tidemark", master: str | None = None, shuffle_partitions: int | None = None, **more: str) -> SparkSession:
    """A session with SETTINGS; shuffle_partitions only where the cluster's default doesn't fit, as in tests."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = SETTINGS | more | ({"spark.sql.shuffle.partitions": str(shuffle_partitions)} if shuffle_partitions else {})
    for k, v in settings.items():
        builder = builder.config(k, v)
    return builder.getOrCreate()
