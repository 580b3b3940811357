"""SparkSession factory."""

from __future__ import annotations

from pyspark.sql import SparkSession


def get_spark(app: str = "tessella", master: str | None = None, shuffle_partitions: int | None = None, **conf: str) -> SparkSession:
    """Session with UTC times and adaptive execution; sizes are left to the cluster unless given."""
    builder = SparkSession.builder.appName(app).config("spark.sql.session.timeZone", "UTC").config("spark.sql.adaptive.enabled", "true")
    builder = builder.config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
    if master:
        builder = builder.master(master)
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()
