"""Session construction: UTC time zone, everything else left to Spark and the cluster."""

from __future__ import annotations

from pyspark.sql import SparkSession


def build_session(app: str = "polarframe", master: str | None = None, **conf: str) -> SparkSession:
    """Start (or get) a session whose dates do not depend on the machine's time zone.

    Adaptive execution, partition coalescing and skew-join splitting are on by default in
    Spark; nothing here switches them off. Cluster sizing belongs to ``spark-submit``.
    """
    builder = SparkSession.builder.appName(app).config("spark.sql.session.timeZone", "UTC")
    if master:
        builder = builder.master(master)
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()
