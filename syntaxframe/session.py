"""Session settings that the plans count on."""

from __future__ import annotations

from pyspark.sql import SparkSession

SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    # Joins on (doc_id, parent_id) reuse a partitioning by doc_id.
    "spark.sql.requireAllClusterKeysForCoPartition": "false",
}


def session(app: str = "syntaxframe", master: str | None = None, **more: str) -> SparkSession:
    """A session with SETTINGS; further settings as keywords with dots written as double underscores."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**SETTINGS, **{k.replace("__", "."): v for k, v in more.items()}}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()
