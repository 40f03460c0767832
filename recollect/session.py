"""Session settings the library is designed around."""

from __future__ import annotations

from pyspark.sql import SparkSession

# Runtime SQL settings; each is safe to set on a session that already exists.
SQL_SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # Joins on (image_id, term) use the postings as they lie, bucketed and sorted: only the
    # other, small side is shuffled and sorted.
    "spark.sql.requireAllClusterKeysForCoPartition": "false",
    "spark.sql.legacy.bucketedTableScan.outputOrdering": "true",
}


def build_session(app: str = "recollect", master: str | None = None, **settings: str) -> SparkSession:
    """A session with the settings above. ``settings`` take dots as double underscores."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in SQL_SETTINGS.items():
        builder = builder.config(key, value)
    for key, value in settings.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()
