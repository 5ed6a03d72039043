"""A Spark session with the settings this library is meant to run with."""

from __future__ import annotations

from pyspark.sql import SparkSession

from codeloom.settings import Settings


def spark_session(settings: Settings | None = None) -> SparkSession:
    """Leaves a running session alone; the sizes are for a single machine and are the cluster's to override."""
    settings = settings or Settings()
    return (
        SparkSession.builder.master(settings.master)
        .appName("codeloom")
        .config("spark.sql.shuffle.partitions", str(settings.shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .getOrCreate()
    )
