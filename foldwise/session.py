"""Session construction for tests, the bench and interactive use."""

from __future__ import annotations

from pyspark.sql import SparkSession


def local_session(cores: str | int = "*", partitions: int = 8, app: str = "foldwise") -> SparkSession:
    """A single-JVM session with the settings the operators are tested under."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", "16g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
