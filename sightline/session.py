"""Session defaults shared by tests, the benchmark and the command line."""

from __future__ import annotations

from pyspark.sql import SparkSession


def local_session(cores: str = "8", partitions: int = 8, **extra: str) -> SparkSession:
    """A local session with the settings the engine is tested under: UTC clocks, ANSI arithmetic and adaptive execution."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("sightline")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.ansi.enabled", "true")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
    )
    for key, value in extra.items():
        builder = builder.config(key.replace("__", "."), value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark
