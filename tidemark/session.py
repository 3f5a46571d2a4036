"""Session settings used by the tests and the benchmark."""

from __future__ import annotations

from pyspark.sql import SparkSession


def local_session(cores: int = 8, name: str = "tidemark", partitions: int | None = None) -> SparkSession:
    """A local session; on a cluster the submitter's settings are used instead."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(name)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "12g")
        .config("spark.sql.shuffle.partitions", str(partitions or cores))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        # Methods above 8,000 bytes of code stay interpreted; wide projections then go by themselves.
        .config("spark.sql.codegen.hugeMethodLimit", "8000")
        .getOrCreate()
    )
