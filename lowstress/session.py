"""Session defaults used by tests, the benchmark and stand-alone runs."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession


def get_spark(app: str = "lowstress", cores: str | int = "*", shuffle_partitions: int = 8, memory: str = "6g") -> SparkSession:
    """A local session with AQE on, UTC and a private checkpoint folder."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", os.environ.get("LOWSTRESS_DRIVER_MEMORY", memory))
        .getOrCreate()
    )
