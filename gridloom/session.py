"""Session defaults shared by tests, the bench and interactive use."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession


def get_spark(app: str = "gridloom", cpus: int | str | None = None, shuffle: int | None = None) -> SparkSession:
    """A session with UTC time, AQE and shuffle partitions sized to the local cores.

    On a cluster, create the session yourself: no operator reads anything but
    ``spark.sql.*`` settings and ``spark.checkpoint.dir`` from it.
    """
    cpus = cpus or os.environ.get("BENCH_CPUS", "8")
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle or cpus))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", os.environ.get("GRIDLOOM_DRIVER_MEMORY", "8g"))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
