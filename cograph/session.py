"""The session that the library's own scripts use; on a cluster, the caller's session is used as it is."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession


def build_session(cores: str | int = "*", app: str = "cograph", **conf: str) -> SparkSession:
    cpus = os.cpu_count() or 1
    n = cpus if cores == "*" else int(cores)
    builder = SparkSession.builder.appName(app)
    if not os.environ.get("SPARK_MASTER_SET"):
        builder = builder.master(f"local[{cores}]")
    settings = {
        "spark.sql.shuffle.partitions": str(n),
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.driver.memory": "8g",
    }
    for key, value in {**settings, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()
