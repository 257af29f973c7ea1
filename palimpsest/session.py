"""Spark session with the settings the engine expects. A session made elsewhere works as well."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession

DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def build_session(app: str = "palimpsest", master: str | None = None, conf: dict[str, str] | None = None) -> SparkSession:
    """Get or make a session. ``conf`` wins over the defaults; on a cluster leave ``master`` to spark-submit."""
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
        if master.startswith("local"):
            cores = master[6:-1] if master.startswith("local[") else "1"
            n = str(os.cpu_count() or 8) if cores == "*" else cores
            b = b.config("spark.sql.shuffle.partitions", n)
    for k, v in {**DEFAULTS, **(conf or {})}.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark
