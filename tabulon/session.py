"""Session settings the operators expect."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession

from tabulon.storage import CLEANUP


def get_spark(app: str = "tabulon", master: str | None = None, **conf: str) -> SparkSession:
    """A session in UTC with adaptive execution; `conf` keys use __ for dots."""
    builder = SparkSession.builder.appName(app)
    if master or "SPARK_MASTER" in os.environ:
        builder = builder.master(master or os.environ["SPARK_MASTER"])
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        CLEANUP: "true",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
    } | {k.replace("__", "."): v for k, v in conf.items()}
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()
