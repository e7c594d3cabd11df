"""One session factory for the command line, the tests and the bench."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession

#: Settings that the operators rely on: UTC, adaptive execution, and skew-join splitting for hot join keys.
DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def build_session(name: str = "lakesmith", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the defaults above; `conf` wins over them. Without a master the environment's is taken."""
    builder = SparkSession.builder.appName(name)
    if master or "SPARK_MASTER" in os.environ:
        builder = builder.master(master or os.environ["SPARK_MASTER"])
    for key, value in {**DEFAULTS, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def checkpoint_dir(spark: SparkSession) -> str | None:
    """The shared folder named in spark.checkpoint.dir, or None where the cluster names none."""
    return spark.conf.get("spark.checkpoint.dir", None)
