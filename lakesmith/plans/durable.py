"""Cutting lineage where a small intermediate result feeds several branches of a plan."""

from __future__ import annotations

import logging
import tempfile

from pyspark.sql import DataFrame

from lakesmith.logs import log
from lakesmith.session import checkpoint_dir


def durable(df: DataFrame) -> DataFrame:
    """`df` computed once and written to the shared folder of spark.checkpoint.dir, so that a lost executor costs nothing.

    Where that setting is missing, a temporary folder serves a local master. A cluster without a shared folder is a fault
    of its configuration that is logged: the plan is returned as it is, which is right, but computed once per use.
    """
    spark = df.sparkSession
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = checkpoint_dir(spark)
        if folder is None and sc.master.startswith("local") and not sc.master.startswith("local-cluster"):
            folder = tempfile.mkdtemp(prefix="lakesmith-checkpoint-")
        if folder is None:
            log("no_checkpoint_folder", logging.WARNING, setting="spark.checkpoint.dir", effect="intermediate results are computed once per use")
            return df
        sc.setCheckpointDir(folder)
    return df.checkpoint()
