"""The folder that the driver and all executors reach."""

from __future__ import annotations

import tempfile

from pyspark.sql import SparkSession


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir. Where it is unset, a local session (as in tests) gets a temporary folder; a cluster has none that all executors see, so this raises."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors reach")
        at = "file://" + tempfile.mkdtemp(prefix="trustlake-")
        spark.conf.set("spark.checkpoint.dir", at)
    return at.rstrip("/")
