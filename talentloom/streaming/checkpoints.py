"""The shared folder for what streams write."""

from __future__ import annotations

import tempfile

from pyspark.sql import SparkSession


def folder(spark: SparkSession) -> str:
    """What ``spark.checkpoint.dir`` names. Where it is unset and all runs on one machine, as in tests, a new local folder; on a cluster it must be set."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    return (named or tempfile.mkdtemp(prefix="talentloom-stream-")).rstrip("/")
