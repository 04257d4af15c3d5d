"""Lineage cuts in the shared folder, and joins against a side of checked size."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of narrow keys (tens of bytes each) up to which a side is broadcast.
BROADCAST_ROWS = 500_000


def shared_dir(spark: SparkSession) -> str:
    """The folder that ``spark.checkpoint.dir`` names. Where it is unset and all runs on one machine, as in tests, a new local one; on a cluster it must be set."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        set_before = spark.sparkContext._jsc.sc().getCheckpointDir()
        if set_before.isDefined():
            return set_before.get()
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="talentloom-"))
        named = spark.sparkContext._jsc.sc().getCheckpointDir().get()
    return named


def cut(df: DataFrame) -> DataFrame:
    """Writes a table into the shared folder and reads it again: what follows depends on files, not on executors."""
    path = f"{shared_dir(df.sparkSession).rstrip('/')}/talentloom/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def checked(small: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """A written table with a broadcast hint if it has at most ``limit`` rows; without one, so that Spark shuffles, if it has more."""
    return F.broadcast(small) if small.count() <= limit else small


def free(name: str, taken: list[str]) -> str:
    """A column name that is not taken: ``name``, with underscores behind it where it is."""
    lowered = {x.lower() for x in taken}
    while name in lowered:
        name += "_"
    return name
