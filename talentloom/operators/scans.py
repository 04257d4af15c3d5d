"""Running sums and maxima over a total order whose groups may be too large for one task."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from talentloom.streaming.checkpoints import folder

#: Ranges that rows are parted in; None: as many as a shuffle has partitions. They spread the work; no result depends on them.
PARTS: int | None = None


def written(df: DataFrame) -> DataFrame:
    """The table, written once into the shared folder and read from there by all that needs it."""
    path = f"{folder(df.sparkSession)}/rows-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def in_ranges(df: DataFrame, order: list[str], part: str = "__part") -> DataFrame:
    """The rows with the number of their range of the ascending order, so that a range holds what lies between two borders.

    Rows that agree in the whole order share a range. Where borders lie depends on a sample that Spark draws, so the rows are written to the shared folder: whatever is worked out
    from the result sees the same ranges, also after an executor is lost.
    """
    n = PARTS or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return written(df.repartitionByRange(n, *order).withColumn(part, F.spark_partition_id()))


def before(df: DataFrame, groups: list[str], order: list, values: dict[str, tuple[str, Column]], part: str = "__part") -> DataFrame:
    """For each row the sums and maxima of its group's rows that come before it, as new columns (null where none do): ``name: (sum or max, value)``.

    Each range of a group is scanned by itself. What a range adds up to is one row; only those of a group meet in one task, and each range then adds what precedes it.
    ``part`` numbers the ranges in the order of ``order``, as ``in_ranges`` does.
    """
    kinds = {"sum": F.sum, "max": F.max}
    both = {"sum": lambda a, b: F.when(a.isNotNull() | b.isNotNull(), F.coalesce(a, F.lit(0)) + F.coalesce(b, F.lit(0))), "max": F.greatest}
    within = Window.partitionBy(*groups, part).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    of_parts = Window.partitionBy(*groups).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    whole = df.groupBy(*groups, part).agg(*(kinds[kind](value).alias(name) for name, (kind, value) in values.items()))
    led = whole.select(*(F.col(c).alias(f"__{c}") for c in (*groups, part)), *(kinds[kind](name).over(of_parts).alias(f"__before_{name}") for name, (kind, _) in values.items()))
    rows = df.withColumns({name: kinds[kind](value).over(within) for name, (kind, value) in values.items()})
    same = reduce(lambda a, b: a & b, (F.col(c).eqNullSafe(F.col(f"__{c}")) for c in (*groups, part)))
    met = rows.join(led, same)
    return met.select(*df.columns, *(both[kind](F.col(name), F.col(f"__before_{name}")).alias(name) for name, (kind, _) in values.items()))
