"""Writers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def append(df: DataFrame, path: str, by: str | None = None) -> None:
    """Adds rows to a Parquet table, in folders by a column if named."""
    writer = df.write.mode("append")
    (writer.partitionBy(by) if by else writer).parquet(path)


def append_searches(df: DataFrame, path: str, kind: str, saved: bool = False) -> None:
    """Adds search events with an id and the time, in folders by kind."""
    append(df.withColumns({"search_id": F.expr("uuid()"), "timestamp": F.current_timestamp(), "is_saved": F.lit(saved), "search_type": F.lit(kind)}), path, "search_type")


def report(df: DataFrame, path: str) -> None:
    """A processing report as JSON lines."""
    df.write.mode("overwrite").json(path)
