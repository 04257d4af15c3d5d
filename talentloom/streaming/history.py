"""Bounded search history, kept by a stream."""

from __future__ import annotations

import time
import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

LIMIT = 100
#: Where a search without a time stands: before all others.
NO_TIME = -(2**62)


def events_stream(spark: SparkSession, path: str) -> DataFrame:
    """A stream over the Parquet files of a path; a single file is a stream of its folder restricted to it."""
    schema = spark.read.parquet(path).schema
    folder, _, name = path.rstrip("/").rpartition("/")
    files = spark.read.parquet(path).inputFiles()
    single = len(files) == 1 and files[0].endswith(f"/{name}")
    reader = spark.readStream.schema(schema)
    return reader.option("pathGlobFilter", name).parquet(folder) if single else reader.parquet(path)


def ring_buffers(events: DataFrame, limit: int = LIMIT) -> DataFrame:
    """For each batch and user with new rows the user's newest ``limit`` rows: ``user_id, event_id, ts_us, version``.

    State is one bounded list for each user. Rows come and go by (time, id), so late rows find their place. ``version`` grows with each update of a user.
    """

    def keep(key: tuple, rows: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        version, ts, ids = state.get if state.exists else (0, [], [])
        held = list(zip(ts, ids))
        for part in rows:
            held = sorted({*held, *zip(part["ts_us"].tolist(), part["event_id"].tolist())}, reverse=True)[:limit]
        state.update((version + 1, [t for t, _ in held], [i for _, i in held]))
        yield pd.DataFrame({"user_id": key[0], "event_id": [i for _, i in held], "ts_us": [t for t, _ in held], "version": version + 1})

    rows = events.select("user_id", "event_id", F.unix_micros(F.to_timestamp("ts")).alias("ts_us"))
    return rows.groupBy("user_id").applyInPandasWithState(keep, "user_id long, event_id long, ts_us long, version long", "version long, ts array<long>, ids array<long>", "update", GroupStateTimeout.NoTimeout)


def ring_buffer_replay(spark: SparkSession, path: str, limit: int = LIMIT) -> DataFrame:
    """Runs the stream over what is there now and returns the buffers: ``event_id, user_id``."""
    from talentloom.streaming.checkpoints import folder

    base = f"{folder(spark)}/history/{uuid.uuid4().hex}"

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{base}/out/batch={number}")

    ring_buffers(events_stream(spark, path), limit).writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", f"{base}/state").trigger(availableNow=True).start().awaitTermination()
    out = spark.read.parquet(f"{base}/out")
    last = out.groupBy("user_id").agg(F.max("version").alias("version"))
    return out.join(last, ["user_id", "version"]).select("event_id", "user_id")

#: The newest searches that a user's lists keep.
LIMITS = {"recent": LIMIT, "saved": 1000}
#: How long a deletion waits for a search that has not come yet.
WAITS_MS = 30 * 24 * 3600 * 1000
KEPT = "user_id long, version long, list string, search_id long, ts_us long"


def kept_searches(changes: DataFrame, limits: dict[str, int] | None = None) -> DataFrame:
    """What a table of changes leaves: ``user_id, list, search_id, ts_us``.

    ``changes`` has ``user_id, search_id, ts_us, change``; a change is the name of a list that takes the search, or ``delete``. A list keeps its newest rows
    by (time, id), repeated ones once; a deleted search is hidden but keeps its place until newer ones push it out, so the order of arrival does not matter.
    Rows without an id, and changes of other names, are left out; without a time a search is the oldest; null users are one user.
    """
    limits = limits or LIMITS
    rows = changes.filter(F.col("search_id").isNotNull()).select("user_id", "search_id", F.coalesce("ts_us", F.lit(NO_TIME)).alias("ts_us"), "change")
    gone = rows.filter("change = 'delete'").select(F.col("user_id").alias("u"), F.col("search_id").alias("s")).distinct()
    newest = Window.partitionBy("user_id", "list").orderBy(F.desc("ts_us"), F.desc("search_id"))
    placed = rows.filter(F.col("change").isin(*limits)).groupBy("user_id", F.col("change").alias("list"), "search_id").agg(F.max("ts_us").alias("ts_us")).withColumn("place", F.row_number().over(newest))
    limit = F.create_map(*(F.lit(x) for pair in limits.items() for x in pair))[F.col("list")]
    held = placed.filter(F.col("place") <= limit).drop("place")
    return held.join(gone, held["user_id"].eqNullSafe(gone["u"]) & (held["search_id"] == gone["s"]), "left_anti")


def search_lists(changes: DataFrame, limits: dict[str, int] | None = None, waits_ms: int = WAITS_MS) -> DataFrame:
    """``kept_searches`` by a stream: for each batch and user with changes what the lists hold now, ``user_id, version, list, search_id, ts_us``, and a row without a list that stands for the version.

    State is as many searches as the limits say, and deletions for ``waits_ms``: a search may come later than its deletion by no more than that.
    """
    limits = limits or LIMITS

    def keep(key: tuple, rows: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        version, ids, times, lists, hidden, early, early_at = state.get if state.exists else (0, [], [], [], [], [], [])
        now = int(time.time() * 1000)
        waiting = {s: at for s, at in zip(early, early_at) if at + waits_ms > now}
        held = {(name, s): (ts, bool(h)) for s, ts, name, h in zip(ids, times, lists, hidden)}
        for part in rows:
            for search, ts, change in zip(part["search_id"].tolist(), part["ts_us"].tolist(), part["change"].tolist()):
                if change == "delete":
                    waiting[search] = now
                elif change in limits:
                    old, was_hidden = held.get((change, search), (ts, False))
                    held[change, search] = (max(old, ts), was_hidden)
        kept = {}
        for name, limit in limits.items():
            newest = sorted(((ts, s, h or s in waiting) for (n, s), (ts, h) in held.items() if n == name), reverse=True)[:limit]
            kept |= {(name, s): (ts, h) for ts, s, h in newest}
        state.update((
            version + 1, [s for _, s in kept], [ts for ts, _ in kept.values()], [n for n, _ in kept], [int(h) for _, h in kept.values()], list(waiting), list(waiting.values()),
        ))
        shown = [(n, s, ts) for (n, s), (ts, h) in kept.items() if not h] + [(None, 0, 0)]
        yield pd.DataFrame({
            "user_id": pd.array([key[0]] * len(shown), dtype="Int64"), "version": version + 1, "list": [n for n, _, _ in shown], "search_id": [s for _, s, _ in shown], "ts_us": [ts for _, _, ts in shown],
        })

    rows = changes.filter(F.col("search_id").isNotNull()).select("user_id", "search_id", F.coalesce("ts_us", F.lit(NO_TIME)).alias("ts_us"), "change")
    held = "version long, ids array<long>, times array<long>, lists array<string>, hidden array<int>, early array<long>, early_at array<long>"
    return rows.groupBy("user_id").applyInPandasWithState(keep, KEPT, held, "update", GroupStateTimeout.NoTimeout)


def search_lists_replay(changes: DataFrame, base: str, limits: dict[str, int] | None = None) -> DataFrame:
    """Runs ``search_lists`` over what is there now and returns what ``kept_searches`` does. Called again with the same ``base`` it goes on where it stopped.

    A batch that is written twice after a crash replaces itself; of each user the rows of the last version hold.
    """

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{base}/out/batch={number}")

    search_lists(changes, limits).writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", f"{base}/state").trigger(availableNow=True).start().awaitTermination()
    out = changes.sparkSession.read.schema(KEPT).parquet(f"{base}/out")
    held = F.collect_list(F.when(F.col("list").isNotNull(), F.struct("list", "search_id", "ts_us")))
    last = out.groupBy("user_id", "version").agg(held.alias("held")).groupBy("user_id").agg(F.max_by("held", "version").alias("held"))
    return last.select("user_id", F.inline("held"))


def windowed_counts(events: DataFrame, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Events by type and window of time, with late rows up to a watermark."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", width), "event_type").agg(F.count(F.lit(1)).alias("n")).select(F.col("window.start").alias("start"), "event_type", "n")
