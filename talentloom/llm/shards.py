"""Texts dealt out to shards of bounded size, and packed keys that travel between shards and buckets."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bytes of text in a shard of a corpus of up to a GB, about, and in any; one long text may exceed it.
SHARD_BYTES, MOST_BYTES = 2 << 20, 64 << 20
LAST_ID = 2**63 - 1


def text_bytes(docs: DataFrame, text_col: str = "text") -> int:
    return docs.agg(F.sum(F.octet_length(F.col(text_col)).cast("long"))).first()[0] or 0


def scaled(size: int, total: int) -> int:
    """``size``, grown with the square root of a total above a GB, so that shards and buckets both grow and what goes from one to the other stays large enough."""
    return int(min(max(size, MOST_BYTES), size * max(1.0, (total / 2**30) ** 0.5)))


def sharded(docs: DataFrame, total: int) -> DataFrame:
    """``doc_id, text, shard``: rows dealt out by a hash of the id (of the text where the id is null)."""
    n = max(1, -(-total // scaled(SHARD_BYTES, total)))
    key = F.xxhash64("doc_id", F.when(F.col("doc_id").isNull(), F.col("text")))
    return docs.select("doc_id", "text", F.pmod(key, F.lit(n)).cast("int").alias("shard"))


def batch_of(table: pa.Table) -> pa.RecordBatch:
    """A group's rows as one batch, in the order of ids and texts' bytes, whatever order the shuffle had."""
    table = table.combine_chunks()
    batch = table.to_batches()[0] if table.num_rows else pa.RecordBatch.from_pylist([], schema=table.schema)
    return batch.take(pa.compute.sort_indices(batch, sort_keys=[("doc_id", "ascending")]))


def ids_of(batch: pa.RecordBatch) -> np.ndarray:
    """Ids as integers; null comes after all others."""
    return batch.column("doc_id").cast(pa.int64()).fill_null(LAST_ID).to_numpy(zero_copy_only=False)


def packed(keys: np.ndarray, width: int = 6) -> bytes:
    """The low ``width`` bytes of each 64-bit key."""
    return np.ascontiguousarray(keys.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width]).tobytes()


def unpacked(stored: bytes, width: int = 6) -> np.ndarray:
    out = np.zeros((len(stored) // width, 8), np.uint8)
    out[:, :width] = np.frombuffer(stored, np.uint8).reshape(-1, width)
    return out.reshape(-1).view("<u8")


def planes(values: np.ndarray) -> bytes:
    """64-bit values, first all lowest bytes, then the next ones: what small values have in common compresses well."""
    return np.ascontiguousarray(values.astype("<i8").view(np.uint8).reshape(-1, 8).T).tobytes()


def of_planes(stored: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(stored, np.uint8).reshape(8, -1).T).reshape(-1).view("<i8")


def buckets(keys: np.ndarray, n: int) -> np.ndarray:
    """Which of ``n`` equal ranges each 48-bit key falls into."""
    return ((keys * np.uint64(n)) >> np.uint64(48)).astype(np.int64) if n < 65536 else (keys.astype(np.float64) / 2.0**48 * n).astype(np.int64)


def runs(sorted_values: np.ndarray) -> np.ndarray:
    """Where runs of equal values start."""
    return np.flatnonzero(np.concatenate(([True], sorted_values[1:] != sorted_values[:-1]))) if len(sorted_values) else np.zeros(0, np.int64)


def member(keys: np.ndarray, of: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Whether each key is in the sorted array ``of``, and where."""
    if not len(of):
        return np.zeros(len(keys), bool), np.zeros(len(keys), np.int64)
    at = np.minimum(np.searchsorted(of, keys), len(of) - 1)
    return of[at] == keys, at
