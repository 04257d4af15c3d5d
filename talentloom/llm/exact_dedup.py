"""Exact deduplication: counting quotient filters find fingerprints that repeat, bytes decide."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from talentloom.llm.cuts import checked, cut
from talentloom.llm.textbytes import of_batches, of_group

#: Fingerprints that one partition gathers in filters before they are handed on, and that one merge task sees, about.
FILTER_KEYS = MERGE_KEYS = 1 << 21
#: Ranges of fingerprints that a task merges, at least.
RANGES = 16
#: Share of a filter's slots that are used, at most, and quotients that are merged at once.
LOAD, STRETCH = 0.95, 1 << 18

_SPACE = " \t\n\x0b\x0c\r"


def normalised(text: Column) -> Column:
    """The text without its white space ``[\x20\x09-\x0D]``; empty for null."""
    return F.translate(F.coalesce(text, F.lit("")), _SPACE, "")


class QuotientFilter:
    """A counting quotient filter: slots in the order of quotients, each with a remainder or a counter, and two bits for each slot.

    The leading ``prefix`` bits of its 64-bit fingerprints are known; the next ``q`` bits are the quotient, the rest is the remainder, so no
    bit is lost. A fingerprint lies in the slot of its quotient or, where that is taken, in one behind it; a quotient's run is in the order of
    remainders. ``occupied`` marks the quotients that have a run, ``runend`` the last slot of each run. One copy is one slot with the remainder; more are
    the remainder twice and a slot with the counter, one more such triple for every full counter.
    """

    def __init__(self, q: int, prefix: int, value: int, slots: np.ndarray, occupied: np.ndarray, runend: np.ndarray):
        self.q, self.prefix, self.value = q, prefix, value
        self.slots, self.occupied, self.runend = slots, occupied, runend
        self.runs()

    @staticmethod
    def of(keys: np.ndarray, counts: np.ndarray, prefix: int = 0) -> QuotientFilter:
        """Of sorted distinct fingerprints that share their leading ``prefix`` bits, and how often each occurs."""
        most, triples = (1 << 16) - 1, np.zeros(len(keys), np.int64)
        triples[counts > 1] = -(-counts[counts > 1] // most)
        size = np.maximum(1, 3 * triples)
        q = max(1, min(44 - prefix, int(np.ceil(np.log2(max(2.0, size.sum() / LOAD))))))
        r = np.uint64(64 - prefix - q)
        quotient = ((keys >> r) & np.uint64((1 << q) - 1)).astype(np.int64)
        remainder = keys & np.uint64((1 << int(r)) - 1)
        # a fingerprint's first slot: its quotient's, or the one behind the fingerprint before
        behind = np.cumsum(size) - size
        slot = np.maximum.accumulate(quotient - behind) + behind if len(keys) else behind
        total = max(1 << q, int((slot + size).max(initial=0)))
        slots, occupied, runend = np.zeros(total, np.uint64), np.zeros(total, bool), np.zeros(total, bool)
        occupied[quotient] = True
        last = np.flatnonzero(np.append(quotient[1:] != quotient[:-1], True))[: len(keys)]
        runend[slot[last] + size[last] - 1] = True
        slots[slot] = remainder
        for i in np.flatnonzero(triples).tolist():
            for k in range(int(triples[i])):
                at = slot[i] + 3 * k
                slots[at : at + 3] = remainder[i], remainder[i], min(most, int(counts[i]) - k * most)
        return QuotientFilter(q, prefix, int(keys[0] >> np.uint64(64 - prefix)) if prefix and len(keys) else 0, slots, occupied, runend)

    def runs(self) -> None:
        """Quotients that have a run, and the first and last slot of each: the first one is that of the quotient, or the one behind the run before."""
        self.quotients, self.ends = np.flatnonzero(self.occupied), np.flatnonzero(self.runend)
        self.starts = np.maximum(self.quotients, np.concatenate(([0], self.ends[:-1] + 1)))[: len(self.ends)]

    def used(self) -> np.ndarray:
        """Which slots hold something."""
        change = np.zeros(len(self.occupied) + 1, np.int8)
        np.add.at(change, self.starts, 1)
        np.add.at(change, self.ends + 1, -1)
        return np.cumsum(change[:-1], dtype=np.int8) > 0

    def stretch(self, low: int, high: int) -> tuple[np.ndarray, np.ndarray]:
        """Sorted fingerprints, and their counts, of the quotients from ``low`` up to ``high``."""
        a, z = np.searchsorted(self.quotients, [low, high])
        size = self.ends[a:z] + 1 - self.starts[a:z]
        at = np.repeat(self.starts[a:z] - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))
        run, remainder = np.repeat(np.arange(len(size)), size), self.slots[at]
        n, counter = np.ones(len(at), np.int64), np.zeros(len(at), bool)
        free = 0
        for i in np.flatnonzero((run[1:] == run[:-1]) & (remainder[1:] == remainder[:-1])).tolist():
            if i >= free:  # a remainder twice is followed by its counter
                n[i], counter[i + 1 : i + 3], free = int(remainder[i + 2]), True, i + 3
        r = np.uint64(64 - self.prefix - self.q)
        lead = np.uint64(self.value << (64 - self.prefix)) if self.prefix else np.uint64(0)
        keys = lead | (self.quotients[a:z][run].astype(np.uint64) << r) | remainder
        return merged([(keys[~counter], n[~counter])])

    def packed(self) -> bytes:
        """The two bits of every slot, and the remainders at their own width; empty slots have none."""
        r = 64 - self.prefix - self.q
        kept = self.slots[self.used()]
        bits = np.unpackbits(kept.astype(">u8").view(np.uint8)).reshape(-1, 64)[:, 64 - r :]
        head = np.array([self.q, self.prefix, self.value, len(self.slots), len(kept)], "<u8").tobytes()
        return head + b"".join(np.packbits(x).tobytes() for x in (self.occupied, self.runend, bits))

    @staticmethod
    def unpacked(stored: bytes) -> QuotientFilter:
        q, prefix, value, n, n_kept = (int(x) for x in np.frombuffer(stored[:40], "<u8"))
        r, marks, raw = 64 - prefix - q, -(-n // 8), np.frombuffer(stored[40:], np.uint8)
        occupied, runend = (np.unpackbits(x, count=n).astype(bool) for x in (raw[:marks], raw[marks : 2 * marks]))
        wide = np.zeros((n_kept, 64), np.uint8)
        wide[:, 64 - r :] = np.unpackbits(raw[2 * marks :], count=n_kept * r).reshape(n_kept, r)
        out = QuotientFilter(q, prefix, value, np.zeros(n, np.uint64), occupied, runend)
        out.slots[out.used()] = np.packbits(wide, axis=1).view(">u8").ravel()
        return out


def merged(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Sorted fingerprints of several sorted ones, two by two in linear steps; the counts of equal ones add up."""
    while len(parts) > 1:
        pairs = []
        for (a, n), (b, m) in zip(parts[::2], parts[1::2]):
            keys, counts = np.empty(len(a) + len(b), np.uint64), np.empty(len(a) + len(b), np.int64)
            at = np.arange(len(b)) + np.searchsorted(a, b, "right")
            rest = np.ones(len(keys), bool)
            rest[at] = False
            keys[at], counts[at], keys[rest], counts[rest] = b, m, a, n
            pairs.append((keys, counts))
        parts = pairs + parts[len(parts) // 2 * 2 :]
    keys, counts = parts[0] if parts else (np.zeros(0, np.uint64), np.zeros(0, np.int64))
    first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))[: len(keys)]
    return keys[first], np.add.reduceat(counts, first) if len(first) else counts


def merged_filters(filters: list[QuotientFilter]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Fingerprints and counts of filters of one range, in order: a stretch of leading bits at a time is read from each and merged by its sorted remainders."""
    if not filters:
        return
    prefix = filters[0].prefix
    bits = max(0, max(f.q for f in filters) + int(np.ceil(np.log2(len(filters)))) - int(np.log2(STRETCH)))
    bits = min(bits, min(f.q for f in filters))
    for k in range(1 << bits):
        yield merged([f.stretch(k << (f.q - bits), (k + 1) << (f.q - bits)) for f in filters if f.prefix == prefix])


def repeated_fingerprints(fingerprints: DataFrame, rows: int) -> DataFrame:
    """``fp``: the values of the column ``fp`` that occur more than once.

    Each partition gathers up to ``FILTER_KEYS`` fingerprints, parts them by their leading bits and hands on a filter for each range, so a merge task
    sees one range from all partitions: a repeated fingerprint is one entry for each filter, however often it occurs.
    """
    bits = int(np.ceil(np.log2(max(RANGES, rows / MERGE_KEYS))))
    shift = np.uint64(64 - bits)

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []

        def out() -> pa.RecordBatch:
            keys, counts = np.unique(np.concatenate(held).view(np.uint64), return_counts=True)
            held.clear()
            blocks, starts = np.unique(keys >> shift, return_index=True)
            ends = np.append(starts[1:], len(keys))
            stored = [QuotientFilter.of(keys[a:b], counts[a:b], bits).packed() for a, b in zip(starts, ends)]
            return pa.RecordBatch.from_arrays([pa.array(blocks.astype(np.int32)), pa.array(stored, pa.binary())], names=["block", "filter"])

        for batch in batches:
            held.append(batch.column("fp").to_numpy())
            if sum(map(len, held)) >= FILTER_KEYS:
                yield out()
        if sum(map(len, held)):
            yield out()

    def merge(group: pa.Table) -> pa.Table:
        found = [keys[counts > 1] for keys, counts in merged_filters([QuotientFilter.unpacked(x) for x in group.column("filter").to_pylist()])]
        return pa.table({"fp": pa.array(np.concatenate(found).view(np.int64))})

    return fingerprints.select("fp").mapInArrow(of_batches(build), "block int, filter binary").groupBy("block").applyInArrow(of_group(merge), "fp long")


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Groups of texts that are equal without white space: ``doc_id, keep_id, group_size, kept, text_sha256`` for every row.

    The row with the most code points, then the smallest id, stays (``keep_id``). Quotient filters over
    64-bit fingerprints find what may repeat; only texts of such fingerprints are grouped, by their bytes, with a map-side
    combine, so a group of any size is one row from each task. The repeated fingerprints are broadcast if they are at most
    ``cuts.BROADCAST_ROWS``, else joined by a shuffle. The hash of the groups meets the slim rows of all documents in a join whose hot keys Spark can split.

    A null text is empty; all texts without characters but white space are one group. Null ids come last among
    equals. Rows that repeat an id and a text count in ``group_size``, and stay or go together. A text of any length is one value. No rows give no
    rows. Other columns are left out.
    """
    norm = normalised(F.col(text_col))
    rows = docs.select(F.col(id_col).alias("doc_id"), F.length(F.coalesce(F.col(text_col), F.lit(""))).alias("n"), norm.alias("norm")).withColumn("fp", F.xxhash64("norm"))
    digests = cut(rows.select("doc_id", "fp", F.sha2("norm", 256).alias("text_sha256")))
    repeated = cut(repeated_fingerprints(digests, digests.count()))
    first = F.min(F.struct((-F.col("n")).alias("n"), F.col("doc_id").isNull().alias("none"), F.col("doc_id"))).alias("first")
    groups = (
        rows.join(checked(repeated), "fp", "left_semi")
        .groupBy("fp", "norm")
        .agg(first, F.count(F.lit(1)).alias("group_size"))
        .filter("group_size > 1")
        .select(F.sha2("norm", 256).alias("text_sha256"), F.col("first.doc_id").alias("first_id"), "group_size")
    )
    return digests.join(groups, "text_sha256", "left").select(
        "doc_id",
        F.when(F.col("group_size").isNull(), F.col("doc_id")).otherwise(F.col("first_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1).cast("long")).alias("group_size"),
        (F.col("group_size").isNull() | F.col("doc_id").eqNullSafe(F.col("first_id"))).alias("kept"),
        "text_sha256",
    )


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"))


OP6_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS norm FROM documents)
SELECT doc_id,
       first_value(doc_id) OVER w AS keep_id,
       count(*) OVER (PARTITION BY norm) AS group_size,
       doc_id = first_value(doc_id) OVER w AS kept,
       sha256(norm) AS text_sha256
FROM d WINDOW w AS (PARTITION BY norm ORDER BY length(t) DESC, doc_id)
"""
