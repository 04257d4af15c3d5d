"""Vectorised word and shingle work on Arrow string columns, as UTF-8 bytes.

All helpers run inside Spark tasks on one slice of an Arrow batch at a time, so memory follows
``SLICE_BYTES`` (or the longest single text), never the partition.
"""

from __future__ import annotations

import ctypes
import os
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text that a task handles at once; a longer single text forms a slice of its own.
SLICE_BYTES = 2 << 20

_U = np.uint64
_SHINGLE, _CHUNK = _U(0xC2B2AE3D27D4EB4F), _U(0x9E3779B97F4A7C15)
#: What word hashes start from, and their multipliers; ``drawn`` gives others.
FIXED = (_U(0), _CHUNK, _SHINGLE)
#: What keeps the first so many bytes of a little-endian number.
_FIRST = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)

#: Byte classes: what is not white space ``[\x20\x09-\x0D]``, and what is a digit, a letter or not ASCII.
NOT_SPACE = np.ones(256, bool)
NOT_SPACE[[0x20, *range(0x09, 0x0E)]] = False
ALNUM = np.zeros(256, bool)
ALNUM[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True

#: Lower-cases A-Z and keeps every other byte.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 0x20


def drawn() -> tuple[np.uint64, np.uint64, np.uint64]:
    """Random numbers for one run in place of ``FIXED``; the multipliers are odd. Who writes texts can't know them, so texts can't be made to collide."""
    a, b, c = np.frombuffer(os.urandom(24), np.uint64)
    return a, b | _U(1), c | _U(1)


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective finaliser on 64-bit values."""
    h = h ^ (h >> _U(33))
    h = h * _U(0xFF51AFD7ED558CCD)
    h ^= h >> _U(33)
    h *= _U(0xC4CEB9FE1A85EC53)
    return h ^ (h >> _U(33))


def eights(raw: np.ndarray) -> np.ndarray:
    """For each position the number that it and the seven bytes after it make, zeros behind the end: a view of a padded copy."""
    return np.ndarray((len(raw),), "<u8", np.append(raw, np.zeros(8, np.uint8)), strides=(1,))


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets (from 0) of a string or binary column; a null is an empty text."""
    if column.null_count:
        column = column.fill_null(b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    if len(column) == 0 or offsets is None:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, at - at[0]


def slices(batch: pa.RecordBatch, column: str, limit: int = 0) -> Iterator[pa.RecordBatch]:
    """Parts of a batch with at most ``limit`` bytes of text each, or one row."""
    limit = limit or SLICE_BYTES
    _, at = buffers(batch.column(column))
    low = 0
    while low < batch.num_rows:
        high = max(low + 1, int(np.searchsorted(at, at[low] + limit, "right")) - 1)
        yield batch.slice(low, high - low)
        low = high


def words(raw: np.ndarray, at: np.ndarray, kind: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of every maximal run of ``kind`` bytes within a text, and the first word of each text (one more at the end)."""
    n = len(raw)
    if n == 0:
        none = np.zeros(0, np.int64)
        return none, none, np.zeros(len(at), np.int64)
    inside = kind[raw]
    cut = np.zeros(n + 1, bool)
    cut[at] = True
    before = np.empty(n, bool)
    before[0], before[1:] = False, inside[:-1]
    starts = np.flatnonzero(inside & (~before | cut[:-1]))
    after = np.empty(n, bool)
    after[-1], after[:-1] = False, inside[1:]
    ends = np.flatnonzero(inside & (~after | cut[1:])) + 1
    return starts, ends, np.searchsorted(starts, at)


def word_hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, secret: tuple = FIXED) -> np.ndarray:
    """64-bit hashes of the words with A-Z lower-cased.

    Every eight bytes are mixed, with their place, before they are added up, so no pattern within words makes sums equal.
    """
    if len(starts) == 0:
        return np.zeros(0, np.uint64)
    (begin, chunk, last), numbers, size = secret, eights(LOWER[raw]), ends - starts
    out = mix((numbers[starts] & _FIRST[np.minimum(size, 8)]) ^ begin)
    long = np.flatnonzero(size > 8)
    if len(long):
        n = (size[long] - 1) // 8
        first = np.cumsum(n) - n
        k = np.arange(int(n.sum())) - np.repeat(first, n) + 1
        at = np.repeat(starts[long], n) + 8 * k
        rest = numbers[at] & _FIRST[np.minimum(np.repeat(ends[long], n) - at, 8)]
        out[long] += np.add.reduceat(mix(mix(rest ^ begin) + k.astype(np.uint64) * chunk), first)
    return mix(out + size.astype(np.uint64) * last)


def run_hashes(hashes: np.ndarray, size: int, secret: tuple = FIXED) -> np.ndarray:
    """Hash of every run of ``size`` consecutive values; runs do not heed text borders."""
    n = len(hashes) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.full(n, _U(size))
    for j in range(size):
        out *= secret[2]
        out += hashes[j : j + n]
    return mix(out)


def shingle_sets(raw: np.ndarray, at: np.ndarray, size: int, secret: tuple = FIXED) -> list[np.ndarray]:
    """For each text the sorted distinct hashes of its runs of ``size`` words; of all its words where it has fewer; none without words."""
    starts, ends, first = words(raw, at, NOT_SPACE)
    hashes = word_hashes(raw, starts, ends, secret)
    runs = run_hashes(hashes, size, secret)
    out = []
    for low, high in zip(first[:-1].tolist(), first[1:].tolist()):
        n = high - low
        if n >= size:
            s = np.sort(runs[low : high - size + 1])
            out.append(s[np.concatenate(([True], s[1:] != s[:-1]))])
        else:
            out.append(run_hashes(hashes[low:high], n, secret) if n else hashes[:0])
    return out


def settle() -> None:
    """Gives memory that a finished piece of work has freed back to the system: idle workers stay small."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):
        pass


def of_batches(work: Callable) -> Callable:
    """``work`` over a partition's batches, which settles at the end."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from work(batches)
        finally:
            settle()

    return run


def of_group(work: Callable) -> Callable:
    """``work`` on a group's table, which settles after each."""

    def run(table: pa.Table) -> pa.Table:
        try:
            return work(table)
        finally:
            settle()

    return run


def of_cogroup(work: Callable) -> Callable:
    """``work`` on two groups' tables, which settles after each."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        try:
            return work(left, right)
        finally:
            settle()

    return run
