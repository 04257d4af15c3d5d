"""Packing token sequences into fixed windows by minimum bin slack."""

from __future__ import annotations

from bisect import bisect_right, insort
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from talentloom.llm import textbytes, wordbpe

#: Pieces, and bytes of their ids, that a task holds before it fills windows from them.
POOL_PIECES = 8192
POOL_BYTES = 48 << 20
#: Pieces kept back as fillers while more are to come.
RESERVE = 2048
#: Tokens of padding that are worth a cut through a document.
WORTH_A_CUT = 16


def fullest(counts: dict[int, int], lengths: list[int], capacity: int) -> dict[int, int]:
    """The multiset of remaining lengths that holds the largest one and comes closest to ``capacity``: length -> how many.

    ``lengths``: the keys of ``counts``, ascending. Bit s of ``reach`` says that some multiset sums to s; counts are
    split into powers of two, so each length takes a logarithm of its count in shifts. The states before each shift are kept and
    walked back from the best sum.
    """
    first = lengths[-1]
    slack = capacity - first
    reach, limit, goal = 1, (1 << (slack + 1)) - 1, 1 << slack
    steps: list[tuple[int, int, int]] = []
    i = bisect_right(lengths, slack) - 1
    while i >= 0 and not reach & goal:
        n = lengths[i]
        left = min(counts[n] - (n == first), slack // n)
        take = 1
        while left > 0 and not reach & goal:
            take = min(take, left)
            steps.append((reach, n, take))
            reach |= (reach << (take * n)) & limit
            left -= take
            take *= 2
        i -= 1
    used = {first: 1}
    at = reach.bit_length() - 1
    for before, n, take in reversed(steps):
        if not before >> at & 1:
            used[n] = used.get(n, 0) + take
            at -= take * n
    return used


def windows(pool: dict[int, list], capacity: int, cut: Callable, reserve: int = 0) -> Iterator[list]:
    """Takes pieces out of ``pool`` (length -> pieces) until ``reserve`` of them are left, and yields the pieces of one window after the other.

    Where the best multiset still misses ``WORTH_A_CUT`` tokens or more, every piece left is longer than that: the
    shortest one is cut (``cut(piece, n)`` gives its first n tokens and the rest) and fills the window.
    """
    counts = {n: len(x) for n, x in pool.items() if x}
    lengths = sorted(counts)
    left = sum(counts.values())

    def take(n: int, k: int) -> list:
        nonlocal left
        counts[n] -= k
        left -= k
        out = [pool[n].pop() for _ in range(k)]
        if not counts[n]:
            del counts[n], pool[n]
            lengths.pop(bisect_right(lengths, n) - 1)
        return out

    while left > reserve:
        used = fullest(counts, lengths, capacity)
        slack = capacity - sum(n * k for n, k in used.items())
        for _ in range(1 if slack >= WORTH_A_CUT else min(counts[n] // k for n, k in used.items())):
            window = [x for n, k in used.items() for x in take(n, k)]
            if slack >= WORTH_A_CUT and lengths:
                shortest = lengths[0]
                head, tail = cut(take(shortest, 1)[0], slack)
                window.append(head)
                rest = shortest - slack
                if rest not in counts:
                    insort(lengths, rest)
                counts[rest] = counts.get(rest, 0) + 1
                pool.setdefault(rest, []).append(tail)
                left += 1
            yield window


def tail_cuts(total: int, capacity: int) -> list[int]:
    """Lengths of the sequences that hold an underfull last window: itself where little is missing, else powers of two, which need no padding."""
    if capacity - total <= capacity // 16:
        return [total]
    return [1 << b for b in reversed(range(total.bit_length())) if total >> b & 1]


def pack(docs: DataFrame, tokenizer: str, capacity: int = 4096, eos: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Packs all texts into sequences of at most ``capacity`` tokens: ``doc_id, start, length, ids, doc_tokens, sequence_id, offset``, a row for each piece.

    A text's ids end with ``eos``. Full windows of a long text are sequences of their own; what remains of each text
    joins a pool of bounded size, from which minimum bin slack fills window after window; where that leaves 16 tokens
    or more, a cut piece fills the window. Pools live within one task, so nothing is shuffled and a lost task is repeated
    with the same result. Only a task's last window can miss more; where that is over a 16th, it is dealt out to
    sequences whose lengths are powers of two. ``ids`` are packed little-endian unsigned 32-bit integers.
    ``sequence_id`` names partition and window.

    A null or empty text is the single token ``eos``. Ids may be null or repeat; every input row is packed once.
    An empty table gives no rows. Columns other than the two named are left out.
    """
    whole = docs.sparkSession.sparkContext.broadcast(wordbpe.whole_tokens(tokenizer))
    texts = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    kind = texts.schema["doc_id"].dataType.simpleString()
    names = ["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"]
    end = eos.to_bytes(4, "little")

    def halves(piece: tuple, n: int) -> tuple[tuple, tuple]:
        doc, start, ids, total = piece
        return (doc, start, ids[: 4 * n], total), (doc, start + n, ids[4 * n :], total)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = wordbpe.encoder(tokenizer, whole.value)
        number = TaskContext.get().partitionId() << 40
        pool: dict[int, list] = {}
        pieces = held = 0
        rows: list[tuple] = []
        of = pa.int64()

        def place(window: list) -> None:
            nonlocal number, held
            at = 0
            for doc, start, ids, total in window:
                rows.append((doc, start, len(ids) // 4, ids, total, number, at))
                at += len(ids) // 4
                held -= len(ids)
            number += 1

        def last(window: list) -> None:
            """Deals the pieces of an underfull window out to sequences of the lengths that ``tail_cuts`` gives."""
            for room in tail_cuts(sum(len(x[2]) // 4 for x in window), capacity):
                part = []
                while room:
                    head, tail = halves(window.pop(), room)
                    part.append(head)
                    room -= len(head[2]) // 4
                    if tail[2]:
                        window.append(tail)
                place(part)

        def out() -> pa.RecordBatch:
            kinds = [of, pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64()]
            made = pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows), kinds)], names=names)
            rows.clear()
            return made

        for batch in batches:
            of = batch.schema.field("doc_id").type
            for part in textbytes.slices(batch, "text"):
                for doc, text in zip(part.column("doc_id").to_pylist(), part.column("text").to_pylist()):
                    ids = enc.encode(text) + end
                    total = len(ids) // 4
                    held += len(ids)
                    for start in range(0, total - capacity + 1, capacity):
                        place([(doc, start, ids[4 * start : 4 * (start + capacity)], total)])
                    if rest := total % capacity:
                        pool.setdefault(rest, []).append((doc, total - rest, ids[4 * (total - rest) :], total))
                        pieces += 1
                if pieces >= POOL_PIECES or held >= POOL_BYTES:
                    pieces = min(RESERVE, pieces // 4)
                    for window in windows(pool, capacity, halves, pieces):
                        place(window)
                if len(rows) >= 1000:
                    yield out()
            if rows:
                yield out()
        for window in windows(pool, capacity, halves):
            if sum(len(x[2]) // 4 for x in window) < capacity:
                last(window)
            else:
                place(window)
            if len(rows) >= 1000:
                yield out()
        if rows:
            yield out()
        enc.forget()

    return texts.mapInArrow(textbytes.of_batches(run), f"doc_id {kind}, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long")


def digest(pieces: DataFrame) -> DataFrame:
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return digest(pack(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("word_bpe_49k.json")))
