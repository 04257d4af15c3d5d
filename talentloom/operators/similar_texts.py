"""Texts that nearly repeat stored ones of the same owner."""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator
from difflib import SequenceMatcher
from functools import lru_cache, reduce

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from talentloom.functions.text import comparable

THRESHOLD = 0.70
#: Bytes of new texts that are broadcast at once, and how many; more are compared block by block.
BLOCK_BYTES, BLOCK_TEXTS = 16 << 20, 8192
#: Pairs after which a task hands on what it has found.
PAIRS = 50_000
#: Letters of texts, and pairs whose lengths fit, that are looked at together; pairs whose runs of letters are.
LETTERS, FITTING, COUNTING = 1 << 18, 1 << 20, 1 << 10
#: From this length on the matcher looks for matches by those of the second text's letters alone that make up a hundredth of it at most (``autojunk``).
LONG = 200
#: Short texts of about the same length are looked at together.
NEARLY = 8
#: How far a match reaches beyond a rare letter before it is looked up.
REACHES = 6, 9
#: Letters of a new text up to this share, and some more, are looked up; the second text's rare ones are up to a hundredth and one.
SHARE, MORE = 0.04, 3
#: A byte's number: letters of either case by themselves, all else together; START stands before each text.
OTHER, START = 27, 28
LETTER = np.full(256, OTHER, np.uint8)
LETTER[0x61:0x7B] = LETTER[0x41:0x5B] = np.arange(1, 27)
#: Lengths of the letter runs that are counted, and counters for them. A longer text's counts might not fit 16 bits.
RUNS, COUNTED = {2: 784, 5: 4096}, 65_535
#: Bits of a stretch's hash by which it is told first whether the index may have it.
SEEN = np.uint64(25)
#: Letters that a match is extended by at once.
STEP = 32
RANK = np.uint64((1 << 24) - 1)


def longest(matcher: SequenceMatcher, places: list[int], joined: list[int], twos: dict[str, list[int]], a: int, a_end: int, b: int, b_end: int) -> tuple[int, int, int]:
    """What the matcher's ``find_longest_match`` finds without junk: the first text's ``places`` have letters that the matcher looks for, the ``joined`` ones start two of them that are among the second text's ``twos``."""
    one, two = matcher.a, matcher.b
    i, j, n, last = a, b, 0, a
    before: dict[int, int] = {}
    for at in joined[bisect_left(joined, a) : bisect_left(joined, a_end - 1)]:
        before = before if last == at - 1 else {}
        held, now, last = twos[one[at : at + 2]], {}, at
        for other in held[bisect_left(held, b) : bisect_left(held, b_end - 1)]:
            size = now[other] = before.get(other - 1, 1) + 1
            if size > n:
                i, j, n = at - size + 2, other - size + 2, size
        before = now
    for k in () if n else range(bisect_left(places, a), bisect_left(places, a_end)):
        held = matcher.b2j[one[places[k]]]
        other = bisect_left(held, b)
        if other < len(held) and held[other] < b_end:
            i, j, n = places[k], held[other], 1
            break
    while i > a and j > b and one[i - 1] == two[j - 1]:
        i, j, n = i - 1, j - 1, n + 1
    while i + n + STEP <= a_end and j + n + STEP <= b_end and one[i + n : i + n + STEP] == two[j + n : j + n + STEP]:
        n += STEP
    while i + n < a_end and j + n < b_end and one[i + n] == two[j + n]:
        n += 1
    return i, j, n


def reached(matcher: SequenceMatcher, threshold: float) -> float | None:
    """The matcher's ratio; none if it is below the threshold, which is known once what is still open can't reach it."""
    la, lb = len(matcher.a), len(matcher.b)
    if matcher.a == matcher.b:
        return 1.0 if threshold <= 1 else None
    sought = f"[{re.escape(''.join(matcher.b2j))}]" if matcher.b2j else "(?!)"
    twos: dict[str, list[int]] = {}
    for x in re.finditer(f"(?={sought}{sought})", matcher.b):
        twos.setdefault(matcher.b[x.start() : x.start() + 2], []).append(x.start())
    places = [x.start() for x in re.finditer(sought, matcher.a)]
    joined = [x for x in places if matcher.a[x : x + 2] in twos]
    parts, matched, left = [(0, la, 0, lb)], 0, min(la, lb)
    while parts:
        if 2.0 * (matched + left) / (la + lb) < threshold:
            return None
        a, a_end, b, b_end = parts.pop()
        left -= min(a_end - a, b_end - b)
        i, j, n = longest(matcher, places, joined, twos, a, a_end, b, b_end)
        matched += n
        for part in ((a, i, b, j), (i + n, a_end, j + n, b_end)) if n else ():
            if part[0] < part[1] and part[2] < part[3]:
                parts.append(part)
                left += min(part[1] - part[0], part[3] - part[2])
    ratio = 2.0 * matched / (la + lb)
    return ratio if ratio >= threshold else None


def numbered(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The texts' letters behind one another, START before each and at the end; which text each belongs to; each text's length."""
    lengths = np.array([len(t) for t in texts], np.int64)
    codes = LETTER[np.frombuffer("".join(f"\0{t}" for t in [*texts, ""]).encode("latin-1", "replace"), np.uint8)]
    codes[np.append(0, np.cumsum(lengths + 1))] = START
    return codes, np.repeat(np.arange(len(texts) + 1), np.append(lengths + 1, 1)), lengths


def counted(codes: np.ndarray, of: np.ndarray, texts: int) -> np.ndarray:
    """How often each text has each letter, and all else together: two texts match in no more characters than they have letters in common."""
    out = np.bincount(of * (START + 1) + codes, minlength=(texts + 1) * (START + 1)).reshape(-1, START + 1)[:texts].astype(np.int32)
    out[:, START] = 0
    return out


def chosen(letters: np.ndarray, codes: np.ndarray, of: np.ndarray) -> np.ndarray:
    """Places of the letters chosen for each text, and of each START."""
    letters = np.append(letters, np.zeros((1, START + 1), bool), 0)
    letters[:, START] = True
    return np.flatnonzero(letters[of, codes])


def runs(text: str, run: int) -> np.ndarray:
    """How often each run of so many letters occurs, by the counter that it falls to; two texts have no more runs in common than counters."""
    codes = LETTER[np.frombuffer(text.encode("latin-1", "replace"), np.uint8)].astype(np.int64)
    n, counters = len(codes) - run + 1, RUNS[run]
    if n <= 0 or n > COUNTED:
        return np.zeros(counters, np.uint16)
    code = sum(codes[i : i + n] * START ** (run - 1 - i) for i in range(run))
    if START**run > counters:
        code = (code * 2654435761 >> 12) % counters
    return np.bincount(code, minlength=counters).astype(np.uint16)


def stretches(codes: np.ndarray, at: np.ndarray, reach: int, step: int) -> np.ndarray:
    """40 bits of a hash of the letters at the places and of ``reach`` more to the right or, with step -1, the left."""
    out = np.full(len(at), 2 * reach + (step > 0), np.uint64)
    for k in range(reach + 1):
        out = out * np.uint64(START + 1) + codes[at + step * k]
    out *= np.uint64(0x9E3779B97F4A7C15)
    out ^= out >> np.uint64(32)
    out *= np.uint64(0xD6E8FEB86659FD93)
    return out & ~RANK


class Block:
    """New texts as ``comparable`` gives them, equal ones of an owner once, by owner and length; with their letters, runs of letters, and an index of the stretches beside letters that are not frequent."""

    def __init__(self, table: pa.Table):
        self.keys = table.column(1).combine_chunks()
        self.ids = self.keys.to_pylist()
        rows: dict[tuple[str, str], list[int]] = {}
        for row, text in enumerate(zip(table.column(0).to_pylist(), table.column(2).to_pylist())):
            rows.setdefault(text, []).append(row)
        order = sorted(rows, key=lambda x: (x[0], len(x[1])))
        self.rows, self.texts = [rows[x] for x in order], [text for _, text in order]
        self.owners: dict[str, tuple[int, int]] = {}
        for k, (owner, _) in enumerate(order):
            self.owners[owner] = self.owners.get(owner, (k,))[0], k + 1
        self.lengths = np.array([len(t) for t in self.texts], np.int64)
        self.sizes = self.lengths.astype(np.float32)
        self.letters, self.frequent = np.zeros((len(order), START + 1), np.int32), np.zeros((START + 1, len(order)), np.float32)
        keys, first = [np.zeros(0, np.uint64)], 0
        ends = np.cumsum(self.lengths)
        while first < len(order):
            last = max(first + 1, int(np.searchsorted(ends, ends[first] + LETTERS)))
            keys += self.stretches(first, last)
            first = last
        index = np.concatenate(keys)
        keys.clear()
        index.sort()
        self.index = index[np.append(True, index[1:] != index[:-1])] if len(index) else index
        self.runs = {run: np.array([runs(t, run) for t in self.texts]) for run in RUNS}
        seen = np.zeros(1 << int(SEEN), bool)
        seen[self.index >> np.uint64(64) - SEEN] = True
        self.seen = np.packbits(seen, bitorder="little")
        self.bits: dict[tuple[int, int], tuple] = {}

    def stretches(self, first: int, last: int) -> list[np.ndarray]:
        """Fills in the letters of some of the texts; the keys of the index for these: a stretch and the text's place."""
        codes, of, lengths = numbered(self.texts[first:last])
        self.letters[first:last] = counted(codes, of, last - first)
        frequent = self.letters[first:last] > np.floor(SHARE * lengths)[:, None] + MORE
        self.frequent[:, first:last] = frequent.T
        at = chosen(~frequent, codes, of)
        end = np.full(max(REACHES), START, np.uint8)
        codes, of = np.concatenate([end, codes, end]), (of + first).astype(np.uint64)
        right, left = at, at[codes[at + len(end)] != START]
        return [stretches(codes, some + len(end), reach, step) | of[some] for reach in REACHES for step, some in ((1, right), (-1, left))]

    def fitting(self, owner: str, least: int, most: int, threshold: float) -> tuple[int, int]:
        """The owner's texts whose length allows the threshold with one of these lengths."""
        low, high = self.owners.get(owner, (0, 0))
        if threshold > 0:
            own = self.lengths[low:high]
            low, high = low + np.searchsorted(own, np.floor(least * threshold / (2 - threshold)) - 1), low + np.searchsorted(own, np.ceil(most * (2 - threshold) / threshold) + 1, "right")
        return int(low), int(high)

    def candidates(self, owner: str, text: str, threshold: float) -> list[int]:
        """Rows whose text may reach the threshold with a stored one of the owner."""
        return [row for k in self.all_candidates([(owner, text)], threshold)[0] for row in self.rows[k]]

    def all_candidates(self, stored: list[tuple[str, str]], threshold: float) -> list[list[int]]:
        """For each stored text (behind its owner) the new ones, as places in ``texts``, whose lengths and letters allow the threshold; whose matches around rare letters and runs of letters do, if it is long, and whose longest common subsequence, if it is short."""
        out: list[list[int]] = [[] for _ in stored]
        short = [k for k, (_, text) in enumerate(stored) if len(text) < LONG]
        for k in sorted(short, key=lambda k: (stored[k][0], len(stored[k][1]))):
            owner, text = stored[k]
            least = len(text) // NEARLY * NEARLY
            low, high = self.fitting(owner, least, least + NEARLY - 1, threshold)
            if low < high:
                out[k] = self.in_order(text, low, high, threshold)
        some, letters, pairs = [], 0, 0
        for k, (owner, text) in enumerate(stored):
            if len(text) >= LONG:
                low, high = self.fitting(owner, len(text), len(text), threshold)
                if low < high:
                    some.append((k, text, low, high))
                    letters, pairs = letters + len(text), pairs + high - low
            if some and (letters >= LETTERS or pairs >= FITTING or k + 1 == len(stored)):
                for found, new in zip(some, self.around(some, threshold)):
                    out[found[0]] = new
                some, letters, pairs = [], 0, 0
        return out

    def around(self, some: list[tuple[int, str, int, int]], threshold: float) -> list[list[int]]:
        """Of long stored texts, each with the range of new ones, those whose matches around rare letters, letters, and runs of letters allow the threshold.

        Of a long stored text the matcher only finds blocks that hold one of its rare letters, and one without any at both beginnings. So of what lies between two neighbouring rare letters there is matched
        what goes on from the left one, from the right one, or both. Less than r letters go on from one unless the new text holds it with the r letters beside it. What a gap
        has beyond that counts where the new text holds these stretches, or where a letter beside the gap is frequent in the new text, and so not in the index.

        There are no more blocks than rare letters in common and one. A block of m letters has m - 1 runs of two and m - 4 of five; what matches is thus bounded by the runs in common and one or four letters for each block too.
        """
        codes, of, lengths = numbered([text for _, text, _, _ in some])
        own = counted(codes, of, len(some))
        rare = own <= lengths[:, None] // 100 + 1
        at = chosen(rare, codes, of)
        gap, at = np.diff(at) - 1, at[:-1]
        text, letter = of[at], codes[at]
        following = np.append(letter[1:], np.uint8(START))
        low, high = np.array([(low, high) for _, _, low, high in some]).T
        width = high - low
        first = np.append(0, np.cumsum(width))

        inner = following != START  # nothing goes on from the right to the last gap
        least = np.minimum(gap, (1 + inner) * (REACHES[0] - 1))
        base = np.bincount(text, least + (letter != START), len(some))
        beside = np.bincount(text * (START + 1) + letter, gap - least, len(some) * (START + 1)) + np.bincount(text * (START + 1) + following, (gap - least) * (inner & (following != letter)), len(some) * (START + 1))
        beside = beside.reshape(-1, START + 1).astype(np.float32)
        most = np.concatenate([beside[k] @ self.frequent[:, low[k] : high[k]] for k in range(len(some))])

        keys, gains, whose = [], [], []
        for reach, beyond in zip(REACHES, (*REACHES[1:], len(codes))):
            gain = np.minimum(gap, beyond - 1) - np.minimum(gap, reach - 1)
            for step in (1, -1):
                gaps = np.flatnonzero((gap > least) & (gain > 0) & (inner | (step > 0)))
                keys.append(stretches(codes, at[gaps] if step > 0 else at[gaps] + gap[gaps] + 1, reach, step))
                gains.append(gain[gaps])
                whose.append(text[gaps])
        keys, gains, whose = np.concatenate(keys), np.concatenate(gains), np.concatenate(whose)
        bit = keys >> np.uint64(64) - SEEN
        order = np.flatnonzero(self.seen[bit >> np.uint64(3)] >> (bit & np.uint64(7)).astype(np.uint8) & 1)
        order = order[np.argsort(keys[order])]
        keys, gains, whose = keys[order], gains[order], whose[order]
        start = np.searchsorted(self.index, keys | low[whose].astype(np.uint64))
        there = np.flatnonzero(self.index[np.minimum(start, len(self.index) - 1)] & ~RANK == keys)
        keys, gains, whose, start = keys[there], gains[there], whose[there], start[there]
        held = np.searchsorted(self.index, keys | high[whose].astype(np.uint64)) - start
        for part in np.split(np.arange(len(held)), np.flatnonzero(np.diff(np.cumsum(held) // FITTING)) + 1):
            n, ours = held[part], whose[part]
            found = np.repeat(start[part] - np.cumsum(n) + n, n) + np.arange(n.sum())
            place = (self.index[found] & RANK).astype(np.int64) + np.repeat(first[ours] - low[ours], n)
            most += np.bincount(place, np.repeat(gains[part], n), first[-1])

        inside = np.flatnonzero((codes[:-1] != START) & (codes[1:] != START))
        twos = np.bincount(of[inside] * RUNS[2] + codes[inside] * np.int64(START) + codes[inside + 1], minlength=len(some) * RUNS[2]).reshape(-1, RUNS[2]).astype(np.uint16)
        out: list[list[int]] = []
        half = threshold / 2 - 1e-4  # 32 bits of a float are rounded
        for k, (_, text, _, _) in enumerate(some):
            fits = low[k] + np.flatnonzero(most[first[k] : first[k + 1]] - np.float32(half) * self.sizes[low[k] : high[k]] >= half * lengths[k] - base[k])
            out.append([])
            counts = {2: twos[k]}
            for part in np.split(fits, range(COUNTING, len(fits), COUNTING)):
                total = lengths[k] + self.lengths[part]
                both = np.minimum(self.letters[part], own[k])
                blocks = both[:, rare[k]].sum(1) + 1
                enough = 2.0 * both.sum(1) >= threshold * total - 1e-9 * total
                for run in RUNS:
                    part, blocks, total = part[enough], blocks[enough], total[enough]
                    enough = np.ones(len(part), bool)
                    if len(part) and lengths[k] <= COUNTED:
                        if run not in counts:
                            counts[run] = runs(text, run)
                        both = np.minimum(self.runs[run][part], counts[run]).sum(1, dtype=np.uint16) + (run - 1) * blocks  # no more than COUNTED
                        enough = (self.lengths[part] > COUNTED) | (2.0 * both >= threshold * total - 1e-9 * total)
                part = part[enough]
                out[k] += part.tolist()
        return out

    def in_order(self, text: str, low: int, high: int, threshold: float) -> list[int]:
        """Of a range of new texts those whose longest common subsequence with a short stored one allows the threshold; what matches is such a subsequence.

        All are worked out at once, in the bits of one number: one for each letter not matched yet, and an empty one behind each text, which takes what a sum carries over.
        """
        if (low, high) not in self.bits:
            if len(self.bits) >= LONG // NEARLY:
                self.bits.clear()
            codes, _, lengths = numbered(self.texts[low:high])
            bits = lambda x: int.from_bytes(np.packbits(x[1:], bitorder="little").tobytes(), "little")
            self.bits[low, high] = bits(codes != START), [bits(codes == c) for c in range(START)], np.append(0, np.cumsum(lengths + 1))
        every, places, starts = self.bits[low, high]
        rest = every
        for c in LETTER[np.frombuffer(text.encode("latin-1", "replace"), np.uint8)].tolist():
            hit = rest & places[c]
            rest = ((rest + hit) | (rest ^ hit)) & every
        unmatched = np.unpackbits(np.frombuffer(rest.to_bytes(int(starts[-1]) // 8 + 1, "little"), np.uint8), bitorder="little")
        common = self.lengths[low:high] - np.add.reduceat(unmatched, starts[:-1], dtype=np.int64)
        total = self.lengths[low:high] + len(text)
        return (low + np.flatnonzero((total == 0) | (2.0 * common >= threshold * total - 1e-9 * total))).tolist()


@lru_cache(maxsize=1)
def block_of(shared: Broadcast) -> Block:
    """The block of a broadcast table, made once for all tasks that a worker runs on it."""
    return Block(shared.value)


def similar_texts(new: DataFrame, stored: DataFrame, owner: list[str], key: str, text: str, threshold: float = THRESHOLD) -> DataFrame:
    """``key, match, ratio`` for each new text and each stored one of the same owner whose ratio reaches the threshold.

    Without owner columns all are compared with all; a null owner is an owner. Rows without a key or text have no pairs.
    Pairs are compared only if bounds on what can match allow the threshold (``Block.all_candidates``); of texts with hardly anything in common that takes a lookup in an index for what they share. Equal texts are compared once for each task.
    New text first: the ratio is not symmetric. Stored rows are dealt out to tasks by a hash of key and text, so an owner with many is
    spread; new texts are broadcast in blocks of about ``BLOCK_BYTES``.
    """
    whose = F.to_json(F.struct(*owner), {"ignoreNullFields": "false"}) if owner else F.lit("")
    given = lambda df, name, as_: df.select(whose.alias("__owner"), F.col(key).alias(name), comparable(F.col(text)).alias(as_))
    new, stored = (df.filter(F.col(key).isNotNull() & F.col(text).isNotNull()) for df in (new, stored))
    spark = new.sparkSession
    stored = given(stored, "match", "__old").repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), F.xxhash64("match", "__old"))
    held, texts = new.agg(F.sum(F.octet_length(text)), F.count(F.lit(1))).first()  # as they are, which is no less than what is compared
    n = max(1, -(-(held or 0) // BLOCK_BYTES), -(-texts // BLOCK_TEXTS))
    schema = f"`{key}` {new.schema[key].dataType.simpleString()}, match {stored.schema['match'].dataType.simpleString()}, ratio double"

    def compared(table: pa.Table) -> DataFrame:
        shared = spark.sparkContext.broadcast(table)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            block = block_of(shared)
            for batch in batches:
                matches = batch.column(1)
                keys = matches.to_pylist()
                found: list[tuple[int, int, float]] = []

                def pairs() -> pa.RecordBatch:
                    ours, theirs, ratios = zip(*found)
                    out = [block.keys.take(pa.array(ours, pa.int64())), matches.take(pa.array(theirs, pa.int64())), pa.array(ratios, pa.float64())]
                    found.clear()
                    return pa.RecordBatch.from_arrays(out, names=[key, "match", "ratio"])

                olds: dict[tuple[str, str], list[int]] = {}
                for at, old in enumerate(zip(batch.column(0).to_pylist(), batch.column(2).to_pylist())):
                    olds.setdefault(old, []).append(at)
                for ((_, old), rows), some in zip(olds.items(), block.all_candidates(list(olds), threshold)):
                    matcher = SequenceMatcher(None, "", old) if some else None
                    for k in some:
                        matcher.set_seq1(block.texts[k])
                        ratio = reached(matcher, threshold)
                        for row in block.rows[k] if ratio is not None else ():
                            found += [(row, at, ratio) for at in rows if block.ids[row] != keys[at]]
                            if len(found) >= PAIRS:
                                yield pairs()
                if found:
                    yield pairs()

        return stored.mapInArrow(run, schema)

    blocks = (given(new.filter(F.pmod(F.xxhash64(key, text), F.lit(n)) == k), key, "__new").toArrow() for k in range(n))
    return reduce(DataFrame.unionByName, map(compared, blocks))
