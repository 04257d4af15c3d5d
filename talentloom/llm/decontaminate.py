"""Benchmark decontamination with an FM-index over each shard of the training texts."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from talentloom.llm import textbytes
from talentloom.llm.cuts import checked, cut, free

WINDOW = 10
#: Words of a shard, and bytes of its texts, after which it is closed; a longer text is indexed stretch by stretch.
SHARD_WORDS = 250_000
SHARD_BYTES = 16 << 20
#: Words of benchmark items that are searched for at once; more are searched for block by block.
BLOCK_WORDS = 1_000_000
#: Every so many-th suffix position is kept.
SAMPLE = 8


class Wavelet:
    """A wavelet matrix over codes: ``rank(code, i)`` counts a code among the first i entries, for whole arrays at once."""

    def __init__(self, codes: np.ndarray, levels: int):
        self.ones, self.zeros, self.levels = [], [], levels
        for b in reversed(range(levels)):
            bit = (codes >> b & 1).astype(bool)
            ones = np.zeros(len(codes) + 1, np.int32)
            np.cumsum(bit, out=ones[1:])
            self.ones.append(ones)
            self.zeros.append(len(codes) - int(ones[-1]))
            codes = np.concatenate([codes[~bit], codes[bit]])

    def rank(self, code: np.ndarray, at: np.ndarray) -> np.ndarray:
        low, high = np.zeros_like(at), at
        for k, (ones, zeros) in enumerate(zip(self.ones, self.zeros)):
            bit = (code >> (self.levels - 1 - k) & 1).astype(bool)
            l1, h1 = ones[low], ones[high]
            low, high = np.where(bit, zeros + l1, low - l1), np.where(bit, zeros + h1, high - h1)
        return high - low

    def get(self, at: np.ndarray) -> np.ndarray:
        code = np.zeros_like(at)
        for ones, zeros in zip(self.ones, self.zeros):
            bit = ones[at + 1] - ones[at]
            code = code * 2 + bit
            at = np.where(bit == 1, zeros + ones[at], at - ones[at])
        return code


def suffix_order(codes: np.ndarray) -> np.ndarray:
    """Start positions of all suffixes in their order, by prefix doubling over those that are still tied. The last code is smaller than all others and unique."""
    n, width = len(codes), 1
    order = np.argsort(codes, kind="stable")
    rank, key, open_ = np.empty(n, np.int64), codes[order], np.arange(n)
    while True:
        first = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
        size = np.diff(np.append(first, len(open_)))
        rank[order[open_]] = np.repeat(open_[first], size)
        open_ = open_[np.repeat(size > 1, size)]
        if not len(open_):
            return order
        tied = order[open_]
        key = rank[tied] * n + rank[tied + width]
        by_key = np.argsort(key, kind="stable")
        order[open_], key = tied[by_key], key[by_key]
        width *= 2


class FMIndex:
    """Backward search over a text of codes (2 and up; 1 parts runs), with sampled suffix positions."""

    def __init__(self, codes: np.ndarray, sigma: int):
        text = np.append(codes, 0).astype(np.int32)
        order = suffix_order(text)
        self.bwt = Wavelet(text[order - 1], max(1, int(sigma).bit_length()))
        self.before = np.concatenate(([0], np.cumsum(np.bincount(text, minlength=sigma + 1)))).astype(np.int32)
        kept = order % SAMPLE == 0
        self.kept = np.concatenate(([0], np.cumsum(kept))).astype(np.int32)
        self.positions = order[kept].astype(np.int64)
        self.n = len(text)

    def search(self, patterns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The range of suffixes that begin with each pattern (rows of equal length); empty ranges drop out early."""
        low, high = np.zeros(len(patterns), np.int32), np.full(len(patterns), self.n, np.int32)
        live = np.arange(len(patterns))
        for k in reversed(range(patterns.shape[1])):
            c = patterns[live, k]
            low[live] = self.before[c] + self.bwt.rank(c, low[live])
            high[live] = self.before[c] + self.bwt.rank(c, high[live])
            live = live[low[live] < high[live]]
        high = np.maximum(low, high)
        return low, high

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions of rows of the suffix order: steps back to a sampled position, and counts them."""
        out, steps = np.zeros(len(rows), np.int64), np.zeros(len(rows), np.int64)
        live, at = np.arange(len(rows)), rows.astype(np.int32)
        while len(live):
            found = self.kept[at + 1] > self.kept[at]
            out[live[found]] = self.positions[self.kept[at[found]]] + steps[live[found]]
            live, at = live[~found], at[~found]
            steps[live] += 1
            c = self.bwt.get(at)
            at = self.before[c] + self.bwt.rank(c, at)
        return out


def _ranges(low: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The numbers low, low + 1, ... of each range, one range after the other."""
    return np.repeat(low - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))


class Phrases:
    """The distinct windows of benchmark items, as places in the items' words, with the items that have them."""

    def __init__(self, items: list[tuple[str, str]], window: int = WINDOW):
        raw, at = textbytes.buffers(pa.array([x[1] for x in items], pa.string()))
        starts, ends, first = textbytes.words(raw, at, textbytes.ALNUM)
        self.names, self.window = [x[0] for x in items], window
        self.raw, self.starts, self.ends = textbytes.LOWER[raw], starts, ends
        self.hashes = textbytes.word_hashes(raw, starts, ends)
        self.words, self.place = np.unique(self.hashes, return_index=True)
        codes, n_words = np.searchsorted(self.words, self.hashes).astype(np.int32), np.diff(first)
        #: length -> first words of the distinct windows, and for each window where its items begin in the list that follows
        self.by_length: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
        for n in np.unique(np.minimum(n_words[n_words > 0], window)).tolist():
            chosen = np.flatnonzero(np.minimum(n_words, window) == n)
            n_windows = n_words[chosen] - n + 1
            place, item = _ranges(first[chosen], n_windows), np.repeat(chosen, n_windows)
            rows = np.ascontiguousarray(codes[place[:, None] + np.arange(n)]).view(f"V{4 * n}").ravel()
            _, kept, which = np.unique(rows, return_index=True, return_inverse=True)
            pairs = np.unique(which.astype(np.int64) * len(items) + item)
            self.by_length[n] = place[kept], np.searchsorted(pairs // len(items), np.arange(len(kept) + 1)), pairs % len(items)


class Shard:
    """Texts of one shard: their batches and all their words."""

    def __init__(self, phrases: Phrases):
        self.phrases = phrases
        self.parts: list[pa.RecordBatch] = []
        self.raws: list[np.ndarray] = []
        self.hashes: list[np.ndarray] = []
        self.where: list[np.ndarray] = []  # document, word number, first byte and end within the text, first byte within the part, part
        self.counts: list[np.ndarray] = []
        self.docs = self.words = self.bytes = 0

    def add(self, part: pa.RecordBatch, column: str) -> None:
        raw, at = textbytes.buffers(part.column(column))
        starts, ends, first = textbytes.words(raw, at, textbytes.ALNUM)
        n = np.diff(first)
        doc = np.repeat(np.arange(len(n)), n)
        self.hashes.append(textbytes.word_hashes(raw, starts, ends))
        self.where.append(np.stack([doc + self.docs, np.arange(len(doc)) - first[doc], starts - at[doc], ends - at[doc], starts, np.full(len(doc), len(self.parts))]))
        self.raws.append(raw)
        self.parts.append(part)
        self.counts.append(n)
        self.docs += len(n)
        self.words += len(doc)
        self.bytes += len(raw)

    def _same(self, at: np.ndarray, codes: np.ndarray) -> np.ndarray:
        """Whether the words at these numbers are, byte for byte, the items' words of these codes."""
        same, size = np.zeros(len(at), bool), self.located[3, at] - self.located[2, at]
        theirs = self.phrases.place[codes]
        start = self.phrases.starts[theirs]
        size_fits = self.phrases.ends[theirs] - start == size
        for k, raw in enumerate(self.raws):
            own = np.flatnonzero((self.located[5, at] == k) & size_fits)
            n = size[own]
            if len(own):
                equal = textbytes.LOWER[raw[_ranges(self.located[4, at[own]], n)]] == self.phrases.raw[_ranges(start[own], n)]
                same[own] = np.logical_and.reduceat(equal, np.cumsum(n) - n)
        return same

    def _occurrences(self) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """Length of some windows, which of them occur, and the number of the first word of each occurrence.

        The index holds all words of the shard, texts parted by a mark, and knows nothing of the items. The items' words are looked up in the shard's
        vocabulary; windows with a word that it lacks can't occur.
        """
        hashes, doc = np.concatenate(self.hashes), self.located[0]
        step = len(hashes) if len(hashes) <= 2 * SHARD_WORDS else SHARD_WORDS
        for low in range(0, len(hashes), max(1, step)):
            part = slice(low, low + step + self.phrases.window - 1)
            vocabulary, codes = np.unique(hashes[part], return_inverse=True)
            apart = np.concatenate(([0], np.cumsum(doc[part][1:] != doc[part][:-1])))
            text = np.ones(len(codes) + int(apart[-1]), np.int64)
            text[np.arange(len(codes)) + apart] = codes + 2
            at = np.minimum(np.searchsorted(vocabulary, self.phrases.hashes), len(vocabulary) - 1)
            known = vocabulary[at] == self.phrases.hashes
            absent = np.concatenate(([0], np.cumsum(~known)))
            if not known.any():
                continue
            index = FMIndex(text, len(vocabulary) + 1)
            number = np.cumsum(text > 1) - 1
            for n, (place, _, _) in self.phrases.by_length.items():
                some = np.flatnonzero(absent[place + n] == absent[place])
                first, end = index.search((at[place[some][:, None] + np.arange(n)] + 2).astype(np.int32))
                times = (end - first).astype(np.int64)
                found = number[index.locate(_ranges(first.astype(np.int64), times))] + low
                yield n, np.repeat(some, times), found

    def found(self) -> tuple[np.ndarray, list[list[str]]]:
        """The spans of hit words (document, first word, word after the last, first byte, end), and the items of each document."""
        items: list[set[str]] = [set() for _ in range(self.docs)]
        self.located = np.concatenate(self.where, axis=1) if self.where else np.zeros((6, 0), np.int64)
        cover = np.zeros(self.located.shape[1] + 1, np.int64)
        for n, which, at in self._occurrences() if self.located.shape[1] and self.phrases.by_length else ():
            # bytes decide
            place, first, owners = self.phrases.by_length[n]
            words = np.unique(np.stack([(at[:, None] + np.arange(n)).ravel(), np.searchsorted(self.phrases.words, self.phrases.hashes[(place[which][:, None] + np.arange(n)).ravel()])]), axis=1)
            wrong = words[0, ~self._same(words[0], words[1])]
            if len(wrong):
                kept = np.searchsorted(wrong, at) == np.searchsorted(wrong, at + n)
                which, at = which[kept], at[kept]
            np.add.at(cover, at, 1)
            np.add.at(cover, at + n, -1)
            pairs = np.unique(self.located[0, at] * len(place) + which)
            for d, k in zip((pairs // len(place)).tolist(), (pairs % len(place)).tolist()):
                items[d].update(self.phrases.names[i] for i in owners[first[k] : first[k + 1]])
        hit = self.located[:, np.cumsum(cover[:-1]) > 0].T
        new = np.flatnonzero(np.concatenate(([True], (hit[1:, 0] != hit[:-1, 0]) | (hit[1:, 1] != hit[:-1, 1] + 1)))) if len(hit) else np.zeros(0, np.int64)
        last = np.append(new[1:], len(hit)) - 1
        spans = np.column_stack([hit[new, 0], hit[new, 1], hit[last, 1] + 1, hit[new, 2], hit[last, 3]]) if len(hit) else np.zeros((0, 5), np.int64)
        return spans, [sorted(x) for x in items]


def _searched(batches: Iterator[pa.RecordBatch], phrases: Phrases, column: str) -> Iterator[tuple[Shard, tuple]]:
    shard = Shard(phrases)
    for batch in batches:
        for part in textbytes.slices(batch, column):
            shard.add(part, column)
            if shard.words >= SHARD_WORDS or shard.bytes >= SHARD_BYTES:
                yield shard, shard.found()
                shard = Shard(phrases)
    if shard.docs:
        yield shard, shard.found()


def _blocks(benchmark: DataFrame, id_col: str, text_col: str, window: int) -> tuple[int, Iterator[Phrases]]:
    """The items' phrases in blocks of about ``BLOCK_WORDS`` words, and how many; the driver makes one block at a time, when it is asked for."""
    items = benchmark.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("item"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = max(1, -(-size // (6 * BLOCK_WORDS)))
    return n, (Phrases([tuple(x) for x in items.filter(F.pmod(F.xxhash64("item", "text"), F.lit(n)) == k).collect()], window) for k in range(n))


SPANS = "array<struct<first:bigint,last:bigint,start:bigint,end:bigint>>"
_SPANS = pa.list_(pa.struct([(x, pa.int64()) for x in ("first", "last", "start", "end")]))


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_words, spans, items, n_hit``: the words of every text that lie in an occurrence of a benchmark window.

    Words are runs of digits, letters and characters beyond ASCII, A-Z lower-cased. Windows are ``window`` consecutive
    words of an item, all its words where it has fewer. Each task closes shards of bounded size and builds an FM-index
    over all words of a shard, whatever the items are; windows are searched backwards, their occurrences located by sampled suffix positions
    and compared byte for byte. ``spans`` are the merged runs of hit words: numbers of the first word and of the one after the last, and their
    byte range. ``items`` are item ids, sorted as strings. Nothing is shuffled: the distinct windows of up to ``BLOCK_WORDS`` words are
    broadcast. A larger benchmark is searched for block by block, each in the texts as they are and released afterwards; rows with hits are then merged.

    Null and empty texts have no words. A text longer than a shard is indexed in stretches that overlap by a window. Items without words have no
    windows; a null item id is the empty string; repeated items count once. Ids may be null or repeat: one row for each input
    row. No documents give no rows, no items no spans. Other columns are left out.
    """
    texts = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    n, blocks = _blocks(benchmark, "item_id", "text", window)
    if n > 1:
        texts = cut(texts.withColumn("row", F.monotonically_increasing_id()))
    return _spans(texts, blocks).drop("row").withColumn("n_hit", F.aggregate("spans", F.lit(0).cast("long"), lambda a, x: a + x["last"] - x["first"]))


def _spans(texts: DataFrame, blocks: Iterator[Phrases]) -> DataFrame:
    """``contamination``'s columns but ``n_hit``, for each row of ``doc_id, row, text``; ``row`` tells rows apart and may be missing where there is one block. Each block is searched for in the texts as they are."""
    names = [x for x in texts.columns if x != "text"]
    schema = ", ".join([*(f"{x} {texts.schema[x].dataType.simpleString()}" for x in names), f"n_words long, spans {SPANS}, items array<string>"])

    def searched(shared: Broadcast) -> DataFrame:

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for shard, (spans, items) in _searched(batches, shared.value, "text"):
                lists: list[list] = [[] for _ in range(shard.docs)]
                for d, a, b, x, y in spans.tolist():
                    lists[d].append({"first": a, "last": b, "start": x, "end": y})
                n_words, low = np.concatenate(shard.counts), 0
                for part in shard.parts:
                    own = slice(low, low + part.num_rows)
                    low = own.stop
                    yield pa.RecordBatch.from_arrays([*(part.column(x) for x in names), pa.array(n_words[own], pa.int64()), pa.array(lists[own], _SPANS), pa.array(items[own], pa.list_(pa.string()))], names=[*names, "n_words", "spans", "items"])

        return texts.mapInArrow(textbytes.of_batches(run), schema)

    first, rest = searched(texts.sparkSession.sparkContext.broadcast(next(blocks))), []
    for phrases in blocks:
        shared = texts.sparkSession.sparkContext.broadcast(phrases)
        rest.append(cut(searched(shared).filter(F.size("spans") > 0).select("row", "spans", "items")))
        shared.destroy()
    if not rest:
        return first
    first = cut(first)
    found = reduce(DataFrame.unionByName, [first.filter(F.size("spans") > 0).select("row", "spans", "items"), *rest])
    found = found.groupBy("row").agg(F.array_sort(F.flatten(F.collect_list("spans"))).alias("spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))
    joined = lambda a, x: F.struct(F.element_at(a, -1)["first"].alias("first"), F.greatest(F.element_at(a, -1)["last"], x["last"]).alias("last"), F.element_at(a, -1)["start"].alias("start"), F.greatest(F.element_at(a, -1)["end"], x["end"]).alias("end"))
    touches = lambda a, x: (F.size(a) > 0) & (F.element_at(a, -1)["last"] >= x["first"])
    merged = F.aggregate("spans", F.array().cast(SPANS), lambda a, x: F.when(touches(a, x), F.array_append(F.slice(a, 1, F.size(a) - 1), joined(a, x))).otherwise(F.array_append(a, x)))
    found = cut(found.select("row", merged.alias("all_spans"), F.col("items").alias("all_items")))
    none = F.array()
    return first.join(checked(found), "row", "left").select(*names, "n_words", F.coalesce("all_spans", none.cast(SPANS)).alias("spans"), F.coalesce("all_items", none.cast("array<string>")).alias("items"))


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, text_col: str = "text") -> DataFrame:
    """The documents, columns as they are, without the byte ranges of ``contamination``'s spans in their texts; clean texts stay untouched.

    A benchmark of several blocks is searched for in the texts as they come in; the merged ranges of all blocks are cut
    out at once. The documents are written once for that, so that their rows keep their numbers.
    """
    n, blocks = _blocks(benchmark, "item_id", "text", window)
    if n == 1:
        return _without(docs, next(blocks), text_col)
    row, spans = (free(x, docs.columns) for x in ("row", "spans"))
    numbered = cut(docs.withColumn(row, F.monotonically_increasing_id()))
    texts = numbered.select(F.lit(0).cast("long").alias("doc_id"), F.col(row).alias("row"), F.col(text_col).alias("text"))
    found = cut(_spans(texts, blocks).filter(F.size("spans") > 0).select(F.col("row").alias(row), F.col("spans").alias(spans)))
    joined = numbered.join(checked(found), row, "left").select(*docs.columns, spans)
    place, schema = docs.columns.index(text_col), docs.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ranges = {d: [(x["start"], x["end"]) for x in own] for d, own in enumerate(batch.column(batch.num_columns - 1).to_pylist()) if own}
            rest = batch.select(range(batch.num_columns - 1))
            yield rest.set_column(place, rest.schema.field(place), _cut_out(rest.column(place), ranges))

    return joined.mapInArrow(textbytes.of_batches(run), schema)


def _cut_out(column: pa.Array, ranges: dict[int, list[tuple[int, int]]]) -> pa.Array:
    """The texts without byte ranges, by the text's place."""
    texts = column.to_pylist()
    for d, own in ranges.items():
        raw, kept, at = texts[d].encode(), [], 0
        for x, y in own:
            kept.append(raw[at:x])
            at = y
        texts[d] = b"".join([*kept, raw[at:]]).decode()
    return pa.array(texts, column.type)


def _without(docs: DataFrame, phrases: Phrases, text_col: str) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(phrases)
    place = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for shard, (spans, _) in _searched(batches, shared.value, text_col):
            ranges: dict[int, list] = {}
            for d, _, _, x, y in spans.tolist():
                ranges.setdefault(d, []).append((x, y))
            low = 0
            for part in shard.parts:
                own = {d - low: ranges[d] for d in range(low, low + part.num_rows) if d in ranges}
                low += part.num_rows
                yield part.set_column(place, part.schema.field(place), _cut_out(part.column(place), own))

    return docs.mapInArrow(textbytes.of_batches(run), docs.schema)


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, benchmark = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "benchmark"))
    found = contamination(docs, benchmark)
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))
