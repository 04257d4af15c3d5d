"""Removal of repeated byte strings by prefix-free parsing.

Trigger strings, chosen by a rolling hash, cut every text into phrases. A string of LENGTH bytes starts in one phrase and runs over its trigger into what
follows, so it is a suffix of a dictionary phrase and a prefix of what the parse has next. Shards first exchange keys of phrases with their surroundings:
what is the same throughout is settled by the smallest document that has it, wherever it lies. Only phrases whose trigger also occurs with other
surroundings travel as bytes, once each: the suffix array of their dictionary and that of their parse
combine into the corpus order, in which equal strings are neighbours. Texts themselves never leave their shard.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from talentloom.llm import textbytes
from talentloom.llm.cuts import BROADCAST_ROWS, checked, cut
from talentloom.llm.phrases import FIXED, LENGTH, SIDE, TRIGGER, drawn, padded_rows, parse, phrase_keys, single, string_minima
from talentloom.llm.shards import LAST_ID, batch_of, buckets, ids_of, member, of_planes, packed, planes, runs, scaled, sharded, text_bytes, unpacked

#: Bytes of text that are parsed at once: what that takes fits a processor's cache.
SLICE = 1 << 16
#: Bytes of a text that are parsed at once; the strings that start behind them are parsed with the bytes that follow.
STRETCH = 2 << 20
#: Bytes of keys that one bucket's task sees, about, for a corpus of up to a GB.
BUCKET_BYTES = 10 << 20
#: A trigger that occurs so often in one of so many parts of the documents is hot: its strings are dealt out one by one.
HOT, PARTS = 200, 1024

_BINARY = pa.binary()


def _table(rows: list[tuple], **kinds: pa.DataType) -> pa.Table:
    columns = zip(*rows) if rows else [()] * len(kinds)
    return pa.Table.from_arrays([pa.array(x, t) for x, t in zip(columns, kinds.values())], names=list(kinds))


def _joined(table: pa.Table, column: str) -> list[bytes]:
    return [x for x in table.column(column).to_pylist() if x]


def _keys(table: pa.Table, column: str, width: int = 8) -> np.ndarray:
    return unpacked(b"".join(_joined(table, column)), width)


def _ids(table: pa.Table, column: str) -> np.ndarray:
    return np.concatenate([np.zeros(0, np.int64), *map(of_planes, _joined(table, column))])


def alike(keys: np.ndarray, triggers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An order in which rows with the same key and trigger follow each other, and where each such group starts."""
    order = np.argsort(keys, kind="stable")
    same, other = keys[order][1:] == keys[order][:-1], triggers[order][1:] != triggers[order][:-1]
    if (same & other).any():  # keys collide
        order = np.lexsort((triggers, keys))
        same, other = keys[order][1:] == keys[order][:-1], triggers[order][1:] != triggers[order][:-1]
    return order, np.flatnonzero(np.concatenate(([True], ~same | other)))[: len(keys)]


def _by_bucket(triggers: np.ndarray, n: int) -> Iterator[tuple[int, slice]]:
    """Ranges of sorted triggers that fall into one bucket."""
    b = buckets(triggers, n)
    starts = runs(b)
    for a, z in zip(starts, np.append(starts[1:], len(b))):
        yield int(b[a]), slice(a, z)


def _hot(texts: DataFrame, least: int, parts: int, secret: tuple) -> np.ndarray:
    """Triggers that occur ``least`` times or more in one of ``parts`` parts of the documents, at most ``cuts.BROADCAST_ROWS``: which ones only decides how their strings travel."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in textbytes.slices(batch, "text", SLICE):
                keys, n = np.unique(parse(*textbytes.buffers(part.column("text")), secret)[1] >> np.uint64(16), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(keys.astype(np.int64)), pa.array(n)], names=["key", "n"])

    some = texts.filter(F.pmod(F.xxhash64("doc_id", "text"), F.lit(parts)) == 0).select("text")
    counts = some.mapInArrow(textbytes.of_batches(count), "key long, n long").groupBy("key").agg(F.sum("n").alias("n")).filter(F.col("n") >= least)
    return np.sort(np.array([x.key for x in counts.orderBy(F.desc("n"), "key").limit(BROADCAST_ROWS).collect()], np.uint64))


def occurrences(batch: pa.RecordBatch, hot: np.ndarray, secrets: tuple = (FIXED, FIXED)) -> Iterator[tuple]:
    """Slices of the shard's texts: bytes, the number of their first byte, and of every trigger its document, place, key, first and last start, and the key of all that its strings cover.

    The strings of a hot trigger stand one by one, each with a second key of its own for a trigger.
    """
    text = byte = 0
    for part in textbytes.slices(batch, "text", SLICE):
        whole, every = textbytes.buffers(part.column("text"))
        for begin in range(0, len(whole), STRETCH) if part.num_rows == 1 and len(whole) > STRETCH + LENGTH else (0,):
            end = len(whole) if part.num_rows > 1 or len(whole) <= STRETCH + LENGTH else min(len(whole), begin + STRETCH + LENGTH - 1)
            raw, at = whole[begin:end], every if end - begin == len(whole) else np.array([0, end - begin])
            yield raw, byte + begin, *_of_slice(raw, at, text, hot, *secrets)
        text += part.num_rows
        byte += len(whole)


def _of_slice(raw: np.ndarray, at: np.ndarray, text: int, hot: np.ndarray, secret: tuple, second: tuple) -> tuple:
    places, triggers, low, high = parse(raw, at, secret)
    warm = member(triggers >> np.uint64(16), hot)[0]
    cold = len(warm) - int(warm.sum())
    if cold < len(warm):
        which, start = single(places[warm], low[warm], high[warm])
        places, low, high = (np.concatenate(x) for x in ((places[~warm], places[warm][which]), (low[~warm], start), (high[~warm], start)))
    keys = phrase_keys(raw, places, low, high, secret)
    triggers = np.concatenate([triggers[~warm], phrase_keys(raw, places[cold:], low[cold:], high[cold:], second)])
    return np.searchsorted(at, low, "right") - 1 + text, places, triggers, low, high, keys


def _settled(texts: DataFrame, shared: Broadcast, n: int) -> DataFrame:
    """``shard, keys, firsts, asked``: for a shard the keys that a document of another shard with a smaller id has too, with that id; and the keys of which it shall send the bytes."""

    def gather(table: pa.Table) -> pa.Table:
        batch = batch_of(table)
        ids, shard = ids_of(batch), table.column("shard")[0].as_py()
        found = [(triggers >> np.uint64(16), keys, ids[doc]) for _, _, doc, _, triggers, _, _, keys in occurrences(batch, *shared.value)]
        if not found:
            return _table([], bucket=pa.int32(), shard=pa.int32(), triggers=_BINARY, keys=_BINARY, firsts=_BINARY)
        triggers, keys, first = (np.concatenate(x) for x in zip(*found))
        order = np.argsort(keys, kind="stable")
        start = runs(keys[order])
        first = np.minimum.reduceat(first[order], start) if len(start) else first
        once = order[start]
        by_trigger = np.argsort(triggers[once], kind="stable")
        triggers, keys, first = triggers[once][by_trigger], keys[once][by_trigger], first[by_trigger]
        # within a bucket four bytes tell triggers apart: what differs there and has one key is not the same
        rows = [(b, shard, packed(triggers[s], 4), keys[s].tobytes(), planes(first[s])) for b, s in _by_bucket(triggers, n)]
        return _table(rows, bucket=pa.int32(), shard=pa.int32(), triggers=_BINARY, keys=_BINARY, firsts=_BINARY)

    def meet(table: pa.Table) -> pa.Table:
        triggers, keys, first = _keys(table, "triggers", 4), _keys(table, "keys"), _ids(table, "firsts")
        order, start = alike(keys, triggers)
        entry = np.empty(len(keys), np.int64)
        entry[order] = np.repeat(np.arange(len(start)), np.diff(np.append(start, len(keys))))
        least, trigger = np.minimum.reduceat(first[order], start), triggers[order[start]]
        by_trigger = np.argsort(trigger, kind="stable")
        group = runs(trigger[by_trigger])
        # bytes are asked for where other surroundings of the trigger have another first document
        differ = np.minimum.reduceat(least[by_trigger], group) < np.maximum.reduceat(least[by_trigger], group)
        several = np.empty(len(start), bool)
        several[by_trigger] = np.repeat(differ, np.diff(np.append(group, len(start))))
        rows, end = [], 0
        for shard, own in zip(table.column("shard").to_pylist(), table.column("keys").to_pylist()):
            mine = slice(end, end + len(own) // 8)
            end = mine.stop
            e = entry[mine]
            smaller, asked = least[e] < first[mine], several[e] & (least[e] == first[mine])
            if smaller.any() or asked.any():
                rows.append((shard, keys[mine][smaller].tobytes(), planes(least[e[smaller]]), keys[mine][asked].tobytes()))
        return _table(rows, shard=pa.int32(), keys=_BINARY, firsts=_BINARY, asked=_BINARY)

    sent = texts.groupBy("shard").applyInArrow(textbytes.of_group(gather), "bucket int, shard int, triggers binary, keys binary, firsts binary")
    return sent.groupBy("bucket").applyInArrow(textbytes.of_group(meet), "shard int, keys binary, firsts binary, asked binary")


def _odd(texts: DataFrame, settled: DataFrame, shared: Broadcast, n: int) -> DataFrame:
    """``shard, odd_keys, odd_places, odd_firsts``: single strings, by the key of what they lie in and the bytes before the trigger, that a smaller document has than that of the key."""
    kinds = {"bucket": pa.int32(), "shard": pa.int32()} | dict.fromkeys(("triggers", "keys", "firsts", "phrases", "parse"), _BINARY)

    def gather(table: pa.Table, told: pa.Table) -> pa.Table:
        asked = np.sort(_keys(told, "asked"))
        if not len(asked) or not table.num_rows:
            return _table([], **kinds)
        batch = batch_of(table)
        ids, found = ids_of(batch), []
        for raw, _, doc, places, triggers, low, high, keys in occurrences(batch, *shared.value):
            some = np.flatnonzero(member(keys, asked)[0])
            order = some[np.lexsort((ids[doc[some]], keys[some]))]
            once = order[runs(keys[order])]
            left, right = places[once] - low[once], high[once] + SIDE - places[once]
            phrase = padded_rows(raw[::-1], len(raw) - places[once], left, SIDE)
            following = padded_rows(raw, places[once] + TRIGGER, right, SIDE)
            found.append((triggers[once], keys[once], ids[doc[once]], np.column_stack([phrase, left]).astype(np.uint8), np.column_stack([following, right]).astype(np.uint8)))
        triggers, keys, first, phrase, following = (np.concatenate(x) for x in zip(*found))
        order = np.lexsort((first, keys))
        once = order[runs(keys[order])]
        once = once[np.argsort(triggers[once], kind="stable")]
        rows, shard = [], table.column("shard")[0].as_py()
        for b, s in _by_bucket(triggers[once] >> np.uint64(16), n):
            o = once[s]
            dictionary, number = np.unique(np.ascontiguousarray(phrase[o]).view(f"V{SIDE + 1}").ravel(), return_inverse=True)
            entries = np.column_stack([number.astype("<u4").reshape(-1, 1).view(np.uint8), following[o]])
            rows.append((b, shard, triggers[o].tobytes(), keys[o].tobytes(), planes(first[o]), dictionary.tobytes(), entries.tobytes()))
        return _table(rows, **kinds)

    def meet(table: pa.Table) -> pa.Table:
        triggers, keys, first = _keys(table, "triggers"), _keys(table, "keys"), _ids(table, "firsts")
        parts = [np.frombuffer(x, np.uint8).reshape(-1, SIDE + 5) for x in _joined(table, "parse")]
        sizes = [len(x) // (SIDE + 1) for x in _joined(table, "phrases")]
        number = np.concatenate([np.ascontiguousarray(x[:, :4]).view("<u4").ravel().astype(np.int64) + k for x, k in zip(parts, np.cumsum([0, *sizes]))])
        every = np.frombuffer(b"".join(_joined(table, "phrases")), f"V{SIDE + 1}")
        dictionary, where = np.unique(every, return_inverse=True)
        phrases = dictionary.view(np.uint8).reshape(-1, SIDE + 1)
        number, following = where[number], np.concatenate([x[:, 4:] for x in parts])
        entry, place, least = string_minima(number, phrases[:, :SIDE], phrases[number, SIDE].astype(np.int64), triggers, following[:, :SIDE], following[:, SIDE].astype(np.int64), first)
        rows, end = [], 0
        for shard, own in zip(table.column("shard").to_pylist(), parts):
            a, z = np.searchsorted(entry, [end, end + len(own)])
            end += len(own)
            if a < z:
                rows.append((shard, keys[entry[a:z]].tobytes(), place[a:z].astype(np.uint8).tobytes(), planes(least[a:z])))
        return _table(rows, shard=pa.int32(), odd_keys=_BINARY, odd_places=_BINARY, odd_firsts=_BINARY)

    sent = texts.groupBy("shard").cogroup(settled.groupBy("shard")).applyInArrow(textbytes.of_cogroup(gather), "bucket int, shard int, triggers binary, keys binary, firsts binary, phrases binary, parse binary")
    return sent.groupBy("bucket").applyInArrow(textbytes.of_group(meet), "shard int, odd_keys binary, odd_places binary, odd_firsts binary")


SPANS = "array<struct<start:bigint,end:bigint>>"
_SPANS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))


def _cut_out(texts: DataFrame, told: DataFrame, shared: Broadcast) -> DataFrame:
    """``doc_id, n_bytes, spans, kept`` of every text of the shards."""

    def apply(table: pa.Table, told: pa.Table) -> pa.Table:
        batch = batch_of(table)
        ids, (data, at) = ids_of(batch), textbytes.buffers(batch.column("text"))
        found = [(keys, low + byte, high + byte, places + byte, ids[doc]) for _, byte, doc, places, _, low, high, keys in occurrences(batch, *shared.value)]
        cover = np.zeros(len(data) + 1, np.int32)
        if found:
            keys, low, high, places, own = (np.concatenate(x) for x in zip(*found))
            order = np.argsort(keys, kind="stable")
            start = runs(keys[order])
            known, least = keys[order][start], np.minimum.reduceat(own[order], start) if len(start) else own
            here, where = member(_keys(told, "keys"), known)
            np.minimum.at(least, where[here], _ids(told, "firsts")[here])
            gone = least[member(keys, known)[1]] < own
            np.add.at(cover, low[gone], 1)
            np.add.at(cover, high[gone] + LENGTH, -1)
            odd, place, odd_least = _keys(told, "odd_keys"), np.frombuffer(b"".join(_joined(told, "odd_places")), np.uint8).astype(np.int64), _ids(told, "odd_firsts")
            by_key = np.argsort(odd, kind="stable")
            odd, place, odd_least = odd[by_key], place[by_key], odd_least[by_key]
            a, z = np.searchsorted(odd, keys), np.searchsorted(odd, keys, "right")
            n = z - a
            pick = np.repeat(a - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
            start, gone = np.repeat(places, n) - place[pick], odd_least[pick] < np.repeat(own, n)
            np.add.at(cover, start[gone], 1)
            np.add.at(cover, start[gone] + LENGTH, -1)
        removed = np.cumsum(cover[:-1]) > 0
        edge = np.zeros(len(data) + 1, bool)
        edge[at] = True
        before, after = (np.concatenate(x) for x in (([False], removed[:-1]), (removed[1:], [False])))
        starts, ends = np.flatnonzero(removed & (~before[: len(removed)] | edge[:-1])), np.flatnonzero(removed & (~after[: len(removed)] | edge[1:])) + 1
        low, spans, kept = np.searchsorted(starts, at), [], []
        for i in range(batch.num_rows):
            own = [{"start": a - at[i], "end": z - at[i]} for a, z in zip(starts[low[i] : low[i + 1]].tolist(), ends[low[i] : low[i + 1]].tolist())]
            spans.append(own)
            text = data[at[i] : at[i + 1]]
            kept.append((text[~removed[at[i] : at[i + 1]]] if own else text).tobytes())
        return pa.Table.from_arrays([batch.column("doc_id"), pa.array(np.diff(at)), pa.array(spans, _SPANS), pa.array(kept, pa.binary())], names=["doc_id", "n_bytes", "spans", "kept"])

    kind = texts.schema["doc_id"].dataType.simpleString()
    return texts.groupBy("shard").cogroup(told.groupBy("shard")).applyInArrow(textbytes.of_cogroup(apply), f"doc_id {kind}, n_bytes long, spans {SPANS}, kept binary")


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", hot: int = HOT, parts: int = PARTS) -> DataFrame:
    """Cuts every byte that lies in a string of 50 bytes which also starts in a text with a smaller id: ``doc_id, n_bytes, spans, kept``.

    Texts are UTF-8 bytes; strings never cross texts; all are judged on the input. ``spans`` are the maximal removed runs (start and
    end), ``kept`` the other bytes in order. Equal texts are settled first, by their hash (repeated hashes are broadcast if at most
    ``cuts.BROADCAST_ROWS``). The others are dealt out to shards by their id; shards and buckets grow with the corpus. Two exchanges of packed keys and
    phrases follow, each between shards and ranges of triggers. A shard names each key once, however often it occurs there. The strings of a
    hot trigger (``hot`` times or more in one of ``parts`` parts of the documents) travel by their own keys, one by one.
    Hashes use numbers drawn for each run, so nobody can write texts that collide. Strings count as equal when 64 bits of all that a phrase covers and 48 of its trigger (of the string
    by another hash, where the trigger is hot) agree.

    Ids are integers; a null id comes after all others. Rows with the same id count as one document, so they
    leave each other alone. Null texts are empty. Texts under 50 bytes stay whole; a text of any length is one row of one shard, parsed in stretches. No rows give no
    rows. Other columns are left out.
    """
    texts = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    rank = F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST_ID))
    hashed = texts.withColumn("sha", F.sha2("text", 256))
    twins = cut(hashed.groupBy("sha").agg(F.min(rank).alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1").select("sha", "first"))
    hashed = hashed.join(checked(twins), "sha", "left").withColumn("copy", F.coalesce(rank > F.col("first"), F.lit(False)))
    total = text_bytes(texts)
    own = sharded(hashed.filter("NOT copy"), total)
    n = max(8, -(-total // scaled(BUCKET_BYTES, total)))
    secrets = drawn(), drawn()
    often = texts.sparkSession.sparkContext.broadcast((_hot(texts, hot, parts, secrets[0]), secrets))
    settled = _settled(own, often, n)
    told = settled.drop("asked").unionByName(_odd(own, settled, often, n), allowMissingColumns=True)
    found = _cut_out(own, told, often)
    size, long = F.octet_length("text").cast("long"), F.octet_length("text") >= LENGTH
    whole = F.array(F.struct(F.lit(0).cast("long").alias("start"), size.alias("end")))
    copies = hashed.filter("copy").select("doc_id", size.alias("n_bytes"), F.when(long, whole).otherwise(F.array().cast(SPANS)).alias("spans"), F.when(long, F.lit("")).otherwise(F.col("text")).cast("binary").alias("kept"))
    return found.unionByName(copies)


def op10_remove_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = remove_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    n_removed = F.aggregate("spans", F.lit(0).cast("long"), lambda a, x: a + x["end"] - x["start"])
    return found.select("doc_id", "n_bytes", n_removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))
