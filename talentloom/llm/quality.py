"""Quality scores by nearest-neighbour voting in a latent-semantic space."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from talentloom.llm import textbytes

#: Labelled rows that the space is fitted on and that vote, at most. They are broadcast: LABELLED * DIMENSIONS floats.
LABELLED = 1536
DIMENSIONS = 32
NEIGHBOURS = 15

TRIGRAMS = 4096
#: Bytes of a text whose trigrams are counted at once.
STRETCH = 1 << 20
_REST = 8  # further terms: see terms()

#: The shape of a byte: a letter's case, digit, white space, line end, or the mark itself.
_SHAPE = np.arange(256, dtype=np.int64) % 64 + 8
_SHAPE[0x61:0x7B] = _SHAPE[0x80:] = 0
_SHAPE[0x41:0x5B] = 1
_SHAPE[0x30:0x3A] = 2
_SHAPE[[0x20, 0x09, 0x0B, 0x0C]] = 3
_SHAPE[[0x0A, 0x0D]] = 4


def terms(raw: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Term counts of each text, a row each: hashed trigrams of byte shapes, then words by kind.

    The words' terms: words, words that occur once in the text, repeats of an earlier word, repeats of the word just
    before, words of one or two bytes, of over twelve bytes, lines, and a constant.
    """
    n = len(at) - 1
    out = np.zeros((n, TRIGRAMS + _REST), np.float32)
    for i in range(n):
        for low in range(int(at[i]), int(at[i + 1]) - 2, STRETCH):
            shape = _SHAPE[raw[low : min(low + STRETCH + 2, at[i + 1])]]
            out[i, :TRIGRAMS] += np.bincount((shape[:-2] * 5003 + shape[1:-1] * 71 + shape[2:]) % TRIGRAMS, minlength=TRIGRAMS)
    starts, ends, first = textbytes.words(raw, at, textbytes.NOT_SPACE)
    hashes, length = textbytes.word_hashes(raw, starts, ends), ends - starts
    for i in range(n):
        a, b = first[i], first[i + 1]
        if b > a:
            h, w = hashes[a:b], length[a:b]
            _, times = np.unique(h, return_counts=True)
            out[i, TRIGRAMS:-1] = b - a, (times == 1).sum(), b - a - len(times), (h[1:] == h[:-1]).sum(), (w < 3).sum(), (w > 12).sum(), (raw[at[i] : at[i + 1]] == 10).sum()
    out[:, -1] = 1
    return out


def weighted(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """Square roots of term frequencies times idf, the word terms relative to the words."""
    grams, rest = counts[:, :TRIGRAMS], counts[:, TRIGRAMS:]
    grams = np.sqrt(grams / np.maximum(1, grams.sum(1, keepdims=True))) * idf
    rest = np.sqrt(rest / np.maximum(1, rest[:, :1])) * 0.5
    rest[:, 0], rest[:, -1] = 0.1, 0.1
    return np.concatenate([grams, rest], 1)


def unit(vectors: np.ndarray) -> np.ndarray:
    return vectors / np.maximum(1e-9, np.linalg.norm(vectors, axis=1, keepdims=True))


class Space:
    """A latent-semantic space with labelled vectors in it. ``vote`` gives scores from 0 to 1."""

    def __init__(self, counts: np.ndarray, labels: np.ndarray, dimensions: int = DIMENSIONS):
        self.labels = labels.astype(np.float64)
        self.idf = np.log1p((1 + len(counts)) / (1 + (counts[:, :TRIGRAMS] > 0).sum(0))).astype(np.float32) if len(counts) else np.ones(TRIGRAMS, np.float32)
        x = weighted(counts, self.idf).astype(np.float64)
        # the right singular vectors, by the smaller of the two Gram matrices
        if len(x):
            values, left = np.linalg.eigh(x @ x.T)
            top = [i for i in reversed(range(len(values))) if values[i] > 1e-9][:dimensions]
            self.axes = (x.T @ left[:, top] / np.sqrt(values[top])).astype(np.float32)
        else:
            self.axes = np.zeros((TRIGRAMS + _REST, 1), np.float32)
        self.points = unit(x @ self.axes).astype(np.float32)

    def vote(self, counts: np.ndarray, neighbours: int = NEIGHBOURS, block: int = 512) -> np.ndarray:
        """Cosines of every document with every labelled vector, in blocks of documents; the nearest ones vote with their similarity."""
        if not len(self.labels):
            return np.full(len(counts), 0.5)
        k = min(neighbours, len(self.labels))
        out = np.empty(len(counts))
        for low in range(0, len(counts), block):
            cosines = unit(weighted(counts[low : low + block], self.idf) @ self.axes) @ self.points.T
            near = np.argpartition(-cosines, k - 1, axis=1)[:, :k]
            weight = np.maximum(np.take_along_axis(cosines, near, 1).astype(np.float64), 1e-6)
            out[low : low + block] = (weight * self.labels[near]).sum(1) / weight.sum(1)
        return np.clip(out, 0, 1)


#: Documents whose term counts a task holds at once.
ROWS = 512


def counted(batches: Iterator[pa.RecordBatch], column: str = "text") -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """Parts of the batches with the term counts of their texts."""
    for batch in batches:
        for part in textbytes.slices(batch, column):
            for low in range(0, part.num_rows, ROWS):
                rows = part.slice(low, ROWS)
                yield rows, terms(*textbytes.buffers(rows.column(column)))


def fit(docs: DataFrame, labels: DataFrame, labelled: int = LABELLED, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> Space:
    """Fits the space on at most ``labelled`` labelled documents, taken in the order of a hash of their ids.

    Rows without a label or id are left out; of several labels for one id the lowest counts. The term counts of the
    chosen rows (16 KB each) come to the driver, which takes the singular vectors.
    """
    rule = labels.filter(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("doc_id")).agg(F.min(label_col).cast("double").alias("label"))
    chosen = F.broadcast(rule.orderBy(F.xxhash64("doc_id"), "doc_id").limit(labelled))
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).join(chosen, "doc_id").groupBy("doc_id").agg(F.min("label").alias("label"), F.min("text").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, counts in counted(batches):
            yield pa.RecordBatch.from_arrays([part.column("label"), pa.array([x.tobytes() for x in counts], pa.binary()), part.column("doc_id").cast("string")], names=["label", "counts", "key"])

    found = sorted(rows.select("label", "text", "doc_id").mapInArrow(textbytes.of_batches(run), "label double, counts binary, key string").collect(), key=lambda x: x.key)
    counts = np.array([np.frombuffer(x.counts, np.float32) for x in found], np.float32).reshape(len(found), TRIGRAMS + _REST)
    return Space(counts, np.array([x.label for x in found]))


def score(docs: DataFrame, space: Space, id_col: str = "doc_id", text_col: str = "text", name: str = "score") -> DataFrame:
    """``score`` (0 to 1; the column is called ``name``) for every document, next to its columns. Space and votes are broadcast; ``LABELLED`` and ``DIMENSIONS`` bound them.

    A null text is empty; empty texts are scored like others. Without any labelled row every score is 0.5. A
    column that is called ``name`` is replaced.
    """
    shared = docs.sparkSession.sparkContext.broadcast(space)
    docs = docs.drop(name)
    names = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, counts in counted(iter([batch]), text_col):
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in names), pa.array(shared.value.vote(counts))], names=[*names, name])

    from pyspark.sql.types import DoubleType, StructField, StructType

    return docs.mapInArrow(textbytes.of_batches(run), StructType([*docs.schema.fields, StructField(name, DoubleType())]))


THRESHOLD = 0.3


def held_out(id_col: str = "doc_id"):
    """Whether a row is kept from learning: its id's checksum modulo 5 is 0."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def learned(docs: DataFrame, labels: DataFrame) -> Space:
    return fit(docs, labels.filter(~held_out()))


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    scored = score(docs.select("doc_id", "text"), learned(docs, labels))
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
