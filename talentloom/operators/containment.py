"""Which texts contain which terms, for two tables: an automaton of the terms runs over the texts, no pair is tried."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from functools import reduce

import ahocorasick
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bytes of terms that one automaton holds, about; more are searched for block by block.
BLOCK_BYTES = 8 << 20
#: Pairs after which a task hands on what it has found.
PAIRS = 50_000
#: Points of a term for a keyword that it contains, is contained in, has a word of, and that has a word of it; and of one that equals it. Fixed values.
CONTAINS, INSIDE, HAS_WORD, WORD_INSIDE, EQUAL = 8.0, 6.0, 4.0, 3.0, 10.0

_built: dict = {}


def normal(text: Column) -> Column:
    return F.lower(F.trim(text))


def _automaton(name: str, terms: Broadcast) -> ahocorasick.Automaton:
    """The automaton of a named block, which the tasks of a worker share; only the last one is kept."""
    if name not in _built:
        _built.clear()
        made = ahocorasick.Automaton()
        for i, term in enumerate(terms.value):
            made.add_word(term, i)
        made.make_automaton()
        _built[name] = made
    return _built[name]


def contained(texts: DataFrame, key: str, text: str, terms: DataFrame, term: str) -> DataFrame:
    """``key, term``: a row for each text and each distinct term that occurs in it, wherever; both are lower-cased, terms are trimmed.

    The terms are dealt out by a hash to blocks of about ``BLOCK_BYTES``, one automaton each, which is broadcast; texts are read once for each block and never shuffled, so neither a long text nor a
    frequent term meets others in one task. Work follows the texts' length and the pairs found. Rows of texts are kept as they are, repeated ones too.
    Null texts and null or blank terms have no pairs.
    """
    spark = texts.sparkSession
    words = terms.select(normal(F.col(term)).alias("term")).filter("term <> ''").distinct()
    total = words.agg(F.sum(F.octet_length("term"))).first()[0] or 0
    n = max(1, -(-total // BLOCK_BYTES))
    rows = texts.select(F.col(key), F.lower(F.col(text)).alias("__text")).filter("__text IS NOT NULL")
    schema = f"`{key}` {texts.schema[key].dataType.simpleString()}, term string"

    def searched(block: list[str]) -> DataFrame:
        shared, name = spark.sparkContext.broadcast(block), uuid.uuid4().hex

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            automaton = _automaton(name, shared)
            for batch in batches:
                at: list[int] = []
                found: list[str] = []
                for i, said in enumerate(batch.column(1).to_pylist()):
                    own = {x for _, x in automaton.iter(said)}
                    at += [i] * len(own)
                    found += [shared.value[x] for x in own]
                    if len(found) >= PAIRS or i == batch.num_rows - 1:
                        yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int64())), pa.array(found, pa.string())], names=[key, "term"])
                        at, found = [], []

        return rows.mapInArrow(run, schema)

    blocks = ([x.term for x in words.filter(F.pmod(F.xxhash64("term"), F.lit(n)) == k).collect()] for k in range(n))
    parts = [searched(b) for b in blocks if b]
    return reduce(DataFrame.unionByName, parts) if parts else rows.select(key, F.lit("").alias("term")).limit(0)


def keyword_relevance(vocabulary: DataFrame, term: str, positions: DataFrame, position: str, keyword: str) -> DataFrame:
    """``position, term, relevance``: a vocabulary's terms by their relevance to the keywords of every position of a table.

    A term that equals a keyword of the position has 10 points; else it has for each keyword what fits first: 8 if it contains it, 6 if it is contained in it, 4 if it contains a word of it, 3 if
    the keyword contains a word of the term (words of more than two characters). Each of the four is a containment join, so no term is tried against a keyword that it has nothing in common
    with. Terms and keywords are lower-cased and trimmed and count once; null and blank ones not at all. Only terms with points have rows.
    """
    t = vocabulary.select(normal(F.col(term)).alias("t")).filter("t <> ''").distinct()
    own = positions.select(F.col(position), normal(F.col(keyword)).alias("k")).filter("k <> ''").distinct()
    k = own.select("k").distinct()
    words = lambda df, c: df.select(c, F.explode(F.array_distinct(F.filter(F.split(c, r"\s+"), lambda w: F.length(w) > 2))).alias("w"))
    of_k, of_t = words(k, "k"), words(t, "t")
    fits = [
        (contained(t, "t", "t", k, "k").withColumnRenamed("term", "k"), CONTAINS),
        (contained(k, "k", "k", t, "t").withColumnRenamed("term", "t"), INSIDE),
        (contained(t, "t", "t", of_k, "w").join(of_k.withColumnRenamed("w", "term"), "term"), HAS_WORD),
        (contained(k, "k", "k", of_t, "w").join(of_t.withColumnRenamed("w", "term"), "term"), WORD_INSIDE),
    ]
    points = reduce(DataFrame.unionByName, (df.select("t", "k", F.lit(p).alias("points")) for df, p in fits)).groupBy("t", "k").agg(F.max("points").alias("points"))
    met = own.join(points, "k").groupBy(position, "t").agg(F.sum("points").alias("sum"), F.bool_or(F.col("t") == F.col("k")).alias("equal"))
    return met.select(position, F.col("t").alias(term), F.when(F.col("equal"), EQUAL).otherwise(F.col("sum")).alias("relevance"))
