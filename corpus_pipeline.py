"""From raw documents to packed training sequences: quality, exact and near duplicates, benchmark passages, packing.

Every stage takes (spark, docs, sf_dir) and works on all rows that the stage before kept. All but the last return the
columns of documents. Extra columns pass through; rows whose id is null can't be named as duplicates and stay; rows that share an id
go only if all of them are to go. An empty table runs through and gives an empty result.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from talentloom.llm import decontaminate, exact_dedup, near_dups, packing, quality
from talentloom.llm.cuts import checked, cut, free


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _without(docs: DataFrame, judged: DataFrame, stays: str) -> DataFrame:
    """The documents without those of whose rows in ``judged`` none stays. Few ids are broadcast, more are joined by a shuffle."""
    gone = cut(judged.groupBy("doc_id").agg(F.bool_or(F.coalesce(F.expr(stays), F.lit(True))).alias("stays")).filter("NOT stays").select("doc_id"))
    return docs.join(checked(gone), "doc_id", "left_anti").select(docs.columns)


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps what nearest labelled documents vote for; labels of held-out rows teach nothing."""
    space = quality.learned(docs, _table(spark, sf_dir, "labels"))
    name = free("score", docs.columns)
    return quality.score(docs, space, name=name).filter(F.col(name) >= quality.THRESHOLD).select(docs.columns)


def exact_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of texts that are equal without white space."""
    return _without(docs, exact_dedup.exact_dedup(docs), "kept")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the smallest id of each group linked by shingle similarity."""
    return _without(docs, near_dups.near_duplicates(docs), "component_id = doc_id")


def benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts the words of benchmark passages out of the texts; other texts stay as they are."""
    return decontaminate.decontaminate(docs, _table(spark, sf_dir, "benchmark")).withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences with their ids, as ``packing.pack`` has them, and the ids' checksums."""
    pieces = packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))
    return pieces.withColumn("ids_crc32", F.crc32("ids"))


STAGES = [
    ("quality_classifier", quality_classifier),
    ("exact_dedup", exact_duplicates),
    ("ngram_jaccard_join", near_duplicates),
    ("benchmark_decontamination", benchmark_passages),
    ("packing", pack),
]

#: Learned scores have no SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each result is written to the shared folder and read by the next stage."""
    docs = _table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = cut(docs)
    return docs
