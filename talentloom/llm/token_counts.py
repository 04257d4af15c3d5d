"""Token counts by a whole-token shortcut."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from talentloom.llm import textbytes, wordbpe


def token_counts(docs: DataFrame, tokenizer: str, limit: int = 2048, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Number of tokens of every whole text: ``doc_id, n_bytes, n_tokens, over_limit`` (``n_tokens > limit``).

    One narrow pass without a shuffle: each text is cut into pre-tokens, those proven to be single tokens count
    directly, the rest are merged and remembered up to a bound. The proven strings are broadcast; the vocabulary
    file bounds them. A null text is empty (0 bytes, 0 tokens). Ids may be null or repeat: there is one row for each input row. A text of
    any length is counted whole; no rows give no rows. Other columns are left out.
    """
    whole = docs.sparkSession.sparkContext.broadcast(wordbpe.whole_tokens(tokenizer))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = wordbpe.Counter(wordbpe.encoder(tokenizer, whole.value))
        for batch in batches:
            for part in textbytes.slices(batch, "text"):
                n = pa.array([counter.count(x) for x in part.column("text").to_pylist()], pa.int64())
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("n_bytes"), n], names=["doc_id", "n_bytes", "n_tokens"])
        counter.encoder.forget()

    texts = docs.select(F.col(id_col).alias("doc_id"), F.octet_length(F.coalesce(F.col(text_col), F.lit(""))).cast("long").alias("n_bytes"), F.col(text_col).alias("text"))
    kind = texts.schema["doc_id"].dataType.simpleString()
    return texts.mapInArrow(textbytes.of_batches(count), f"doc_id {kind}, n_bytes long, n_tokens long").withColumn("over_limit", F.col("n_tokens") > limit)


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return token_counts(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("word_bpe_49k.json"))
