"""Questions put to a table of texts: what is retrieved, what of it a model gets to read, counts of both, and the model's answers read back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from talentloom.functions.loose_json import tolerant_json
from talentloom.functions.text import preview
from talentloom.operators import vector_index
from talentloom.operators.vectors import PRESETS

# Characters that a model reads at most, what stands between two texts, and what an answer without a reason says.
BUDGET, BETWEEN, NO_REASON = 8000, "\n\n---\n\n", "No reason provided"
ANSWER = "_id string, id string, total_candidates bigint, matches array<struct<_id: string, relevance_score: double, match_reason: string>>"


def retrieved(index: vector_index.Index, questions: DataFrame, question: str, vector: str, texts: DataFrame, text: str, preset: str, budget: int = BUDGET) -> DataFrame:
    """``question, key, score, rank, preview, read``: for each question the rows whose vectors are nearest, as many as the preset retrieves, and whether a model reads them.

    All questions are searched for at once in an exact index; ``texts`` holds the index's key and the texts. Rows without a text (null) or with none in
    ``texts`` are passed over and take no place. See ``within_context`` for what is read.
    """
    most, closely = PRESETS[preset]
    hits, _ = vector_index.nearest_of_many(index, questions, question, vector, most)
    scored = hits.drop("rank").withColumn("score", (1 + F.col("cosine")) / 2)
    said = texts.filter(F.col(text).isNotNull()).select(index.key, F.col(text).alias("__text"))
    rows = within_context(scored.join(said, index.key), [question], [F.desc("score"), index.key], F.length("__text"), closely, budget)
    return rows.select(question, index.key, "score", "rank", preview(F.col("__text")).alias("preview"), "read", F.length("__text").alias("size"))


def within_context(hits: DataFrame, per: list[str], order: list, size: Column, closely: int, budget: int = BUDGET) -> DataFrame:
    """The hits of each question with ``rank``, and ``read``: whether they are among the first ``closely`` and fit the budget together with all before them. The first that does not fit ends it.

    A question's hits are few (a preset's most), so a question is one task's.
    """
    of = Window.partitionBy(*per).orderBy(*order)
    used = F.sum(size).over(of.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return hits.withColumn("rank", F.row_number().over(of)).withColumn("__used", used).withColumn("read", (F.col("rank") <= closely) & (F.col("__used") <= budget)).drop("__used")


def statistics(questions: DataFrame, found: DataFrame, question: str, budget: int = BUDGET) -> DataFrame:
    """``question, n_retrieved, n_read, context_length, exceeded`` for every question, those that found nothing too (zeros, not exceeded).

    The length is that of what is read, joined. The limit counts as exceeded where the first text is too long already, or what is read is as long as the budget.
    """
    length = F.sum(F.when(F.col("read"), F.col("size") + len(BETWEEN)).otherwise(0)) - len(BETWEEN)
    counts = found.groupBy(question).agg(F.count(F.lit(1)).alias("n_retrieved"), F.count_if("read").alias("n_read"), F.greatest(F.lit(0), length).alias("context_length"))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    exceeded = F.coalesce((F.col("n_read") == 0) | (F.col("context_length") >= budget), F.lit(False))
    return questions.select(question).join(counts, question, "left").select(question, zero("n_retrieved"), zero("n_read"), zero("context_length"), exceeded.alias("exceeded"))


def contexts(found: DataFrame, texts: DataFrame, question: str, key: str, text: str) -> DataFrame:
    """``question, context``: what a model reads for each question, best text first; no longer than the budget and its separators."""
    rows = found.filter("read").select(question, key, "rank").join(texts.select(key, F.col(text).alias("__text")), key)
    parts = F.array_sort(F.collect_list(F.struct("rank", "__text")))
    return rows.groupBy(question).agg(F.array_join(F.transform(parts, lambda x: x["__text"]), BETWEEN).alias("context"))


def chosen(answers: DataFrame, question: str, answer: str) -> DataFrame:
    """``question, key``: the one row that an answer names, as ``_id`` or ``id``; null where it names none."""
    said = F.from_json(tolerant_json(F.col(answer)), ANSWER)
    return answers.select(question, said.alias("__said")).select(question, F.coalesce("__said._id", "__said.id").alias("key"))


def ranked(answers: DataFrame, question: str, answer: str, found: DataFrame, key: str) -> DataFrame:
    """``question, place, key, relevance, reason, score, total_candidates``: the matches that an answer ranks, in its order, with their retrieval scores.

    Answers may be wrapped, cut short or damaged (``tolerant_json``); one without matches gives no rows. A match without an id is passed over, without a relevance it has 0. Ids that were not
    retrieved have no score. ``total_candidates`` is what the answer says, else how many matches it has.
    """
    said = F.from_json(tolerant_json(F.col(answer)), ANSWER)
    named = F.filter("__said.matches", lambda m: m["_id"].isNotNull())
    each = answers.select(question, said.alias("__said")).select(question, F.coalesce("__said.total_candidates", F.size(named).cast("long")).alias("total_candidates"), F.posexplode(named).alias("at", "m"))
    scores = found.select(F.col(question), F.col(key).cast("string").alias("__key"), "score")
    joined = each.withColumn("__key", F.col("m._id")).join(scores, [question, "__key"], "left")
    return joined.select(question, (F.col("at") + 1).alias("place"), F.col("__key").alias("key"), F.coalesce("m.relevance_score", F.lit(0.0)).alias("relevance"), F.coalesce("m.match_reason", F.lit(NO_REASON)).alias("reason"), "score", "total_candidates")
