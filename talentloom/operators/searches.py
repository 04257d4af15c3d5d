"""Searches that score profiles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from talentloom.functions.scoring import Criteria, Job, blend, criteria_facts, criteria_score, job_facts, priority_of, query_facts, ranking, ranking_facts, recalled
from talentloom.operators import vector_index
from talentloom.operators.vectors import OVERFETCH

#: Points that a match needs, and how many matches a search shows. Fixed values.
LEAST_SCORE, SHOWN = 40, 50
#: Blended score, out of 100, that a profile found for a file needs. Fixed value.
RELEVANT = 40.0


def once(df: DataFrame, columns: dict[str, Column], *keep: str) -> DataFrame:
    """Columns that what follows uses several times, worked out once for each row: the optimizer neither merges a generator with later columns nor moves their filters before it."""
    return df.select(*keep, F.inline(F.array(F.struct(*(v.alias(k) for k, v in columns.items())))))


def by_criteria(df: DataFrame, c: Criteria, key: str, least: float = LEAST_SCORE, limit: int = SHOWN) -> DataFrame:
    """Profiles that meet any criterion and reach the least score, best first: by criteria met, score, single matches, key."""
    facts = once(df.filter(recalled(c)), criteria_facts(c), key)
    scored = facts.select(key, *(v.alias(k) for k, v in criteria_score(c, {k: F.col(k) for k in facts.columns if k != key}).items()))
    return scored.filter(F.col("match_score") >= least).orderBy(F.desc("fields_matched"), F.desc("match_score"), F.desc("single_matches"), key).limit(limit)


def ranked_for(df: DataFrame, job: Job, key: str, *keep: str) -> DataFrame:
    """Every profile's match with one job, as ``scoring.ranking`` has it; what the match is made of is read once from a profile."""
    facts, asked = ranking_facts(), job_facts(job)
    rows = once(df, facts, key, *keep)
    parts = ranking(asked, {k: F.col(k) for k in facts})
    return rows.select(key, *keep, *(v.alias(k) for k, v in parts.items()))


def ranked_for_jobs(df: DataFrame, jobs: DataFrame, key: str, job: str, asked: str) -> DataFrame:
    """``key, job`` and the match of every profile with every job of a table; ``asked`` is a column of ``scoring.requirements``.

    The jobs are the set of questions, the profiles all rows: each is read once, and what a match is made of is worked out before the jobs come in.
    """
    facts = ranking_facts()
    wanted = job_facts(F.col(asked))
    parts = ranking({k: F.col(f"__{k}") for k in wanted}, {k: F.col(k) for k in facts})
    pairs = once(df, facts, key).crossJoin(once(jobs, {f"__{k}": v for k, v in wanted.items()}, job))
    return pairs.select(key, job, *(v.alias(k) for k, v in parts.items()))


def by_files(index: vector_index.Index, profiles: DataFrame, files: DataFrame, file: str, text: str, vector: str, n: int = 10, least: float = 0.0, relevant: float = RELEVANT, keep: Column | None = None) -> DataFrame:
    """``file, key, similarity, priority, reason, final_score``: for each file of a table (its text, and a vector that any embedder made of it) the profiles that suit it.

    All files are searched for at once in an exact index, five times as far as ``n``. What is similar enough and passes ``keep`` (the caller's own rows; its columns may be those of profiles and files) is
    cut to the ``n`` most similar, scored by the file's words, blended with the similarity, and kept from ``relevant`` up. Files without a vector find nothing; a file
    whose text is null or blank is left out, as is one that could not be read.
    """
    told = files.filter(F.trim(F.regexp_replace(text, r"\s+", " ")) != "")
    asked = {f"__{k}": v for k, v in query_facts(F.col(text)).items()}
    said = once(told, asked, *(c for c in files.columns if c not in (text, vector)))
    hits, _ = vector_index.nearest_of_many(index, told, file, vector, n * OVERFETCH)
    similar = hits.select(file, index.key, ((1 + F.col("cosine")) / 2).alias("similarity")).filter(F.col("similarity") >= least)
    rows = similar.join(said, file).join(profiles, index.key)
    rows = rows if keep is None else rows.filter(keep)
    best = rows.withColumn("__place", F.row_number().over(Window.partitionBy(file).orderBy(F.desc("similarity"), index.key))).filter(F.col("__place") <= n)
    scored = best.select(file, index.key, "similarity", *(v.alias(k) for k, v in priority_of({k: F.col(k) for k in asked}).items()))
    return scored.withColumn("final_score", blend(F.col("priority"), F.col("similarity"))).filter(F.col("final_score") >= relevant)
