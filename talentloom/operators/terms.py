"""Frequencies, relations and relevance of terms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from talentloom.functions.similarity import sequence_ratio
from talentloom.functions.text import split_skills
from talentloom.operators import fuzzy


def term_counts(df: DataFrame, terms: Column) -> DataFrame:
    """``term, n``: how often each normalised term occurs in an array column."""
    return df.select(F.explode(terms).alias("term")).select(F.lower(F.trim("term")).alias("term")).filter("term <> ''").groupBy("term").agg(F.count(F.lit(1)).alias("n"))


def weighted_counts(parts: list[tuple[DataFrame, float]]) -> DataFrame:
    """``term, weight``: sums over tables of terms, each with its weight."""
    out = None
    for df, w in parts:
        part = df.select("term", F.lit(float(w)).alias("w"))
        out = part if out is None else out.unionByName(part)
    return out.groupBy("term").agg(F.sum("w").alias("weight"))


def related(df: DataFrame, key: str, terms: Column, least: int = 2, top: int = 15) -> DataFrame:
    """``term, other, n, strength, rank``: terms that occur in the same rows, with their share of the term's co-occurrences.

    The pairs of a row are made of its distinct terms, so their number follows the rows' lengths, not the terms' frequencies.
    """
    rows = df.select(F.array_distinct(F.filter(F.transform(terms, lambda x: F.lower(F.trim(x))), lambda x: x != "")).alias("t"))
    pairs = rows.select("t", F.explode("t").alias("term")).select("term", F.explode(F.filter("t", lambda x: x != F.col("term"))).alias("other"))
    counts = pairs.groupBy("term", "other").agg(F.count(F.lit(1)).alias("n"))
    of_term = Window.partitionBy("term")
    counts = counts.withColumn("strength", F.col("n") / F.sum("n").over(of_term)).filter(F.col("n") >= least)
    return counts.withColumn("rank", F.row_number().over(of_term.orderBy(F.desc("n"), "other"))).filter(F.col("rank") <= top)


def _inside(keyword: str):
    return lambda part: F.contains(F.lit(keyword), part)


def keyword_relevance(vocabulary: DataFrame, term: str, keywords: list[str]) -> DataFrame:
    """Relevance of each term to a position's keywords: 10 for an equal one, else 8, 6, 4 or 3 for each by how much of it is shared. Keywords are a short list of literals."""
    t = F.lower(F.trim(F.col(term)))
    parts = F.filter(F.split(t, r"\s+"), lambda p: F.length(p) > 2)
    score = F.lit(0.0)
    for k in (k.lower().strip() for k in keywords):
        own = [w for w in k.split() if len(w) > 2]
        some = F.exists(F.array(*map(F.lit, own)).cast("array<string>"), lambda p: F.contains(t, p)) if own else F.lit(False)
        shared = F.size(F.filter(parts, _inside(k))) > 0
        score = score + F.when(F.contains(t, F.lit(k)), 8.0).when(F.contains(F.lit(k), t), 6.0).when(some, 4.0).when(shared, 3.0).otherwise(0.0)
    return vocabulary.withColumn("relevance", F.when(t.isin(*[k.lower() for k in keywords]), 10.0).otherwise(score)).filter("relevance > 0")


#: Weight of how many profiles have a skill. Fixed value.
POPULARITY_WEIGHT = 0.5


def position_keywords(position: str, keywords: dict[str, list[str]]) -> list[str]:
    """The keywords of the first entry that a position's name contains or is contained in; the words of the name else."""
    name = position.lower().strip()
    return next((words for entry, words in keywords.items() if entry in name or (name and name in entry)), name.split())


def recommended(vocabulary: DataFrame, term: str, keywords: list[str], popularity: DataFrame, limit: int) -> DataFrame:
    """``term, score``: a vocabulary's entries by their relevance to keywords, and half a point for each profile that has them. ``popularity`` holds ``term, n``."""
    found = keyword_relevance(vocabulary, term, keywords).join(popularity.select(F.col("term").alias("__t"), "n"), F.lower(F.trim(F.col(term))) == F.col("__t"), "left")
    return found.select(F.col(term), (F.col("relevance") + F.coalesce("n", F.lit(0)) * POPULARITY_WEIGHT).alias("score")).orderBy(F.desc("score"), term).limit(limit)


#: Terms that say little. Fixed values.
GENERIC = ("and", "the", "with", "for", "from", "this", "that", "have", "will", "can")


def completion_score(text: Column, prefix: str, semantic: Column | None = None, alike: Column | None = None) -> Column:
    """How well a text completes a prefix: equal, beginning, containing, similar, or with its characters in order.

    ``alike`` is the sequence ratio where it matters, as ``fuzzy.similar`` finds it. Without it the ratio is worked out here, for texts that neither begin with the prefix nor contain it and whose length allows it.
    """
    semantic = F.lit(0.0) if semantic is None else semantic
    low, p = F.lower(text), prefix.lower()
    at = F.locate(p, low)
    fits = (at == 0) & (2.0 * F.least(F.length(low), F.lit(len(p))) > fuzzy.SIMILAR * (F.length(low) + len(p)))
    alike = sequence_ratio(F.when(fits, p), low) if alike is None else alike
    in_order = F.replace(low, F.lit(" "), F.lit("")).rlike(".*".join(("\\" + c if not c.isalnum() else c) for c in p)) if len(p) >= 2 else F.lit(False)
    return (
        F.when(low == p, F.greatest(F.lit(1.0), semantic + 0.5))
        .when(at == 1, F.greatest(F.lit(0.9) - (F.length(text) - len(p)) * 0.01, semantic + 0.3))
        .when(at > 1, F.greatest(F.lit(0.7) - (at - 1) * 0.01, semantic + 0.2))
        .when(alike > fuzzy.SIMILAR, F.greatest(alike * 0.5, semantic + 0.1))
        .when(in_order, F.greatest(F.lit(0.3), semantic))
        .otherwise(semantic)
    )


def completions(counts: DataFrame, relations: DataFrame, prefix: str, limit: int = 50) -> DataFrame:
    """``term, n, score``: terms for a prefix, with bonuses for relation to it and frequency, and a penalty for being generic.

    Which terms are merely similar to the prefix comes from postings of letters and letter pairs; no other term's ratio is worked out.
    """
    p = prefix.lower()
    totals = F.broadcast(counts.agg(F.max("n").alias("most"), F.count(F.lit(1)).alias("terms")))
    near = relations.filter((F.col("term") == p) | (F.col("other") == p)).select(F.when(F.col("term") == p, F.col("other")).otherwise(F.col("term")).alias("term"), F.least(F.col("strength") * 2, F.lit(0.3)).alias("bonus")).groupBy("term").agg(F.max("bonus").alias("bonus"))
    generic = F.when(F.col("term").isin(*GENERIC), -0.3).when(F.col("n") > F.col("terms") * 0.1, -0.1).otherwise(0.0)
    alike = fuzzy.similar(fuzzy.postings(counts, "term"), p).select(F.col("term").alias("__low"), "alike")
    base = completion_score(F.col("term"), p, alike=F.col("alike"))
    score = base + F.coalesce("bonus", F.lit(0.0)) + F.least(F.col("n") / F.col("most") * 0.2, F.lit(0.2)) + generic
    scored = counts.crossJoin(totals).join(near, "term", "left").join(alike, F.lower("term") == F.col("__low"), "left").filter(base > 0).select("term", "n", F.greatest(F.lit(0.0), F.least(F.lit(2.0), score)).alias("score"))
    return scored.orderBy(F.desc("score"), F.length("term"), "term").limit(limit)


# Words of descriptions that say nothing, how many titles are read, the least frequency and relevance, and what relevance weighs.
SILENT = (
    "and", "the", "for", "with", "this", "that", "have", "will", "are", "was", "been", "from", "they", "were",
    "but", "not", "what", "can", "had", "her", "his", "she", "has", "him",
)
TITLES_READ, LEAST_FREQUENCY, LEAST_RELEVANCE, RELEVANCE_WEIGHT = 3, 2, 0.01, 10


def co_occurring(df: DataFrame, prefix: str, skills: Column, titles: Column, descriptions: Column) -> DataFrame:
    """``term, n, relevance, score``: terms around a prefix, by frequency and how well they complete it. Skills, titles and descriptions are arrays of texts.

    Where a skill or title contains the prefix, the row's skills (lists are split) and the words of its first three titles count, words from three characters; of every description that contains the prefix its words of
    three letters or more, without the silent ones. The prefix itself, terms of one character, those that occur once and those of no relevance are left out.
    """
    p, none = prefix.lower(), F.array().cast("array<string>")
    low = lambda items: F.transform(F.array_compact(F.coalesce(items, none)), F.lower)
    says = lambda x: F.contains(x, F.lit(p))
    words = lambda x, kind: F.regexp_extract_all(x, F.lit(rf"(?U)\b{kind}{{3,}}\b"), F.lit(0))
    around = F.concat(F.flatten(F.transform("__skills", split_skills)), F.flatten(F.transform(F.slice("__titles", 1, TITLES_READ), lambda x: words(x, r"\w"))))
    told = F.filter(F.flatten(F.transform(F.filter("__descriptions", says), lambda x: words(x, "[a-z]"))), lambda w: ~w.isin(*SILENT))
    rows = df.select(low(skills).alias("__skills"), low(titles).alias("__titles"), low(descriptions).alias("__descriptions"))
    terms = F.concat(F.when(F.exists("__skills", says) | F.exists("__titles", says), around).otherwise(none), told)
    counts = rows.select(F.explode(terms).alias("term")).filter((F.col("term") != p) & (F.length("term") >= 2)).groupBy("term").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= LEAST_FREQUENCY)
    alike = fuzzy.similar(fuzzy.postings(counts, "term"), p).select(F.col("term").alias("__low"), "alike")
    scored = counts.join(alike, F.col("term") == F.col("__low"), "left").select("term", "n", completion_score(F.col("term"), p, alike=F.col("alike")).alias("relevance"))
    return scored.filter(F.col("relevance") > LEAST_RELEVANCE).withColumn("score", F.col("n") + F.col("relevance") * RELEVANCE_WEIGHT)


# Weights of a skill's share of the titles and of its frequency, lengths of usual names, terms that say little and what they lose, the least score.
COVERAGE_WEIGHT, FREQUENCY_WEIGHT, RARE, COMMON = 2, 1.5, 0.01, 0.1
USUAL_LENGTHS, LENGTH_BONUS, GENERIC_PENALTY, LEAST_SKILL = (3, 15), 0.5, -2, 0.5
GENERIC_SKILLS = (
    "experience", "knowledge", "understanding", "ability", "skill", "working", "good", "excellent", "strong", "basic", "advanced", "years", "work", "team", "project",
    "development", "application", "system", "business", "management", "communication", "problem", "solving", "analytical", "technical",
)


def title_skills(rows: DataFrame, counts: DataFrame, n_titles: int) -> DataFrame:
    """``skill, titles, score`` of the skills that ``rows`` (``title, skill``) name for ``n_titles`` chosen titles.

    A skill scores a point for each title, its share of the titles twice, up to 1.5 for its frequency in ``counts`` (``term, n``) against the most frequent one, half a point for a name of usual length;
    a generic one loses two. Frequencies of at most a hundredth of the highest, and counts of a tenth of the number of terms or more, add nothing. Skills of one letter, null ones and scores up to 0.5 are left out.
    """
    skill = F.lower(F.trim("skill"))
    named = rows.filter(F.col("title").isNotNull()).select("title", skill.alias("skill")).filter(F.length("skill") >= 2)
    titles = named.groupBy("skill").agg(F.countDistinct("title").alias("titles"))
    ratio = F.col("n") / counts.agg(F.max("n")).scalar()
    telling = (ratio > RARE) & (F.col("n") < counts.agg(F.count(F.lit(1))).scalar() * COMMON)
    frequencies = counts.select(F.col("term").alias("__term"), F.when(telling, F.least(ratio * FREQUENCY_WEIGHT, F.lit(FREQUENCY_WEIGHT))).otherwise(0.0).alias("__bonus"))
    score = F.col("titles") + F.col("titles") / n_titles * COVERAGE_WEIGHT + F.coalesce("__bonus", F.lit(0.0)) + F.when(F.length("skill").between(*USUAL_LENGTHS), LENGTH_BONUS).otherwise(0.0) + F.when(F.col("skill").isin(*GENERIC_SKILLS), GENERIC_PENALTY).otherwise(0)
    return titles.join(frequencies, F.col("skill") == F.col("__term"), "left").select("skill", "titles", score.alias("score")).filter(F.col("score") > LEAST_SKILL)


def adaptive(df: DataFrame, score: str, order: list) -> DataFrame:
    """As many rows as their quality allows: from 30 good ones (3 and up) the best 80; from 15 the good ones and 50 middling (1.5 and up); from 5 those, all middling and 30 weak (0.5 and up); else all above 0.5."""
    s = F.col(score)
    band = F.when(s >= 3, "high").when(s >= 1.5, "medium").when(s >= 0.5, "low")
    good = F.broadcast(df.agg(F.count_if(s >= 3).alias("__high")))
    banded = df.withColumn("band", band).filter("band IS NOT NULL")
    best = banded.withColumn("__at", F.row_number().over(Window.partitionBy("band").orderBy(*order))).filter("__at <= 80").crossJoin(good)  # no task sends more than 80 of a band
    high, at = F.col("__high"), F.col("__at")
    few = F.when(F.col("band") == "high", high >= 5).when(F.col("band") == "medium", high.between(15, 29) & (at <= 50)).otherwise(high.between(5, 14) & (at <= 30))
    all_of = F.when(high < 5, s > 0.5).otherwise((F.col("band") == "medium") & (high < 15))
    return best.filter(few).drop("__high", "__at").unionByName(banded.crossJoin(good).filter(all_of).drop("__high"))
