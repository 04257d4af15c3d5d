"""Terms that nearly read like a prefix: postings of letters and letter pairs, with counts that a similar term has to reach."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from talentloom.functions.similarity import sequence_ratio

#: What a ratio has to exceed. Fixed value.
SIMILAR = 0.7


def tokens(text: Column) -> Column:
    """Letters and letter pairs of a text, each numbered by how often it has occurred before, so that common tokens of two texts are counted with their multiplicity."""
    letters = F.filter(F.split(text, ""), lambda c: c != "")

    def numbered(items: Column, kind: str) -> Column:
        return F.transform(items, lambda c, i: F.concat(F.lit(kind), c, F.lit("#"), F.size(F.filter(F.slice(items, F.lit(1), i), lambda d: d == c)).cast("string")))

    pairs = F.transform(F.sequence(F.lit(1), F.length(text) - 1), lambda i: F.substr(text, i, F.lit(2)))
    return F.concat(numbered(letters, "1"), F.when(F.length(text) > 1, numbered(pairs, "2")).otherwise(F.array().cast("array<string>")))


def least_common(total: Column, threshold: float = SIMILAR) -> tuple[Column, Column]:
    """How many letters, and letter pairs, two texts have in common at least if their ratio exceeds the threshold and they have ``total`` letters together.

    More than half the threshold's share of all letters match, in order. Between two matching runs lies a letter without match, so there are at most as many runs as such letters and one, and each run of n
    letters has n - 1 pairs.
    """
    matched = F.floor(total * (threshold / 2)) + 1
    return matched, F.greatest(F.lit(0), 3 * matched - total - 1)


def postings(vocabulary: DataFrame, term: str) -> DataFrame:
    """``token, term, length``: every distinct lower-cased term of a vocabulary by its tokens. Null and empty terms have none."""
    rows = vocabulary.select(F.lower(F.col(term)).alias("term")).filter("term <> ''").distinct()
    return rows.select(F.explode(tokens(F.col("term"))).alias("token"), "term", F.length("term").alias("length"))


def _met(posted: DataFrame, prefix: str, threshold: float) -> DataFrame:
    """``term, enough``: terms that share tokens with the prefix, and whether enough of them."""
    p = prefix.lower()
    own = posted.sparkSession.range(1).select(F.explode(tokens(F.lit(p))).alias("token"))
    met = posted.join(F.broadcast(own), "token").groupBy("term", "length").agg(F.count_if(F.startswith("token", F.lit("1"))).alias("letters"), F.count_if(F.startswith("token", F.lit("2"))).alias("pairs"))
    letters, pairs = least_common(F.col("length") + len(p), threshold)
    return met.select("term", ((F.col("letters") >= letters) & (F.col("pairs") >= pairs)).alias("enough"))


def candidates(posted: DataFrame, prefix: str, threshold: float = SIMILAR) -> DataFrame:
    """``term``: those that have enough letters and letter pairs of the prefix. Only postings of the prefix's own tokens are read, and added up before they are shuffled."""
    return _met(posted, prefix, threshold).filter("enough").select("term")


def similar(posted: DataFrame, prefix: str, threshold: float = SIMILAR) -> DataFrame:
    """``term, alike``: terms whose sequence ratio to the prefix exceeds the threshold; it is worked out for candidates only.

    The ratio hangs on what the aggregation counts, so Spark can't take the filter on it below the aggregation, where it would be worked out for every row.
    """
    return _met(posted, prefix, threshold).select("term", sequence_ratio(F.when(F.col("enough"), F.lit(prefix.lower())), F.col("term")).alias("alike")).filter(F.col("alike") > threshold)
