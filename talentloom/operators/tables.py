"""Keyed tables: pages, samples, updates, deletions, merges, vocabularies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, MapType, StructType
from pyspark.sql.window import Window

from talentloom.operators.scans import before, in_ranges, written


#: How many rows a list of the newest shows. Fixed values.
DEFAULT_ROWS, MOST_ROWS = 10, 50
#: Shares that a group is summed in, and units of a stretch of periods.
SHARES, STRETCH = 1024, 1024


def shown_rows(limit: int | None) -> int:
    """A limit between 1 and 50, 10 without one; below 1 also 10."""
    return DEFAULT_ROWS if limit is None or limit < 1 else min(MOST_ROWS, limit)


def without_suffix(df: DataFrame, suffix: str = "_vector") -> DataFrame:
    """The table without columns whose names end so."""
    return df.drop(*(c for c in df.columns if c.endswith(suffix)))


def as_text(df: DataFrame) -> DataFrame:
    """Every column as trimmed text; arrays, maps and structs as JSON."""
    nested = lambda t: isinstance(t, (ArrayType, MapType, StructType))
    return df.select(*((F.to_json(f.name) if nested(f.dataType) else F.trim(F.col(f.name).cast("string"))).alias(f.name) for f in df.schema.fields))


def at_least(df: DataFrame, score: str, least: float | None) -> DataFrame:
    """Rows whose score reaches a threshold; all of them where it is 0 or missing."""
    return df.filter(F.col(score) >= least) if least else df


def others_with(df: DataFrame, column: str, value: str, key: str, but: int) -> DataFrame:
    """Rows other than one's own that have a value."""
    return df.filter((F.col(column) == value) & (F.col(key) != but))


def embedded(df: DataFrame, embed: Column, vector: str) -> DataFrame:
    """The table with a vector column made anew; where that fails (null) the old vector stays, and ``failed`` says so."""
    old = F.col(vector) if vector in df.columns else F.lit(None)
    made = df.withColumn("__made", embed)
    return made.withColumn("failed", F.col("__made").isNull()).withColumn(vector, F.coalesce("__made", old)).drop("__made")


def page(df: DataFrame, order: list, skip: int = 0, limit: int = 100) -> DataFrame:
    """Rows ``skip`` and on in a total order; the limit is kept between 1 and 100."""
    return df.orderBy(*order).offset(max(0, skip)).limit(min(100, max(1, limit)))


def sample(df: DataFrame, n: int, key: str) -> DataFrame:
    """``n`` rows that look random and are the same on every run."""
    return df.orderBy(F.md5(F.col(key).cast("string")), key).limit(n)


def upsert(df: DataFrame, changes: DataFrame, key: str) -> DataFrame:
    """New values where a change has some, the old ones else; keys that only the changes have are added."""
    new = changes.select(F.col(key), *(F.col(c).alias(f"__{c}") for c in changes.columns if c != key))
    out = df.join(new, key, "full_outer")
    return out.select(key, *(F.coalesce(f"__{c}", c).alias(c) if c in changes.columns else F.col(c) for c in df.columns if c != key))


def delete(df: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    return df.join(keys.select(key), key, "left_anti")


def overlay(primary: DataFrame, secondary: DataFrame, key: str) -> DataFrame:
    """Records of two sources merged: what the first has (not null, not blank) wins."""
    other = secondary.select(F.col(key), *(F.col(c).alias(f"__{c}") for c in secondary.columns if c != key))
    out = primary.join(other, key, "full_outer")
    return out.select(key, *(F.coalesce(F.nullif(F.trim(F.col(c).cast("string")), F.lit("")), F.col(f"__{c}").cast("string")).alias(c) for c in primary.columns if c != key))


def first_spelling(df: DataFrame, value: str, order: list) -> DataFrame:
    """One row for each value that differs in more than case and outer white space: the first in the order."""
    w = Window.partitionBy(F.lower(F.trim(F.col(value)))).orderBy(*order)
    return df.withColumn("__n", F.row_number().over(w)).filter("__n = 1").drop("__n")


def absent(candidates: DataFrame, vocabulary: DataFrame, value: str) -> DataFrame:
    """Distinct normalised candidates that a vocabulary lacks."""
    norm = F.lower(F.trim(F.col(value)))
    return candidates.select(norm.alias(value)).filter(F.col(value) != "").distinct().join(vocabulary.select(norm.alias(value)), value, "left_anti")


def upsert_counts(candidates: DataFrame, vocabulary: DataFrame, value: str) -> DataFrame:
    """``outcome, n``: how many distinct normalised candidates a vocabulary lacks (added) and has (existing)."""
    norm = F.lower(F.trim(F.col(value)))
    distinct = lambda df: df.select(norm.alias("__v")).filter("__v <> ''").distinct()
    met = distinct(candidates).join(distinct(vocabulary).withColumn("__there", F.lit(True)), "__v", "left")
    sums = met.agg(F.count_if(F.col("__there").isNull()).alias("added"), F.count_if(F.col("__there")).alias("existing"))
    return sums.select(F.inline(F.array(*(F.struct(F.lit(c).alias("outcome"), F.col(c).alias("n")) for c in ("added", "existing")))))


def scoped(df: DataFrame, users: DataFrame, requester: int, user: str = "user_id") -> DataFrame:
    """All rows for a requester that the table of users knows, else the requester's own."""
    known = users.filter(F.col(user) == requester).limit(1).select(F.lit(True).alias("__known"))
    return df.join(F.broadcast(known), F.lit(True), "left").filter(F.col("__known").isNotNull() | (F.col(user) == requester)).drop("__known")


def newest(df: DataFrame, per: str, n: int, order: list) -> DataFrame:
    """The newest ``n`` rows of each ``per``."""
    w = Window.partitionBy(per).orderBy(*order)
    return df.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= n)


def conflicts(df: DataFrame, key: str, identities: list[str]) -> DataFrame:
    """For each row the identity columns whose (not blank) value some other row has too: one aggregation for each column, no pairs."""
    out = df
    for c in identities:
        value = F.nullif(F.trim(F.col(c).cast("string")), F.lit(""))
        shared = df.select(value.alias("__v")).filter("__v IS NOT NULL").groupBy("__v").agg(F.count(F.lit(1)).alias(f"__{c}")).filter(F.col(f"__{c}") > 1)
        out = out.withColumn("__v", value).join(shared, "__v", "left").drop("__v")
    names = F.array_compact(F.array(*(F.when(F.col(f"__{c}").isNotNull(), F.lit(c)) for c in identities)))
    return out.withColumn("conflicts", F.concat_ws(",", names)).filter("conflicts <> ''").select(*df.columns, "conflicts")


def within_budget(df: DataFrame, per: list[str], order: list, size: Column, budget: int) -> DataFrame:
    """The leading rows whose sizes (not negative) add up to at most the budget, stopping at the first that does not fit.

    The order has to be total, of columns. What follows the first row that does not fit in a share of its group fits
    nowhere; so a hot group meets in one task only with what fits within each of its shares, and the row after that.
    """
    up_to = lambda last, *by: F.sum(size).over(Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, last))
    shares = df.withColumn("__share", F.pmod(F.hash(*order), F.lit(SHARES)))
    led = shares.withColumn("__before", up_to(-1, *per, "__share")).filter(F.coalesce(F.col("__before") <= budget, F.lit(True))).drop("__share", "__before")
    return led.withColumn("used", up_to(0, *per)).filter(F.col("used") <= budget)


def ranked(df: DataFrame, score: str, name: str, rank: str = "rank") -> DataFrame:
    """Ranks of all rows by descending score, then name: places in ranges of that order, after the sizes of the ranges before. Only these sizes meet in one task.

    Rows with a null score come last, those with a null name first among their score. Rows that agree in both share a range.
    """
    order = ["__none", "__down", name]
    rows = in_ranges(df.withColumns({"__none": F.col(score).isNull(), "__down": -F.col(score)}), order)
    found = before(rows, [], order, {"__n": ("sum", F.lit(1))})
    return found.select(*df.columns, (F.coalesce("__n", F.lit(0)) + 1).alias(rank))


def merged_periods(df: DataFrame, key: str, start: str, end: str) -> DataFrame:
    """Periods (whole units, ends included) joined where they overlap or touch: ``key, start, end``.

    Of periods with one start the latest end is all that matters, so they are one row before anything is ordered; then a stretch of ``STRETCH`` units holds at most so many rows of a key,
    however many periods it has. Stretches are joined by themselves, and what is left of them by running maxima and sums over stretches. A null key is a key; periods
    without a start are one period; a null end is the earliest.
    """
    starts = df.groupBy(key, start).agg(F.max(end).alias(end)).withColumn("__part", F.floor(F.col(start) / STRETCH))
    within = Window.partitionBy(key, "__part").orderBy(start)
    opens = lambda latest: F.when(F.col(start) > latest + 1, 1).otherwise(0)
    latest = F.max(end).over(within.rowsBetween(Window.unboundedPreceding, -1))
    own = starts.withColumn("__new", opens(latest)).withColumn("__island", F.sum("__new").over(within))
    own = own.groupBy(key, "__part", "__island").agg(F.min(start).alias(start), F.max(end).alias(end)).drop("__island")
    own = written(own)
    led = before(own, [key], [start], {"__latest": ("max", F.col(end))}).withColumn("__new", opens(F.col("__latest")))
    islands = before(led, [key], [start], {"__island": ("sum", F.col("__new"))}).withColumn("__island", F.coalesce("__island", F.lit(0)) + F.col("__new"))
    return islands.groupBy(key, "__island").agg(F.min(start).alias(start), F.max(end).alias(end)).drop("__island")
