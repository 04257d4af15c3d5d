"""Filter interaction audit: five document filters replayed in all their 120 orders."""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from talentloom.llm.cuts import checked, cut

FILTERS = "ABCDE"
#: Documents that a task replays, about: each makes 600 rows there, which only that task's partial sums leave.
TASK_ROWS, MOST_TASKS = 20_000, 4000


def own_failures(text: Column) -> Column:
    """Bits 1, 2, 4 and 8 for the filters A to D, which look at one text: too few words, too few distinct ones, too many capitals, odd characters."""
    words = F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != "")

    def bits(w: Column) -> Column:
        n = F.size(w).cast("long")
        shouted = 100 * F.regexp_count(text, F.lit("[A-Z]")).cast("long") > 2 * F.length(text).cast("long")
        fails = (n < 200, 100 * F.size(F.array_distinct(w)).cast("long") < 50 * n, shouted, text.rlike("[#$%&*|]"))
        return sum((F.when(x, 1 << k).otherwise(0) for k, x in enumerate(fails)), F.lit(0))

    return F.transform(F.array(words), bits)[0]  # the words are worked out once


def document_failures(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``part, failures, good, toxic`` for every document: one bit for each filter that it fails, and its labels.

    E needs the smallest id of each text. Texts meet as SHA-256 digests, of which those that repeat are broadcast if few and joined by a shuffle
    otherwise; a text that a third of all rows share is one digest, summed up before it travels.
    """
    text = F.coalesce("text", F.lit(""))
    own = cut(docs.select("doc_id", F.coalesce("source", F.lit("")).alias("part"), F.unhex(F.sha2(text, 256)).alias("sha"), own_failures(text).alias("own")))
    first = cut(own.groupBy("sha").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("n")).filter("n > 1").select("sha", "least"))
    label = labels.filter("doc_id IS NOT NULL").groupBy("doc_id").agg(F.max((F.col("quality") == 1).cast("int")).alias("good"), F.max((F.col("toxic") == 1).cast("int")).alias("toxic"))
    copy = F.coalesce(F.col("doc_id") > F.col("least"), F.lit(False))
    joined = own.join(checked(first), "sha", "left").join(label, "doc_id", "left")
    return joined.select("part", (F.col("own") + F.when(copy, 16).otherwise(0)).alias("failures"), F.coalesce("good", F.lit(0)).alias("good"), F.coalesce("toxic", F.lit(0)).alias("toxic"))


def replay(failures: DataFrame) -> DataFrame:
    """``part, filter_order, step`` with its counts, for ``part, failures, good, toxic`` of each document.

    Every document meets the 120 orders, which are broadcast; its first failure in an order is an expression, and its five steps are added up in the task, by part,
    order and step, before anything is shuffled. ``shapley`` adds up a filter's 120 sums of a part.
    """
    spark = failures.sparkSession
    orders = spark.createDataFrame([("".join(o), [1 << FILTERS.index(x) for x in o]) for o in permutations(FILTERS)], "filter_order string, bits array<int>")
    written = cut(failures)
    rows = written.count()
    spread = written.repartition(max(1, min(-(-rows // TASK_ROWS), MOST_TASKS + rows // 1_000_000)))
    fails = lambda bit: F.col("failures").bitwiseAND(bit) != 0
    first = F.lit(len(FILTERS) + 1)
    for k in reversed(range(len(FILTERS))):
        first = F.when(fails(F.get("bits", F.lit(k))), k + 1).otherwise(first)
    crossed = spread.crossJoin(F.broadcast(orders)).withColumn("first", first)
    steps = crossed.select("part", "filter_order", "failures", "good", "toxic", "first", F.posexplode("bits").alias("at", "bit")).withColumn("step", F.col("at") + 1)
    total = lambda x: F.sum(x.cast("long"))
    removed = F.col("first") == F.col("step")
    counts = steps.groupBy("part", "filter_order", "step").agg(
        total(F.col("first") > F.col("step")).alias("kept"), total(removed).alias("removed"), total(fails(F.col("bit")) & (F.col("first") < F.col("step"))).alias("redundant"),
        total(F.col("failures") == F.col("bit")).alias("unique_fails"), total(removed & (F.col("good") == 1)).alias("good_lost"), total(removed & (F.col("toxic") == 1)).alias("toxic_lost"),
    )
    letter = F.substring("filter_order", F.col("step"), F.lit(1))
    counts = cut(counts.withColumn("letter", letter))
    shapley = counts.groupBy("part", "letter").agg(F.sum("removed").alias("shapley"))
    return counts.join(shapley, ["part", "letter"]).drop("letter")


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """How five filters act on documents (``doc_id, text, source``) in every order of theirs, next to labels (``doc_id, quality, toxic``).

    Conditions of failure: A under 200 words, B under half as many distinct words as words, C more than 2 capitals A-Z in 100 characters, D one of ``#$%&*|``, E a
    text that a smaller doc_id has too, whether or not that one stays. A row for each part (a source value), order and step: documents ``kept`` after the step and ``removed`` by it;
    ``redundant``, which fail its filter and went before; ``unique_fails``, which fail no other filter; ``good_lost`` and ``toxic_lost`` of those it removed; and
    ``shapley``, what its filter removed in all orders together.

    Null texts and sources are empty. An empty text fails A alone, and E where it repeats. A null id is never smaller and never larger than another, so such rows pass E; rows that
    share id and text pass it too unless a smaller id has that text. A document counts as good or toxic if any of its label rows says 1. Words and texts of any length are read whole. Rows are
    counted as often as they are there. No documents give no rows. Other columns are left out.
    """
    return replay(document_failures(docs, labels))


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))


OP13_SQL = r"""
WITH texts AS (
    SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text FROM documents
), worded AS (
    SELECT *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words, min(doc_id) OVER (PARTITION BY text) AS least FROM texts
), label AS (
    SELECT doc_id, max((quality = 1)::INT) AS good, max((toxic = 1)::INT) AS toxic FROM labels GROUP BY doc_id
), flags AS (
    SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic,
        (len(words) < 200)::INT + 2 * (100 * list_unique(words) < 50 * len(words))::INT + 4 * (100 * len(regexp_extract_all(text, '[A-Z]')) > 2 * length(text))::INT
        + 8 * regexp_matches(text, '[#$%&*|]')::INT + 16 * coalesce(doc_id > least, false)::INT AS failures
    FROM worded LEFT JOIN label USING (doc_id)
), letter AS (
    SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x
), orders AS (
    SELECT a.x || b.x || c.x || d.x || e.x AS filter_order FROM letter a, letter b, letter c, letter d, letter e
    WHERE len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5
), steps AS (
    SELECT filter_order, i AS step, (1 << strpos('ABCDE', filter_order[i]) - 1)::INT AS bit,
        coalesce(list_sum(list_transform(range(1, i), lambda j: 1 << strpos('ABCDE', filter_order[j]) - 1)), 0)::INT AS before
    FROM orders, range(1, 6) AS r(i)
), replayed AS (
    SELECT part, filter_order, step::INT AS step, bit,
        count(*) FILTER (failures & (before | bit) = 0) AS kept, count(*) FILTER (failures & before = 0 AND failures & bit <> 0) AS removed,
        count(*) FILTER (failures & before <> 0 AND failures & bit <> 0) AS redundant, count(*) FILTER (failures = bit) AS unique_fails,
        count(*) FILTER (failures & before = 0 AND failures & bit <> 0 AND good = 1) AS good_lost, count(*) FILTER (failures & before = 0 AND failures & bit <> 0 AND toxic = 1) AS toxic_lost
    FROM flags, steps GROUP BY ALL
)
SELECT * EXCLUDE (bit), (sum(removed) OVER (PARTITION BY part, bit))::BIGINT AS shapley FROM replayed
"""
