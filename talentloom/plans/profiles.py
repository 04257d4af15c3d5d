"""Candidate profiles made of the customers' tables, in Spark and as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame, key: str) -> DataFrame:
    """The rows dealt out by a key to as many tasks as a shuffle has, for work that is heavy for each row: files that compress well are few tasks' otherwise, however many rows they hold."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), key)


def profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A profile for each customer: orders are its experience (newest first), their priorities its skills, the segment what else it knows."""
    t = lambda name: table(spark, sf_dir, name)
    month = lambda c: F.date_format(c, "yyyy-MM")
    word = F.lower(F.substring("o_orderpriority", 3, 100))
    job = F.struct((-F.unix_seconds(F.to_timestamp("o_orderdate"))).alias("at"), F.col("o_orderkey").alias("key"), word.alias("title"), F.col("o_orderstatus").alias("company"), month("o_orderdate").alias("from_date"), month(F.add_months("o_orderdate", 8)).alias("until"))
    jobs = t("orders").groupBy("o_custkey").agg(F.array_sort(F.collect_list(job)).alias("jobs"), F.array_sort(F.collect_set(word)).alias("skills"), F.max("o_totalprice").alias("current_salary"), F.count(F.lit(1)).alias("n"))
    none = F.array().cast("array<string>")
    joined = t("customer").join(t("nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(t("region"), F.col("n_regionkey") == F.col("r_regionkey")).join(jobs, F.col("c_custkey") == F.col("o_custkey"), "left")
    return joined.select(
        F.col("c_custkey").alias("profile_id"),
        F.col("c_nationkey").alias("user_id"),
        F.col("c_name").alias("name"),
        F.lower("n_name").alias("current_city"),
        F.array(F.lower("r_name")).alias("looking_for"),
        F.coalesce("skills", none).alias("skills"),
        F.array(F.lower("c_mktsegment")).alias("may_also"),
        F.array(F.concat(F.lower("c_mktsegment"), F.lit(" specialist"))).alias("labels"),
        F.array(F.concat(F.lower("c_mktsegment"), F.when(F.col("c_custkey") % 3 == 0, F.lit(" degree")).otherwise(F.lit(" diploma")))).alias("education"),
        F.transform(F.coalesce("jobs", F.array().cast("array<struct<at:bigint,key:bigint,title:string,company:string,from_date:string,until:string>>")), lambda x: F.struct(x["title"].alias("title"), x["company"].alias("company"), x["from_date"].alias("from_date"), x["until"].alias("until"))).alias("experience"),
        F.concat(F.coalesce("n", F.lit(0)).cast("string"), F.lit(" years "), (F.col("c_custkey") % 12).cast("string"), F.lit(" months")).alias("total_experience"),
        (F.col("c_acctbal") * 100).alias("expected_salary"),
        "current_salary",
    )


PROFILES_SQL = """
jobs AS (SELECT o_custkey,
    list(struct_pack(title := lower(substr(o_orderpriority, 3)), company := o_orderstatus, from_date := strftime(o_orderdate, '%Y-%m'), until := strftime(o_orderdate + INTERVAL 8 MONTH, '%Y-%m')) ORDER BY o_orderdate DESC, o_orderkey) AS experience,
    list_sort(list_distinct(list(lower(substr(o_orderpriority, 3))))) AS skills, max(o_totalprice) AS current_salary, count(*) AS n FROM orders GROUP BY o_custkey),
profiles AS (SELECT c_custkey AS profile_id, c_nationkey AS user_id, c_name AS name, lower(n_name) AS current_city, [lower(r_name)] AS looking_for, coalesce(skills, []) AS skills, [lower(c_mktsegment)] AS may_also,
    [lower(c_mktsegment) || ' specialist'] AS labels, [lower(c_mktsegment) || CASE WHEN c_custkey % 3 = 0 THEN ' degree' ELSE ' diploma' END] AS education, coalesce(experience, []) AS experience,
    coalesce(n, 0)::varchar || ' years ' || (c_custkey % 12)::varchar || ' months' AS total_experience, c_acctbal * 100 AS expected_salary, current_salary
    FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey LEFT JOIN jobs ON c_custkey = o_custkey)"""
