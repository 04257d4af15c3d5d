from pyspark.sql import functions as F

from talentloom.functions import resumes
from talentloom.plans import resume_queries

JOB = "array<struct<title: string, company: string, n: int>>"


def plan(df):
    return df._jdf.queryExecution().analyzed().toString()


def test_readings_are_merged_once(spark):
    rows = [([("Clerk", "A", 1), ("boss", None, 2)], [(" CLERK", "a ", 3), ("Boss", None, 4), (None, None, 5), (None, "B", 6)]), ([], None), ([("x", "y", 7)], [])]
    df = spark.createDataFrame(rows, f"a {JOB}, b {JOB}").select(resumes.merged_jobs(F.reverse("a"), F.reverse(F.reverse("b"))).alias("j"))
    assert plan(df).count("reverse(a#") == 1
    assert [r.j and [x.n for x in r.j] for r in df.collect()] == [[2, 1, 5, 6], None, [7]]


def test_a_resume_is_read_once(spark):
    df = spark.createDataFrame([("EXPERIENCE\nClerk at Works of some name\nJan 2001 - Mar 2004\n",)], "t string")
    months, jobs = df.select(resumes.months_by_spans(F.col("t"), "2025-06-15").alias("m")), df.select(resumes.jobs(F.col("t"), "2025-06-15").alias("j"))
    assert plan(months).split("+- ")[0].count("initcap(") == 1
    assert plan(jobs).split("+- ")[0].count("regexp_extract_all(") == 1
    assert [tuple(x) for x in jobs.first().j] == [("Clerk", "Works of some name", "2001-01", "2004-03", False)]


DATES = ("January 2001", "MAY 2020", "Sep 1999", "Sept 1999", "03/2004", "3/2004", "2004-03-09", "+12004-03-09", "09/03/2004", "2004", "02004", "03-2004", "March 9, 2004", "May 19, 2004", "9 March 2004", "-9 March 2004", "09-03-2004", "May 9,2004", "03/04",
         "13/04", " 2004 ", "2004\n", "31/02/2004", "Présent", "present", "NOW", "", "x", "ſep 1999", "٢٠٠٤", None)


def test_only_forms_of_a_dates_shape_are_tried(spark):
    df = spark.createDataFrame([(d,) for d in DATES], "t string")
    plain = F.coalesce(*(F.try_to_timestamp(F.trim("t"), F.lit(w)) for w in resumes.DATE_FORMS)).cast("date").cast("string")
    got = {r.t: (r.d, r.plain) for r in df.select("t", resumes.day(F.col("t"), "2025-06-15").cast("string").alias("d"), plain.alias("plain")).collect()}
    assert got["present"][0] == got["NOW"][0] == "2025-06-15"
    assert {t for t, (d, p) in got.items() if d != p} == {"present", "NOW"}
    assert sum(d is not None for d, _ in got.values()) > 15
    shapes = [len([w for w in resumes.DATE_FORMS if df.filter(F.col("t") == t).filter(F.col("t").rlike(resumes.shape(w))).count()]) for t in ("2004", "x", "03/2004")]
    assert shapes == [1, 0, 1]


def test_small_files_are_dealt_out(spark, small):
    assert resume_queries._texts(spark, small).rdd.getNumPartitions() == 4
