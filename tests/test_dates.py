import pytest
from pyspark.sql import functions as F

from talentloom.functions import dates

#: Spelling -> month, as of 2026; None where nothing can be read or a period goes on.
SPELLINGS = {
    "2020-03-15": "2020-03", "2020-03": "2020-03", "2020/3": "2020-03", "2020.03.15": "2020-03", "2020-15-03": "2020-03", "20200315": "2020-03", "202003": "2020-03",
    "2020-03-15T10:30:00Z": "2020-03", "2020-03-15 10:30": "2020-03", "March 2020": "2020-03", "march 15, 2020": "2020-03", "15 March 2020": "2020-03", "15th of March, 2020": "2020-03",
    "Mar-2020": "2020-03", "Mar'20": "2020-03", "Mar ’20": "2020-03", "Mar 20": "2020-03", "15 Mar 20": "2020-03", "Mar 15 '20": "2020-03", "15-Mar-98": "1998-03", "98 March": "1998-03", "SEPT 2019": "2019-09", "Sep. 2019": "2019-09",
    "03/15/2020": "2020-03", "15/03/2020": "2020-03", "3/2020": "2020-03", "03-2020": "2020-03", "15.03.2020": "2020-03", "04/03/2020": "2020-04", "03/15/20": "2020-03", "15/03/20": "2020-03", "98/03/15": "1998-03", "'98-03": "1998-03", "03/20": "2020-03", "03/98": "1998-03",
    "2020": "2020-01", "in 2020": "2020-01", "'19": "2019-01", "since May 2018, at work": "2018-05", "Joined on 1st June 2017 at 9:30 am": "2017-06", "Jan 2019 - Mar 2020": "2019-01", "2020-99": "2020-01", "13/2020": "2020-01", " dec 1999 ": "1999-12", "December31,1999": "1999-12",
    "present": None, " Till Date ": None, "ongoing": None, "": None, "soon": None, "March": None, "15th of March": None, "15": None, "99/99/99": None, "market 12": None, "3000": None, "mayor": None,
}


def test_fifty_spellings(spark):
    assert len(SPELLINGS) >= 50
    rows = spark.createDataFrame([*SPELLINGS.items(), (None, None)], "said string, want string")
    for r in rows.withColumn("got", dates.written_month(F.col("said"), 2026)).collect():
        assert r["got"] == r["want"], r


def test_days_in_front(spark):
    rows = spark.createDataFrame([("04/03/2020",), ("13/03/20",), ("03/13/2020",)], "said string")
    assert [r[0] for r in rows.select(dates.written_month(F.col("said"), 2026, day_first=True)).collect()] == ["2020-03"] * 3


def test_a_fixed_month_for_what_is_unreadable(spark):
    rows = spark.createDataFrame([("soon",), ("",), (None,), ("current",), ("May 2011",), ("x" * 300_000 + " May 2011",)], "said string")
    assert [r[0] for r in rows.select(dates.month_or_default(F.col("said"), 2026)).collect()] == ["2020-01", "2020-01", "2020-01", None, "2011-05", "2011-05"]


@pytest.mark.parametrize("start, end, want", [("Mar 2020", "2019-12-31", ("2019-12", "2020-03", 3)), ("2020-01", "present", ("2020-01", None, 77)), ("2020-01", "Jan 20", ("2020-01", "2020-01", 1)), ("soon", "2020-01", (None, "2020-01", None)), (None, None, (None, None, None))])
def test_spans(spark, start, end, want):
    row = spark.createDataFrame([(start, end)], "a string, b string").select(dates.written_span(F.col("a"), F.col("b"), "2026-06").alias("s")).first()["s"]
    assert tuple(row) == want
