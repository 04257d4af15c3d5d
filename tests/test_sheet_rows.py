from talentloom.functions.ingest import finite_rows
from talentloom.sources.readers import csv_rows


def test_quoted_line_ends(spark, tmp_path):
    path = f"{tmp_path}/a.csv"
    with open(path, "w") as f:
        f.write('Name,Note,Name \nAnn,"one\ntwo, ""three""",x\n , ,\nBo,plain,y\n')
    got = csv_rows(spark, path, multi_line=True)
    assert sorted(tuple(r) for r in got.collect()) == [("Ann", 'one\ntwo, "three"'), ("Bo", "plain")]
    assert got.columns == ["name", "note"]


def test_numbers_that_are_none(spark):
    nan, inf = float("nan"), float("inf")
    df = spark.createDataFrame([(1, nan, " a "), (2, inf, " "), (3, -inf, None), (4, 2.5, None), (5, None, "nan")], "id int, `x.y` double, t string")
    assert sorted((tuple(r) for r in finite_rows(df, ["id"]).collect()), key=lambda r: r[0]) == [(1, None, "a"), (4, 2.5, None), (5, None, "nan")]
    assert finite_rows(df.limit(0), ["id"]).count() == 0 and finite_rows(df.select("id"), ["id"]).count() == 5
