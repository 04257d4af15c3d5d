from talentloom.operators import terms


def test_title_skills(spark):
    titles = [("a", "Python "), ("b", "python"), ("b", "python"), ("a", "team"), ("b", "team"), ("c", "c"), ("c", None), (None, "java"), ("c", ""), ("c", "sql"), ("a", "x" * 20), ("a", "project")]
    rows = spark.createDataFrame(titles, "title string, skill string")
    counts = spark.createDataFrame([("python", 3), ("sql", 10)] + [(f"t{i}", 1) for i in range(38)], "term string, n long")
    got = {r["skill"]: (r["titles"], round(r["score"], 6)) for r in terms.title_skills(rows, counts, 4).collect()}
    # python: 2 + 2 / 4 * 2 + 0.3 * 1.5 + 0.5; sql is too common for its frequency to count; team is generic; project falls to 0
    assert got == {"python": (2, 3.95), "team": (2, 1.5), "sql": (1, 2.0), "x" * 20: (1, 1.5)}
    assert terms.title_skills(rows.limit(0), counts, 4).count() == 0
    assert terms.title_skills(rows, counts.limit(0), 4).filter("skill = 'python'").first()["score"] == 3.5
