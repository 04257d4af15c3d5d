import pytest
from pyspark.sql import functions as F

from talentloom.functions import cleaning, context, scoring
from talentloom.operators import answers, fuzzy, searches, terms, vector_index
from talentloom.plans.profiles import profiles


@pytest.fixture(scope="module")
def vectors(spark):
    return spark.createDataFrame([(k, [float(k), 1.0, 0.5]) for k in range(30)], "id long, v array<float>")


def test_texts_are_read_until_the_first_that_does_not_fit(spark):
    hits = spark.createDataFrame([("a", 1, 0.9, 5), ("a", 2, 0.8, 6), ("a", 3, 0.7, 1), ("b", 4, 0.9, 99), ("c", 5, 0.9, 1), ("c", 6, 0.9, 1), ("c", 7, 0.1, 1)], "q string, k long, score double, size long")
    found = answers.within_context(hits, ["q"], [F.desc("score"), "k"], F.col("size"), 2, 10)
    assert {r.k for r in found.filter("read").collect()} == {1, 5, 6}
    asked = spark.createDataFrame([("a",), ("b",), ("c",), ("d",)], "q string")
    got = {r.q: (r.n_retrieved, r.n_read, r.context_length, r.exceeded) for r in answers.statistics(asked, found, "q", 10).collect()}
    assert got == {"a": (3, 1, 5, False), "b": (1, 0, 0, True), "c": (3, 2, 9, False), "d": (0, 0, 0, False)}


def test_retrieval_passes_over_rows_without_texts(spark, vectors, tmp_path):
    index = vector_index.build(vectors, "id", "v", str(tmp_path / "index"))
    questions = spark.createDataFrame([(7, [29.0, 1.0, 0.5]), (8, None)], "q long, v array<float>")
    texts = spark.createDataFrame([(29, None), (28, "x" * 300), (27, "")], "id long, text string")
    got = answers.retrieved(index, questions, "q", "v", texts, "text", "fast").collect()
    assert sorted((r.q, r.id, r.rank, r.read, len(r.preview)) for r in got) == [(7, 27, 2, True, 0), (7, 28, 1, True, 203)]
    empty = answers.retrieved(index, questions.limit(0), "q", "v", texts, "text", "fast")
    assert empty.collect() == [] and answers.statistics(questions, empty, "q").count() == 2


def test_answers_that_name_one_row_or_none(spark):
    said = [("a", '{"_id": "5"}'), ("b", 'It is {"id": 6,}'), ("c", "none"), ("d", None), ("e", '{"matches": []}'), ("f", '{"matches": [{"_id": "9"}]}')]
    given = spark.createDataFrame(said, "q string, answer string")
    assert {r.q: r.key for r in answers.chosen(given, "q", "answer").collect()} == {"a": "5", "b": "6", "c": None, "d": None, "e": None, "f": None}
    found = spark.createDataFrame([("f", 9, 0.5), ("a", 5, 0.4)], "q string, k long, score double")
    assert [tuple(r) for r in answers.ranked(given, "q", "answer", found, "k").collect()] == [("f", 1, "9", 0.0, answers.NO_REASON, 0.5, 1)]


def test_a_job_that_could_not_be_read_asks_for_nothing(spark, small):
    given = spark.createDataFrame([(1, "no job"), (2, None), (3, '{"required_skills": "sql", "experience_years": "some"}')], "job long, answer string")
    asked = given.select("job", scoring.requirements(F.col("answer")).alias("asked"))
    assert {tuple(map(str, r.asked)) for r in asked.collect()} == {("[]", "[]", "[]", "[]", "0.0")}
    got = searches.ranked_for_jobs(profiles(spark, small), asked, "profile_id", "job", "asked")
    assert {(r.skills_score, r.experience_score, r.education_score, r.missing) for r in got.collect()} == {(0.0, 0.0, 100.0, "")}


def test_a_job_as_a_column_is_scored_like_a_literal(spark, small):
    rows = profiles(spark, small)
    job = scoring.Job(titles=("urgent", "high"), required=("high", "machinery"), preferred=("low",), education=("Bachelor degree",), years=8)
    asked = spark.createDataFrame([(1, ["high", "machinery"], ["low"], ["urgent", "high"], ["Bachelor degree"], 8.0)], "job long, required array<string>, preferred array<string>, titles array<string>, education array<string>, years double")
    jobs = asked.select("job", F.struct("required", "preferred", "titles", "education", "years").alias("asked"))
    one = {tuple(r) for r in searches.ranked_for(rows, job, "profile_id").collect()}
    many = {tuple(r) for r in searches.ranked_for_jobs(rows, jobs, "profile_id", "job", "asked").drop("job").collect()}
    assert one == many and len({r[6] for r in one}) > 3


@pytest.mark.parametrize("asked", ["urgent machinery roles in mumbai 10 years 8 lakh", "nothing of it", "", "HIGH low 3.5 LAKH 7exp"])
def test_a_column_of_queries_is_scored_like_a_literal(spark, small, asked):
    rows = profiles(spark, small)
    score = lambda parts: {tuple(r) for r in rows.select("profile_id", F.round(parts["priority"], 9), parts["reason"]).collect()}
    assert score(scoring.priority_score(asked)) == score(scoring.priority_of(scoring.query_facts(F.lit(asked))))


def test_relevance_from_facts_that_were_read_before(spark, small):
    rows, request = profiles(spark, small), context.read_request("looking for urgent machinery manager in mumbai with sql, 5 to 9 years, 2 lakh salary")
    at = context.facts()
    once = context.relevance(request, at={k: F.col(k) for k in at})
    got = {tuple(r) for r in searches.once(rows, at, "profile_id").select("profile_id", F.round(once["relevance"], 9)).collect()}
    assert got == {tuple(r) for r in rows.select("profile_id", F.round(context.relevance(request)["relevance"], 9)).collect()}


def test_files_without_a_text_or_vector_find_nothing(spark, small, vectors, tmp_path):
    index = vector_index.build(vectors.withColumnRenamed("id", "profile_id"), "profile_id", "v", str(tmp_path / "index"))
    files = spark.createDataFrame([(1, "urgent high low", [3.0, 1.0, 0.5]), (2, " \n", [3.0, 1.0, 0.5]), (3, "urgent", None), (4, None, [3.0, 1.0, 0.5])], "file long, text string, v array<float>")
    found = searches.by_files(index, profiles(spark, small), files, "file", "text", "v", n=3, relevant=0).collect()
    assert {r.file for r in found} == {1} and len(found) == 3
    assert searches.by_files(index, profiles(spark, small), files.limit(0), "file", "text", "v").collect() == []


def test_co_occurring_terms_by_place(spark):
    rows = [
        (["python, django", None], ["Python Developer", "clerk", "boss", "fourth"], ["a python mind and café pytho"]),
        (["Django"], ["python boss"], None),
        (["pythons"], None, ["no such word: boss boss boss", "pytho PYTHON pytho"]),
        (None, None, None),
    ]
    df = spark.createDataFrame(rows, "s array<string>, t array<string>, d array<string>")
    got = {r.term: (r.n, round(r.relevance, 6), round(r.score, 6)) for r in terms.co_occurring(df, "Python", F.col("s"), F.col("t"), F.col("d")).collect()}
    assert got == {"pytho": (3, round(10 / 11 * 0.5, 6), round(3 + 100 / 22, 6))}  # django, boss: of no relevance; python itself, silent words and "caf" are no terms


def test_ratios_are_worked_out_behind_the_aggregation(spark):
    """a filter on the ratio went below the aggregation, so that it was worked out for every word of every text."""
    df = spark.createDataFrame([(["python"], ["pytho"], ["python pytho"])], "s array<string>, t array<string>, d array<string>")
    counts = df.select(F.explode("s").alias("term")).groupBy("term").count()
    around = terms.co_occurring(df, "Python", F.col("s"), F.col("t"), F.col("d"))
    for found in (around, fuzzy.similar(fuzzy.postings(counts, "term"), "python")):
        plan = found._jdf.queryExecution().optimizedPlan().toString()
        assert "Aggregate [" in plan.rsplit("ArrowEvalPython", 1)[1]


NASTY = {
    ("name", "JEAN-LUC o'neil"): "JEAN-LUC o'neil", ("name", "jean-luc  o'neil"): "Jean-Luc O'Neil", ("name", "J.K"): "J. K", ("name", "élan vital"): "Élan Vital", ("name", "42"): "42",
    ("email", " A b@C.org "): "ab@c.org", ("phone", "call +1 (2) 3-4"): "+1 (2) 3-4", ("location", "GOA,, , india ,"): "GOA, india ", ("location", "goa , "): "Goa ",
    ("salary", "5,00,000 INR"): 500000.0, ("salary", "12 LPA, 3 weeks"): 12.0, ("salary", "rs 7k"): 7000.0, ("salary", "in lakhs: 4.5"): 450000.0, ("experience", "x"): "x",
    ("percentage", "-5.5%"): -5.5, ("percentage", "9/10 %"): 9.0, ("skills", "a, sql,, c++"): ["sql", "c++"], ("skills", "sql"): "sql", ("other", " a  b "): "a b",
}


def test_fields_are_cleaned_by_kind(spark):
    df = spark.createDataFrame([(n, k, v) for n, (k, v) in enumerate(NASTY)], "n long, kind string, value string")
    got = {}
    for kind in {k for k, _ in NASTY}:
        for r in df.filter(F.col("kind") == kind).select("value", cleaning.cleaned(F.col("value"), kind).alias("c")).collect():
            got[kind, r.value] = next((x for x in (r.c.number, r.c["items"], r.c.text) if x is not None), None)
    assert got == NASTY


def test_blank_fields_stay_and_names_may_hold_dots(spark):
    df = spark.createDataFrame([(1, None, " \t"), (2, "ann", "x")], "`k.1` long, `a.b` string, c string")
    got = {(r[0], r.field): (r.text, r.number, r["items"], r.steps, r.score) for r in cleaning.cleaned_fields(df, ["k.1"], {"a.b": "name", "c": "salary"}).collect()}
    assert got == {(1, "a.b"): (None, None, None, [], 1.0), (1, "c"): (" \t", None, None, [], 1.0), (2, "a.b"): ("Ann", None, None, ["name_formatting"], pytest.approx(0.9)), (2, "c"): ("x", None, None, [], 1.0)}
    hard = spark.createDataFrame([("919876543210", "Ann1 Lee", "Mail: A@b.org now")], "p string, n string, m string")
    r = hard.select(cleaning.clean_phone(F.col("p"), True), cleaning.clean_name(F.col("n"), True), cleaning.clean_email(F.col("m"), True)).first()
    assert tuple(r) == ("+91 98765 43210", "Ann Lee", "a@b.orgnow")


def test_a_field_is_collapsed_once(spark):
    df = spark.createDataFrame([(1, " a, b ")], "n long, c string")
    for kind in (*cleaning.STEPS, "other"):
        plan = df.select(cleaning.cleaned(F.col("c"), kind).alias("x"))._jdf.queryExecution().analyzed().toString()
        assert plan.count("trim(regexp_replace(c#") == 1, kind
