import random
from difflib import SequenceMatcher

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from talentloom.functions import context, durations, ingest, resumes, scoring, text, validation
from talentloom.functions.similarity import sequence_ratio
from talentloom.operators import searches, tables, terms, vectors
from talentloom.operators.similar_texts import similar_texts
from talentloom.plans import ingest_queries, table_queries


def value(spark, expression, **columns):
    return spark.createDataFrame([Row(**columns)]).select(expression.alias("x")).first()[0]


def test_months_of(spark):
    for said, want in {"2 years 6 months": 30, "5 yrs": 60, "7": 84, "18 months": 18, "2.5 years": 60, "": 0, "none": 0}.items():
        assert value(spark, durations.months_of(F.col("s")), s=said) == want


def test_months_between(spark):
    f = durations.months_between(F.col("a"), F.col("b"), "2025-06")
    for a, b, want in [("2020-01", "2021-03", 14), ("2020-01", "", 65), ("2020-01", "2019-01", 1), ("x", "2020-01", 0), ("2020", "", 0)]:
        assert value(spark, f, a=a, b=b) == want


def test_year_month(spark):
    for said, want in {"2020-05-17": "2020-05", "05/2019": "2019-05", "Jan 2018": "2018-01", "soon": None}.items():
        assert value(spark, durations.year_month(F.col("s")), s=said) == want


def test_mask(spark):
    assert value(spark, text.mask_pii(F.col("s")), s="a.b@c.org or 9876543210, 123-456-7890") == "****@****.*** or ***-***-****, ***-***-****"


def test_sequence_ratio(spark):
    a, b = "senior python developer", "python developer senior"
    assert value(spark, sequence_ratio("a", "b"), a=a, b=b) == SequenceMatcher(None, a, b).ratio()


def test_split_skills(spark):
    assert value(spark, text.split_skills(F.col("s")), s="Python, SQL and Spark; 2020 | etc / C++ or -Go-") == ["Python", "SQL", "Spark", "C++", "Go"]


PROFILE = {
    "current_city": "Bangalore", "looking_for": ["Mumbai", "Delhi"], "skills": ["Python", "Machine Learning", "Django", "AWS"], "may_also": ["JavaScript", "React"], "labels": ["Software Engineer", "Python Developer"],
    "total_experience": "5.5", "expected_salary": 1_200_000.0, "current_salary": 0.0, "education": ["BTech in Computer Science"],
    "experience": [Row(title="Senior Software Engineer", company="Tech Corp", from_date="2020-01", until=None), Row(title="Software Developer", company="StartupXYZ", from_date="2018-01", until="2020-01")],
}
SCHEMA = "current_city string, looking_for array<string>, skills array<string>, may_also array<string>, labels array<string>, total_experience string, expected_salary double, current_salary double, education array<string>, experience array<struct<title:string,company:string,from_date:string,until:string>>"


def profile(spark, **changes):
    row = PROFILE | changes
    return spark.createDataFrame([tuple(row[c.split()[0]] for c in SCHEMA.split(", "))], SCHEMA)


def test_priority_scenarios(spark):
    want = {"Python developer": 0.47, "Software engineer in Mumbai": 0.64, "Machine learning engineer 3 years": 0.61, "Developer in Chennai 8 lakh salary": 0.32, "Java developer in Delhi": 0.71}
    for query, score in want.items():
        assert round(profile(spark).select(scoring.priority_score(query)["priority"]).first()[0], 6) == score, query


def test_criteria_scenario(spark):
    c = scoring.Criteria(titles=("Software Engineer",), skills=("Python", "React", "AWS"), education=("BTech",), locations=("Mumbai",), min_months=30, max_months=60, min_salary=500_000, max_salary=1_500_000)
    df = profile(spark, current_city="Mumbai", total_experience="2 years 6 months", expected_salary=1_500_000.0, experience=[Row(title="Software Engineer", company="x", from_date="2020-01", until=None)], looking_for=["Mumbai"])
    row = df.select(*(v.alias(k) for k, v in scoring.criteria_score(c).items())).first()
    assert (row.base_score, row.match_score, row.fields_matched, row.single_matches) == (69.0, 79.0, 6, 9)


def test_detected_types(spark):
    want = {"a@b.org": "email", "5 years": "experience", "12 lakh": "currency", "85%": "percentage", "2019-05-01": "date", "Immediate": "duration", "Python, SQL": "list", "2015": "year", "plain": "text"}
    for said, kind in want.items():
        assert value(spark, ingest.detect(F.col("s"))["type"], s=said) == kind, said


def test_normalised(spark):
    assert value(spark, ingest.amount(F.col("s")), s="1.5 crore") == 1.5e7
    assert value(spark, ingest.percent(F.col("s")), s="8.5/10") == 85.0
    assert value(spark, ingest.notice_days(F.col("s")), s="30 days") == 30
    assert value(spark, ingest.notice_days(F.col("s")), s="2 weeks") == 14
    assert value(spark, ingest.notice_days(F.col("s")), s="Immediate") == 0


def test_headers():
    assert ingest.clean_headers(["Full Name ", "E-Mail", "e mail", "Salary (INR)"]) == ["full_name", "e_mail", "e_mail_2", "salary_inr"]
    assert ingest.kept_headers(["Name", " name ", "Mail", "NAME"]) == [0, 2]


def test_header_mapping():
    synonyms = {"name": ["full name"], "email": ["e-mail", "mail"], "phone": ["phone number", "mobile"], "skills": ["key skills"], "current_salary": ["ctc"]}
    mapped = ingest.map_headers(["Candidate Full Name", "Mail", "Phone No", "Tech Stack", "Package", "xyz"], synonyms)
    assert {h: f for h, (f, _) in mapped.items()} == {"Candidate Full Name": "name", "Mail": "email", "Phone No": "phone", "Tech Stack": "skills", "Package": "salary"}
    assert mapped["Mail"][1] == 1.0 and mapped["Tech Stack"][1] == ingest.PATTERN_SHARE
    assert ingest.header_scores("career", {})["current_role"] == ingest.AREA_SHARE
    # a field that is held goes to a header that fits it more than a tenth better; else that header takes its next best field
    assert ingest.map_headers(["Mailing", "email"], synonyms)["email"] == ("email", 1.0)
    assert ingest.map_headers(["email", "mail"], synonyms) == {"email": ("email", 1.0), "mail": ("phone", 0.6)}
    assert ingest.unmapped(["Mail", "xyz"], {"Mail": ("email", 1.0)}, ["email", "name"]) == (["xyz"], ["name"])


MINIMAL = "Jane Smith\njane@email.com\n+1-555-123-4567\n\nWORK EXPERIENCE\nSoftware Developer at Tech Company\nJan 2020 - Present\n\nSKILLS\nPython, Java"


def test_parsed_resumes(spark):
    row = spark.createDataFrame([(MINIMAL,)], "t string").select(resumes.contact(F.col("t")).alias("c"), resumes.jobs(F.col("t"), "2025-06-15").alias("j"), resumes.skills(F.col("t"), ("java", "perl")).alias("s"), resumes.months_by_spans(F.col("t"), "2025-06-15").alias("m"), resumes.degrees(F.col("t"), 2025).alias("d")).first()
    assert (row.c.name, row.c.email, row.c.phone, row.c.city) == ("Jane Smith", "jane@email.com", "+15551234567", resumes.NO_CITY)
    assert (row.j[0].title, row.j[0].company, row.j[0].from_date, row.j[0].is_current) == ("Software Developer", "Tech Company", "2020-01", True)
    assert {"Python", "Java"} <= set(row.s) and row.m == 65 and row.d == []
    assert not value(spark, text.resume_like(F.col("s")), s="This is a recipe for bread. Mix flour and water.")


def test_months_of_entries(spark):
    entry = lambda d, a, z: value(spark, resumes.months_of_entry(F.col("d"), F.col("a"), F.col("z"), "2025-06-15"), d=d, a=a, z=z)
    said = {("2 years 3 months", "", ""): 27, ("", "March 2020", "Mar 2021"): 12, ("", "03/2020", "present"): 63, ("until present", "2020-01-15", "current"): 65, ("", "3 years ago", ""): 36, ("", "5 months ago", "x"): 5, ("", "15 March 2019", "15-03-2020"): 12, ("", "Mar 5,2019", "March 4, 2020"): 11, ("", "03/19", "2020"): 10, ("", "soon", "2020"): 0}
    assert {k: entry(*k) for k in said} == said
    assert [value(spark, resumes.spelled_out(F.col("m")), m=m) for m in (0, 1, 12, 25)] == ["No experience", "1 month", "1 year", "2 years and 1 month"]


def test_vector_fields():
    assert vectors.vector_of("projects") == "projects_text_vector"
    with pytest.raises(ValueError, match="Choose from: skills, experience"):
        vectors.vector_of("hobbies")


def test_limits_and_thresholds(spark):
    assert [tables.shown_rows(x) for x in (None, 0, -3, 1, 50, 51)] == [10, 10, 10, 1, 50, 50]
    rows = spark.createDataFrame([(1, 0.5), (2, 0.0)], "k int, s double")
    assert [tables.at_least(rows, "s", x).count() for x in (None, 0, 0.1)] == [2, 2, 1]
    failed = tables.embedded(rows, F.when(F.col("k") == 1, F.array(F.lit(1.0))), "v").filter("failed").collect()
    assert [(r.k, r.v) for r in failed] == [(2, None)]


def test_validation_by_hand(spark):
    ok = lambda v, k: tuple(value(spark, validation.validated(F.col("v"), k), v=v))
    assert ok("Jane Smith", "name") == (True, 1.0) and ok("  ", "name") == (True, 0.0) and ok("x", None) == (True, 1.0)
    assert ok("JANE", "name") == (True, pytest.approx(0.9 * 0.9)) and ok("jane2", "name")[0] is False
    assert ok("a@b.org", "email") == (True, 1.0) and ok("a b@c.org", "email") == (False, pytest.approx(0.3 * 0.6 * 0.9))
    assert ok("75", "age") == (True, 0.9) and ok("17 years", "age") == (True, 0.95) and ok("none", "age")[0] is False
    assert [validation.kind_of(x) for x in ("full_name", "CGPA", "home_address", "hobby")] == ["name", "percentage", "location", None]


def test_request_with_labelled_skills():
    assert {"spark", "scala"} <= set(context.read_request("need a data engineer. skills: spark, scala").skills)


def test_similar_texts(spark):
    rows = [(1, 1, "John works at Acme Corporation with Python and Docker every day"), (1, 2, "John works at Acme with Python and every day"), (1, 3, "A wholly different person who paints"), (2, 4, "John works at Acme with Python and every day")]
    df = spark.createDataFrame(rows, "owner int, id int, body string")
    got = {(r.id, r.match) for r in similar_texts(df.filter("id = 2"), df, ["owner"], "id", "body").collect()}
    assert got == {(2, 1)}


def test_similar_texts_of_null_owners_and_without_owners(spark, monkeypatch):
    pick = random.Random(3)
    words = "john works at acme with python and docker every day while others paint zebras".split()
    texts = [" ".join(pick.choices(words, k=pick.choice([1, 3, 8, 40, 60]))) for _ in range(25)]
    texts += [t.replace("a", "", 3) + " x" for t in texts] + ["", "", None]
    rows = [(["u", "v", None][i % 25 % 3], i, t) for i, t in enumerate(texts)] + [("u", None, texts[0])]
    df = spark.createDataFrame(rows, "owner string, id int, body string")
    plain = {r.id: r.t for r in df.select("id", text.comparable(F.col("body")).alias("t")).collect() if r.id is not None and r.t is not None}
    whose = {i: o for o, i, _ in rows}
    for owner in ([], ["owner"]):
        want = {(a, b, SequenceMatcher(None, plain[a], plain[b]).ratio()) for a in plain for b in plain if a % 3 == 0 and a != b and (not owner or whose[a] == whose[b])}
        want = {x for x in want if x[2] >= 0.7}
        assert any(whose[a] is None and whose[b] is None for a, b, _ in want)
        for size in (1 << 20, 600):
            monkeypatch.setattr("talentloom.operators.similar_texts.BLOCK_BYTES", size)
            got = [tuple(r) for r in similar_texts(df.filter("id % 3 = 0"), df, owner, "id", "body").collect()]
            assert len(got) == len(set(got)) and set(got) == want


def test_similar_documents_across_languages(spark, tmp_path):
    body = "a near copy of this text is filed under another language by mistake"
    rows = [(20, body, "en"), (21, body + " now", "de"), (40, body, None), (41, "nothing of the kind", "en")]
    spark.createDataFrame(rows, "doc_id long, text string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {(r.doc_id, r.match) for r in table_queries.similar_documents(spark, str(tmp_path)).collect()}
    assert got == {(20, 21), (20, 40), (40, 20), (40, 21)}


def test_completion_of_misspelt_prefixes(spark):
    score = lambda s, prefix, **more: value(spark, terms.completion_score(F.col("s"), prefix, **more), s=s)
    assert abs(score("Python", "pyhton") - 0.5 * 10 / 12) < 1e-9  # "py", "t" or "h", "on" in order
    assert abs(score("python", "pythn") - 0.5 * 10 / 11) < 1e-9  # in order too, but more alike
    assert abs(score("python", "pyhton", semantic=F.lit(0.6)) - 0.7) < 1e-9
    assert score("a long text with p, y and n", "pyn") == 0.3 and score("docker", "pyhton") == 0
    counts = spark.createDataFrame([("python", 5), ("docker", 5)], "term string, n long")
    none = spark.createDataFrame([], "term string, other string, n long, strength double")
    assert [r.term for r in terms.completions(counts, none, "pyhton").collect()] == ["python"]


def test_normalised_values_of_all_rows(spark, small):
    got = {r.p_partkey: tuple(r)[1:] for r in ingest_queries.normalised_values(spark, small).collect()}
    keys = {r[0] for r in spark.read.parquet(f"{small}/part.parquet").select("p_partkey").collect()}
    assert set(got) == keys
    assert all(got[k] == (919000000000.0 + k, None, 919000000000.0 + k) for k in keys if k % 11 == 1)  # "+91" and ten digits


def test_scoped(spark):
    users = spark.createDataFrame([("admin",)], "user_id string")
    rows = spark.createDataFrame([("admin",), ("user",), ("other",)], "user_id string")
    assert tables.scoped(rows, users, "admin").count() == 3
    assert [r[0] for r in tables.scoped(rows, users, "user").collect()] == ["user"]


def test_leading_rows_within_a_budget(spark, monkeypatch):
    pick = random.Random(5)
    rows = [(pick.choice(["hot", "hot", "hot", "b", None]), k, pick.choice([0, 1, 3, 40, 90, None])) for k in range(400)]
    pick.shuffle(rows)
    df = spark.createDataFrame(rows, "per string, k int, size int")
    for budget, shares in ((100, 3), (1000, 16), (0, 2)):
        monkeypatch.setattr(tables, "SHARES", shares)
        want, used = set(), {}
        for per, k, size in sorted(rows, key=lambda r: r[1]):
            if size is not None:
                used[per] = used.get(per, 0) + size
            if used.get(per, budget + 1) <= budget:
                want.add((per, k, used[per]))
        got = [(r.per, r.k, r.used) for r in tables.within_budget(df, ["per"], ["k"], F.col("size"), budget).collect()]
        assert len(got) == len(set(got)) and set(got) == want
    assert tables.within_budget(df.limit(0), ["per"], ["k"], F.col("size"), 5).count() == 0


def test_ranks_of_all_rows(spark):
    pick = random.Random(6)
    names = [None, "", "a", "ab", "abc", "abcd", "abce", "\u00e9t\u00e9"] + ["".join(pick.choices("abc", k=5)) for _ in range(60)]
    rows = [(x, pick.choice([1, 1, 1, 2, 7, None])) for x in dict.fromkeys(names)]
    df = spark.createDataFrame(rows, "name string, score int")
    order = sorted(rows, key=lambda r: (r[1] is None, -(r[1] or 0), r[0] is not None, (r[0] or "").encode()))
    assert {(r.name, r.score): r.rank for r in tables.ranked(df, "score", "name").collect()} == {r: k + 1 for k, r in enumerate(order)}
    assert tables.ranked(df.limit(0), "score", "name").count() == 0


def test_as_many_rows_as_their_quality_allows(spark):
    scores = {"good": 5.0, "fair": 2.0, "weak": 0.7, "half": 0.5, "bad": 0.1}
    for good, want in ((100, {"good": 80}), (30, {"good": 30}), (29, {"good": 29, "fair": 50}), (15, {"good": 15, "fair": 50}), (14, {"good": 14, "fair": 120, "weak": 30}), (5, {"good": 5, "fair": 120, "weak": 30}), (4, {"good": 4, "fair": 120, "weak": 90})):
        rows = [(k, i, s) for k, s in scores.items() for i in range({"good": good, "fair": 120, "weak": 90}.get(k, 7))]
        got = terms.adaptive(spark.createDataFrame(rows, "kind string, i int, score double"), "score", [F.desc("score"), "kind", "i"]).collect()
        counts = {k: [r.i for r in got if r.kind == k] for k in scores}
        assert {k: len(v) for k, v in counts.items() if v} == want, good
        assert all(sorted(v) == list(range(len(v))) for v in counts.values())


def test_words_held(spark):
    cases = [("C++ and (so) on", ("c++", "(so)"), True), ("plain", ("c++", "[x]"), False), ("a.b", ("a.c", "x"), False), ("TWO words", ("two words", "zz"), True), (None, ("a", "b"), None), (None, ("a",), None), ("x", (), False), ("\u00c9t\u00e9 #1", ("\u00e9t\u00e9 #1", "q"), True)]
    for said, words, want in cases:
        df = spark.createDataFrame([(said,)], "s string")
        assert df.select(text.holds(F.col("s"), *words)).first()[0] is want, (said, words)


def test_columns_worked_out_once(spark):
    df = spark.createDataFrame([(1, "a"), (2, None)], "k int, s string")
    out = searches.once(df, {"n": F.length("s"), "m": F.col("k") * 2}, "k")
    assert sorted(tuple(r) for r in out.collect() if r.n) == [(1, 1, 2)] and out.count() == 2
    plan = out.filter("m > 2 AND m < 9")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Filter") < plan.index("Generate"), plan


def test_record_fields(spark):
    one = lambda f, v: value(spark, f(F.col("v")), v=v)
    phones = {"9876543210": "+919876543210", "919876543210": "+919876543210", "(0) 12": "+91012", "+1 2": "+12", "none": "+91"}
    assert {k: one(validation.record_phone, k) for k in phones} == phones
    assert [one(validation.record_name, x) for x in ("null", " J. O'Neil 3", "42")] == ["Name Not Extracted", "J. ONeil", "Name Not Extracted"]
    assert [one(validation.record_pan, x) for x in ("abcde1234f", "abcd1234f", "")] == ["ABCDE1234F", None, None]
    assert [one(validation.record_aadhaar, x) for x in ("1234-5678-9012", "123", "x")] == ["123456789012", None, None]
    blank = spark.createDataFrame([(None,)], "v string")
    assert tuple(blank.select(*(f(F.col("v")) for f in (validation.record_email, validation.record_phone, validation.record_name, validation.record_city, validation.record_pan, validation.record_aadhaar))).first()) == ("email.not.found@placeholder.com", "+91-0000000000", "Name Not Extracted", "Location Not Specified", None, None)


def test_typed_text(spark):
    typed = lambda v, t: value(spark, text.matches_typed(F.col("v"), t), v=v)
    assert typed("Knows C++ well", "c++") is True and typed("C#", "(c#)") is True and typed("ab", "a.b") is False and typed("a+b", "+b") is True
