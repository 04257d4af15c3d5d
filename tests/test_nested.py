import json

import pytest
from pyspark.sql import functions as F

from talentloom.functions import nested, sections

DEEP = "id int, `a.b` string, name string, tags array<string>, box struct<note:string,n:int,jobs:array<struct<title:string,parts:array<string>,more:map<string,struct<x:string>>>>>, path string"


def deep(spark):
    box = ("  Hi ", 3, [(" Dev\t", [" a ", " ", None, "B"], {"k ": (" v ",), "l": (" ",), "m": None}), None])
    return spark.createDataFrame([(1, " X ", " ", [" a ", "", None, "b"], box, "p"), (2, None, None, None, None, None)], DEEP)


def test_three_levels(spark):
    got = {r["id"]: r.asDict(recursive=True) for r in nested.cleaned_rows(deep(spark), required={"name"}, lower={"box.jobs.parts", "a.b"}).collect()}
    assert got[1] == {"id": 1, "a.b": "x", "name": " ", "tags": ["a", "b"], "path": "p", "box": {"note": "Hi", "n": 3, "jobs": [{"title": "Dev", "parts": ["a", "b"], "more": {"k ": {"x": "v"}, "l": {"x": None}, "m": None}}, None]}}
    assert got[2] == {"id": 2, "a.b": None, "name": None, "tags": [], "box": None, "path": None}


def test_schema_and_empty_tables_stay(spark):
    df = deep(spark)
    out = nested.cleaned_rows(df, empty_lists=False)
    assert out.schema.simpleString() == df.schema.simpleString()
    assert out.limit(0).count() == 0 and out.filter("id = 2").first()["tags"] is None
    assert nested.cleaned_rows(df, lower=None).first()["box"]["jobs"][0]["title"] == "dev"


ROW = "name string, email string, phone string, age int, current_role string, current_company string, experience struct<years:int,formatted:string>, skills array<string>, degree string, graduation_year int, percentage double, current_salary double, notice_period string, work_mode string, languages array<string>, unknown string"
FULL = ("ann o'hara", "Ann@Mail.Example", "+911", 30, "dev", "acme", (5, "5 years"), ["sql", " ", "spark"], "BSc", 2015, 71.5, 10.0, "30 days", "remote", ["en", "de"], "x")


def test_all_sections_of_a_row(spark):
    df = spark.createDataFrame([FULL], ROW)
    assert df.select(sections.row_text(df.schema)).first()[0] == (
        "PERSONAL INFORMATION:\nAnn O'Hara\nann@mail.example | +911\nAge: 30\n\nCONTACT INFORMATION:\nEmail: ann@mail.example\nPhone: +911\n\n"
        "PROFESSIONAL SUMMARY:\nCurrently working as dev at acme. with 5 years of professional experience.\n\nWORK EXPERIENCE:\nCurrent Role: dev\nCompany: acme\nTotal Experience: 5 years\n\n"
        "SKILLS & EXPERTISE:\nSkills: sql, spark\n\nEDUCATION:\nDegree: BSc\nYear: 2015 | Grade: 71.5\n\nSALARY & PREFERENCES:\nCurrent Salary: 10.0\nNotice Period: 30 days\nWork Mode: remote\n\n"
        "ADDITIONAL INFORMATION:\nLanguages: en, de" + sections.FOOTER
    )
    compact = df.select(sections.row_text(df.schema, "compact")).first()[0].split("\n")
    assert compact[0] == "PERSONAL INFORMATION: Ann O'Hara" and "WORK EXPERIENCE: Current Role: dev | Company: acme | Total Experience: 5 years" in compact
    minimal = df.select(sections.row_text(df.schema, "minimal")).first()[0]
    assert minimal.startswith("Ann O'Hara\nann@mail.example | +911\nEmail:") and "Skills" not in minimal


def test_rows_with_little(spark):
    df = spark.createDataFrame([(None,) * 16, (None, " ", *[None] * 3, "acme", *[None] * 10)], ROW)
    assert [r[0] for r in df.select(sections.row_text(df.schema)).collect()] == ["", "PROFESSIONAL SUMMARY:\nAssociated with acme.\n\nWORK EXPERIENCE:\nCompany: acme" + sections.FOOTER]
    with pytest.raises(ValueError):
        nested.rendered(df.schema, sections.OF_A_ROW, "long")


def test_profile_text(spark):
    schema = "contact_details struct<name:string,looking_for_jobs_in:array<string>>, experience array<struct<company:string,title:string,from_date:string,until:string>>, is_tier1_mba boolean, skills array<string>"
    df = spark.createDataFrame([(("Ann", ["pune", "delhi"]), [("A", "dev", "2020-01", None), ("B", None, "2018-01", "2019-12")], True, []), (None, None, None, None)], schema)
    one, two = (r[0] for r in df.select(sections.profile_text(df.schema)).collect())
    assert one.startswith("\nRESUME\n\nPERSONAL INFORMATION\n-------------------\nName: Ann\nContact Details:\n  Email: N/A\n")
    assert "  Looking for jobs in: pune, delhi\n" in one and "Primary Skills: N/A\n" in one and "Tier 1 MBA: Yes\nTier 1 Engineering: No\n" in one
    assert "PROFESSIONAL EXPERIENCE\n----------------------\n\nCompany: A\nTitle: dev\nDuration: 2020-01 to Present\n\n\nCompany: B\nTitle: N/A\nDuration: 2018-01 to 2019-12\n\n\nEDUCATION\n---------\nN/A\n\nADDITIONAL" in one
    assert "PROFESSIONAL EXPERIENCE\n----------------------\nN/A\n\nEDUCATION" in two and two.endswith("Portfolio: N/A\n")


def test_json_by_section(spark):
    df = spark.createDataFrame([FULL, (None,) * 16], ROW)
    one, two = (json.loads(r[0]) for r in df.select(nested.sectioned(df.schema, sections.JSON_SECTIONS)).collect())
    assert one["work_experience"] == {"current_role": "dev", "current_company": "acme", "total_experience": {"years": 5, "formatted": "5 years"}} and one["skills_expertise"] == {"skills": ["sql", " ", "spark"]}
    assert two == {} and "unknown" not in json.dumps(one)
    assert df.select(nested.sectioned(df.select(F.col("unknown")).schema, sections.JSON_SECTIONS)).first()[0] == "{}"
