"""Rows of nested records: cleaning, rendering, and fields that several columns claim."""

from __future__ import annotations

from pyspark.sql import functions as F

from talentloom.functions import nested, sections
from talentloom.operators.claims import Claim, resolved, resolved_rows, unpivoted
from talentloom.plans.profiles import PROFILES_SQL, profiles, table

QUERIES: dict = {}


def query(sql: str | None = None):
    def put(f):
        QUERIES[f.__name__] = (f, sql)
        return f

    return put


#: Columns that claim a name, an e-mail address or a number: column -> (expression in both dialects, field, how sure the mapping is).
CLAIMS = {
    "title": ("CASE p_partkey % 4 WHEN 0 THEN NULL WHEN 1 THEN ' ' ELSE p_name END", "name", 0.6),
    "kind": ("CASE WHEN p_partkey % 3 <> 0 THEN p_type END", "name", 0.9),
    "label": ("p_brand", "name", 0.95),
    "mail": ("CASE p_partkey % 5 WHEN 0 THEN 'x' WHEN 1 THEN concat('u', p_partkey, '@mail.example') END", "email", 0.7),
    "contact": ("CASE p_partkey % 3 WHEN 0 THEN 'a@b.c' WHEN 1 THEN concat('c', p_partkey, '@post.example') END", "email", 0.72),
    "note": ("concat('user ', p_partkey)", "email", 0.85),
    "before": ("p_size - 25", "size", 0.9),
    "after": ("p_size % 7", "size", 0.9),
}
_IS_NUMBER = {"before", "after"}


def _quality(column: str, field: str) -> str:
    if column in _IS_NUMBER:
        return f"CASE WHEN {column} > 0 THEN 6 ELSE 2 END"
    fits = {"name": f"trim({column}) <> '' AND NOT regexp_matches({column}, '[0-9]')", "email": f"contains({column}, '@') AND contains({column}, '.')"}[field]
    return f"least(10, 2 + CASE WHEN trim({column}) <> '' THEN 2 ELSE 0 END + CASE WHEN length(trim({column})) > 5 THEN 2 ELSE 0 END + CASE WHEN {fits} THEN 4 ELSE 0 END)"


def _held(field: str) -> str:
    """The claims of a field as a list, and the one that stays, in DuckDB SQL."""
    mine = [(c, sure) for c, (_, f, sure) in CLAIMS.items() if f == field]
    entries = ", ".join(f"{{'v': {c}::varchar, 's': '{c}', 'q': {_quality(c, field)}, 'sure': {str(sure > 0.8).lower()}}}" for c, sure in mine)
    there = f"list_filter([{entries}], lambda x: x.v IS NOT NULL AND trim(x.v) <> '')"
    return f"list_reduce(list_prepend({{'v': NULL, 's': NULL, 'q': 0, 'sure': false}}, {there}), lambda a, b: CASE WHEN b.q > a.q OR (b.q = a.q AND b.sure) THEN b ELSE a END) AS {field}, len({there}) AS n_{field}"


_CLAIMED = f"c AS (SELECT p_partkey, {', '.join(f'{e} AS {c}' for c, (e, _, _) in CLAIMS.items())} FROM part), r AS (SELECT p_partkey, {', '.join(_held(f) for f in ('name', 'email', 'size'))} FROM c)"


def _claimed(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", *(F.expr(e).alias(c) for c, (e, _, _) in CLAIMS.items())), [Claim(c, f, sure) for c, (_, f, sure) in CLAIMS.items()]


@query(f"WITH {_CLAIMED} SELECT p_partkey, " + ", ".join(f"{f}.v AS {f}, {f}.s AS {f}_from, {f}.q AS {f}_quality, n_{f}" for f in ("name", "email", "size")) + " FROM r")
def claimed_fields(spark, sf_dir):
    """Three fields that eight columns claim: the values of the highest quality, sure mappings win ties."""
    df, claims = _claimed(spark, sf_dir)
    r = resolved(df, claims, ["p_partkey"])
    out = [c for f in ("name", "email", "size") for c in (F.col(f"{f}.value").cast("string").alias(f), F.col(f"{f}.source").alias(f"{f}_from"), F.col(f"{f}.quality").alias(f"{f}_quality"), F.col(f"{f}.n_claims").cast("long").alias(f"n_{f}"))]
    return r.select("p_partkey", *out)


@query(f"WITH {_CLAIMED} " + " UNION ALL ".join(f"SELECT p_partkey, '{f}' AS field, {f}.v AS value, {f}.s AS source, n_{f} AS n_claims FROM r WHERE n_{f} > 0" for f in ("name", "email", "size")))
def claimed_rows(spark, sf_dir):
    """The same where claims are rows of (key, field, value), combined before the shuffle."""
    df, claims = _claimed(spark, sf_dir)
    return resolved_rows(unpivoted(df, claims, ["p_partkey"]), ["p_partkey"]).select("p_partkey", "field", "value", "source", "n_claims")


@query("""SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN '  ' ELSE lower(c_name) END AS name, CASE WHEN c_custkey % 4 > 1 THEN 'No. ' || c_nationkey END AS note, c_mktsegment AS title,
CASE WHEN c_custkey % 5 = 0 THEN 0 ELSE 2 END AS n_tags, CASE WHEN c_custkey % 5 <> 0 THEN c_mktsegment || '|x' ELSE '' END AS tags, CASE WHEN c_custkey % 2 = 0 THEN 'v' || c_custkey END AS inner_value FROM customer""")
def cleaned_records(spark, sf_dir):
    """Strings three levels deep in structs, arrays and maps: trimmed, blank ones null, blank entries gone; a name that must be there keeps its blank."""
    built = F.expr("""named_struct('name', CASE WHEN c_custkey % 3 = 0 THEN '  ' ELSE concat(' ', c_name, ' ') END, 'note', CASE c_custkey % 4 WHEN 0 THEN '' WHEN 1 THEN NULL ELSE concat('No. ', c_nationkey, '\t') END,
        'jobs', array(named_struct('title', concat('\n', c_mktsegment), 'tags', CASE WHEN c_custkey % 5 = 0 THEN array(' ', CAST(NULL AS string)) ELSE array(concat(c_mktsegment, ' '), '', 'x') END, 'more', map('k', named_struct('v', CASE WHEN c_custkey % 2 = 0 THEN concat(' v', c_custkey) ELSE '  ' END)))))""")
    clean = nested.cleaned_rows(table(spark, sf_dir, "customer").select("c_custkey", built.alias("r")), required={"r.name"}, lower={"r.name"})
    job = F.element_at("r.jobs", 1)
    return clean.select("c_custkey", "r.name", "r.note", job["title"].alias("title"), F.size(job["tags"]).alias("n_tags"), F.array_join(job["tags"], "|").alias("tags"), job["more"]["k"]["v"].alias("inner_value"))


#: Fields of a spreadsheet row for each customer, many of them absent: field -> expression in both dialects.
ROW = {
    "name": "lower(c_name)", "email": "CASE WHEN c_custkey % 3 <> 0 THEN concat('C', c_custkey, '@Mail.Example') END", "age": "CASE WHEN c_custkey % 4 = 0 THEN 20 + c_custkey % 30 END",
    "current_role": "CASE WHEN c_custkey % 2 = 0 THEN c_mktsegment END", "current_company": "CASE WHEN c_custkey % 5 <> 0 THEN concat('nation ', c_nationkey) END", "experience_years": "CASE WHEN c_custkey % 7 <> 0 THEN c_custkey % 20 END",
    "skills": "CASE WHEN c_custkey % 3 = 1 THEN array[c_mktsegment, concat('s', c_custkey % 9)] END", "degree": "CASE WHEN c_custkey % 4 = 1 THEN 'BSc' END", "graduation_year": "CASE WHEN c_custkey % 2 = 1 THEN 2000 + c_custkey % 20 END",
    "current_salary": "CASE WHEN c_custkey % 5 = 2 THEN c_custkey END", "notice_period": "CASE WHEN c_custkey % 6 = 0 THEN '30 days' END", "languages": "CASE WHEN c_custkey % 8 = 0 THEN array['en', 'de'] END",
}
_ROWS_SQL = "r AS (SELECT c_custkey, " + ", ".join(f"{e} AS {f}" for f, e in ROW.items()) + " FROM customer)"


def _rows(spark, sf_dir):
    return table(spark, sf_dir, "customer").select("c_custkey", *(F.expr(e.replace("array[", "array(").replace("]", ")")).alias(f) for f, e in ROW.items()))


_SUMMARY = "nullif(concat_ws('. ', coalesce('Currently working as ' || current_role || ' at ' || current_company, 'Currently working as ' || current_role, 'Associated with ' || current_company), 'with ' || experience_years || ' years of professional experience'), '') || '.'"
_WORK = "CASE WHEN coalesce(current_role, current_company) IS NOT NULL THEN nullif(concat_ws(chr(10), 'Current Role: ' || current_role, 'Company: ' || current_company, 'Total Experience: ' || experience_years || ' years'), '') END"
_PARTS = {
    "PERSONAL INFORMATION": "concat_ws(chr(10), upper(name[1]) || name[2:], lower(email), 'Age: ' || age)", "CONTACT INFORMATION": "'Email: ' || lower(email)", "PROFESSIONAL SUMMARY": _SUMMARY, "WORK EXPERIENCE": _WORK,
    "SKILLS & EXPERTISE": "'Skills: ' || array_to_string(skills, ', ')", "EDUCATION": "nullif(concat_ws(chr(10), 'Degree: ' || degree, 'Year: ' || graduation_year), '')",
    "SALARY & PREFERENCES": "nullif(concat_ws(chr(10), 'Current Salary: ' || current_salary, 'Notice Period: ' || notice_period), '')", "ADDITIONAL INFORMATION": "'Languages: ' || array_to_string(languages, ', ')",
}


@query(f"WITH {_ROWS_SQL} SELECT c_custkey, concat_ws(chr(10) || chr(10), " + ", ".join(f"'{t}:' || chr(10) || {e}" for t, e in _PARTS.items()) + ", '---' || chr(10) || 'Profile generated from Excel data') AS body FROM r")
def row_texts(spark, sf_dir):
    """Spreadsheet rows as texts of eight sections; what is absent leaves no line."""
    rows = _rows(spark, sf_dir)
    return rows.select("c_custkey", sections.row_text(rows.schema).alias("body"))


def _json(*pieces: str) -> str:
    """DuckDB SQL of a section: its pieces that are there, or null."""
    return "'{' || nullif(concat_ws(',', " + ", ".join(pieces) + "), '') || '}'"


_quoted = lambda f: f"'\"{f}\":\"' || {f} || '\"'"
_bare = lambda f: f"'\"{f}\":' || {f}"
_list = lambda f: f"'\"{f}\":[\"' || array_to_string({f}, '\",\"') || '\"]'"
_SECTIONS = {
    "personal_information": _json(_quoted("name"), _bare("age")), "contact_information": _json(_quoted("email")), "professional_summary": _json(_quoted("current_role"), _quoted("current_company"), _bare("experience_years")),
    "work_experience": _json(_quoted("current_role"), _quoted("current_company"), _bare("experience_years")), "skills_expertise": _json(_list("skills")), "education": _json(_quoted("degree"), _bare("graduation_year")),
    "salary_preferences": _json(_bare("current_salary"), _quoted("notice_period")), "additional_information": _json(_list("languages")),
}


@query(f"WITH {_ROWS_SQL} SELECT c_custkey, '{{' || concat_ws(',', " + ", ".join(f"'\"{t}\":' || {e}" for t, e in _SECTIONS.items()) + ") || '}' AS sections FROM r")
def row_sections(spark, sf_dir):
    """The same rows as JSON by section."""
    rows = _rows(spark, sf_dir)
    return rows.select("c_custkey", nested.sectioned(rows.schema, sections.JSON_SECTIONS).alias("sections"))


_NA = "'N/A'"
_LINES = [
    "''", "'RESUME'", "''", "'PERSONAL INFORMATION'", f"'{'-' * 19}'", "'Name: ' || name", "'Contact Details:'", "'  Email: N/A'", "'  Phone: N/A'", "'  Alternative Phone: N/A'", "'  Current City: ' || current_city", "'  Looking for jobs in: ' || array_to_string(looking_for, ', ')",
    "'  Gender: N/A'", "'  Age: N/A'", "'  PAN Card: N/A'", "'  Aadhar Card: N/A'", "''", "'PROFESSIONAL SUMMARY'", f"'{'-' * 19}'", "'Total Experience: ' || total_experience || ' years'", "'Notice Period: N/A days'",
    f"'Current Salary: INR ' || coalesce(round(current_salary)::bigint::varchar, {_NA}) || ' (yearly)'", "'Expected Salary: INR ' || round(expected_salary)::bigint || ' (yearly)'", "'Hike Expected: N/A%'", "'Last Working Day: N/A'", "'Exit Reason: N/A'", "''",
    "'SKILLS'", "'------'", f"'Primary Skills: ' || coalesce(nullif(array_to_string(skills, ', '), ''), {_NA})", "'Additional Skills: ' || array_to_string(may_also, ', ')", "'Labels: ' || array_to_string(labels, ', ')", "''", "'PROFESSIONAL EXPERIENCE'", f"'{'-' * 22}'",
    "CASE WHEN len(experience) = 0 THEN 'N/A' ELSE array_to_string(list_transform(experience, lambda e: chr(10) || 'Company: ' || e.company || chr(10) || 'Title: ' || e.title || chr(10) || 'Duration: ' || e.from_date || ' to ' || e.until || chr(10)), chr(10)) END", "''",
    "'EDUCATION'", "'---------'", "chr(10) || 'Degree: ' || education[1] || chr(10) || 'College: N/A' || chr(10) || 'Pass Year: N/A' || chr(10)", "''", "'ADDITIONAL INFORMATION'", f"'{'-' * 21}'", "'Tier 1 MBA: ' || CASE WHEN profile_id % 2 = 0 THEN 'Yes' ELSE 'No' END", "'Tier 1 Engineering: No'", "'Comments: N/A'", "''",
    "'PROFESSIONAL LINKS'", f"'{'-' * 17}'", "'Naukri Profile: N/A'", "'LinkedIn Profile: N/A'", "'Portfolio: N/A'", "''",
]


@query(f"WITH {PROFILES_SQL} SELECT profile_id, concat_ws(chr(10), {', '.join(_LINES)}) AS body FROM profiles")
def combined_resumes(spark, sf_dir):
    """Stored profiles as texts of all sections, absent fields shown; what an embedding model reads."""
    p = profiles(spark, sf_dir)
    whole = lambda c: F.round(c).cast("long").alias(c)
    rows = p.select(
        "profile_id", F.struct("name", "current_city", F.col("looking_for").alias("looking_for_jobs_in")).alias("contact_details"), "total_experience", whole("current_salary"), whole("expected_salary"), F.lit("INR").alias("currency"), F.lit("yearly").alias("pay_duration"),
        "skills", F.col("may_also").alias("may_also_known_skills"), "labels", "experience", F.transform("education", lambda e: F.struct(e.alias("education"))).alias("academic_details"), (F.col("profile_id") % 2 == 0).alias("is_tier1_mba"),
    )
    return rows.select("profile_id", sections.profile_text(rows.schema).alias("body"))
