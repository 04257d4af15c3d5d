"""Resumes read by rules, readings merged, experience added up, gaps and highlights."""

from __future__ import annotations

from pyspark.sql import functions as F

from talentloom.functions import resumes, scoring, text
from talentloom.functions.durations import years_of
from talentloom.operators import tables
from talentloom.plans.profiles import PROFILES_SQL, profiles, spread, table

QUERIES: dict = {}
AS_OF = "2025-06-15"


def query(sql: str | None = None):
    def put(f):
        QUERIES[f.__name__] = (f, sql)
        return f

    return put


#: A resume for each customer, in words that both engines read; every part of it takes several shapes.
_NL = "chr(10)"
_RESUME = f"""concat(CASE c_custkey % 4 WHEN 0 THEN 'Email: first' WHEN 1 THEN 'Jane Smith' WHEN 2 THEN 'A Person With Many Long Names' ELSE '  Ravi Kumar  ' END, {_NL},
CASE WHEN c_custkey % 3 = 0 THEN '' ELSE concat('Email: c', c_custkey, '@mail.example', {_NL}) END,
CASE c_custkey % 3 WHEN 0 THEN '' WHEN 1 THEN concat('Phone: +91 987-654-', 1000 + c_custkey % 9000, {_NL}) ELSE concat('Phone: (987) 654-', 1000 + c_custkey % 9000, {_NL}) END,
CASE c_custkey % 4 WHEN 0 THEN concat('City: Pune.', {_NL}) WHEN 1 THEN concat('No 5 Goa, India', {_NL}) WHEN 2 THEN concat('at 5 Jaipur - 302001', {_NL}) ELSE '' END, '#1', {_NL}, '#2', {_NL}, '#3', {_NL}, '#4', {_NL},
CASE WHEN c_custkey % 5 = 0 THEN '' ELSE concat({_NL}, 'WORK EXPERIENCE', {_NL}, 'Senior Clerk at ', c_mktsegment, ' Works', {_NL}, 'Jan ', 2000 + c_custkey % 10, ' - Mar ', 2012 + c_custkey % 5, {_NL}, {_NL}, c_mktsegment, ' Ltd - Junior Clerk', {_NL}, '1995 - 1999', {_NL}, {_NL}, 'Old Company Name Here', {_NL}, 'Data analyst of sales', {_NL}) END,
CASE WHEN c_custkey % 2 = 0 THEN concat({_NL}, 'EDUCATION', {_NL}, 'B.Tech in Physics, ', 1990 + c_custkey % 8, {_NL}, 'Some Diploma', {_NL}) ELSE '' END,
CASE WHEN c_custkey % 7 = 0 THEN '' ELSE concat({_NL}, 'Skills: sql, python; c++ | ', lower(c_mktsegment), {_NL}) END)"""
VOCABULARY = ("python", "excel", "sql", "clerk")


def _texts(spark, sf_dir):
    customers = spread(table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment"), "c_custkey")
    return customers.select("c_custkey", "c_mktsegment", F.expr(_RESUME).alias("text"))


@query(f"""SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN 'noemail@notprovided.com' ELSE 'c' || c_custkey || '@mail.example' END AS email,
CASE WHEN c_custkey % 3 = 0 THEN '+91-0000000000' ELSE '+91987654' || (1000 + c_custkey % 9000) END AS phone,
CASE c_custkey % 4 WHEN 1 THEN 'Jane Smith' WHEN 3 THEN 'Ravi Kumar' ELSE 'Name Not Found' END AS name, CASE c_custkey % 4 WHEN 0 THEN 'Pune' WHEN 1 THEN 'Goa' WHEN 2 THEN 'Jaipur' ELSE 'City not specified' END AS city FROM customer""")
def parsed_contacts(spark, sf_dir):
    """Name, e-mail, phone and city of resumes."""
    return _texts(spark, sf_dir).select("c_custkey", resumes.contact(F.col("text")).alias("c")).select("c_custkey", "c.email", "c.phone", "c.name", "c.city")


@query("""SELECT c_custkey, title, company, from_date, until FROM (
SELECT c_custkey, 'Senior Clerk' AS title, c_mktsegment || ' Works' AS company, (2000 + c_custkey % 10) || '-01' AS from_date, (2012 + c_custkey % 5) || '-03' AS until FROM customer WHERE c_custkey % 5 <> 0
UNION ALL SELECT c_custkey, 'Junior Clerk', c_mktsegment || ' Ltd', '1995-01', '1999-01' FROM customer WHERE c_custkey % 5 <> 0
UNION ALL SELECT c_custkey, 'Data analyst of sales', 'Old Company Name Here', '2020-01', NULL FROM customer WHERE c_custkey % 5 <> 0)""")
def parsed_jobs(spark, sf_dir):
    """The jobs that resumes list, with their dates."""
    rows = _texts(spark, sf_dir).select("c_custkey", F.inline(resumes.jobs(F.regexp_replace("text", r"(?is)\n(?=(?:EDUCATION|Skills)).*$", ""), AS_OF)))
    return rows.select("c_custkey", "title", "company", "from_date", "until")


@query("""SELECT c_custkey, education, pass_year FROM (SELECT c_custkey, 'B.Tech in Physics, ' || (1990 + c_custkey % 8) AS education, (1990 + c_custkey % 8)::int AS pass_year FROM customer WHERE c_custkey % 2 = 0 UNION ALL SELECT c_custkey, 'Diploma', 2025 FROM customer WHERE c_custkey % 2 = 0)""")
def parsed_degrees(spark, sf_dir):
    """The degrees that resumes list."""
    return _texts(spark, sf_dir).select("c_custkey", F.inline(resumes.degrees(F.col("text"), 2025))).select("c_custkey", "education", "pass_year")


@query("""SELECT c_custkey, array_to_string(list_sort(list_distinct(list_concat(CASE WHEN c_custkey % 7 = 0 THEN [] ELSE ['Sql', 'Python', 'C++', upper(c_mktsegment[1]) || lower(c_mktsegment[2:])] END, CASE WHEN c_custkey % 5 = 0 THEN [] ELSE ['Clerk'] END, ['Report', 'Python']))), '~') AS skills FROM customer""")
def merged_skills(spark, sf_dir):
    """What rules read and what another method found, as one set."""
    found = F.array(F.lit("Report"), F.lit("Python"))
    return _texts(spark, sf_dir).select("c_custkey", F.array_join(resumes.merged_skills(resumes.skills(F.col("text"), VOCABULARY), found, F.lit(None).cast("array<string>")), "~").alias("skills"))


@query("""SELECT c_custkey, CASE WHEN c_custkey % 5 = 0 THEN 1 ELSE 4 END::bigint AS jobs, CASE WHEN c_custkey % 5 = 0 THEN 'Boss' ELSE 'Senior Clerk' END AS first_title FROM customer""")
def merged_jobs(spark, sf_dir):
    """Jobs of two readings, without those that both have."""
    job = lambda title, company: F.struct(F.lit(title).alias("title"), company.alias("company"), F.lit("2020-01").alias("from_date"), F.lit(None).cast("string").alias("until"), F.lit(True).alias("is_current"))
    second = F.when(F.col("c_custkey") % 5 == 0, F.array(job("Boss", F.lit("Own")))).otherwise(F.array(job("senior CLERK", F.concat(F.col("c_mktsegment"), F.lit(" works "))), job("Boss", F.lit("Own"))))
    jobs = resumes.merged_jobs(resumes.jobs(F.regexp_replace("text", r"(?is)\n(?=(?:EDUCATION|Skills)).*$", ""), AS_OF), second)
    return _texts(spark, sf_dir).select("c_custkey", jobs.alias("j")).select("c_custkey", F.size("j").cast("long").alias("jobs"), F.col("j")[0]["title"].alias("first_title"))


@query("SELECT c_custkey, CASE c_custkey % 3 WHEN 0 THEN 'a' || c_custkey || '@b.org' WHEN 1 THEN 'c@d.org' ELSE 'noemail@notprovided.com' END AS email, CASE c_custkey % 3 WHEN 0 THEN '+91-0000000000' WHEN 1 THEN '+917' ELSE '+91-0000000000' END AS phone FROM customer")
def merged_contacts(spark, sf_dir):
    """The contact of the first of three readings that has one: a line of text, another method's, defaults."""
    k = F.col("c_custkey")
    read = F.when(k % 3 == 0, resumes.contact(F.concat(F.lit("a"), k.cast("string"), F.lit("@b.org"))))
    other = F.when(k % 3 == 1, F.struct(F.lit("c@d.org").alias("email"), F.lit("+917").alias("phone"), F.lit("Ann").alias("name"), F.lit("Goa").alias("city")))
    return table(spark, sf_dir, "customer").select("c_custkey", resumes.merged_contact(read, other, resumes.contact(F.lit(""))).alias("c")).select("c_custkey", "c.email", "c.phone")


@query("SELECT c_custkey FROM customer WHERE (c_custkey % 3 <> 0 OR c_custkey % 4 = 0 OR (c_mktsegment = 'AUTOMOBILE' AND (c_custkey % 5 <> 0 OR c_custkey % 7 <> 0))) AND (c_custkey % 5 <> 0 OR c_custkey % 2 = 0 OR c_custkey % 7 <> 0)")
def resume_like_texts(spark, sf_dir):
    """Texts that name a contact, and work, studies or skills."""
    return _texts(spark, sf_dir).filter(text.resume_like(F.col("text"))).select("c_custkey")


_BEGIN = "CASE c_custkey % 6 WHEN 0 THEN concat('January ', 2010 + c_custkey % 10) WHEN 1 THEN concat('0', c_custkey % 9 + 1, '/', 2010 + c_custkey % 10) WHEN 2 THEN concat(2010 + c_custkey % 10, '-03-15') WHEN 3 THEN concat(c_custkey % 9 + 1, ' years ago') WHEN 4 THEN concat(c_custkey % 9 + 1, ' months ago') ELSE 'unknown' END"
_TOLD = "CASE WHEN c_custkey % 5 = 0 THEN concat(c_custkey % 4 + 1, ' yrs ', c_custkey % 12, ' months') WHEN c_custkey % 5 = 1 THEN 'until present' ELSE '' END"
_SINCE = "CASE c_custkey % 6 WHEN 0 THEN make_date((2010 + c_custkey % 10)::int, 1, 1) WHEN 1 THEN make_date((2010 + c_custkey % 10)::int, (c_custkey % 9 + 1)::int, 1) WHEN 2 THEN make_date((2010 + c_custkey % 10)::int, 3, 15) END"


@query(f"""WITH t AS (SELECT c_custkey, CASE WHEN c_custkey % 5 = 0 THEN (c_custkey % 4 + 1) * 12 + c_custkey % 12 ELSE coalesce(datesub('month', {_SINCE}, CASE WHEN c_custkey % 2 = 0 THEN DATE '{AS_OF}' ELSE DATE '2022-12-01' END), CASE c_custkey % 6 WHEN 3 THEN (c_custkey % 9 + 1) * 12 WHEN 4 THEN c_custkey % 9 + 1 ELSE 0 END) END::int AS months FROM customer)
SELECT c_custkey, months, CASE WHEN months = 0 THEN 'No experience' ELSE concat_ws(' and ', CASE WHEN months >= 12 THEN (months // 12) || CASE WHEN months // 12 = 1 THEN ' year' ELSE ' years' END END, CASE WHEN months % 12 > 0 THEN (months % 12) || CASE WHEN months % 12 = 1 THEN ' month' ELSE ' months' END END) END AS spelled FROM t""")
def experience_totals(spark, sf_dir):
    """Months of experience from durations, dates of several spellings, or a start some time ago."""
    until = F.when(F.col("c_custkey") % 2 == 0, "Present").otherwise("December 2022")
    months = resumes.months_of_entry(F.expr(_TOLD), F.expr(_BEGIN), until, AS_OF)
    return table(spark, sf_dir, "customer").select("c_custkey", months.alias("months")).withColumn("spelled", resumes.spelled_out(F.col("months")))


@query(f"""SELECT c_custkey, CASE WHEN c_custkey % 5 = 0 THEN 0 ELSE datesub('month', make_date((2000 + c_custkey % 10)::int, 1, 1), make_date((2012 + c_custkey % 5)::int, 3, 1)) + 48 END::int AS months FROM customer""")
def months_by_spans(spark, sf_dir):
    """Months summed over the spans of dates that resumes name."""
    return _texts(spark, sf_dir).select("c_custkey", resumes.months_by_spans(F.col("text"), AS_OF).alias("months"))


_WANTED = ("medium", "machine", "spark", "high")


@query(f"""WITH {PROFILES_SQL}, o AS (SELECT profile_id, list_concat(skills, may_also) AS own, {list(_WANTED)} AS wanted FROM profiles)
SELECT profile_id, array_to_string(list_filter(wanted, lambda x: len(list_filter(own, lambda y: contains(x, y) OR contains(y, x))) > 0), '~') AS matched, array_to_string(list_filter(wanted, lambda x: len(list_filter(own, lambda y: contains(x, y) OR contains(y, x))) = 0), '~') AS missing,
array_to_string(list_filter(own, lambda x: len(list_filter(wanted, lambda y: contains(x, y) OR contains(y, x))) = 0), '~') AS additional FROM o""")
def skill_gaps(spark, sf_dir):
    """Of a job's skills those that a profile has and lacks, and what else it has."""
    gaps = resumes.skill_gaps(F.array(*map(F.lit, _WANTED)), scoring.all_skills())
    return profiles(spark, sf_dir).select("profile_id", gaps.alias("g")).select("profile_id", *(F.array_join(f"g.{c}", "~").alias(c) for c in ("matched", "missing", "additional")))


@query(f"""WITH {PROFILES_SQL}, o AS (SELECT profile_id, try_cast(regexp_extract(total_experience, '[0-9]+') AS double) AS years, list_concat(list_concat(skills, may_also), labels) AS own, CASE WHEN expected_salary > 1000000 THEN expected_salary / 100000 ELSE expected_salary END AS pay, {list(_WANTED)} AS wanted FROM profiles)
SELECT profile_id, years, CASE WHEN years BETWEEN 5 AND 12 THEN 'PERFECT_MATCH' ELSE 'OUT_OF_RANGE' END AS fit, m AS matched, round(m / 4.0::double, 6) AS share, pay <= 9 AS affordable FROM (SELECT *, len(list_filter(wanted, lambda x: len(list_filter(own, lambda y: contains(x, y) OR contains(y, x))) > 0)) AS m FROM o)""")
def highlighted_profiles(spark, sf_dir):
    """What of each profile meets a request."""
    h = resumes.highlights(years_of(F.col("total_experience")), F.concat(scoring.all_skills(), F.col("labels")), F.col("expected_salary"), _WANTED, 5, 12, 9)
    return profiles(spark, sf_dir).select("profile_id", h.alias("h")).select("profile_id", F.col("h.experience_years").alias("years"), F.col("h.experience_match").alias("fit"), F.size("h.matched_skills").cast("long").alias("matched"), F.round("h.skills_match_ratio", 6).alias("share"), F.col("h.within_budget").alias("affordable"))


@query(f"""WITH {PROFILES_SQL}, s AS (SELECT profile_id, unnest(list_concat(skills, may_also)) AS skill FROM profiles), c AS (SELECT lower(trim(skill)) AS skill, count(*) AS n FROM s GROUP BY 1)
SELECT skill, n, (SELECT count(*) FROM c) AS kinds, round((SELECT sum(n) FROM c) / (SELECT count(*) FROM profiles), 2) AS per_profile FROM c ORDER BY n DESC, skill LIMIT 20""")
def skill_overview(spark, sf_dir):
    """The twenty most frequent skills, how many there are, and how many a profile has."""
    found = profiles(spark, sf_dir)
    counts = found.select(F.explode(scoring.all_skills()).alias("s")).groupBy(F.lower(F.trim("s")).alias("skill")).agg(F.count(F.lit(1)).alias("n"))
    whole = counts.agg(F.count(F.lit(1)).alias("kinds"), F.sum("n").alias("all")).crossJoin(found.agg(F.count(F.lit(1)).alias("profiles"))).select("kinds", F.round(F.col("all") / F.col("profiles"), 2).alias("per_profile"))
    return counts.orderBy(F.desc("n"), "skill").limit(20).crossJoin(F.broadcast(whole))


@query("""WITH v AS (SELECT DISTINCT lower(p_brand) AS term FROM part WHERE p_size <= 10), c AS (SELECT DISTINCT lower(trim(x)) AS term FROM (SELECT CASE WHEN p_partkey % 3 = 0 THEN ' ' || p_brand WHEN p_partkey % 3 = 1 THEN p_type || ' ' || (p_partkey % 5) ELSE ' ' END AS x FROM part) WHERE trim(x) <> '')
SELECT 'added' AS outcome, count(*) AS n FROM c WHERE term NOT IN (SELECT term FROM v) UNION ALL SELECT 'existing', count(*) FROM c WHERE term IN (SELECT term FROM v)""")
def vocabulary_upserts(spark, sf_dir):
    """How many new values a vocabulary takes in, and how many it has already."""
    p, k = table(spark, sf_dir, "part"), F.col("p_partkey")
    said = F.when(k % 3 == 0, F.concat(F.lit(" "), "p_brand")).when(k % 3 == 1, F.concat_ws(" ", "p_type", (k % 5).cast("string"))).otherwise(" ")
    return tables.upsert_counts(p.select(said.alias("term")), p.filter("p_size <= 10").select(F.col("p_brand").alias("term")), "term")
