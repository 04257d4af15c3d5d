"""Searches, rankings and vector retrieval."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from talentloom.functions import context, scoring
from talentloom.functions.durations import months_of, years_of
from talentloom.operators import searches, tables, vector_index, vectors
from talentloom.plans.profiles import PROFILES_SQL, profiles, table
from talentloom.streaming.checkpoints import folder

QUERIES: dict = {}


def query(sql: str | None = None):
    def put(f):
        QUERIES[f.__name__] = (f, sql)
        return f

    return put


CRITERIA = scoring.Criteria(titles=("high", "urgent"), skills=("low", "machinery", "medium"), education=("degree",), locations=("nation_1", "region_2"), min_months=60, max_months=140, min_salary=100_000, max_salary=600_000)


def _levels(levels: dict[str, int], text: str) -> str:
    return "CASE " + " ".join(f"WHEN contains({text}, '{k}') THEN {v}" for k, v in levels.items()) + " ELSE 0 END"


def _hits(text: str, words) -> str:
    return "(" + " + ".join(f"contains(lower({text}), '{w.lower()}')::int" for w in words) + ")"


def _sum(items: str, value: str) -> str:
    return f"coalesce(list_sum(list_transform({items}, lambda x: {value})), 0)"


MONTHS = r"""CASE WHEN regexp_matches(total_experience, '(?i)(\d+)\s*(?:year|years|yr|yrs|month|months|mo|mos)') THEN coalesce(try_cast(regexp_extract(total_experience, '(?i)(\d+)\s*(?:year|years|yr|yrs)', 1) AS int), 0) * 12 + coalesce(try_cast(regexp_extract(total_experience, '(?i)(\d+)\s*(?:month|months|mo|mos)', 1) AS int), 0) ELSE coalesce(try_cast(regexp_extract(total_experience, '(\d+)', 1) AS int), 0) * 12 END"""
PAY = "CASE WHEN coalesce(expected_salary, 0) > 0 THEN expected_salary ELSE current_salary END"


def _criteria_sql(c: scoring.Criteria) -> str:
    all_skills = "list_concat(skills, may_also)"
    recall = " OR ".join([
        f"coalesce(list_bool_or(list_transform(experience, lambda x: {_hits('x.title', c.titles)} > 0)), false)",
        f"coalesce(list_bool_or(list_transform({all_skills}, lambda x: {_hits('x', c.skills)} > 0)), false)",
        f"coalesce(list_bool_or(list_transform(education, lambda x: {_hits('x', c.education)} > 0)), false)",
        f"{_hits('current_city', c.locations)} > 0",
        f"coalesce(list_bool_or(list_transform(looking_for, lambda x: {_hits('x', c.locations)} > 0)), false)",
    ])
    return f"""
WITH {PROFILES_SQL},
m AS (SELECT profile_id, {_sum('experience', _hits('x.title', c.titles))} AS t, {" + ".join(f"list_contains({all_skills}, '{s}')::int" for s in c.skills)} AS s,
    {_sum('education', _hits('x', c.education))} AS e, {_sum('education', f"{_hits('x', c.education)} * ({_levels(scoring.CRITERIA_LEVELS, 'lower(x)')})")} AS lv,
    {MONTHS} AS months, {_hits('current_city', c.locations)} AS city, {_sum('looking_for', _hits('x', c.locations))} AS wish, {PAY} AS pay FROM profiles WHERE {recall}),
p AS (SELECT *, months BETWEEN {c.min_months} AND {c.max_months} AS fit, coalesce(pay > 0 AND pay BETWEEN {c.min_salary} AND {c.max_salary}, false) AS paid FROM m),
q AS (SELECT profile_id, round(CASE WHEN t > 0 THEN least(25.0, t * 8.0 + (t - 1) * 2.0) ELSE 0 END + CASE WHEN s > 0 THEN least(25.0, s * 6.0 + (s - 1) * 1.5) ELSE 0 END + CASE WHEN lv > 0 THEN least(15.0, lv * 2.5) ELSE 0 END
    + CASE WHEN fit THEN 10 WHEN months >= {c.min_months} * 0.8 THEN 5 ELSE 0 END + least(15.0, (city * 3 + wish * 2) * 2.0) + CASE WHEN paid THEN 10 ELSE 0 END, 2)::double AS base_score,
    (t > 0)::int + (s > 0)::int + (lv > 0)::int + fit::int + (city + wish > 0)::int + paid::int AS fields_matched, t + s + e + city + wish + fit::int + paid::int AS single_matches FROM p)
SELECT profile_id, base_score, fields_matched, round(least(100.0, base_score + least(10, fields_matched * 2)), 2)::double AS match_score, single_matches
FROM q WHERE least(100.0, base_score + least(10, fields_matched * 2)) >= 40 ORDER BY fields_matched DESC, match_score DESC, single_matches DESC, profile_id LIMIT 50"""


@query(_criteria_sql(CRITERIA))
def criteria_search(spark, sf_dir):
    """Profiles that meet any criterion, scored; the best 50 of those with 40 points or more."""
    return searches.by_criteria(profiles(spark, sf_dir), CRITERIA, "profile_id")


STRICT = scoring.Criteria(titles=("high",), skills=("low",), locations=("nation_1",), min_months=60)


@query(f"""
WITH {PROFILES_SQL},
m AS (SELECT profile_id, {_sum('experience', _hits('x.title', STRICT.titles))} AS t, list_contains(skills, 'low')::int AS s, {MONTHS} AS months, {_hits('current_city', STRICT.locations)} AS city, {_sum('looking_for', _hits('x', STRICT.locations))} AS wish,
    {_sum('education', _levels(dict(sorted(scoring.CRITERIA_LEVELS.items(), key=lambda x: -x[1])), 'lower(x)'))} AS lv FROM profiles)
SELECT profile_id, (t * 10 + s * 10 + lv + 10 + CASE WHEN city > 0 THEN 5 ELSE 3 END)::double AS score FROM m
WHERE t > 0 AND s > 0 AND months >= 60 AND city + wish > 0 ORDER BY score DESC, profile_id LIMIT 100""")
def strict_search(spark, sf_dir):
    """Every criterion must be met: ten points for each fitting job, ten for the share of skills, the highest level of education, ten for the range, five or three for the place. Sorted, then cut."""
    titles = scoring.all_hits(F.transform("experience", lambda e: e["title"]), STRICT.titles)
    own = F.transform(scoring.all_skills(), F.lower)
    share = sum((F.array_contains(own, s).cast("int") for s in STRICT.skills), F.lit(0)) / len(STRICT.skills)
    city, wish = scoring.hits(F.lower("current_city"), STRICT.locations), scoring.all_hits("looking_for", STRICT.locations)
    level = F.aggregate("education", F.lit(0), lambda a, e: F.greatest(a, scoring.highest_level(F.lower(e), scoring.CRITERIA_LEVELS)))
    rows = profiles(spark, sf_dir).filter((titles > 0) & (share > 0) & (months_of(F.col("total_experience")) >= STRICT.min_months) & (city + wish > 0))
    score = titles * 10 + share * 10 + level + 10 + F.when(city > 0, 5).otherwise(3)
    return rows.select("profile_id", score.cast("double").alias("score")).orderBy(F.desc("score"), "profile_id").limit(100)


PRIORITY_QUERY = "urgent machinery roles in nation_1 10 years 8 lakh"
_WORDS = tuple(w for w in PRIORITY_QUERY.split() if len(w) > 2)


def _says(x: str) -> str:
    return "(" + " OR ".join(f"contains(lower({x}), '{w}')" for w in _WORDS) + ")"


_ANY = lambda items, cond: f"coalesce(list_bool_or(list_transform({items}, lambda x: {cond})), false)"


@query(f"""
WITH {PROFILES_SQL},
v AS (SELECT vec_id, (1 + list_sum(list_transform(list_zip(embedding, q), lambda x: x[1]::double * x[2]::double)) / (sqrt(list_sum(list_transform(embedding, lambda x: x::double * x::double))) * sqrt(list_sum(list_transform(q, lambda x: x::double * x::double))))) / 2 AS similarity
      FROM embeddings, (SELECT embedding AS q FROM embeddings WHERE vec_id = 0)),
s AS (SELECT profile_id, similarity, try_cast(regexp_extract(total_experience, '(\\d+(?:\\.\\d+)?)', 1) AS double) AS own, CASE WHEN expected_salary > 1000000 THEN expected_salary / 100000 ELSE expected_salary END AS pay,
    CASE WHEN {_ANY('experience[1:3]', f'{_says("x.title")} AND x = experience[1]')} THEN 1.0 WHEN {_ANY('experience[1:3]', _says('x.title'))} THEN 0.8 WHEN {_ANY('labels', _says('x'))} THEN 0.7 ELSE 0.0 END AS d,
    CASE WHEN contains(current_city, 'nation_1') THEN 1.0 WHEN {_ANY('looking_for', "contains(x, 'nation_1')")} THEN 0.8 ELSE 0.0 END AS l,
    CASE WHEN {_ANY('list_concat(skills, may_also)', _says('x'))} THEN 1.0 ELSE 0.0 END AS k FROM profiles JOIN v ON profile_id = vec_id),
p AS (SELECT *, CASE WHEN abs(own - 10) <= 1 THEN 1.0 WHEN abs(own - 10) <= 2 THEN 0.8 WHEN own >= 8 THEN 0.6 ELSE 0.0 END AS x, CASE WHEN pay <= 8 THEN 1.0 WHEN pay <= 8.0::double * 1.2::double THEN 0.8 ELSE 0.0 END AS y FROM s),
r AS (SELECT *, 0.0::double + d::double * 0.4::double + l::double * 0.3::double + k::double * 0.15::double + x::double * 0.1::double + y::double * 0.05::double AS priority FROM p)
SELECT profile_id, round(priority, 4) AS priority, CASE WHEN d + l + k + x + y = 0 THEN 'Basic vector similarity' ELSE concat_ws('; ', CASE WHEN d > 0 THEN 'Designation match' END, CASE WHEN l > 0 THEN 'Location match' END, CASE WHEN k > 0 THEN 'Skills match' END, CASE WHEN x > 0 THEN 'Experience match' END, CASE WHEN y > 0 THEN 'Salary match' END) END AS reason,
    round(CASE WHEN priority > 0 THEN priority * 0.7::double + similarity * 0.3::double ELSE similarity END * 100, 4) AS final_score FROM r WHERE similarity >= 0.4""")
def priority_search(spark, sf_dir):
    """Hits of a vector search joined with profiles in one join, scored by a free query, blended with the similarity."""
    e = table(spark, sf_dir, "embeddings")
    q = F.broadcast(e.filter("vec_id = 0").select(F.col("embedding").alias("q")).limit(1))
    hits = e.crossJoin(q).select(F.col("vec_id").alias("profile_id"), ((1 + vectors.cosine(F.col("embedding"), F.col("q"))) / 2).alias("similarity")).filter("similarity >= 0.4")
    parts = scoring.priority_score(PRIORITY_QUERY, ("nation_1",))
    rows = profiles(spark, sf_dir).join(hits, "profile_id").select("profile_id", "similarity", *(c.alias(k) for k, c in parts.items()))
    return rows.select("profile_id", F.round("priority", 4).alias("priority"), "reason", F.round(scoring.blend(F.col("priority"), F.col("similarity")), 4).alias("final_score"))


JOB = scoring.Job(titles=("urgent", "high"), required=("high", "machinery"), preferred=("low", "medium"), education=("Bachelor degree",), years=8)


def _best(text: str) -> str:
    return "greatest(" + ", ".join(f"CASE WHEN contains({text}, '{k}') THEN {v} ELSE 0 END" for k, v in scoring.RANKING_LEVELS.items()) + ")"


_RANKED = f"""
m AS (SELECT profile_id, looking_for, current_city, coalesce(current_salary, 0) AS cur, coalesce(expected_salary, 0) AS exp, coalesce(try_cast(regexp_extract(total_experience, '(\\d+(?:\\.\\d+)?)', 1) AS double), 0) AS years,
    list_filter(['high', 'machinery', 'low', 'medium'], lambda s: coalesce(list_bool_or(list_transform(list_concat(skills, may_also), lambda c: contains(s, c) OR contains(c, s))), false)) AS met,
    coalesce(list_bool_or(list_transform(experience, lambda x: contains('urgent', x.title) OR contains(x.title, 'urgent') OR contains('high', x.title) OR contains(x.title, 'high'))), false) AS fits,
    coalesce(list_max(list_transform(education, lambda x: {_best('lower(x)')})), 0) AS level FROM profiles),
p AS (SELECT profile_id, round(len(met) / 4.0::double * 100, 2) AS skills_score, round(least(100.0::double, CASE WHEN fits AND years > 0 THEN years * 0.7::double ELSE 0.0 END / 8 * 100), 2) AS experience_score, (CASE WHEN level >= 4 THEN 100.0 ELSE level / 4.0::double * 100 END)::double AS education_score,
    100.0::double AS location_score, (CASE WHEN exp > 0 AND cur > 0 THEN CASE WHEN (exp - cur) / cur * 100 <= 30 THEN 100 WHEN (exp - cur) / cur * 100 <= 50 THEN 80 ELSE 60 END WHEN exp > 0 OR cur > 0 THEN 70 ELSE 90 END)::double AS salary_score,
    array_to_string(list_filter(['high', 'machinery'], lambda s: NOT list_contains(met, s)), ',') AS missing FROM m),
r AS (SELECT *, 0.0::double + skills_score * 0.40::double + experience_score * 0.30::double + education_score * 0.15::double + location_score * 0.10::double + salary_score * 0.05::double AS overall FROM p)"""


@query(f"""WITH {PROFILES_SQL}, {_RANKED}
SELECT profile_id, skills_score, experience_score, education_score, location_score, salary_score, round(overall, 4) AS overall, CASE WHEN overall >= 80 THEN 'Excellent match' WHEN overall >= 60 THEN 'Good match' WHEN overall >= 40 THEN 'Partial match' ELSE 'Poor match' END AS band, CASE WHEN overall >= 40 THEN 'accepted' ELSE 'rejected' END AS status, missing FROM r""")
def candidate_ranking(spark, sf_dir):
    """Every profile's match with a job: weighted parts, a verdict and what is missing."""
    return searches.ranked_for(profiles(spark, sf_dir), JOB, "profile_id").withColumn("overall", F.round("overall", 4))


@query(f"""WITH {PROFILES_SQL}, b AS (SELECT CASE WHEN years < 2 OR years IS NULL THEN '0-2' WHEN years < 5 THEN '2-5' WHEN years < 10 THEN '5-10' ELSE '10+' END AS bucket, len(skills) + len(may_also) AS n FROM (SELECT *, try_cast(regexp_extract(total_experience, '(\\d+(?:\\.\\d+)?)', 1) AS double) AS years FROM profiles))
SELECT bucket, count(*) AS profiles, sum(n)::bigint AS skills FROM b GROUP BY bucket""")
def ranking_stats(spark, sf_dir):
    """Profiles and skills by years of experience; what can't be read counts as none."""
    years = years_of(F.col("total_experience"))
    bucket = F.when(years.isNull() | (years < 2), "0-2").when(years < 5, "2-5").when(years < 10, "5-10").otherwise("10+")
    return profiles(spark, sf_dir).groupBy(bucket.alias("bucket")).agg(F.count(F.lit(1)).alias("profiles"), F.sum(F.size(scoring.all_skills())).alias("skills"))


@query(f"""WITH {PROFILES_SQL}, {_RANKED}, x AS (SELECT profile_id, overall / 100 AS s, years, len(met) / 4.0::double AS share FROM r JOIN m USING (profile_id))
SELECT profile_id, round(least(1.0::double, s * CASE WHEN years BETWEEN 5 AND 12 THEN 1.1::double ELSE 1 END * CASE WHEN share >= 0.8 THEN 1.15::double ELSE 1 END), 6) AS boosted FROM x""")
def boosted_matches(spark, sf_dir):
    """Scores that came from outside (here: the overall match), joined by id and raised for fitting experience and skills, to 1 at most."""
    given = candidate_scores(spark, sf_dir)
    years = years_of(F.col("total_experience"))
    share = F.col("skills_score") / 100
    up = F.when(years.between(5, 12), 1.1).otherwise(1.0)
    return profiles(spark, sf_dir).join(given, "profile_id").select("profile_id", F.round(F.least(F.lit(1.0), F.col("overall") / 100 * up * F.when(share >= 0.8, 1.15).otherwise(1.0)), 6).alias("boosted"))


def candidate_scores(spark, sf_dir):
    return searches.ranked_for(profiles(spark, sf_dir), JOB, "profile_id").select("profile_id", "overall", "skills_score")


_COS = "list_sum(list_transform(list_zip(embedding, q), lambda x: x[1]::double * x[2]::double)) / (sqrt(list_sum(list_transform(embedding, lambda x: x::double * x::double))) * sqrt(list_sum(list_transform(q, lambda x: x::double * x::double))))"
_SCORED = f"s AS (SELECT vec_id, label, {_COS} AS c FROM embeddings, (SELECT embedding AS q FROM embeddings WHERE vec_id = 7))"


def _query_vector(spark, sf_dir, of: int = 7):
    return vectors.literal(table(spark, sf_dir, "embeddings").filter(F.col("vec_id") == of).select("embedding").first()[0])


@query(f"WITH {_SCORED} SELECT vec_id, round(c, 6) AS cosine, round((1 + c) / 2, 6) AS score FROM s ORDER BY c DESC, vec_id LIMIT 20")
def vector_search(spark, sf_dir):
    """The 20 nearest vectors by cosine."""
    found = vectors.nearest(table(spark, sf_dir, "embeddings"), _query_vector(spark, sf_dir), 20, "vec_id")
    return found.select("vec_id", F.round("cosine", 6).alias("cosine"), F.round("score", 6).alias("score"))


@query(f"WITH {_SCORED} SELECT vec_id, round(c, 6) AS cosine FROM s WHERE label = 3 ORDER BY c DESC, vec_id LIMIT 20")
def vector_search_tenant(spark, sf_dir):
    """The 20 nearest of one tenant, filtered before the search."""
    found = vectors.nearest(table(spark, sf_dir, "embeddings"), _query_vector(spark, sf_dir), 20, "vec_id", keep=F.col("label") == 3)
    return found.select("vec_id", F.round("cosine", 6).alias("cosine"))


@query(f"WITH {_SCORED}, t AS (SELECT * FROM s ORDER BY c DESC, vec_id LIMIT 100) SELECT vec_id, round(c, 6) AS cosine FROM t WHERE label = 3 ORDER BY c DESC, vec_id LIMIT 20")
def vector_search_post_filter(spark, sf_dir):
    """The same, filtered after a search of five times as many rows."""
    found = vectors.nearest(table(spark, sf_dir, "embeddings"), _query_vector(spark, sf_dir), 20, "vec_id", keep=F.col("label") == 3, after=True)
    return found.select("vec_id", F.round("cosine", 6).alias("cosine"))


def _field(of: int, boost: float, k: int) -> str:
    return f"(SELECT vec_id, (1 + {_COS}) / 2 * {boost}::double AS b FROM embeddings, (SELECT embedding AS q FROM embeddings WHERE vec_id = {of}) ORDER BY b DESC, vec_id LIMIT {k})"


@query(f"SELECT vec_id, round(max(b), 6) AS boosted FROM (SELECT * FROM {_field(7, 1.0, 40)} UNION ALL SELECT * FROM {_field(8, 0.8, 20)} UNION ALL SELECT * FROM {_field(9, 0.9, 20)}) GROUP BY vec_id ORDER BY max(b) DESC, vec_id LIMIT 20")
def multi_vector_search(spark, sf_dir):
    """Searches over three vector fields with boosts; each row keeps its best."""
    e = table(spark, sf_dir, "embeddings")
    asked = dict(e.filter(F.col("vec_id").isin(7, 8, 9)).select("vec_id", "embedding").collect())
    fields = [("embedding", vectors.literal(asked[of]), boost, 20 * reach) for of, (boost, reach) in zip((7, 8, 9), vectors.FIELD_BOOSTS.values())]
    return vectors.nearest_by_fields(e, fields, "vec_id", 20).withColumn("boosted", F.round("boosted", 6))


@query("SELECT event_id, user_id, event_type FROM events WHERE user_id = 11 OR EXISTS (SELECT 1 FROM (VALUES (7), (8)) u(user_id) WHERE u.user_id = 11)")
def access_own_rows(spark, sf_dir):
    """A requester that is not on the list sees its own rows."""
    users = spark.createDataFrame([(7,), (8,)], "user_id long")
    return tables.scoped(table(spark, sf_dir, "events"), users, 11).select("event_id", "user_id", "event_type")


@query("SELECT user_id, count(*) AS rows_seen FROM events GROUP BY user_id")
def access_all_rows(spark, sf_dir):
    """A requester on the list sees all rows."""
    users = spark.createDataFrame([(7,), (8,)], "user_id long")
    return tables.scoped(table(spark, sf_dir, "events"), users, 7).groupBy("user_id").agg(F.count(F.lit(1)).alias("rows_seen"))


@query(f"""WITH {PROFILES_SQL} SELECT profile_id, total_experience FROM profiles WHERE (try_cast(regexp_extract(total_experience, '(\\d+(?:\\.\\d+)?)', 1) AS double) >= 10 - 0.5 OR NOT regexp_matches(total_experience, '\\d')) AND (expected_salary / 100000 <= 5 * 1.2::double OR expected_salary IS NULL)""")
def context_filters(spark, sf_dir):
    """Hard limits of a context search: half a year short and a fifth too dear are tolerated; what can't be read passes."""
    years = years_of(F.col("total_experience"))
    dear = F.col("expected_salary") / 100_000 <= 5 * 1.2
    return profiles(spark, sf_dir).filter(((years >= 10 - 0.5) | years.isNull()) & (dear | F.col("expected_salary").isNull())).select("profile_id", "total_experience")


REQUEST = context.Request(role="urgent machinery", domain="things", skills=("machinery", "high"), location="nation_1", min_years=5, max_years=9, max_lakh=2)
THINGS = {"things": ("machinery", "furniture", "low")}
_TEXTS = "list_concat(list_concat(list_concat(skills, may_also), labels), flatten(list_transform(experience, lambda x: [x.title, lower(x.company), x.from_date, x.until])))"


@query(f"""WITH {PROFILES_SQL}, p AS (SELECT *, try_cast(regexp_extract(total_experience, '(\\d+(?:\\.\\d+)?)', 1) AS double) AS own, CASE WHEN expected_salary > 1000000 THEN expected_salary / 100000 ELSE expected_salary END AS pay FROM profiles),
s AS (SELECT profile_id, CASE WHEN coalesce(contains(experience[1].title, 'urgent'), false) THEN 1.0::double WHEN {_ANY('experience[1:3]', "contains(x.title, 'urgent machinery')")} THEN 0.8 WHEN {_ANY('labels', "contains(x, 'urgent machinery')")} THEN 0.7 WHEN {_ANY('experience[1:3]', "contains(x.title, 'urgent') OR contains(x.title, 'machinery')")} THEN 0.6 WHEN {_ANY('list_concat(skills, may_also)', "contains(x, 'urgent') OR contains(x, 'machinery')")} THEN 0.4 ELSE 0.0 END AS role,
 least(1.0::double, {_sum(_TEXTS, _hits('x', THINGS['things']))} / 3.0::double) AS domain, CASE WHEN contains(current_city, 'nation_1') THEN 1.0::double WHEN {_ANY('looking_for', "contains(x, 'nation_1')")} THEN 0.8 ELSE 0.0 END AS location,
 ({_ANY(_TEXTS, "length(x) > 2 AND (contains(x, 'machinery') OR contains('machinery', x))")}::int + {_ANY(_TEXTS, "length(x) > 2 AND (contains(x, 'high') OR contains('high', x))")}::int) / 2.0::double AS skills,
 CASE WHEN own BETWEEN 5 AND 9 THEN 1.0::double WHEN own < 5 THEN greatest(0.0, 1 - (5 - own) / 5) WHEN own - 9 <= 2 THEN 0.9 ELSE 0.7 END AS experience, CASE WHEN pay = 0 THEN 0.0::double WHEN pay <= 2 THEN 1.0 ELSE greatest(0.0, 1 - (pay - 2) / 2) END AS salary FROM p)
SELECT profile_id, round(least(1.0, greatest(0.0, (role * 0.6 + domain * 0.4) * 0.4 + location * 0.3 + skills * 0.15 + experience * 0.1 + salary * 0.05)), 5) AS relevance FROM s""")
def context_relevance(spark, sf_dir):
    """Profiles by their graded relevance to a request."""
    parts = context.facts()
    facts = searches.once(profiles(spark, sf_dir), parts, "profile_id")
    scored = context.relevance(REQUEST, domains=THINGS, at={k: F.col(k) for k in parts})
    return facts.select("profile_id", F.round(scored["relevance"], 5).alias("relevance"))


@query("""WITH q AS (SELECT embedding AS e FROM embeddings WHERE vec_id = 0), s AS (SELECT vec_id, label, list_cosine_similarity(embedding::double[], (SELECT e FROM q)::double[]) AS c FROM embeddings), k AS (SELECT *, row_number() OVER (ORDER BY c DESC, vec_id) AS place FROM s WHERE c IS NOT NULL)
SELECT vec_id, round((1 + c) / 2, 6) AS score, 'label ' || label AS preview, place <= 10 AS read FROM k WHERE place <= 50""")
def retrieved_rows(spark, sf_dir):
    """The rows that a preset retrieves for a vector, with previews, and those to be read closely."""
    rows = table(spark, sf_dir, "embeddings").withColumn("said", F.concat(F.lit("label "), F.col("label").cast("string")))
    asked = vectors.literal(rows.filter("vec_id = 0").first()["embedding"])
    return vectors.retrieved(rows, asked, "balanced", "vec_id", "said").withColumn("score", F.round("score", 6))


@query("""WITH s AS (SELECT a.vec_id AS query, b.vec_id, list_cosine_similarity(a.embedding::double[], b.embedding::double[]) AS c FROM embeddings a, embeddings b WHERE a.vec_id % 20 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY c DESC, vec_id) AS rank FROM s)
SELECT query, vec_id, round(c, 6) AS cosine, rank FROM r WHERE rank <= 10""")
def nearest_of_many(spark, sf_dir):
    """The 10 nearest vectors of every vector whose id is divisible by 20, by an exact index over all of them."""
    rows = table(spark, sf_dir, "embeddings")
    index = vector_index.build(rows, "vec_id", "embedding", f"{folder(spark)}/index-{uuid.uuid4().hex}")
    found, _ = vector_index.nearest_of_many(index, rows.filter("vec_id % 20 = 0").select(F.col("vec_id").alias("query"), "embedding"), "query", "embedding", 10)
    return found.select("query", "vec_id", F.round("cosine", 6).alias("cosine"), "rank")
