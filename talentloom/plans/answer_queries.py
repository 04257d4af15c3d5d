"""Questions, job files and jobs put to the tables, terms around a prefix and cleaned fields."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from talentloom.functions import cleaning, scoring
from talentloom.operators import answers, scans, searches, terms, vector_index
from talentloom.plans.profiles import PROFILES_SQL, profiles, spread, table
from talentloom.plans.search_queries import _ANY
from talentloom.plans.term_queries import matching_runs
from talentloom.streaming.checkpoints import folder

QUERIES: dict = {}


def query(sql: str | None = None):
    def put(f):
        QUERIES[f.__name__] = (f, sql)
        return f

    return put


def _index(spark, rows, key="vec_id"):
    return vector_index.build(rows, key, "embedding", f"{folder(spark)}/index-{uuid.uuid4().hex}")


#: Every vector whose id is divisible by 20 is a question; the documents of the same ids are what a model reads.
_FOUND = """c AS (SELECT a.vec_id AS question, b.vec_id, (1 + list_cosine_similarity(a.embedding::double[], b.embedding::double[])) / 2 AS score FROM embeddings a, embeddings b WHERE a.vec_id % 20 = 0),
n AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY question ORDER BY score DESC, vec_id) AS place FROM c) WHERE place <= 50),
t AS (SELECT n.*, text, length(text) AS size FROM n JOIN documents ON doc_id = vec_id WHERE text IS NOT NULL),
f AS (SELECT question, vec_id, score, row_number() OVER w AS rank, text, size, row_number() OVER w <= 10 AND sum(size) OVER w <= 8000 AS read FROM t WINDOW w AS (PARTITION BY question ORDER BY score DESC, vec_id ROWS UNBOUNDED PRECEDING))"""


def _found(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    questions = e.filter("vec_id % 20 = 0").select(F.col("vec_id").alias("question"), "embedding")
    texts = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("vec_id"), "text")
    return questions, texts, scans.written(answers.retrieved(_index(spark, e), questions, "question", "embedding", texts, "text", "balanced"))


@query(f"WITH {_FOUND} SELECT question, vec_id, round(score, 6) AS score, rank, CASE WHEN size > 200 THEN left(text, 200) || '...' ELSE text END AS preview, read FROM f")
def asked_questions(spark, sf_dir):
    """What is retrieved for each question, and what of it fits the text that a model reads."""
    _, _, found = _found(spark, sf_dir)
    return found.select("question", "vec_id", F.round("score", 6).alias("score"), "rank", "preview", "read")


@query(f"""WITH {_FOUND}, x AS (SELECT question, count(*) AS n_retrieved, count(*) FILTER (read) AS n_read, greatest(0, coalesce(sum(size + 7) FILTER (read), 0) - 7)::bigint AS context_length, string_agg(text, chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY rank) FILTER (read) AS context FROM f GROUP BY 1)
SELECT q.vec_id AS question, coalesce(n_retrieved, 0) AS n_retrieved, coalesce(n_read, 0) AS n_read, coalesce(context_length, 0) AS context_length, coalesce(n_read = 0 OR context_length >= 8000, false) AS exceeded, sha256(context) AS context_sha256 FROM embeddings q LEFT JOIN x ON q.vec_id = x.question WHERE q.vec_id % 20 = 0""")
def question_contexts(spark, sf_dir):
    """Counts for each question, and the text that a model reads."""
    questions, texts, found = _found(spark, sf_dir)
    counts = answers.statistics(questions, found, "question")
    read = answers.contexts(found, texts, "question", "vec_id", "text").select("question", F.sha2("context", 256).alias("context_sha256"))
    return counts.join(read, "question", "left")


_ANSWERS = """CASE WHEN c_custkey % 7 = 0 THEN concat('None fits ', c_name) WHEN c_custkey % 7 = 1 THEN concat('{"matches": [{"_id": "', c_custkey, '", "relevance_score": 0.', c_nationkey, ', "match_reason": "', c_mktsegment, '"}, {"_id": ', c_custkey + 1)
WHEN c_custkey % 7 = 2 THEN concat('Sure: ```json {"total_candidates": ', c_nationkey, ', "matches": [{"_id": "', c_custkey, '", "relevance_score": ', c_nationkey, ',}, {"relevance_score": 1}],} ```')
ELSE concat('{"total_candidates": 2, "matches": [{"_id": "', c_custkey, '", "relevance_score": 0.5, "match_reason": "', c_name, '"}, {"_id": "', c_custkey - 1, '", "relevance_score": 0.25}]}') END"""


@query("""WITH a AS (SELECT c_custkey AS k, c_custkey % 7 AS kind, c_nationkey AS n, c_name, c_mktsegment FROM customer),
m AS (SELECT k, 1 AS place, k AS id, CASE kind WHEN 1 THEN ('0.' || n)::double WHEN 2 THEN n ELSE 0.5 END::double AS relevance, CASE kind WHEN 1 THEN c_mktsegment WHEN 2 THEN 'No reason provided' ELSE c_name END AS reason, CASE WHEN kind = 2 THEN n ELSE 2 END AS total_candidates FROM a WHERE kind > 0
UNION ALL SELECT k, 2, CASE WHEN kind = 1 THEN k + 1 ELSE k - 1 END, CASE WHEN kind = 1 THEN 0.0 ELSE 0.25 END, 'No reason provided', 2 FROM a WHERE kind NOT IN (0, 2))
SELECT k AS question, place, id::varchar AS key, relevance, reason, CASE WHEN id % 3 = 0 AND id IN (SELECT k FROM a) THEN id / 10.0::double END AS score, total_candidates::bigint AS total_candidates FROM m""")
def ranked_answers(spark, sf_dir):
    """Matches that models' answers rank, whole and damaged, with the scores of those that were retrieved."""
    c = table(spark, sf_dir, "customer")
    said = c.select(F.col("c_custkey").alias("question"), F.expr(_ANSWERS).alias("answer"))
    found = c.select(F.explode(F.array(*(F.struct((F.col("c_custkey") + d).alias("question"), F.col("c_custkey").alias("id"), (F.col("c_custkey") / 10.0).alias("score")) for d in (-1, 0, 1)))).alias("x")).select("x.*").filter("id % 3 = 0")
    return answers.ranked(said, "question", "answer", found, "id")


_REQUIRED = """CASE WHEN n_nationkey % 4 = 0 THEN concat('I can not read the job of ', n_name) WHEN n_nationkey % 4 = 1 THEN concat('{"required_skills": ["high"], "preferred_skills": ["machinery"], "experience_years": "', n_nationkey, '+ years", "job_titles": ["urgent"], "education_requirements": ["Bachelor degree"]}')
WHEN n_nationkey % 4 = 2 THEN concat('```json {"required_skills": ["low", "furniture",], "experience_years": ', n_nationkey, ', "job_titles": ["medium"]') ELSE '{"education_requirements": ["diploma"], "required_skills": null}' END"""


@query(f"""WITH {PROFILES_SQL}, j AS (SELECT n_nationkey AS job, n_nationkey % 4 AS kind, CASE n_nationkey % 4 WHEN 1 THEN ['high'] WHEN 2 THEN ['low', 'furniture'] ELSE []::varchar[] END AS required, CASE n_nationkey % 4 WHEN 1 THEN ['machinery'] ELSE []::varchar[] END AS preferred,
 CASE n_nationkey % 4 WHEN 1 THEN 'urgent' WHEN 2 THEN 'medium' END AS title, CASE WHEN n_nationkey % 4 IN (1, 2) THEN n_nationkey ELSE 0 END AS asked FROM nation),
m AS (SELECT *, coalesce(current_salary, 0) AS cur, coalesce(expected_salary, 0) AS exp, coalesce(try_cast(regexp_extract(total_experience, '(\\d+(?:\\.\\d+)?)', 1) AS double), 0) AS years,
 list_filter(list_concat(required, preferred), lambda s: {_ANY('list_concat(skills, may_also)', 'contains(s, x) OR contains(x, s)')}) AS met,
 coalesce(list_bool_or(list_transform(experience, lambda x: contains(title, x.title) OR contains(x.title, title))), false) AS fits, {_ANY('education', "contains(x, 'degree')")} AS degree FROM profiles, j),
p AS (SELECT profile_id, job, round(len(met) / greatest(1, len(required) + len(preferred))::double * 100, 2) AS skills_score,
 round(CASE WHEN asked > 0 THEN least(100.0::double, CASE WHEN fits THEN years * 0.7::double ELSE 0 END / asked * 100) WHEN fits AND years > 0 THEN 100 ELSE 0 END::double, 2) AS experience_score,
 {{EDUCATION}} AS education_score, CASE WHEN len(looking_for) > 0 THEN 100.0::double END AS location_score,
 (CASE WHEN exp > 0 AND cur > 0 THEN CASE WHEN (exp - cur) / cur * 100 <= 30 THEN 100 WHEN (exp - cur) / cur * 100 <= 50 THEN 80 ELSE 60 END WHEN exp > 0 OR cur > 0 THEN 70 ELSE 90 END)::double AS salary_score,
 array_to_string(list_filter(required, lambda s: NOT list_contains(met, s)), ',') AS missing FROM m)
SELECT job, profile_id, skills_score, experience_score, education_score, round(skills_score * 0.40::double + experience_score * 0.30::double + education_score * 0.15::double + location_score * 0.10::double + salary_score * 0.05::double, 4) AS overall, missing FROM p""".replace(
    "{EDUCATION}", "(SELECT CASE WHEN needed = 0 THEN 100.0 WHEN level >= needed THEN 100.0 ELSE level / needed::double * 100 END::double FROM (SELECT CASE kind WHEN 1 THEN 4 WHEN 3 THEN 3 ELSE 0 END AS needed, list_max(list_transform(education, lambda x: greatest(" + ", ".join(f"CASE WHEN contains(x, '{k}') THEN {v} ELSE 0 END" for k, v in scoring.RANKING_LEVELS.items()) + "))) AS level))"))
def ranked_for_jobs(spark, sf_dir):
    """Every profile's match with every job whose requirements a model read; an answer without them asks for nothing."""
    jobs = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("job"), scoring.requirements(F.expr(_REQUIRED)).alias("asked"))
    found = searches.ranked_for_jobs(profiles(spark, sf_dir), jobs, "profile_id", "job", "asked")
    return found.select("job", "profile_id", "skills_score", "experience_score", "education_score", F.round("overall", 4).alias("overall"), "missing")


_FILE_SAYS = lambda x: f"len(list_filter(words, lambda w: contains(lower({x}), w))) > 0"
_FILE_TEXT = "CASE WHEN doc_id % 40 = 0 THEN concat('Urgent need of machinery in nation_', doc_id % 7, ', ', doc_id % 15, ' years, up to ', doc_id % 9, ' lakh. ', text) ELSE text END"


@query(f"""WITH {PROFILES_SQL}, d AS (SELECT doc_id AS file, {_FILE_TEXT} AS said, embedding AS q, label FROM documents JOIN embeddings ON doc_id = vec_id WHERE doc_id % 20 = 0), g AS (SELECT *, list_distinct(list_filter(string_split_regex(lower(said), '\\s+'), lambda w: length(w) > 2)) AS words,
 try_cast(regexp_extract(lower(said), '([0-9]+)\\s*(?:year|yr|yrs|years|exp|experience)', 1) AS double) AS target, try_cast(regexp_extract(lower(said), '([0-9]+(?:\\.[0-9]+)?)\\s*(?:lakh|lac|l)', 1) AS double) AS lakhs FROM d WHERE trim(regexp_replace(said, '\\s+', ' ', 'g')) <> ''),
c AS (SELECT g.*, e.vec_id, (1 + list_cosine_similarity(g.q::double[], e.embedding::double[])) / 2 AS similarity FROM g, embeddings e),
h AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY file ORDER BY similarity DESC, vec_id) AS place FROM c) WHERE place <= 50),
n AS (SELECT * FROM (SELECT h.*, p.*, row_number() OVER (PARTITION BY file ORDER BY similarity DESC, vec_id) AS nth FROM h JOIN profiles p ON p.profile_id = vec_id WHERE similarity >= 0.4 AND p.user_id % 3 = h.label % 3) WHERE nth <= 10),
s AS (SELECT *, try_cast(regexp_extract(total_experience, '([0-9]+(?:\\.[0-9]+)?)', 1) AS double) AS own, CASE WHEN coalesce(expected_salary, 0) > 1000000 THEN expected_salary / 100000 ELSE coalesce(expected_salary, 0) END AS pay FROM n),
r AS (SELECT *, CASE WHEN {_ANY('experience[1:3]', f'x = experience[1] AND {_FILE_SAYS("x.title")}')} THEN 1.0 WHEN {_ANY('experience[1:3]', _FILE_SAYS('x.title'))} THEN 0.8 WHEN {_ANY('labels', _FILE_SAYS('x'))} THEN 0.7 ELSE 0 END AS d,
 CASE WHEN {_ANY('list_concat(skills, may_also)', _FILE_SAYS('x'))} THEN 1.0 ELSE 0 END AS k, CASE WHEN abs(own - target) <= 1 THEN 1.0 WHEN abs(own - target) <= 2 THEN 0.8 WHEN own >= target * 0.8::double THEN 0.6 ELSE 0 END AS x, CASE WHEN pay <= lakhs THEN 1.0 WHEN pay <= lakhs * 1.2::double THEN 0.8 ELSE 0 END AS y FROM s),
o AS (SELECT *, d::double * 0.4::double + k::double * 0.15::double + x::double * 0.1::double + y::double * 0.05::double AS priority FROM r)
SELECT file, profile_id, round(similarity, 6) AS similarity, round(priority, 4) AS priority, CASE WHEN priority = 0 THEN 'Basic vector similarity' ELSE concat_ws('; ', CASE WHEN d > 0 THEN 'Designation match' END, CASE WHEN k > 0 THEN 'Skills match' END, CASE WHEN x > 0 THEN 'Experience match' END, CASE WHEN y > 0 THEN 'Salary match' END) END AS reason,
 round(CASE WHEN priority > 0 THEN priority * 0.7::double + similarity * 0.3::double ELSE similarity END * 100, 4) AS final_score FROM o WHERE CASE WHEN priority > 0 THEN priority * 0.7::double + similarity * 0.3::double ELSE similarity END * 100 >= 40""")
def searched_by_files(spark, sf_dir):
    """The profiles that suit job files (every document whose id is divisible by 20, with its vector), within the rows that each file's owner sees."""
    e = table(spark, sf_dir, "embeddings")
    files = table(spark, sf_dir, "documents").filter("doc_id % 20 = 0").join(e, F.col("doc_id") == F.col("vec_id")).select(F.col("doc_id").alias("file"), F.expr(_FILE_TEXT).alias("text"), "embedding", "label")
    index = _index(spark, e.select(F.col("vec_id").alias("profile_id"), "embedding"), "profile_id")
    found = searches.by_files(index, profiles(spark, sf_dir), files, "file", "text", "embedding", least=0.4, keep=F.col("user_id") % 3 == F.col("label") % 3)
    return found.select("file", "profile_id", F.round("similarity", 6).alias("similarity"), F.round("priority", 4).alias("priority"), "reason", F.round("final_score", 4).alias("final_score"))


_SILENT = ", ".join(f"'{w}'" for w in terms.SILENT)


@query(f"""WITH RECURSIVE d AS (SELECT doc_id, lower(text) AS text, lower(left(text, 60)) AS title, CASE WHEN source IS NULL THEN [] ELSE [lower(source), CASE WHEN doc_id % 3 = 0 THEN 'other work' ELSE 'new work' END] END AS skills FROM documents),
w AS (SELECT unnest(list_concat(CASE WHEN contains(title, 'ther') OR list_contains(skills, 'other work') THEN list_concat(skills, list_filter(regexp_extract_all(coalesce(title, ''), '[\\p{{L}}\\p{{M}}\\p{{N}}_]+'), lambda x: length(x) >= 3)) ELSE [] END,
 CASE WHEN contains(text, 'ther') THEN list_filter(regexp_extract_all(text, '[\\p{{L}}\\p{{M}}\\p{{N}}_]+'), lambda x: regexp_full_match(x, '[a-z]{{3,}}') AND x NOT IN ({_SILENT})) ELSE [] END)) AS term FROM d),
k AS (SELECT term, count(*) AS n FROM w WHERE term <> 'ther' AND length(term) >= 2 GROUP BY 1 HAVING count(*) >= 2), {matching_runs('ther', 'k WHERE length(term) BETWEEN 3 AND 7 AND NOT contains(term, chr(116) || chr(104) || chr(101) || chr(114))')},
q AS (SELECT term, 2.0::double * sum(n) / (length(term) + 4) AS alike FROM m GROUP BY term),
x AS (SELECT k.term, n, CASE WHEN strpos(k.term, 'ther') = 1 THEN 0.9::double - (length(k.term) - 4) * 0.01::double WHEN strpos(k.term, 'ther') > 1 THEN 0.7::double - (strpos(k.term, 'ther') - 1) * 0.01::double WHEN alike > 0.7 THEN alike * 0.5::double WHEN regexp_matches(replace(k.term, ' ', ''), 't.*h.*e.*r') THEN 0.3 ELSE 0 END::double AS relevance FROM k LEFT JOIN q ON k.term = q.term)
SELECT term, n, round(relevance, 6) AS relevance, round(n + relevance * 10, 6) AS score FROM x WHERE relevance > 0.01""")
def co_occurring_terms(spark, sf_dir):
    """Terms around a prefix: of skills, titles (the first 60 characters of documents) and descriptions (their texts)."""
    d = table(spark, sf_dir, "documents")
    skills = F.array(F.concat("source", F.when(F.col("doc_id") % 3 == 0, ", other work").otherwise(", new work")))
    found = terms.co_occurring(d, "ther", skills, F.array(F.left("text", F.lit(60))), F.array("text"))
    return found.select("term", "n", F.round("relevance", 6).alias("relevance"), F.round("score", 6).alias("score"))


#: Fields of several spellings, in words that both engines read.
_DIRTY = {
    "person": ("name", "CASE p_partkey % 5 WHEN 0 THEN upper(p_name) WHEN 1 THEN concat('  ', p_name, '-lee ') WHEN 2 THEN concat('Lee A.B ', p_brand) WHEN 3 THEN 'Ann  Lee' ELSE ' ' END"),
    "mail": ("email", "CASE p_partkey % 3 WHEN 0 THEN concat('Ann. Lee', p_size, '@Mail.ORG') WHEN 1 THEN concat('a', p_size, '@b.org') ELSE NULL END"),
    "mobile": ("phone", "CASE p_partkey % 3 WHEN 0 THEN concat('+91-98765.', 43210 + p_size) WHEN 1 THEN concat('(080)  ', 2345678 + p_size) ELSE concat('tel: ', p_size) END"),
    "skills": ("skills", "CASE p_partkey % 4 WHEN 0 THEN concat(p_name, ', x, ', p_brand, '|', p_type) WHEN 1 THEN concat(p_name, ' / ', p_brand) WHEN 2 THEN p_name ELSE concat(p_name, '; ', p_type, ';') END"),
    "years": ("experience", "CASE p_partkey % 3 WHEN 0 THEN concat(p_size, '.5 years') WHEN 1 THEN concat('over  ', p_size) ELSE 'fresher' END"),
    "pay": ("salary", "CASE p_partkey % 6 WHEN 0 THEN concat('₹ ', p_size, ' Lakh') WHEN 1 THEN concat('Rs. ', p_size, ',50,000') WHEN 2 THEN concat(p_size, ' crore INR') WHEN 3 THEN concat('$', p_size, 'K') WHEN 4 THEN concat(p_size, '.25 lac pa') ELSE 'negotiable' END"),
    "marks": ("percentage", "CASE p_partkey % 4 WHEN 0 THEN concat(p_size, '.5 %') WHEN 1 THEN concat('-', p_size, '%') WHEN 2 THEN concat('about ', p_size, '%') ELSE concat(p_size, '') END"),
    "place": ("location", "CASE p_partkey % 4 WHEN 0 THEN concat(lower(p_type), ', , goa,') WHEN 1 THEN concat(p_type, ',,  GOA') WHEN 2 THEN 'New Goa' ELSE concat('new  ', 'goa , ') END"),
    "note": ("text", "CASE p_partkey % 2 WHEN 0 THEN concat(p_name, '   ', p_brand) ELSE p_name END"),
}
_TITLE = "array_to_string(list_transform(string_split(p_name, ' '), lambda w: upper(w[1]) || w[2:]), ' ')"
_TYPE = "upper(p_type[1]) || lower(p_type[2:])"
_WS, _OK = "whitespace_normalization", "''"
#: For each field: its text, number and items when clean, and the steps, by the same cases.
_CLEAN = {
    "person": (f"CASE p_partkey % 5 WHEN 0 THEN {_TITLE} WHEN 1 THEN {_TITLE} || '-Lee' WHEN 2 THEN 'Lee A. B ' || p_brand WHEN 3 THEN 'Ann Lee' ELSE ' ' END", "NULL", "NULL", f"CASE p_partkey % 5 WHEN 0 THEN 'name_formatting' WHEN 2 THEN 'name_formatting' WHEN 4 THEN '' ELSE '{_WS},name_formatting' END"),
    "mail": ("CASE p_partkey % 3 WHEN 0 THEN 'ann.lee' || p_size || '@mail.org' WHEN 1 THEN 'a' || p_size || '@b.org' END", "NULL", "NULL", "CASE p_partkey % 3 WHEN 0 THEN 'email_formatting' ELSE '' END"),
    "mobile": ("CASE p_partkey % 3 WHEN 0 THEN '+91-98765' || (43210 + p_size) WHEN 1 THEN '(080) ' || (2345678 + p_size) ELSE p_size::varchar END", "NULL", "NULL", f"CASE p_partkey % 3 WHEN 1 THEN '{_WS},phone_formatting' ELSE 'phone_formatting' END"),
    "skills": ("CASE WHEN p_partkey % 4 = 2 THEN p_name END", "NULL", "CASE p_partkey % 4 WHEN 0 THEN p_name || '~' || p_brand || '|' || p_type WHEN 1 THEN p_name || '~' || p_brand WHEN 3 THEN p_name || '~' || p_type END", "CASE WHEN p_partkey % 4 = 2 THEN '' ELSE 'skills_normalization' END"),
    "years": ("CASE WHEN p_partkey % 3 = 2 THEN 'fresher' END", "CASE p_partkey % 3 WHEN 0 THEN p_size + 0.5::double WHEN 1 THEN p_size END", "NULL", f"CASE p_partkey % 3 WHEN 0 THEN 'experience_normalization' WHEN 1 THEN '{_WS},experience_normalization' ELSE '' END"),
    "pay": ("CASE WHEN p_partkey % 6 = 5 THEN 'negotiable' END", "CASE p_partkey % 6 WHEN 0 THEN p_size * 1e5 WHEN 1 THEN p_size * 1e5 + 50000 WHEN 2 THEN p_size * 1e7 WHEN 3 THEN p_size * 1e3 WHEN 4 THEN (p_size + 0.25::double) * 1e5 END", "NULL", "CASE WHEN p_partkey % 6 = 5 THEN '' ELSE 'salary_normalization' END"),
    "marks": ("NULL", "CASE p_partkey % 4 WHEN 0 THEN p_size + 0.5::double WHEN 1 THEN -p_size ELSE p_size END", "NULL", "'percentage_normalization'"),
    "place": (f"CASE p_partkey % 4 WHEN 0 THEN {_TYPE} || ', Goa' WHEN 1 THEN CASE WHEN p_type = upper(p_type) THEN {_TYPE} || ', Goa' ELSE p_type || ', GOA' END WHEN 2 THEN 'New Goa' ELSE 'New Goa ' END", "NULL", "NULL", f"CASE p_partkey % 4 WHEN 0 THEN 'location_formatting' WHEN 2 THEN '' ELSE '{_WS},location_formatting' END"),
    "note": ("CASE p_partkey % 2 WHEN 0 THEN p_name || ' ' || p_brand ELSE p_name END", "NULL", "NULL", f"CASE p_partkey % 2 WHEN 0 THEN '{_WS}' ELSE '' END"),
}


@query(" UNION ALL ".join(f"SELECT p_partkey, '{f}' AS field, {t} AS text, ({n})::double AS number, ({i})::varchar AS items, {s} AS steps, CASE WHEN ({s}) = '' THEN 1.0 WHEN contains({s}, ',') THEN 1.0 ELSE 0.9 END::double AS score FROM part" for f, (t, n, i, s) in _CLEAN.items()))
def cleaned_fields(spark, sf_dir):
    """Nine fields of several spellings, cleaned by their kinds, with the steps that it took."""
    parts = spread(table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_brand", "p_type", "p_size"), "p_partkey")
    rows = parts.select("p_partkey", *(F.expr(said).alias(f) for f, (_, said) in _DIRTY.items()))
    found = cleaning.cleaned_fields(rows, ["p_partkey"], {f: kind for f, (kind, _) in _DIRTY.items()})
    return found.select("p_partkey", "field", "text", "number", F.array_join("items", "~").alias("items"), F.array_join("steps", ",").alias("steps"), F.round("score", 6).alias("score"))
