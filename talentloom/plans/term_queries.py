"""Frequencies, relations, recommendations and completion of terms."""

from __future__ import annotations

from pyspark.sql import functions as F

from talentloom.functions import text
from talentloom.operators import containment, tables, terms
from talentloom.plans.profiles import PROFILES_SQL, profiles, table

QUERIES: dict = {}


def query(sql: str | None = None):
    def put(f):
        QUERIES[f.__name__] = (f, sql)
        return f

    return put


def _words(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.array_distinct(F.split(F.lower("text"), r"[^a-z]+")).alias("words"))


_COUNTS = "SELECT w AS term, count(*) AS n FROM (SELECT unnest(list_distinct(regexp_split_to_array(lower(text), '[^a-z]+'))) AS w FROM documents) WHERE w <> '' GROUP BY w"


@query(_COUNTS)
def skill_frequency(spark, sf_dir):
    """In how many texts each word occurs."""
    return terms.term_counts(_words(spark, sf_dir), F.col("words"))


@query("SELECT p_name AS title, count(*) AS n FROM part WHERE contains(lower(p_name), 'bolt') AND p_name <> '' GROUP BY p_name ORDER BY n DESC, title LIMIT 10")
def title_frequency(spark, sf_dir):
    """The most frequent titles that contain a prefix."""
    found = table(spark, sf_dir, "part").filter(text.holds(F.col("p_name"), "bolt") & (F.col("p_name") != ""))
    return found.groupBy(F.col("p_name").alias("title")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "title").limit(10)


@query("SELECT lower(p_type) AS position, count(*) AS n, arg_min(p_name, p_partkey) AS first_title FROM part GROUP BY 1")
def popular_positions(spark, sf_dir):
    """Positions whatever their case, with the first title of each."""
    return table(spark, sf_dir, "part").groupBy(F.lower("p_type").alias("position")).agg(F.count(F.lit(1)).alias("n"), F.min_by("p_name", "p_partkey").alias("first_title"))


@query("SELECT DISTINCT p_brand, p_type FROM part")
def distinct_values(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_brand", "p_type").distinct()


@query(f"SELECT upper(substr(term, 1, 1)) || substr(term, 2) AS skill, n FROM (SELECT * FROM ({_COUNTS}) ORDER BY n DESC, term LIMIT 40) WHERE length(term) > 2")
def trending_skills(spark, sf_dir):
    """The 40 most frequent terms, then those of more than two letters, capitalised."""
    top = terms.term_counts(_words(spark, sf_dir), F.col("words")).orderBy(F.desc("n"), "term").limit(40)
    return top.filter(F.length("term") > 2).select(F.initcap("term").alias("skill"), "n")


@query("SELECT p_partkey, coalesce(n, 0) AS n FROM part LEFT JOIN (SELECT l_partkey, count(*) AS n FROM lineitem GROUP BY 1) ON p_partkey = l_partkey ORDER BY n DESC, p_partkey LIMIT 100")
def trending_vocabulary(spark, sf_dir):
    """A vocabulary by use, unused entries with zero."""
    used = table(spark, sf_dir, "lineitem").groupBy(F.col("l_partkey").alias("p_partkey")).agg(F.count(F.lit(1)).alias("n"))
    return table(spark, sf_dir, "part").select("p_partkey").join(used, "p_partkey", "left").select("p_partkey", F.coalesce("n", F.lit(0)).alias("n")).orderBy(F.desc("n"), "p_partkey").limit(100)


@query("""SELECT term, round(sum(w), 2) AS weight FROM (SELECT lower(p_type) AS term, 1.0::double AS w FROM part
UNION ALL SELECT t, 0.5 FROM (SELECT unnest(string_split(lower(p_name), ' ')) AS t FROM part) WHERE length(t) > 2
UNION ALL SELECT t, 0.3 FROM (SELECT unnest(regexp_extract_all(lower(p_brand), '[a-z]+')) AS t FROM part)
UNION ALL SELECT lower(p_name), 2.0 FROM part WHERE p_size > 40) GROUP BY term""")
def weighted_terms(spark, sf_dir):
    """Terms from several sources, each with its weight."""
    p = table(spark, sf_dir, "part")
    one = p.select(F.lower("p_type").alias("term"))
    words = p.select(F.explode(F.split(F.lower("p_name"), " ")).alias("term")).filter(F.length("term") > 2)
    brands = p.select(F.explode(F.regexp_extract_all(F.lower("p_brand"), F.lit("[a-z]+"), F.lit(0))).alias("term"))
    named = p.filter("p_size > 40").select(F.lower("p_name").alias("term"))
    return terms.weighted_counts([(one, 1.0), (words, 0.5), (brands, 0.3), (named, 2.0)]).select("term", F.round("weight", 2).alias("weight"))


def _orders_types(spark, sf_dir):
    named = table(spark, sf_dir, "part").select("p_partkey", "p_name")
    rows = table(spark, sf_dir, "lineitem").join(named, F.col("l_partkey") == F.col("p_partkey"))
    return rows.groupBy("l_orderkey").agg(F.collect_set("p_name").alias("names"))


_RELATED = """t AS (SELECT DISTINCT l_orderkey, lower(p_name) AS term FROM lineitem JOIN part ON l_partkey = p_partkey),
c AS (SELECT a.term, b.term AS other, count(*) AS n FROM t a JOIN t b ON a.l_orderkey = b.l_orderkey AND a.term <> b.term GROUP BY 1, 2),
s AS (SELECT *, n / sum(n) OVER (PARTITION BY term) AS strength FROM c),
r AS (SELECT *, row_number() OVER (PARTITION BY term ORDER BY n DESC, other) AS rank FROM s WHERE n >= 2)"""


@query(f"WITH {_RELATED} SELECT term, other, n, round(strength, 6) AS strength, rank FROM r WHERE rank <= 15")
def related_terms(spark, sf_dir):
    """The 15 terms that occur most often with each term, with their shares."""
    found = terms.related(_orders_types(spark, sf_dir), "l_orderkey", F.col("names"))
    return found.withColumn("strength", F.round("strength", 6)).withColumn("rank", F.col("rank").cast("long"))


@query(r"""SELECT term, n, n + 10 * relevance AS score FROM (SELECT t AS term, count(*) AS n, max(CASE WHEN t = 'the' THEN 1 WHEN contains(t, 'the') THEN 0.7 ELSE 0 END)::double AS relevance
FROM (SELECT unnest(regexp_extract_all(lower(text), '[a-z]{3,}')) AS t FROM documents WHERE contains(lower(text), 'the')) WHERE t NOT IN ('and', 'for', 'was', 'that', 'with') GROUP BY t) WHERE n >= 2""")
def context_terms(spark, sf_dir):
    """Words of the texts that contain a prefix, by frequency and relevance, at least twice and without stop words."""
    rows = table(spark, sf_dir, "documents").filter(text.holds(F.col("text"), "the"))
    found = rows.select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]{3,}"), F.lit(0))).alias("term")).filter(~F.col("term").isin("and", "for", "was", "that", "with"))
    relevance = F.when(F.col("term") == "the", 1.0).when(F.contains("term", F.lit("the")), 0.7).otherwise(0.0)
    return found.groupBy("term").agg(F.count(F.lit(1)).alias("n")).filter("n >= 2").select("term", "n", (F.col("n") + 10 * relevance).alias("score"))


_BY_TITLES = """t AS (SELECT DISTINCT p_type AS title, w AS skill FROM (SELECT p_type, unnest(string_split(lower(p_name), ' ')) AS w FROM part)),
s AS (SELECT skill, count(DISTINCT title)::double AS base FROM t GROUP BY 1),
f AS (SELECT skill, base + base / 6 * 2 + CASE WHEN length(skill) BETWEEN 3 AND 15 THEN 0.5::double ELSE 0 END AS score FROM s WHERE length(skill) >= 2)"""


@query(f"WITH {_BY_TITLES}, b AS (SELECT *, CASE WHEN score >= 3 THEN 'high' WHEN score >= 1.5 THEN 'medium' WHEN score >= 0.5 THEN 'low' END AS band, count(*) FILTER (score >= 3) OVER () AS h FROM f), r AS (SELECT *, row_number() OVER (PARTITION BY band ORDER BY score DESC, skill) AS pos FROM b WHERE band IS NOT NULL) SELECT skill, round(score, 6) AS score, band, 'other' AS category FROM r WHERE CASE WHEN h >= 30 THEN band = 'high' AND pos <= 80 WHEN h >= 15 THEN band = 'high' OR (band = 'medium' AND pos <= 50) WHEN h >= 5 THEN band <> 'low' OR pos <= 30 ELSE score > 0.5 END")
def skills_by_titles(spark, sf_dir):
    """Skills of chosen titles by how many titles have them, as many as their quality allows, by category."""
    rows = table(spark, sf_dir, "part").select(F.col("p_type").alias("title"), F.explode(F.split(F.lower("p_name"), " ")).alias("skill"))
    base = rows.groupBy("skill").agg(F.countDistinct("title").cast("double").alias("base")).filter(F.length("skill") >= 2)
    scored = base.select("skill", (F.col("base") + F.col("base") / 6 * 2 + F.when(F.length("skill").between(3, 15), 0.5).otherwise(0.0)).alias("score"))
    found = terms.adaptive(scored, "score", [F.desc("score"), "skill"])
    return found.select("skill", F.round("score", 6).alias("score"), "band", text.category(F.col("skill")).alias("category"))


@query("SELECT p_type AS title, count(DISTINCT w) AS skills FROM (SELECT p_type, unnest(string_split(lower(p_name), ' ')) AS w FROM part) GROUP BY 1")
def skills_per_title(spark, sf_dir):
    rows = table(spark, sf_dir, "part").select(F.col("p_type").alias("title"), F.explode(F.split(F.lower("p_name"), " ")).alias("skill"))
    return rows.groupBy("title").agg(F.countDistinct("skill").alias("skills"))


_LADDER = "CASE WHEN term = 'red' THEN 1.0 WHEN strpos(term, 'red') = 1 THEN greatest(0.9::double - (length(term) - 3) * 0.01::double, 0.3) WHEN strpos(term, 'red') > 1 THEN greatest(0.7::double - (strpos(term, 'red') - 1) * 0.01::double, 0.2) WHEN regexp_matches(replace(term, ' ', ''), 'r.*e.*d') THEN 0.3 ELSE 0.0 END"


@query(f"""WITH {_RELATED}, k AS (SELECT lower(p_name) AS term, count(*) AS n FROM part GROUP BY 1),
b AS (SELECT CASE WHEN term = 'red' THEN other ELSE term END AS term, max(least(strength * 2, 0.3)) AS bonus FROM r WHERE rank <= 15 AND (term = 'red' OR other = 'red') GROUP BY 1),
x AS (SELECT k.term, n, ({_LADDER.replace('term', 'k.term')})::double AS base, coalesce(bonus, 0) + least(n / max(n) OVER () * 0.2::double, 0.2) + CASE WHEN n > count(*) OVER () * 0.1 THEN -0.1 ELSE 0 END AS more FROM k LEFT JOIN b ON k.term = b.term)
SELECT term, n, round(greatest(0.0, least(2.0, base + more)), 6) AS score FROM x WHERE base > 0 ORDER BY greatest(0.0, least(2.0, base + more)) DESC, length(term), term LIMIT 50""")
def autocomplete(spark, sf_dir):
    """Terms for a prefix by how they match, with bonuses for relation and frequency."""
    counts = terms.term_counts(table(spark, sf_dir, "part"), F.array("p_name"))
    related = terms.related(_orders_types(spark, sf_dir), "l_orderkey", F.col("names"))
    return terms.completions(counts, related, "red").withColumn("score", F.round("score", 6))


@query("""SELECT p_name, relevance FROM (SELECT DISTINCT lower(trim(p_name)) AS p_name FROM part) t, LATERAL (SELECT CASE WHEN p_name IN ('red', 'blue widget') THEN 10.0 ELSE
 (CASE WHEN contains(p_name, 'red') THEN 8 WHEN contains('red', p_name) THEN 6 WHEN contains(p_name, 'red') THEN 4 WHEN list_bool_or(list_transform(list_filter(string_split(p_name, ' '), lambda w: length(w) > 2), lambda w: contains('red', w))) THEN 3 ELSE 0 END)
 + (CASE WHEN contains(p_name, 'blue widget') THEN 8 WHEN contains('blue widget', p_name) THEN 6 WHEN contains(p_name, 'blue') OR contains(p_name, 'widget') THEN 4 WHEN list_bool_or(list_transform(list_filter(string_split(p_name, ' '), lambda w: length(w) > 2), lambda w: contains('blue widget', w))) THEN 3 ELSE 0 END) END::double AS relevance) WHERE relevance > 0""")
def position_skills(spark, sf_dir):
    """Vocabulary entries by their relevance to a position's keywords."""
    vocabulary = table(spark, sf_dir, "part").select(F.lower(F.trim("p_name")).alias("p_name")).distinct()
    return terms.keyword_relevance(vocabulary, "p_name", ["red", "blue widget"])


@query("""SELECT w AS skill, count(*) AS profiles FROM (SELECT DISTINCT lower(trim(p_name)) AS w FROM part) v JOIN (SELECT DISTINCT l_orderkey, lower(trim(p_name)) AS s FROM lineitem JOIN part ON l_partkey = p_partkey) u ON w = s GROUP BY 1""")
def vocabulary_popularity(spark, sf_dir):
    """How many rows have each vocabulary entry: normalised values meet in an equi-join."""
    vocabulary = table(spark, sf_dir, "part").select(F.lower(F.trim("p_name")).alias("skill")).distinct()
    used = _orders_types(spark, sf_dir).select("l_orderkey", F.explode("names").alias("s")).select("l_orderkey", F.lower(F.trim("s")).alias("skill")).distinct()
    return used.join(vocabulary, "skill").groupBy("skill").agg(F.count(F.lit(1)).alias("profiles"))


@query("SELECT p_name, p_partkey FROM (SELECT *, row_number() OVER (PARTITION BY lower(trim(p_name)) ORDER BY p_partkey) AS n FROM part) WHERE n = 1")
def first_spellings(spark, sf_dir):
    """Values without regard to case, the first spelling of each."""
    return tables.first_spelling(table(spark, sf_dir, "part"), "p_name", ["p_partkey"]).select("p_name", "p_partkey")


@query("""SELECT v AS value, src FROM (SELECT v, src, row_number() OVER (PARTITION BY lower(trim(v)) ORDER BY pr, v) AS n FROM (SELECT DISTINCT p_type AS v, 'semantic' AS src, 1 AS pr FROM part UNION ALL SELECT DISTINCT p_name, 'lexical', 2 FROM part UNION ALL SELECT DISTINCT lower(p_type), 'lexical', 2 FROM part)) WHERE n = 1""")
def merged_suggestions(spark, sf_dir):
    """Two candidate lists as one; the first list wins where both have a value."""
    p = table(spark, sf_dir, "part")
    first = p.select(F.col("p_type").alias("value"), F.lit("semantic").alias("src"), F.lit(1).alias("pr")).distinct()
    second = p.select(F.explode(F.array("p_name", F.lower("p_type"))).alias("value"), F.lit("lexical").alias("src"), F.lit(2).alias("pr")).distinct()
    return tables.first_spelling(first.unionByName(second), "value", ["pr", "value"]).select("value", "src")


@query("""SELECT term FROM (SELECT DISTINCT w AS term FROM (SELECT unnest(string_split(lower(p_name || ' ' || p_type), ' ')) AS w FROM part WHERE p_size > 25)) WHERE term <> '' AND term NOT IN (SELECT w FROM (SELECT unnest(string_split(lower(p_name), ' ')) AS w FROM part WHERE p_size <= 1))""")
def vocabulary_additions(spark, sf_dir):
    """New values that a vocabulary lacks."""
    words = lambda df, said: df.select(F.explode(F.split(F.lower(said), " ")).alias("term"))
    p = table(spark, sf_dir, "part")
    return tables.absent(words(p.filter("p_size > 25"), F.concat_ws(" ", "p_name", "p_type")), words(p.filter("p_size <= 1"), F.col("p_name")), "term")


@query("SELECT term, n, count(*) OVER () - row_number() OVER (ORDER BY n DESC, term) + 1 AS pseudo FROM (SELECT p_type AS term, count(*) AS n FROM part GROUP BY 1)")
def position_frequency(spark, sf_dir):
    """Frequencies that stand for positions in a list."""
    counts = table(spark, sf_dir, "part").groupBy(F.col("p_type").alias("term")).agg(F.count(F.lit(1)).alias("n"))
    every = F.broadcast(counts.agg(F.count(F.lit(1)).alias("terms")))
    return tables.ranked(counts, "n", "term").crossJoin(every).select("term", "n", (F.col("terms") - F.col("rank") + 1).alias("pseudo"))


@query(f"""WITH {PROFILES_SQL} SELECT profile_id, title, company, from_date FROM (SELECT DISTINCT profile_id, lower(x.title) AS title, lower(x.company) AS company, x.from_date AS from_date FROM (SELECT profile_id, unnest(experience) AS x FROM profiles))""")
def distinct_jobs(spark, sf_dir):
    """Jobs of each profile without repeats of company, title and start."""
    jobs = profiles(spark, sf_dir).select("profile_id", F.explode("experience").alias("x"))
    return jobs.select("profile_id", F.lower("x.title").alias("title"), F.lower("x.company").alias("company"), F.col("x.from_date").alias("from_date")).dropDuplicates()


@query("SELECT (SELECT count(DISTINCT lower(p_name)) FROM part) AS file_skills, (SELECT count(DISTINCT lower(p_type)) FROM part) AS database_skills, (SELECT count(DISTINCT lower(v)) FROM (SELECT p_name AS v FROM part UNION ALL SELECT p_type FROM part)) AS all_skills")
def skill_counts(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    return p.select(F.explode(F.array(F.struct(F.lit("f").alias("k"), F.lower("p_name").alias("v")), F.struct(F.lit("d").alias("k"), F.lower("p_type").alias("v")))).alias("x")).agg(F.countDistinct(F.when(F.col("x.k") == "f", F.col("x.v"))).alias("file_skills"), F.countDistinct(F.when(F.col("x.k") == "d", F.col("x.v"))).alias("database_skills"), F.countDistinct("x.v").alias("all_skills"))


@query(f"WITH {PROFILES_SQL} SELECT upper(substr(skill, 1, 1)) || substr(skill, 2) AS skill, n FROM (SELECT lower(trim(s)) AS skill, count(*) AS n FROM (SELECT unnest(list_concat(skills, may_also)) AS s FROM profiles) WHERE trim(s) <> '' GROUP BY 1 ORDER BY n DESC, skill LIMIT 8) WHERE length(skill) > 2")
def trending_profile_skills(spark, sf_dir):
    """The most frequent of what profiles know and may also know, then those of more than two letters, capitalised."""
    both = F.concat("skills", "may_also")
    top = terms.term_counts(profiles(spark, sf_dir), both).orderBy(F.desc("n"), "term").limit(8)
    return top.filter(F.length("term") > 2).select(F.concat(F.upper(F.substring("term", 1, 1)), F.substring("term", 2, 100)).alias("skill"), "n")


#: Keywords by position, for the test tables.
POSITIONS = {"steel": ["steel", "brass"], "copper": ["economy", "large"]}


@query("""WITH v AS (SELECT lower(trim(p_type)) AS t, count(*) AS n FROM part GROUP BY 1), w AS (SELECT t, n, list_filter(string_split(t, ' '), lambda x: length(x) > 2) AS parts FROM v),
s AS (SELECT t, n, CASE WHEN t IN ('economy', 'large') THEN 10.0 ELSE CASE WHEN contains(t, 'economy') THEN 8 WHEN contains('economy', t) THEN 6 WHEN len(list_filter(parts, lambda x: contains('economy', x))) > 0 THEN 3 ELSE 0 END + CASE WHEN contains(t, 'large') THEN 8 WHEN contains('large', t) THEN 6 WHEN len(list_filter(parts, lambda x: contains('large', x))) > 0 THEN 3 ELSE 0 END END AS relevance FROM w)
SELECT t AS p_type, (relevance + n * 0.5)::double AS score FROM s WHERE relevance > 0 ORDER BY score DESC, p_type LIMIT 15""")
def recommended_skills(spark, sf_dir):
    """A position's skills: vocabulary by relevance to its keywords, raised by how common each is."""
    counts = table(spark, sf_dir, "part").groupBy(F.lower(F.trim("p_type")).alias("p_type")).agg(F.count(F.lit(1)).alias("n"))
    return terms.recommended(counts.select("p_type"), "p_type", terms.position_keywords("Senior Copper Smith", POSITIONS), counts.withColumnRenamed("p_type", "term"), 15)


@query("""SELECT doc_id, term FROM documents JOIN (SELECT DISTINCT w AS term FROM (SELECT unnest(string_split(lower(p_name), ' ')) AS w FROM part UNION ALL SELECT lower(p_name) FROM part) WHERE w <> '') ON contains(lower(text), term)""")
def mentioned_terms(spark, sf_dir):
    """Which entries of a vocabulary, and which of their words, each text contains."""
    p = table(spark, sf_dir, "part")
    vocabulary = p.select(F.explode(F.split("p_name", " ")).alias("w")).unionByName(p.select(F.col("p_name").alias("w")))
    return containment.contained(table(spark, sf_dir, "documents"), "doc_id", "text", vocabulary, "w")


@query("""WITH t AS (SELECT DISTINCT lower(trim(v)) AS t FROM (SELECT p_name AS v FROM part UNION ALL SELECT p_type FROM part)), w AS (SELECT t, list_filter(string_split(t, ' '), lambda x: length(x) > 2) AS parts FROM t),
o AS (SELECT DISTINCT p_brand AS position, k FROM (SELECT p_brand, lower(CASE WHEN p_size < 10 THEN p_name WHEN p_size < 25 THEN string_split(p_name, ' ')[1] ELSE left(p_type, 4) || ' ' || string_split(p_name, ' ')[2] END) AS k FROM part)),
s AS (SELECT position, t, k, CASE WHEN contains(t, k) THEN 8 WHEN contains(k, t) THEN 6 WHEN len(list_filter(string_split(k, ' '), lambda x: length(x) > 2 AND contains(t, x))) > 0 THEN 4 WHEN len(list_filter(parts, lambda x: contains(k, x))) > 0 THEN 3 ELSE 0 END AS points FROM o, w)
SELECT position, t AS skill, (CASE WHEN bool_or(t = k) THEN 10 ELSE sum(points) END)::double AS relevance FROM s GROUP BY 1, 2 HAVING sum(points) > 0""")
def relevance_by_positions(spark, sf_dir):
    """A vocabulary's relevance to the keywords of every position, both of them tables."""
    p = table(spark, sf_dir, "part")
    vocabulary = p.select(F.explode(F.array("p_name", "p_type")).alias("skill"))
    words = F.split("p_name", " ")
    keyword = F.when(F.col("p_size") < 10, F.col("p_name")).when(F.col("p_size") < 25, words[0]).otherwise(F.concat(F.left("p_type", F.lit(4)), F.lit(" "), words[1]))
    return containment.keyword_relevance(vocabulary, "skill", p.select(F.col("p_brand").alias("position"), keyword.alias("keyword")), "position", "keyword")


def matching_runs(prefix: str, terms_of: str) -> str:
    """The matching runs of a term and a misspelt prefix, found as the longest one (the earliest of equally long ones) and then those on either side of it."""
    return f"""m(term, a, b, n) AS (SELECT term, '{prefix}', term, 0::bigint FROM {terms_of} UNION ALL
 SELECT term, x.a, x.b, x.n FROM (SELECT term, unnest([{{'a': substr(a, 1, -best.i - 1), 'b': substr(b, 1, -best.j - 1), 'n': best.n}}, {{'a': substr(a, best.n - best.i), 'b': substr(b, best.n - best.j), 'n': 0::bigint}}]) AS x FROM
  (SELECT term, a, b, list_max(flatten(list_transform(range(1, length(a) + 1), lambda i: list_transform(list_filter(range(1, length(a) - i + 2), lambda n: contains(b, substr(a, i, n))), lambda n: {{'n': n, 'i': -i, 'j': -strpos(b, substr(a, i, n))}})))) AS best FROM m WHERE a <> '' AND b <> '') WHERE best IS NOT NULL))"""


@query(f"""WITH RECURSIVE {_RELATED}, k AS (SELECT lower(p_name) AS term, count(*) AS n FROM part GROUP BY 1), {matching_runs('smal rign', 'k')},
q AS (SELECT term, 2.0::double * sum(n) / (length(term) + 9) AS alike FROM m GROUP BY term),
x AS (SELECT k.term, n, (CASE WHEN alike > 0.7 THEN alike * 0.5 WHEN regexp_matches(replace(k.term, ' ', ''), 's.*m.*a.*l.* .*r.*i.*g.*n') THEN 0.3 ELSE 0 END)::double AS base,
 least(n / max(n) OVER () * 0.2::double, 0.2) + CASE WHEN n > count(*) OVER () * 0.1 THEN -0.1 ELSE 0 END AS more FROM k JOIN q ON k.term = q.term)
SELECT term, n, round(greatest(0.0, least(2.0, base + more)), 6) AS score FROM x WHERE base > 0 ORDER BY greatest(0.0, least(2.0, base + more)) DESC, length(term), term LIMIT 50""")
def autocomplete_misspelt(spark, sf_dir):
    """Terms for a prefix that none of them holds: those that read much like it."""
    counts = terms.term_counts(table(spark, sf_dir, "part"), F.array("p_name"))
    related = terms.related(_orders_types(spark, sf_dir), "l_orderkey", F.col("names"))
    return terms.completions(counts, related, "smal rign").withColumn("score", F.round("score", 6))


_GENERIC_SKILLS = ", ".join(f"'{w}'" for w in terms.GENERIC_SKILLS)


@query(f"""WITH w AS (SELECT DISTINCT doc_id, source AS title, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS skill FROM documents), c AS (SELECT skill, count(*) AS n FROM w GROUP BY 1),
t AS (SELECT skill, count(DISTINCT title) AS titles FROM w WHERE title IS NOT NULL AND length(skill) >= 2 GROUP BY 1),
s AS (SELECT t.skill, titles, titles + titles / 8::double * 2 + CASE WHEN n / (SELECT max(n) FROM c)::double > 0.01::double AND n < (SELECT count(*) FROM c) * 0.1::double THEN least(n / (SELECT max(n) FROM c)::double * 1.5::double, 1.5::double) ELSE 0 END
 + CASE WHEN length(t.skill) BETWEEN 3 AND 15 THEN 0.5::double ELSE 0 END + CASE WHEN t.skill IN ({_GENERIC_SKILLS}) THEN -2 ELSE 0 END AS score FROM t JOIN c ON t.skill = c.skill)
SELECT skill, titles, round(score, 6) AS score FROM s WHERE score > 0.5""")
def scored_title_skills(spark, sf_dir):
    """Words by how many sources have them, their share of eight, their frequency, length and how generic they are."""
    words = F.explode(F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit("[a-z0-9]+"), F.lit(0))))
    rows = table(spark, sf_dir, "documents").select(F.col("source").alias("title"), words.alias("skill"))
    counts = rows.groupBy(F.col("skill").alias("term")).agg(F.count(F.lit(1)).alias("n"))
    return terms.title_skills(rows, counts, 8).select("skill", "titles", F.round("score", 6).alias("score"))
