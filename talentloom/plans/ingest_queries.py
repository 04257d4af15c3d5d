"""Typing, normalising, validating and grading of tabular rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from talentloom.functions import ingest, normalise, text, validation
from talentloom.plans.profiles import PROFILES_SQL, profiles, table

QUERIES: dict = {}


def query(sql: str | None = None):
    def put(f):
        QUERIES[f.__name__] = (f, sql)
        return f

    return put


#: Spreadsheet-like values made of a part's columns, by the remainder of its key.
VALUES = {
    0: ("concat('user', p_partkey, '@mail.example')", "'user' || p_partkey || '@mail.example'"),
    1: ("concat('+91', 9000000000 + p_partkey)", "'+91' || (9000000000 + p_partkey)"),
    2: ("concat(p_size, ' lakh')", "p_size || ' lakh'"),
    3: ("concat(p_size, ' years')", "p_size || ' years'"),
    4: ("concat(p_size, '%')", "p_size || '%'"),
    5: ("concat(p_size % 28 + 1, '/12/2020')", "(p_size % 28 + 1) || '/12/2020'"),
    6: ("concat(1960 + p_size)", "(1960 + p_size)::varchar"),
    7: ("concat(p_size, ' days')", "p_size || ' days'"),
    8: ("concat(p_name, ', ', p_brand)", "p_name || ', ' || p_brand"),
    9: ("concat(p_size * 1000, '.5')", "(p_size * 1000) || '.5'"),
    10: ("p_brand", "p_brand"),
}
_SPARK = "CASE p_partkey % 11 " + " ".join(f"WHEN {k} THEN {s}" for k, (s, _) in VALUES.items()) + " END"
_DUCK = "CASE p_partkey % 11 " + " ".join(f"WHEN {k} THEN {s}" for k, (_, s) in VALUES.items()) + " END"


def _any(patterns, x: str = "lower(v)") -> str:
    return "(" + " OR ".join(f"regexp_matches({x}, '{p}')" for p in patterns) + ")"


_SURE = {
    "email": r"CASE WHEN regexp_matches(v, '^[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}$') THEN 0.95 ELSE 0.1 END",
    "phone": r"CASE WHEN regexp_matches(regexp_replace(v, '[\s\-()]', '', 'g'), '^\+?\d{10,13}$') THEN 0.95 WHEN regexp_matches(regexp_replace(v, '[\s\-()]', '', 'g'), '^\+?\d{8,15}$') THEN 0.6 ELSE 0.1 END",
    "currency": f"CASE WHEN {_any(ingest.CURRENCY)} THEN 0.9 WHEN regexp_matches(v, '{ingest.PLAIN_MONEY}') THEN 0.6 ELSE 0.1 END",
    "experience": f"CASE WHEN {_any(ingest.EXPERIENCE)} THEN 0.9 ELSE 0.1 END",
    "percentage": r"CASE WHEN contains(v, '%') THEN 0.95 WHEN regexp_matches(v, '^\d+(?:\.\d+)?(?:/\d+(?:\.\d+)?)?$') AND try_cast(string_split(v, '/')[1] AS double) BETWEEN 0 AND 100 THEN 0.7 ELSE 0.1 END",
    "date": f"CASE WHEN {_any(ingest.DATES)} THEN 0.9 ELSE 0.1 END",
    "year": r"CASE WHEN regexp_matches(v, '^\d{4}$') THEN CASE WHEN try_cast(v AS int) BETWEEN 1950 AND 2036 THEN 0.9 ELSE 0.6 END ELSE 0.1 END",
    "duration": f"CASE WHEN {_any(ingest.DURATION)} THEN 0.9 ELSE 0.1 END",
    "list": r"CASE WHEN regexp_matches(v, '[,;|/\n]') THEN 0.8 WHEN len(regexp_split_to_array(v, '\s+')) >= 3 AND list_bool_and(list_transform(regexp_split_to_array(v, '\s+'), lambda w: length(w) >= 2)) THEN 0.6 ELSE 0.1 END",
    "number": "CASE WHEN try_cast(replace(v, ',', '') AS double) IS NOT NULL THEN 0.9 ELSE 0.1 END",
    "text": "0.5",
}


@query(f"WITH t AS (SELECT p_partkey, trim({_DUCK}) AS v FROM part), c AS (SELECT p_partkey, v, {', '.join(f'({e})::double AS c_{k}' for k, e in _SURE.items())} FROM t), b AS (SELECT *, greatest({', '.join(f'c_{k}' for k in ingest.TYPES)}) AS best FROM c) SELECT p_partkey, v AS value, CASE {' '.join(f'WHEN c_{k} = best THEN {chr(39)}{k}{chr(39)}' for k in ingest.TYPES)} END AS type, best AS confidence FROM b")
def detected_types(spark, sf_dir):
    """The type of each value by the surest detector."""
    rows = table(spark, sf_dir, "part").select("p_partkey", F.trim(F.expr(_SPARK)).alias("value"))
    return rows.select("p_partkey", "value", ingest.detect(F.col("value")).alias("d")).select("p_partkey", "value", "d.type", "d.confidence")


@query(rf"""WITH t AS (SELECT p_partkey, {_DUCK} AS v FROM part) SELECT p_partkey, try_cast(replace(regexp_extract(lower(v), '(\d[\d,]*(?:\.\d+)?)', 1), ',', '') AS double) * CASE WHEN regexp_matches(lower(v), '\d\s*(?:lakh|lac)') THEN 1e5 WHEN regexp_matches(lower(v), '\d\s*(?:crore|cr)') THEN 1e7 WHEN regexp_matches(lower(v), '\d\s*k') THEN 1e3 ELSE 1 END AS amount,
CASE WHEN regexp_matches(lower(v), 'immediate|asap|^0$|zero') THEN 0 ELSE coalesce(try_cast(regexp_extract(lower(v), '(\d+)\s*(?:days?|d)', 1) AS int), try_cast(regexp_extract(lower(v), '(\d+)\s*(?:weeks?|w)', 1) AS int) * 7, try_cast(regexp_extract(lower(v), '(\d+)\s*(?:months?|mon?|m)', 1) AS int) * 30) END AS notice_days,
CASE WHEN contains(v, '%') THEN try_cast(regexp_extract(v, '(\d+(?:\.\d+)?)', 1) AS double) WHEN try_cast(regexp_extract(v, '(\d+(?:\.\d+)?)\s*/\s*(\d+(?:\.\d+)?)', 2) AS double) > 0 THEN try_cast(regexp_extract(v, '(\d+(?:\.\d+)?)\s*/\s*(\d+(?:\.\d+)?)', 1) AS double) / try_cast(regexp_extract(v, '(\d+(?:\.\d+)?)\s*/\s*(\d+(?:\.\d+)?)', 2) AS double) * 100 WHEN try_cast(regexp_extract(v, '(\d+(?:\.\d+)?)', 1) AS double) <= 10 THEN try_cast(regexp_extract(v, '(\d+(?:\.\d+)?)', 1) AS double) * 10 ELSE try_cast(regexp_extract(v, '(\d+(?:\.\d+)?)', 1) AS double) END AS percent FROM t""")
def normalised_values(spark, sf_dir):
    """Money in units, notice in days, marks in percent."""
    rows = table(spark, sf_dir, "part").select("p_partkey", F.expr(_SPARK).alias("v"))
    return rows.select("p_partkey", ingest.amount(F.col("v")).alias("amount"), ingest.notice_days(F.col("v")).alias("notice_days"), ingest.percent(F.col("v")).alias("percent"))


_ROW = "SELECT c_custkey, CASE WHEN c_custkey % 5 = 0 THEN NULL ELSE c_name END AS name, CASE WHEN c_custkey % 3 = 0 THEN '' ELSE 'c' || c_custkey || '@mail.example' END AS email, CASE WHEN c_custkey % 4 = 0 THEN NULL ELSE (9000000000 + c_custkey)::varchar END AS phone, c_mktsegment AS role, 18 + c_custkey % 45 AS age, (c_custkey % 40)::double AS years, 1990 + c_custkey % 35 AS graduated, c_acctbal * 100 AS pay FROM customer"


#: Values by kind of field, made of a part's columns, in words that both engines read.
FIELD_VALUES = {
    "name": "CASE p_partkey % 6 WHEN 0 THEN upper(p_name) WHEN 1 THEN concat(p_name, ' 7') WHEN 2 THEN p_name WHEN 3 THEN 'Al' WHEN 4 THEN '  ' ELSE 'Anna Maria Berg' END",
    "email": "CASE p_partkey % 5 WHEN 0 THEN concat('a', p_partkey, '@mail.example') WHEN 1 THEN concat('a b', p_partkey, '@mail.example') WHEN 2 THEN 'nobody' WHEN 3 THEN 'x@y' ELSE concat('q,', p_partkey, '@mail.example') END",
    "phone": "CASE p_partkey % 5 WHEN 0 THEN concat('+91 ', 9000000000 + p_partkey) WHEN 1 THEN concat(p_partkey, '') WHEN 2 THEN concat('0', 900000000 + p_partkey) WHEN 3 THEN 'call me' ELSE concat('91', 9000000000 + p_partkey) END",
    "experience": "CASE p_partkey % 4 WHEN 0 THEN concat(p_size, ' years') WHEN 1 THEN concat('about ', p_size, ' or so') WHEN 2 THEN concat(p_size + 10, '') ELSE concat(p_size, '.1234') END",
    "age": "concat(p_size + 10, '')",
    "salary": "CASE p_partkey % 3 WHEN 0 THEN concat(p_size * 50, '') WHEN 1 THEN 'negotiable' ELSE concat('Rs ', p_size * 250000) END",
    "year": "concat(1930 + p_size * 3, '')",
    "percentage": "concat(p_size * 2.5, '%')",
    "location": "CASE p_partkey % 4 WHEN 0 THEN lower(p_type) WHEN 1 THEN concat(p_type, ', India') WHEN 2 THEN concat(p_type, ' 560001') ELSE 'X' END",
    "other": "p_brand",
}


def _checks() -> dict[str, tuple[str, str]]:
    """For each kind the SQL of what makes a value invalid, and of its score."""
    m = lambda p, x="v": f"regexp_matches({x}, '{p.replace(chr(39), chr(39) * 2)}')"
    by = lambda *rules: " * ".join(["1.0::double", *(f"(CASE WHEN {c} THEN {k}::double ELSE 1 END)" for c, k in rules)])
    w, n = "trim(v)", "try_cast(regexp_replace(v, '[^0-9.]', '', 'g') AS double)"
    cased = f"(upper({w}) <> lower({w}) AND ({w} = upper({w}) OR {w} = lower({w})))"
    outside = lambda a, z: f"coalesce(NOT ({n} BETWEEN {a} AND {z}), true)"
    return {
        "name": (f"NOT {m(chr(94) + '[a-zA-Z' + chr(92) + 's.' + chr(39) + '-]+$')} OR {m('[0-9]')} OR {m('[!@#$%^&*()_+={}|:;,.<>?/]')} OR length(v) < 2", by(("length(v) > 100", 0.8), (cased, 0.9), (m("[0-9]", w), 0.8), (f"length({w}) < 3", 0.7), (m(r"^\w+\s+\w+\s+\w+$"), 0.9), (m("^[A-Z]{2,}$"), 0.9), (m("^[a-z]+$"), 0.9), (m("[0-9]"), 0.9))),
        "email": (f"NOT {m(r'^[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+[.][a-zA-Z]{2,}$')} OR {m(r'\s')} OR {m('[<>()]')}", by((f"NOT {m(r'^[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+[.][a-zA-Z]{2,}$', w)}", 0.3), (f"contains({w}, ' ')", 0.6), ("NOT contains(v, '@')", 0.9), (m("^[^@]+@[^.]+$"), 0.9), (m(r"\s"), 0.9), (m("[,;]"), 0.9))),
        "phone": (f"NOT {m(r'^[+]?[0-9\s()-]{10,20}$')} OR {m('[a-zA-Z]')}", by((f"length(regexp_replace(v, '[^0-9]', '', 'g')) < 10", 0.5), (f"NOT {m(r'^[+]?[0-9\s()-]{10,20}$', w)}", 0.4), (m("^[0-9]{11,}$"), 0.9), (m("^[0-9]{1,9}$"), 0.9), (m("[a-zA-Z]"), 0.9), ("starts_with(v, '0')", 0.9))),
        "experience": (outside(0, 50), by((f"{n} > 40", 0.9), (m("^[0-9]+[.][0-9]{3,}$"), 0.9), (m("^[5-9][0-9]+$"), 0.9), (m("[a-zA-Z].*[0-9]"), 0.9))),
        "age": (outside(16, 80), by((f"{n} > 70", 0.9), (f"{n} < 18", 0.95))),
        "salary": (outside(1000, 10000000), "1.0::double"),
        "year": (outside(1950, 2031), "1.0::double"),
        "percentage": (outside(0, 100), "1.0::double"),
        "location": (f"NOT {m(r'^[a-zA-Z\s,.-]+$')} OR length(v) < 2", by(("length(v) > 100", 0.8), (cased, 0.9), (m("[0-9]", w), 0.8))),
        "other": ("false", "1.0::double"),
    }


_CHECKED = " UNION ALL ".join(f"SELECT p_partkey, '{k}' AS kind, trim(v) = '' OR NOT ({wrong}) AS is_valid, CASE WHEN trim(v) = '' THEN 0 ELSE {score} END AS score FROM (SELECT p_partkey, {FIELD_VALUES[k]} AS v FROM part)" for k, (wrong, score) in _checks().items())


@query(f"SELECT p_partkey, kind, is_valid, round(score, 6) AS score FROM ({_CHECKED})")
def validated_values(spark, sf_dir):
    """Values of ten kinds by their rules: whether they are valid, and a score."""
    rows = table(spark, sf_dir, "part").select("p_partkey", *(F.expr(v).alias(k) for k, v in FIELD_VALUES.items()))
    judged = F.inline(F.array(*(F.struct(F.lit(k).alias("kind"), validation.validated(F.col(k), k).alias("j")) for k in FIELD_VALUES)))
    return rows.select("p_partkey", judged).select("p_partkey", "kind", "j.is_valid", F.round("j.score", 6).alias("score"))


_LISTS = "CASE p_partkey % 5 WHEN 0 THEN {0} WHEN 1 THEN {1} WHEN 2 THEN {2} WHEN 3 THEN {3} ELSE {4} END"
_SPARK_LISTS = _LISTS.format("split(p_name, ' ')", "array(p_name, upper(p_name), p_brand)", "array('a', 'b', p_name)", "array(' ', p_name)", "cast(array() as array<string>)")
_DUCK_LISTS = _LISTS.format("string_split(p_name, ' ')", "[p_name, upper(p_name), p_brand]", "['a', 'b', p_name]", "[' ', p_name]", "[]::varchar[]")


@query(f"""WITH t AS (SELECT p_partkey, list_transform({_DUCK_LISTS}, lambda x: trim(x)) AS l FROM part) SELECT p_partkey, len(l) > 0 AS is_valid, round(CASE WHEN len(list_filter(l, lambda x: x = '')) > 0 THEN 0.95::double ELSE 1 END
* CASE WHEN len(list_filter(l, lambda x: length(x) = 1)) > len(l) * 0.3 THEN 0.9::double ELSE 1 END * CASE WHEN len(list_distinct(list_transform(l, lambda x: lower(x)))) < len(l) THEN 0.7225::double ELSE 1 END, 6) AS score FROM t""")
def validated_lists(spark, sf_dir):
    """Lists of skills by their rules."""
    rows = table(spark, sf_dir, "part").select("p_partkey", validation.validated_list(F.expr(_SPARK_LISTS)).alias("j"))
    return rows.select("p_partkey", "j.is_valid", F.round("j.score", 6).alias("score"))


_ONE = lambda column, kind: f"CASE WHEN {column} IS NULL THEN NULL WHEN {column} = '' THEN [1, 0] ELSE (SELECT [CASE WHEN {_checks()[kind][0]} THEN 0 ELSE 1 END, {_checks()[kind][1]}] FROM (SELECT {column} AS v)) END"
_GRADED = f"""WITH r AS ({_ROW}), j AS (SELECT *, (coalesce((name <> '')::int, 0) + coalesce((email <> '')::int, 0) + coalesce((phone <> '')::int, 0) + 1) / 4.0::double * 0.6::double + 1 / 2.0::double * 0.3::double + 2 / 2.0::double * 0.1::double AS completeness,
 (CASE WHEN years > age - 14 THEN 0.7::double ELSE 1 END) * (CASE WHEN graduated - (2025 - age) NOT BETWEEN 16 AND 35 THEN 0.9::double ELSE 1 END) * (CASE WHEN pay NOT BETWEEN years * 100000 AND years * 4000000 THEN 0.95::double ELSE 1 END)
 * (CASE WHEN name IS NOT NULL AND c_custkey % 2 = 1 THEN 0.9::double ELSE 1 END) * (CASE WHEN c_custkey % 3 <> 0 AND c_custkey % 7 = 0 THEN 1.05::double ELSE 1 END) AS consistency, {_ONE("name", "name")} AS j1, {_ONE("email", "email")} AS j2, {_ONE("phone", "phone")} AS j3 FROM r),
a AS (SELECT *, (j1 IS NOT NULL)::int + 1 + (j3 IS NOT NULL)::int AS there FROM j),
s AS (SELECT c_custkey, completeness, consistency, (coalesce(j1[1], 0) + j2[1] + coalesce(j3[1], 0)) / there * 0.7::double + (coalesce(j1[2], 0) + j2[2] + coalesce(j3[2], 0)) / there * 0.3::double AS accuracy, least(1.0::double, (there + 5) / 15.0::double + 0.1::double) AS richness FROM a)"""


@query(f"""{_GRADED} SELECT c_custkey, round(completeness, 6) AS completeness, round(accuracy, 6) AS accuracy, round(consistency, 6) AS consistency, round(richness, 6) AS richness, q AS quality, CASE WHEN q >= 0.9 THEN 'A+' WHEN q >= 0.8 THEN 'A' WHEN q >= 0.7 THEN 'B' WHEN q >= 0.6 THEN 'C' WHEN q >= 0.5 THEN 'D' ELSE 'F' END AS grade
FROM (SELECT *, round(completeness * 0.3::double + accuracy * 0.25::double + consistency * 0.2::double + richness * 0.15::double + 0.08::double, 6) AS q FROM s)""")
def graded_rows(spark, sf_dir):
    """Rows by completeness, accuracy, consistency between fields, richness and reliability, with a grade."""
    return graded(spark, sf_dir).select("c_custkey", *(F.round(c, 6).alias(c) for c in ("completeness", "accuracy", "consistency", "richness")), F.col("overall").alias("quality"), "grade")


def graded(spark, sf_dir):
    rows, c, k = _rows(spark, sf_dir), F.col, F.col("c_custkey")
    skills = F.array(F.lit("sql"), F.lower("role"))
    fields = {"age": c("age"), "experience_years": c("years"), "graduation_year": c("graduated"), "salary": c("pay"), "name": c("name"), "first_name": F.split("name", "#")[0], "last_name": F.when(k % 2 == 1, "Other").otherwise(F.substring_index("name", "#", -1)), "email": F.when(c("email") != "", c("email")), "company": F.when(k % 7 == 0, "The Mail Works").otherwise("Works")}
    fields["name"] = F.when(k % 2 == 1, c("name")).otherwise(F.concat(fields["first_name"], F.lit(" "), fields["last_name"]))
    results = [F.when(c(x).isNotNull(), validation.validated(c(x), x)) for x in ("name", "email", "phone")]
    rich = validation.richness([c(x) for x in ("name", "email", "phone", "role", "age", "years", "pay")], lists=[skills])
    parts = validation.quality([c("name"), c("email"), c("phone"), c("years")], [c("role"), F.lit(None).cast("string")], [c("age"), c("pay")], results, validation.consistency(fields, 2025), rich)
    scored = rows.select("c_custkey", "role", *(v.alias(name) for name, v in parts.items())).withColumn("overall", F.round("overall", 6))
    return scored.withColumn("grade", ingest.grade(F.col("overall")))


@query(f"""{_GRADED}, g AS (SELECT round(completeness * 0.3::double + accuracy * 0.25::double + consistency * 0.2::double + richness * 0.15::double + 0.08::double, 6) AS q FROM s)
SELECT CASE WHEN q >= 0.9 THEN 'A+' WHEN q >= 0.8 THEN 'A' WHEN q >= 0.7 THEN 'B' WHEN q >= 0.6 THEN 'C' WHEN q >= 0.5 THEN 'D' ELSE 'F' END AS grade, count(*) AS n, round(avg(q), 6) AS mean FROM g GROUP BY 1""")
def grade_histogram(spark, sf_dir):
    """How many rows have each grade."""
    return graded(spark, sf_dir).groupBy("grade").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("overall"), 6).alias("mean"))


def _rows(spark, sf_dir):
    c, k = table(spark, sf_dir, "customer"), F.col("c_custkey")
    return c.select(
        "c_custkey", F.when(k % 5 == 0, None).otherwise(F.col("c_name")).alias("name"), F.when(k % 3 == 0, "").otherwise(F.concat(F.lit("c"), k.cast("string"), F.lit("@mail.example"))).alias("email"),
        F.when(k % 4 == 0, None).otherwise((k + 9000000000).cast("string")).alias("phone"), F.col("c_mktsegment").alias("role"), (18 + k % 45).alias("age"), (k % 40).cast("double").alias("years"), (1990 + k % 35).alias("graduated"), (F.col("c_acctbal") * 100).alias("pay"),
    )


@query(f"WITH r AS ({_ROW}), v AS (SELECT c_custkey, concat_ws(',', CASE WHEN name IS NULL THEN 'name missing' END, CASE WHEN email = '' THEN 'email missing' END, CASE WHEN phone IS NULL THEN 'phone missing' END, CASE WHEN years > age - 14 THEN 'experience exceeds age' END) AS errors FROM r) SELECT errors, count(*) AS n FROM v GROUP BY 1")
def failure_reasons(spark, sf_dir):
    """How many rows fail for which reasons."""
    missing = lambda c: F.when(text.filled(F.col(c)).isNull(), F.lit(f"{c} missing"))
    errors = F.concat_ws(",", missing("name"), missing("email"), missing("phone"), F.when(F.col("years") > F.col("age") - 14, "experience exceeds age"))
    return _rows(spark, sf_dir).groupBy(errors.alias("errors")).agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH r AS ({_ROW}), s AS (SELECT role, ((name IS NOT NULL)::int + (email <> '')::int + (phone IS NOT NULL)::int) / 3.0::double AS q FROM r) SELECT role, count(*) AS n, round(avg(q), 6) AS mean, min(q) AS least, max(q) AS most, round(stddev_pop(q), 6) AS spread, count(*) FILTER (q >= 0.6) AS passed FROM s GROUP BY role")
def quality_summary(spark, sf_dir):
    """Means, extremes, spread and passes of the rows' quality."""
    share = sum((text.filled(F.col(c)).isNotNull().cast("int") for c in ("name", "email", "phone")), F.lit(0)) / 3
    q = F.col("q")
    return _rows(spark, sf_dir).select("role", share.alias("q")).groupBy("role").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(q), 6).alias("mean"), F.min(q).alias("least"), F.max(q).alias("most"), F.round(F.stddev_pop(q), 6).alias("spread"), F.count_if(q >= 0.6).alias("passed"))


@query(f"WITH r AS ({_ROW}) SELECT field, count(v) FILTER (v <> '') AS filled, round(count(v) FILTER (v <> '') / count(*), 6) AS share FROM (SELECT 'name' AS field, name AS v FROM r UNION ALL SELECT 'email', email FROM r UNION ALL SELECT 'phone', phone FROM r UNION ALL SELECT 'role', role FROM r) GROUP BY field")
def extraction_summary(spark, sf_dir):
    """How often each field is filled."""
    pairs = F.explode(F.array(*(F.struct(F.lit(c).alias("field"), F.col(c).alias("v")) for c in ("name", "email", "phone", "role"))))
    filled = F.count_if(F.coalesce(F.col("v") != "", F.lit(False)))
    return _rows(spark, sf_dir).select(pairs.alias("x")).select("x.field", "x.v").groupBy("field").agg(filled.alias("filled"), F.round(filled / F.count(F.lit(1)), 6).alias("share"))


#: Values of several spellings, in words that both engines read.
_DURATION = "CASE p_partkey % 6 WHEN 0 THEN concat(p_size, ' years ', p_partkey % 12, ' months') WHEN 1 THEN concat(p_size, '.5 yrs') WHEN 2 THEN concat(p_size, ' months') WHEN 3 THEN 'Fresher' WHEN 4 THEN concat(p_size, ' to ', p_size + 3, ' years') ELSE 'unknown' END"
_DAY = "CASE p_partkey % 4 WHEN 0 THEN concat('2020-0', p_size % 9 + 1, '-1', p_size % 10) WHEN 1 THEN concat('1', p_size % 10, '/0', p_size % 9 + 1, '/2021') WHEN 2 THEN concat('1', p_size % 10, '-0', p_size % 9 + 1, '-2019') ELSE 'some day' END"
_PAY = "CASE p_partkey % 5 WHEN 0 THEN concat('$ ', p_size, 'k') WHEN 1 THEN concat(p_size, ' lakh') WHEN 2 THEN concat('EUR ', p_size, ',000') WHEN 3 THEN concat('Rs. ', p_size) ELSE 'none' END"
_CALL = "CASE p_partkey % 5 WHEN 0 THEN concat('+44 ', 7000000000 + p_partkey) WHEN 1 THEN concat(9000000000 + p_partkey, '') WHEN 2 THEN concat('91', 9000000000 + p_partkey) WHEN 3 THEN concat('0', 9000000000 + p_partkey) ELSE 'none' END"
_MANY = "CASE p_partkey % 4 WHEN 0 THEN concat(p_name, ', x, ', p_brand) WHEN 1 THEN concat(p_name, ';', p_brand, ';', p_type, ', y') WHEN 2 THEN concat(p_name, ' | ', p_brand) ELSE p_name END"


@query(f"""WITH t AS (SELECT p_partkey, lower({_DURATION}) AS d, {_DAY} AS w, {_PAY} AS m, {_CALL} AS c, {_MANY} AS l, concat(1940 + p_size * 2, ' ') AS y FROM part),
e AS (SELECT *, CASE WHEN d = 'fresher' THEN 0 WHEN contains(d, ' to ') THEN floor((regexp_extract(d, '([0-9]+) to', 1)::double + regexp_extract(d, 'to ([0-9]+)', 1)::double) / 2 * 12) ELSE floor(coalesce(try_cast(regexp_extract(d, '([0-9.]+) y', 1) AS double), 0) * 12) + coalesce(try_cast(regexp_extract(d, '([0-9]+) m', 1) AS double), 0) END::int AS months FROM t)
SELECT p_partkey, months, round(months / 12.0::double, 1) AS years, CASE p_partkey % 4 WHEN 0 THEN try_strptime(w, '%Y-%m-%d') WHEN 1 THEN try_strptime(w, '%d/%m/%Y') WHEN 2 THEN try_strptime(w, '%d-%m-%Y') END::date::varchar AS day,
 try_cast(replace(regexp_extract(m, '[0-9,]+'), ',', '') AS double) * CASE p_partkey % 5 WHEN 0 THEN 1000 WHEN 1 THEN 100000 ELSE 1 END AS amount, CASE p_partkey % 5 WHEN 0 THEN 'USD' WHEN 2 THEN 'EUR' ELSE 'INR' END AS currency,
 CASE p_partkey % 5 WHEN 0 THEN '+44' || (7000000000 + p_partkey) WHEN 4 THEN NULL ELSE '+91' || (9000000000 + p_partkey) END AS phone, trim(y)::int AS year, trim(y)::int BETWEEN 1950 AND 2035 AS year_ok,
 array_to_string(list_filter(list_transform(string_split(l, CASE p_partkey % 4 WHEN 1 THEN ';' WHEN 2 THEN '|' ELSE ',' END), lambda x: trim(x)), lambda x: length(x) > 1), '~') AS items FROM e""")
def typed_values(spark, sf_dir):
    """Durations, dates, money, phone numbers, years and lists of several spellings as one form each."""
    e = lambda x: F.expr(x)
    rows = table(spark, sf_dir, "part").select("p_partkey", normalise.experience(e(_DURATION)).alias("d"), normalise.date(e(_DAY)).alias("day"), normalise.money(e(_PAY)).alias("m"), normalise.phone(e(_CALL)).alias("phone"), normalise.year(e("concat(1940 + p_size * 2, ' ')"), 2025).alias("y"), normalise.listed(e(_MANY)).alias("l"))
    return rows.select("p_partkey", F.col("d.total_months").alias("months"), "d.years", F.col("day").cast("string").alias("day"), "m.amount", "m.currency", "phone", "y.year", F.col("y.is_valid").alias("year_ok"), F.array_join("l", "~").alias("items"))


_SHARED = {
    "name_email": "CASE WHEN p_partkey % 2 = 0 THEN concat(p_name, ' <a', p_partkey, '@mail.example>') ELSE concat('a', p_partkey, '@mail.example (', p_name, ')') END",
    "name_phone": "CASE WHEN p_partkey % 2 = 0 THEN concat(p_name, ' (+91 ', p_partkey, ')') ELSE concat(p_partkey, ' (', p_name, ')') END",
    "location": "CASE p_partkey % 4 WHEN 0 THEN concat(p_type, ', Goa, India, 40300', p_size % 10) WHEN 1 THEN concat(p_type, ', Goa') WHEN 2 THEN concat(p_type, ' - 40300', p_size % 10) ELSE '12' END",
    "experience_company": "CASE WHEN p_partkey % 2 = 0 THEN concat(p_size, ' years at ', p_brand) ELSE concat(p_brand, ' - ', p_size, ' yrs') END",
    "education": "CASE p_partkey % 3 WHEN 0 THEN 'B.Tech from Lake College - 2015' WHEN 1 THEN 'MBA, Hill School, 2018' ELSE 'Ph.D, Lab' END",
    "salary": "CASE WHEN p_partkey % 2 = 0 THEN concat('$ ', p_size, ',000') ELSE concat(p_size, '.50 EUR') END",
    "skill_rating": "CASE p_partkey % 3 WHEN 0 THEN concat('C++ - ', p_size % 10, '/10') WHEN 1 THEN concat('Go (', p_size, '%)') ELSE '???' END",
}
_EVEN = "p_partkey % 2 = 0"
_PARTS = {
    "name_email": "[p_name, 'a' || p_partkey || '@mail.example']",
    "name_phone": f"[p_name, CASE WHEN {_EVEN} THEN '+91 ' || p_partkey ELSE p_partkey::varchar END]",
    "location": "CASE p_partkey % 4 WHEN 0 THEN [p_type, 'Goa', 'India', '40300' || (p_size % 10)] WHEN 1 THEN [p_type, 'Goa'] WHEN 2 THEN [p_type, '40300' || (p_size % 10)] END",
    "experience_company": "[p_brand, p_size::varchar]",
    "education": "CASE p_partkey % 3 WHEN 0 THEN ['B.Tech', 'Lake College', '2015'] WHEN 1 THEN ['MBA', 'Hill School', '2018'] ELSE ['Ph.D', 'Lab'] END",
    "salary": f"CASE WHEN {_EVEN} THEN [p_size || ',000', '$'] ELSE [p_size || '.50', 'EUR'] END",
    "skill_rating": "CASE p_partkey % 3 WHEN 0 THEN ['C++', (p_size % 10)::varchar] WHEN 1 THEN ['Go', p_size::varchar] END",
}


@query(" UNION ALL ".join(f"SELECT p_partkey, '{k}' AS kind, array_to_string(list_sort({v}), '~') AS parts FROM part" for k, v in _PARTS.items()))
def split_composites(spark, sf_dir):
    """Values of seven kinds that hold several fields, split."""
    rows = table(spark, sf_dir, "part").select("p_partkey", *(F.expr(v).alias(k) for k, v in _SHARED.items()))
    split = F.inline(F.array(*(F.struct(F.lit(k).alias("kind"), F.array_join(F.array_sort(F.map_values(normalise.composite(F.col(k), k))), "~").alias("parts")) for k in _SHARED)))
    return rows.select("p_partkey", split)


@query("""SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN 'Ann ' || c_mktsegment ELSE c_name || ' of Lake' END AS name, CASE WHEN c_custkey % 3 = 0 THEN 'Ann' ELSE c_name END AS first_name, CASE WHEN c_custkey % 3 = 0 THEN c_mktsegment ELSE 'of Lake' END AS last_name,
 concat_ws(', ', CASE WHEN c_custkey % 2 = 0 THEN 'Goa' END, 'India') AS location, concat_ws(' | ', CASE WHEN c_custkey % 2 = 0 THEN 'Email: a@b.org' END, 'Phone: 7') AS contact, c_mktsegment || ' at Works (3 years experience)' AS work, round(CASE WHEN c_custkey % 2 = 0 THEN 5 ELSE 4 END / 7 * 100, 1) AS completeness FROM customer""")
def derived_fields(spark, sf_dir):
    """Names, places and summaries made of the fields that are there."""
    rows, k = table(spark, sf_dir, "customer"), F.col("c_custkey")
    name = normalise.full_name(F.when(k % 3 != 0, F.concat("c_name", F.lit(" of Lake"))), F.when(k % 3 == 0, "Ann"), F.when(k % 3 == 0, F.col("c_mktsegment")))
    fields = {"name": F.col("c_name"), "email": F.when(k % 2 == 0, "a@b.org"), "phone": F.lit("7"), "city": F.lit(" "), "role": F.col("c_mktsegment"), "company": F.lit("Works"), "experience": F.lit("3 years"), "skills": F.lit("N/A"), "education": F.lit(None).cast("string")}
    made = normalise.summaries(fields)
    return rows.select("c_custkey", name.alias("n"), normalise.location(F.when(k % 2 == 0, "Goa"), F.lit(None).cast("string"), F.lit("India")).alias("location"), *(made[x].alias(x) for x in ("contact", "work")), F.round(made["completeness"], 1).alias("completeness")).select("c_custkey", "n.*", "location", "contact", "work", "completeness")


@query(f"WITH r AS ({_ROW}), e AS (SELECT unnest([CASE WHEN name IS NULL THEN 'name missing' END, CASE WHEN email = '' THEN 'email missing' END, CASE WHEN phone IS NULL THEN 'phone missing' END]) AS message FROM r) SELECT message, count(*) AS n FROM e WHERE message IS NOT NULL GROUP BY 1 ORDER BY n DESC, message LIMIT 2")
def top_errors(spark, sf_dir):
    """The most frequent messages about rows."""
    missing = lambda c: F.when(text.filled(F.col(c)).isNull(), F.lit(f"{c} missing"))
    messages = F.explode(F.array_compact(F.array(missing("name"), missing("email"), missing("phone"))))
    return _rows(spark, sf_dir).select(messages.alias("message")).groupBy("message").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "message").limit(2)


@query(f"WITH r AS ({_ROW}), c AS (SELECT (name IS NOT NULL)::int + (email <> '')::int + (phone IS NOT NULL)::int + 1 AS n FROM r) SELECT count(*) AS n_rows, round(count(*) FILTER (n >= 3) / count(*) * 100, 2) AS success_rate, round(avg(n), 4) AS fields_per_row, round(avg(n / 4.0::double) * 100, 2) AS completeness FROM c")
def extraction_overview(spark, sf_dir):
    """How many rows gave three fields or more, fields for each row, and how complete rows are."""
    n = sum((text.filled(F.col(c)).isNotNull().cast("int") for c in ("name", "email", "phone", "role")), F.lit(0))
    rows = _rows(spark, sf_dir).select(n.alias("n"))
    return rows.agg(F.count(F.lit(1)).alias("n_rows"), F.round(F.avg((F.col("n") >= 3).cast("int")) * 100, 2).alias("success_rate"), F.round(F.avg("n"), 4).alias("fields_per_row"), F.round(F.avg(F.col("n") / 4) * 100, 2).alias("completeness"))


@query("SELECT DISTINCT p_type, upper(substr(p_type, 1, 1)) || lower(substr(p_type, 2)) AS tidy FROM part")
def tidy_names(spark, sf_dir):
    """Names in one case get capitals."""
    return table(spark, sf_dir, "part").select("p_type", ingest.tidy_name(F.col("p_type")).alias("tidy")).distinct()


@query("SELECT p_partkey, p_name || '|' || p_brand AS tidy FROM part")
def tidy_lists(spark, sf_dir):
    """Lists without repeats in another case."""
    value = F.concat_ws(", ", "p_name", "p_brand", F.upper("p_name"))
    return table(spark, sf_dir, "part").select("p_partkey", F.array_join(ingest.tidy_list(value), "|").alias("tidy"))


@query(f"""WITH {PROFILES_SQL} SELECT profile_id, 'Name: ' || name || chr(10) || 'City: ' || current_city || chr(10) || 'Skills: ' || array_to_string(skills, ', ') || chr(10) || 'Experience: ' || array_to_string(list_transform(experience, lambda x: x.title || ' at ' || x.company || ' from ' || x.from_date), '; ') AS body FROM profiles""")
def profile_texts(spark, sf_dir):
    """Profiles as text, section by section."""
    jobs = F.array_join(F.transform("experience", lambda e: F.concat(e["title"], F.lit(" at "), e["company"], F.lit(" from "), e["from_date"])), "; ")
    line = lambda label, value: F.concat(F.lit(f"{label}: "), value)
    return profiles(spark, sf_dir).select("profile_id", F.concat_ws("\n", line("Name", F.col("name")), line("City", F.col("current_city")), line("Skills", F.array_join("skills", ", ")), line("Experience", jobs)).alias("body"))


@query("SELECT p_partkey, CASE WHEN p_size % 4 > 1 THEN p_size * 1.5::double END AS price, CASE WHEN p_size % 3 > 0 THEN p_name END AS name FROM part WHERE p_size % 4 > 1 OR p_size % 3 > 0")
def finite_rows(spark, sf_dir):
    """Rows of a sheet without what is no number, and without those that have nothing but their key."""
    price = "CASE p_size % 4 WHEN 0 THEN double('NaN') WHEN 1 THEN double(CASE WHEN p_size % 8 = 1 THEN '-Infinity' ELSE 'Infinity' END) ELSE p_size * 1.5D END AS price"
    said = table(spark, sf_dir, "part").select("p_partkey", F.expr(price), F.expr("CASE WHEN p_size % 3 = 0 THEN ' \t' ELSE concat(' ', p_name) END AS name"))
    return ingest.finite_rows(said, ["p_partkey"])
