"""Extraction from raw texts, and completeness of parsed profiles."""

from __future__ import annotations

from pyspark.sql import functions as F

from talentloom.functions import dates, extraction, loose_json, scoring, text, validation
from talentloom.plans.profiles import PROFILES_SQL, profiles, table
from talentloom.streaming.history import windowed_counts

QUERIES: dict = {}


def query(sql: str | None = None):
    def put(f):
        QUERIES[f.__name__] = (f, sql)
        return f

    return put


SKILLS = ["the", "und", "les", "with"]


@query(rf"""SELECT doc_id, nullif(regexp_extract(text, '({extraction.EMAIL})', 1), '') AS email, nullif(regexp_extract(text, '({extraction.PHONE})', 1), '') AS phone,
array_to_string(list_filter(['the', 'und', 'les', 'with'], lambda w: regexp_matches(lower(text), '(?:^|[^a-z0-9])' || w || '(?:[^a-z0-9]|$)')), ',') AS skills FROM documents""")
def extracted_contacts(spark, sf_dir):
    """The first e-mail address and phone number of each text, and the skills that it names."""
    t = F.col("text")
    return table(spark, sf_dir, "documents").select("doc_id", extraction.first_email(t).alias("email"), extraction.first_phone(t).alias("phone"), F.array_join(extraction.named_skills(t, SKILLS), ",").alias("skills"))


@query("SELECT p_partkey, p_size % 9 + greatest(0, 2025 - (2000 + p_size)) AS years FROM part")
def years_by_spans(spark, sf_dir):
    """Years summed over the spans that a text names."""
    size = F.col("p_size")
    said = F.concat(F.lit("Clerk 2001 - "), (2001 + size % 9).cast("string"), F.lit(". Since then: "), (2000 + size).cast("string"), F.lit(" – Present"))
    return table(spark, sf_dir, "part").select("p_partkey", extraction.years_by_spans(said, 2025).alias("years"))


@query(f"""WITH {PROFILES_SQL}, p AS (SELECT profile_id, (name <> '')::int + (profile_id % 2 = 0)::int + 0 + (current_city <> '')::int + CASE WHEN len(experience) > 0 THEN 2 ELSE 0 END + 1 + CASE WHEN len(skills) >= 3 THEN 2 ELSE 0 END + coalesce((current_salary <> 0)::int, 0) + coalesce((expected_salary <> 0)::int, 0)
 + CASE WHEN total_experience <> '0 years 0 months' THEN 2 ELSE 0 END + 0 + 1 AS points FROM profiles)
SELECT profile_id, round(points / 15 * 100, 2) AS completeness, (CASE WHEN points / 15 * 100 >= 80 THEN 95 WHEN points / 15 * 100 >= 60 THEN 85 WHEN points / 15 * 100 >= 40 THEN 75 ELSE 60 END)::double AS accuracy FROM p""")
def parsed_completeness(spark, sf_dir):
    """How complete each profile is, and how accurate it is taken to be."""
    c = F.col
    fields = {"name": c("name"), "email": F.when(c("profile_id") % 2 == 0, "a@b.org"), "phone": F.lit(extraction.DEFAULT_PHONE), "city": c("current_city"), "experience": c("experience"), "education": c("education"), "skills": c("skills"), "current_salary": c("current_salary"), "expected_salary": c("expected_salary"), "total_experience": c("total_experience"), "notice": F.lit(None).cast("string"), "source": F.lit("upload")}
    share = extraction.profile_points(fields) / 15 * 100
    return profiles(spark, sf_dir).select("profile_id", F.round(share, 2).alias("completeness"), extraction.accuracy(share).alias("accuracy"))


@query("SELECT p_partkey, CASE WHEN p_size % 5 > p_size % 3 OR (p_size % 5 = p_size % 3 AND p_size % 2 = 0) THEN p_type ELSE p_name END AS resolved FROM part")
def resolved_fields(spark, sf_dir):
    """Two columns that claim one field: the better value stays."""
    size = F.col("p_size")
    return table(spark, sf_dir, "part").select("p_partkey", extraction.better(F.col("p_name"), F.col("p_type"), size % 3, size % 5, F.when(size % 2 == 0, 0.9).otherwise(0.5)).alias("resolved"))


@query("""SELECT c_custkey, '{"contact":{"name":"' || c_name || '","nation":' || c_nationkey || '},"work":{"segment":"' || c_mktsegment || '"}}' AS sections FROM customer""")
def sectioned_json(spark, sf_dir):
    """Rows as JSON by section."""
    contact = F.struct(F.col("c_name").alias("name"), F.col("c_nationkey").alias("nation"))
    return table(spark, sf_dir, "customer").select("c_custkey", F.to_json(F.struct(contact.alias("contact"), F.struct(F.col("c_mktsegment").alias("segment")).alias("work"))).alias("sections"))


@query("SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN NULL WHEN c_custkey % 3 = 1 THEN NULL ELSE lower(c_name) END AS name FROM customer")
def cleaned_strings(spark, sf_dir):
    """Blank strings and the sentinel for absent as null, the others trimmed and in lower case."""
    said = F.when(F.col("c_custkey") % 3 == 0, "  ").when(F.col("c_custkey") % 3 == 1, "N/A").otherwise(F.concat(F.lit(" "), F.col("c_name"), F.lit(" ")))
    return table(spark, sf_dir, "customer").select("c_custkey", F.lower(text.filled(said)).alias("name"))


@query("SELECT event_id, (event_id % 7)::int AS score FROM events")
def repaired_json(spark, sf_dir):
    """Objects read out of an assistant's prose and fences."""
    said = F.concat(F.lit("Sure!\n```json\n{\"score\": "), (F.col("event_id") % 7).cast("string"), F.lit("}\n``` Anything else?"))
    return table(spark, sf_dir, "events").select("event_id", F.from_json(text.json_object(said), "score int")["score"].alias("score"))


@query("SELECT c_custkey, nullif(trim(c_mktsegment), '') AS city FROM customer")
def cities_of_addresses(spark, sf_dir):
    address = F.concat(F.lit("12 Main Road, "), F.col("c_mktsegment"), F.lit(", 560001"))
    return table(spark, sf_dir, "customer").select("c_custkey", text.city_of(address).alias("city"))


@query("SELECT event_id, user_id FROM events WHERE event_id % 10 <> 0")
def deleted_history(spark, sf_dir):
    """History without the searches that were deleted by id."""
    from talentloom.operators.tables import delete

    e = table(spark, sf_dir, "events")
    return delete(e.select("event_id", "user_id"), e.filter("event_id % 10 = 0"), "event_id")


#: Fields of a record for each customer, some absent, some spelled oddly.
_FIELDS = {
    "email": "CASE c_custkey % 4 WHEN 0 THEN 'noemail@notprovided.com' WHEN 1 THEN NULL ELSE concat('c', c_custkey, '@mail.example') END",
    "phone": "CASE c_custkey % 5 WHEN 0 THEN '' WHEN 1 THEN concat('98765-4', 1000 + c_custkey % 9000) WHEN 2 THEN concat('91 98765 4', 1000 + c_custkey % 9000) WHEN 3 THEN '+44 (20) 7946' ELSE '12-34' END",
    "name": "CASE c_custkey % 3 WHEN 0 THEN concat(' Dr. Ann ', c_custkey) WHEN 1 THEN 'N/A' ELSE '#1' END",
    "city": "CASE c_custkey % 3 WHEN 0 THEN 'City not specified' WHEN 1 THEN concat('  ', c_mktsegment, ' ') END",
    "pan": "CASE c_custkey % 3 WHEN 0 THEN concat(' abcde', 1000 + c_custkey % 9000, 'f') WHEN 1 THEN 'ABCDE12345' END",
    "aadhaar": "CASE c_custkey % 3 WHEN 0 THEN concat('1234 5678 ', 1000 + c_custkey % 9000) WHEN 1 THEN '1234-5678' END",
}


@query("""SELECT c_custkey, CASE WHEN c_custkey % 4 < 2 THEN 'email.not.found@placeholder.com' ELSE concat('c', c_custkey, '@mail.example') END AS email,
CASE c_custkey % 5 WHEN 0 THEN '+91-0000000000' WHEN 1 THEN concat('+91987654', 1000 + c_custkey % 9000) WHEN 2 THEN concat('+91987654', 1000 + c_custkey % 9000) WHEN 3 THEN '+44207946' ELSE '+911234' END AS phone,
CASE WHEN c_custkey % 3 = 0 THEN 'Dr. Ann' ELSE 'Name Not Extracted' END AS name, CASE WHEN c_custkey % 3 = 1 THEN c_mktsegment ELSE 'Location Not Specified' END AS city,
CASE WHEN c_custkey % 3 = 0 THEN concat('ABCDE', 1000 + c_custkey % 9000, 'F') END AS pan, CASE WHEN c_custkey % 3 = 0 THEN concat('12345678', 1000 + c_custkey % 9000) END AS aadhaar FROM customer""")
def checked_records(spark, sf_dir):
    """Fields of records in one spelling, with placeholders for absent ones."""
    rules = {"email": validation.record_email, "phone": validation.record_phone, "name": validation.record_name, "city": validation.record_city, "pan": validation.record_pan, "aadhaar": validation.record_aadhaar}
    said = table(spark, sf_dir, "customer").select("c_custkey", *(F.expr(v).alias(k) for k, v in _FIELDS.items()))
    return said.select("c_custkey", *(rule(F.col(k)).alias(k) for k, rule in rules.items()))


@query("SELECT p_partkey, p_brand FROM part WHERE regexp_matches(p_brand, '(?i)brand#1.')")
def typed_filter(spark, sf_dir):
    """Values that contain what a user typed, as it stands without brackets and commas."""
    return table(spark, sf_dir, "part").filter(text.matches_typed(F.col("p_brand"), " (brand#1.)!")).select("p_partkey", "p_brand")


@query("SELECT l_orderkey, l_linenumber, round(l_discount * 100, 2) AS discount, round(CASE WHEN l_quantity <= 1 THEN l_quantity * 100 ELSE l_quantity END, 2)::double AS quantity FROM lineitem")
def scores_as_percent(spark, sf_dir):
    """Scores of up to 1 as percentages; others are some already."""
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", scoring.as_percent(F.col("l_discount")).alias("discount"), scoring.as_percent(F.col("l_quantity")).cast("double").alias("quantity"))


@query("SELECT strftime(date_trunc('hour', ts::timestamp), '%Y-%m-%d %H:%M') AS start, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def windowed_events(spark, sf_dir):
    """Events by type and hour; a stream of them counts alike, with rows up to ten minutes late."""
    rows = table(spark, sf_dir, "events").withColumn("ts", F.to_timestamp("ts"))
    return windowed_counts(rows).select(F.date_format("start", "yyyy-MM-dd HH:mm").alias("start"), "event_type", "n")


#: Spellings of an order's date, by the remainder of its key.
_SPELLINGS = ("MMMM yyyy", "d MMM yy", "'Since' MMM d, yyyy", "MM/dd/yyyy", "yyyy-MM-dd'T'HH:mm:ss", "yyyyMMdd", "''yy-MM", "dd.MM.yyyy", "MM-yy", "'in' yyyy", "'some day'")


@query("SELECT o_orderkey, CASE o_orderkey % 11 WHEN 10 THEN NULL WHEN 9 THEN strftime(o_orderdate, '%Y-01') WHEN 7 THEN CASE WHEN day(o_orderdate) <= 12 THEN strftime(o_orderdate, '%Y-') || lpad(day(o_orderdate)::varchar, 2, '0') ELSE strftime(o_orderdate, '%Y-%m') END ELSE strftime(o_orderdate, '%Y-%m') END AS month FROM orders")
def written_months(spark, sf_dir):
    """Months out of dates in eleven spellings, with names, ordinals, short years and text around them."""
    at, key = F.col("o_orderdate"), F.col("o_orderkey")
    said = F
    for k, form in enumerate(_SPELLINGS):
        said = said.when(key % len(_SPELLINGS) == k, F.date_format(at, form))
    return table(spark, sf_dir, "orders").select("o_orderkey", dates.written_month(said, 2026).alias("month"))


#: Ten kinds of damage to ``{"id": .., "kind": "..", "parts": [.., ".."], "at": {"user": .., "big": ..}}``, by the remainder of an event's id.
_DAMAGE = (
    """concat('{"id": ', e, ', "kind": "', k, '", "parts": [', u, ', "', k, '"], "at": {"user": ', u, ', "big": ', b, '}}')""",
    """concat('Sure:\\n```json\\n{"id": ', e, ', "kind": "', k, '", "parts": [', u, ', "', k, '"], "at": {"user": ', u, ', "big": ', b, '}}\\n```\\nMore {braces}?')""",
    """concat('{"id": ', e, ', "kind": "', k, '", "parts": [', u, ', "', k, '",], "at": {"user": ', u, ', "big": ', b, ',},}')""",
    """concat("{'id': ", e, ", 'kind': '", k, "', 'parts': [", u, ", '", k, "'], 'at': {'user': ", u, ", 'big': ", initcap(b), "}}")""",
    """concat('{id: ', e, ', kind: ', k, ', parts: [', u, ', ', k, '], at: {user: ', u, ', big: ', b, '}}')""",
    """concat('{"id": ', e, ', "kind": "', k, '", "parts": [', u, ', "', k, '"], "at": {"user": ', u, ', "big": ', b)""",
    """concat('{"id": ', e, ' "kind": "', k, '" "parts": [', u, ' "', k, '"] "at": {"user": ', u, ' "big": ', b, '}}')""",
    """concat('{"id": ', e, ', // the kind\\n "kind": "', k, '", /* } */ "parts": [', u, ', "', k, '"], "at": {"user": ', u, ', "big": ', b, '}}')""",
    """concat('{"id": ', e, ', "at": {"user": ', u, ', "big": ', b, '}, "kind": "', k, '", "parts": [', u, ', "', k)""",
    """concat('{"id": ', e, ', "kind": “', k, '”, "at": {"user": ', u, ', "big": ', b, '}, "parts": [', u, ', "', k, '"}')""",
)


@query("SELECT event_id, event_id AS id, event_type AS kind, user_id AS \"user\", value > 100 AS big, user_id::varchar AS first, event_type AS last FROM events")
def tolerant_json(spark, sf_dir):
    """Objects of three levels in ten kinds of damage, read back."""
    e = table(spark, sf_dir, "events").select("event_id", F.expr("cast(event_id as string) e"), F.expr("event_type k"), F.expr("cast(user_id as string) u"), F.expr("cast(value > 100 as string) b"))
    said = F.expr("CASE event_id % 10 " + " ".join(f"WHEN {k} THEN {d}" for k, d in enumerate(_DAMAGE)) + " END")
    read = e.select("event_id", F.from_json(loose_json.tolerant_json(said), "id long, kind string, parts array<string>, at struct<user: long, big: boolean>").alias("x"))
    return read.select("event_id", "x.id", "x.kind", "x.at.user", "x.at.big", F.element_at("x.parts", 1).alias("first"), F.element_at("x.parts", 2).alias("last"))
