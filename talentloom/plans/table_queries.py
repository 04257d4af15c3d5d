"""Keyed tables, filters, text rules, history and durations."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from talentloom.functions import durations, text
from talentloom.operators import tables
from talentloom.operators.similar_texts import similar_texts
from talentloom.plans.profiles import PROFILES_SQL, profiles, table
from talentloom.sources.buckets import BucketTable
from talentloom.streaming import history
from talentloom.streaming.checkpoints import folder

QUERIES: dict = {}


def query(sql: str | None = None):
    def put(f):
        QUERIES[f.__name__] = (f, sql)
        return f

    return put


@query("SELECT doc_id, lang, n_chars FROM documents ORDER BY n_chars DESC, doc_id LIMIT 20 OFFSET 40")
def page_of_documents(spark, sf_dir):
    """The third page of 20."""
    return tables.page(table(spark, sf_dir, "documents").select("doc_id", "lang", "n_chars"), [F.desc("n_chars"), "doc_id"], 40, 20)


@query("SELECT c_custkey, c_name FROM customer WHERE c_custkey = 5")
def point_lookup(spark, sf_dir):
    return table(spark, sf_dir, "customer").filter("c_custkey = 5").select("c_custkey", "c_name").limit(1)


@query("SELECT lang, count(*) AS n FROM documents WHERE source = 'src0' GROUP BY lang")
def filtered_counts(spark, sf_dir):
    return table(spark, sf_dir, "documents").filter("source = 'src0'").groupBy("lang").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT c_custkey, c_name FROM customer ORDER BY md5(c_custkey::varchar), c_custkey LIMIT 100")
def random_sample(spark, sf_dir):
    return tables.sample(table(spark, sf_dir, "customer").select("c_custkey", "c_name"), 100, "c_custkey")


@query("SELECT coalesce(c_custkey, k) AS c_custkey, coalesce(s, c_mktsegment) AS c_mktsegment, coalesce(a, c_acctbal) AS c_acctbal FROM customer FULL JOIN (SELECT c_custkey + 10 AS k, upper(c_name) AS s, CASE WHEN c_custkey % 2 = 0 THEN c_acctbal + 1 END AS a FROM customer WHERE c_nationkey = 3) ON c_custkey = k")
def updated_rows(spark, sf_dir):
    """New values laid over old ones by key, rows that only the changes have added."""
    c = table(spark, sf_dir, "customer")
    changes = c.filter("c_nationkey = 3").select((F.col("c_custkey") + 10).alias("c_custkey"), F.upper("c_name").alias("c_mktsegment"), F.when(F.col("c_custkey") % 2 == 0, F.col("c_acctbal") + 1).alias("c_acctbal"))
    return tables.upsert(c.select("c_custkey", "c_mktsegment", "c_acctbal"), changes, "c_custkey")


@query("SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_nationkey < 5)")
def deleted_rows(spark, sf_dir):
    gone = table(spark, sf_dir, "customer").filter("c_nationkey < 5").select(F.col("c_custkey").alias("o_custkey"))
    return tables.delete(table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), gone, "o_custkey")


@query("SELECT coalesce(c_custkey, s_suppkey) AS key, coalesce(nullif(trim(CASE WHEN c_custkey % 4 = 0 THEN '' ELSE c_name END), ''), s_name) AS name, coalesce(c_nationkey, s_nationkey)::varchar AS nation FROM customer FULL JOIN supplier ON c_custkey = s_suppkey")
def merged_records(spark, sf_dir):
    """Two sources' records merged: what the first has, filled from the second."""
    first = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("key"), F.when(F.col("c_custkey") % 4 == 0, "").otherwise(F.col("c_name")).alias("name"), F.col("c_nationkey").alias("nation"))
    second = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("key"), F.col("s_name").alias("name"), F.col("s_nationkey").alias("nation"))
    return tables.overlay(first, second, "key")


@query("SELECT doc_id, coalesce(text, '') AS body, CASE WHEN length(text) > 200 THEN substr(text, 1, 200) || '...' ELSE text END AS preview, coalesce(n_chars, 0) * 2 AS doubled, trim(doc_id::varchar) AS id_text FROM documents")
def default_projection(spark, sf_dir):
    """Defaults for what is missing, previews, computed and stringified columns."""
    return table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("body"), text.preview(F.col("text")).alias("preview"), (F.coalesce("n_chars", F.lit(0)) * 2).alias("doubled"), F.trim(F.col("doc_id").cast("string")).alias("id_text"))


@query(r"""SELECT doc_id, regexp_replace(regexp_replace(text, '\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Z|a-z]{2,7}\b', '****@****.***', 'g'), '\b\d{10}\b|\b(?:\d{3}-){2}\d{4}\b|\b\(\d{3}\) \d{3}-\d{4}\b', '***-***-****', 'g') AS masked FROM documents""")
def masked_documents(spark, sf_dir):
    """Texts without e-mail addresses and phone numbers."""
    return table(spark, sf_dir, "documents").select("doc_id", text.mask_pii(F.col("text")).alias("masked"))


def _comparable_sql(x: str) -> str:
    out = rf"regexp_replace(regexp_replace(lower({x}), '[^a-z\s]', ' ', 'g'), '\s+', ' ', 'g')"
    for w in text.COMMON_WORDS:
        out = f"replace({out}, '{w}', ' ')"
    return rf"trim(regexp_replace({out}, '\s+', ' ', 'g'))"


@query(f"SELECT min(doc_id) AS first_id, count(*) AS n FROM documents GROUP BY {_comparable_sql('text')} HAVING count(*) > 1")
def repeated_texts(spark, sf_dir):
    """Groups of texts that are the same for the comparison of near-copies."""
    rows = table(spark, sf_dir, "documents").select("doc_id", text.comparable(F.col("text")).alias("t"))
    return rows.groupBy(F.sha2("t", 256).alias("sha")).agg(F.min("doc_id").alias("first_id"), F.count(F.lit(1)).alias("n")).filter("n > 1").drop("sha")


@query()
def similar_documents(spark, sf_dir):
    """Documents whose id is divisible by 20 against all documents; they have no owner, so none is set."""
    d = table(spark, sf_dir, "documents")
    return similar_texts(d.filter("doc_id % 20 = 0"), d, [], "doc_id", "text")


@query("SELECT p_partkey, p_name FROM part WHERE contains(lower(p_name), 'red') OR contains(lower(p_type), 'promo') OR regexp_matches(p_name, '(?i)small.*bolt')")
def any_filter(spark, sf_dir):
    """Any of several containments, or words with a gap."""
    p = table(spark, sf_dir, "part")
    return p.filter(text.holds(F.col("p_name"), "red") | text.holds(F.col("p_type"), "promo") | text.word_gap(F.col("p_name"), "small bolt")).select("p_partkey", "p_name")


@query("SELECT DISTINCT p_name FROM part WHERE starts_with(lower(p_name), 'bl') ")
def prefix_filter(spark, sf_dir):
    return table(spark, sf_dir, "part").filter(text.starts(F.col("p_name"), "BL")).select("p_name").distinct()


@query("SELECT DISTINCT p_name FROM part WHERE regexp_matches(replace(lower(p_name), ' ', ''), 'b.*t')")
def subsequence_filter(spark, sf_dir):
    return table(spark, sf_dir, "part").filter(text.subsequence(F.col("p_name"), "bt")).select("p_name").distinct()


@query(r"""WITH s AS (SELECT n_name, regexp_matches(n_name, '(?i)\bnation_1\b') AS whole, contains(lower(n_name), 'nation_1') AS part FROM nation) SELECT n_name FROM s WHERE whole OR (part AND NOT (SELECT bool_or(whole) FROM s))""")
def word_or_contains(spark, sf_dir):
    """Whole-word matches; containing ones only if there are none."""
    rows = table(spark, sf_dir, "nation").select("n_name", text.whole_word(F.col("n_name"), "nation_1").alias("whole"))
    some = F.broadcast(rows.agg(F.bool_or("whole").alias("some")))
    return rows.crossJoin(some).filter(F.col("whole") | (text.holds(F.col("n_name"), "nation_1") & ~F.col("some"))).select("n_name")


@query("SELECT n_name FROM (SELECT n_name FROM nation WHERE contains(lower(n_name), '1') ORDER BY n_nationkey LIMIT 5) ORDER BY n_name")
def cut_then_sorted(spark, sf_dir):
    """The first five in stored order, then sorted."""
    return table(spark, sf_dir, "nation").filter(text.holds(F.col("n_name"), "1")).orderBy("n_nationkey").limit(5).select("n_name").orderBy("n_name")


@query(f"WITH {PROFILES_SQL} SELECT profile_id, len(skills) AS n FROM profiles WHERE len(skills) > 0 AND list_has_any(list_concat(skills, may_also), ['low', 'household']) AND current_city IN ('nation_1', 'nation_2', 'nation_3') AND current_city <> ''")
def list_filters(spark, sf_dir):
    """Arrays that are not empty and share values with a list, scalars in a list."""
    wanted = F.array(F.lit("low"), F.lit("household"))
    return profiles(spark, sf_dir).filter((F.size("skills") > 0) & (F.arrays_overlap("skills", wanted) | F.arrays_overlap("may_also", wanted)) & F.col("current_city").isin("nation_1", "nation_2", "nation_3") & (F.col("current_city") != "")).select("profile_id", F.size("skills").cast("long").alias("n"))


@query("SELECT c_custkey, concat_ws(',', CASE WHEN n > 1 THEN 'place' END, CASE WHEN m > 1 THEN 'balance' END) AS conflicts FROM (SELECT c_custkey, count(*) OVER (PARTITION BY c_nationkey, c_mktsegment, c_acctbal::int // 500) AS n, count(*) OVER (PARTITION BY c_acctbal) AS m FROM customer) WHERE n > 1 OR m > 1")
def identity_conflicts(spark, sf_dir):
    """Rows that share an identity with another one, and which identities these are."""
    c = table(spark, sf_dir, "customer").select("c_custkey", F.concat_ws("/", "c_nationkey", "c_mktsegment", F.expr("cast(round(c_acctbal) as int) div 500").cast("string")).alias("place"), F.col("c_acctbal").alias("balance"))
    return tables.conflicts(c, "c_custkey", ["place", "balance"]).select("c_custkey", "conflicts")


@query("SELECT event_id, user_id, rank FROM (SELECT event_id, user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rank FROM events) WHERE rank <= 100")
def newest_events(spark, sf_dir):
    """The newest 100 events of each user."""
    found = tables.newest(table(spark, sf_dir, "events"), "user_id", 100, [F.desc("ts"), F.desc("event_id")])
    return found.select("event_id", "user_id", F.col("rank").cast("long").alias("rank"))


@query("SELECT event_id, user_id FROM (SELECT event_id, user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rank FROM events) WHERE rank <= 100")
def streamed_history(spark, sf_dir):
    """The same buffer kept by a stream: state holds at most 100 rows of a user."""
    return history.ring_buffer_replay(spark, f"{sf_dir}/events.parquet", 100)


@query("""WITH e AS (SELECT user_id, event_id AS search_id, CASE WHEN event_type = 'purchase' THEN 'saved' ELSE 'recent' END AS list, ts FROM events)
SELECT user_id, list, search_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id, list ORDER BY ts DESC, search_id DESC) AS place FROM e) WHERE place <= CASE list WHEN 'saved' THEN 10 ELSE 40 END AND search_id % 7 <> 0""")
def streamed_deletions(spark, sf_dir):
    """Recent and saved searches kept by a stream, with their own bounds; every seventh search is deleted, half of these before they come."""
    e = history.events_stream(spark, f"{sf_dir}/events.parquet")
    kind = F.when(F.col("event_type") == "purchase", "saved").otherwise("recent")
    change = lambda c: F.struct(F.col("user_id"), F.col("event_id").alias("search_id"), F.unix_micros(F.to_timestamp("ts")).alias("ts_us"), c.alias("change"))
    put, gone = change(kind), change(F.lit("delete"))
    each = F.when(F.col("event_id") % 14 == 0, F.array(gone, put)).when(F.col("event_id") % 7 == 0, F.array(put, gone)).otherwise(F.array(put))
    base = f"{folder(spark)}/searches/{uuid.uuid4().hex}"
    return history.search_lists_replay(e.select(F.inline(each)), base, {"recent": 40, "saved": 10}).select("user_id", "list", "search_id")


@query("SELECT event_id, event_type FROM events WHERE user_id = 3 ORDER BY ts DESC, event_id DESC LIMIT 50")
def recent_searches(spark, sf_dir):
    """A user's newest rows, with the limit kept between 1 and 50."""
    limit = tables.shown_rows(500)
    return table(spark, sf_dir, "events").filter("user_id = 3").orderBy(F.desc("ts"), F.desc("event_id")).limit(limit).select("event_id", "event_type")


@query("SELECT doc_id, source, used FROM (SELECT doc_id, source, sum(n_chars) OVER (PARTITION BY source ORDER BY doc_id) AS used FROM documents) WHERE used <= 8000")
def packed_context(spark, sf_dir):
    """The leading texts of each source that fit 8000 characters."""
    found = tables.within_budget(table(spark, sf_dir, "documents"), ["source"], ["doc_id"], F.col("n_chars"), 8000)
    return found.select("doc_id", "source", "used")


_PERIODS = "p AS (SELECT l_suppkey AS k, date_diff('day', TIMESTAMP '1970-01-01', l_shipdate) AS s, date_diff('day', TIMESTAMP '1970-01-01', l_shipdate) + l_quantity::int AS e FROM lineitem)"


@query(f"""WITH {_PERIODS}, m AS (SELECT k, s, e, max(e) OVER (PARTITION BY k ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS latest FROM p),
i AS (SELECT *, sum(CASE WHEN s > latest + 1 THEN 1 ELSE 0 END) OVER (PARTITION BY k ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS island FROM m)
SELECT k, count(*) AS periods, sum(e - s + 1)::bigint AS days FROM (SELECT k, min(s) AS s, max(e) AS e FROM i GROUP BY k, island) GROUP BY k""")
def merged_experience(spark, sf_dir):
    """Periods joined where they overlap or touch, and their total."""
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("k"), F.unix_date(F.to_date("l_shipdate")).cast("long").alias("s"), (F.unix_date(F.to_date("l_shipdate")) + F.col("l_quantity").cast("int")).cast("long").alias("e"))
    return tables.merged_periods(rows, "k", "s", "e").groupBy("k").agg(F.count(F.lit(1)).alias("periods"), F.sum(F.col("e") - F.col("s") + 1).alias("days"))


@query(f"""WITH {PROFILES_SQL} SELECT profile_id, CASE WHEN profile_id % 3 = 0 THEN try_cast(regexp_extract(total_experience, '(\\d+)', 1) AS int) * 12 + profile_id % 12 ELSE profile_id % 7 * 12 END AS months,
    coalesce(list_sum(list_transform(experience, lambda x: greatest(1, (coalesce(x.until, '2025-06')[1:4]::int - x.from_date[1:4]::int) * 12 + coalesce(x.until, '2025-06')[6:7]::int - x.from_date[6:7]::int))), 0)::bigint AS by_dates,
    (profile_id % 7 + (profile_id % 5 + 13) // 12)::varchar || ' years, ' || ((profile_id % 5 + 13) % 12)::varchar || ' months' AS summed FROM profiles""")
def durations_of_profiles(spark, sf_dir):
    """Months of free texts, of dated jobs, and sums of durations."""
    said = F.when(F.col("profile_id") % 3 == 0, F.col("total_experience")).otherwise((F.col("profile_id") % 7).cast("string"))
    parts = F.array(F.concat((F.col("profile_id") % 7).cast("string"), F.lit(" yrs 13 months")), F.concat((F.col("profile_id") % 5).cast("string"), F.lit(" months")))
    by_dates = F.aggregate("experience", F.lit(0).cast("long"), lambda a, e: a + durations.months_between(e["from_date"], e["until"], "2025-06"))
    return profiles(spark, sf_dir).select("profile_id", durations.months_of(said).cast("long").alias("months"), by_dates.alias("by_dates"), durations.total_of(parts).alias("summed"))


_RESUME = lambda ws: "(" + " OR ".join(f"contains(lower(text), '{w}')" for w in ws) + ")"


@query(f"SELECT doc_id, contact, experience, education, skills, contact AND (experience OR education OR skills) AS resume_like FROM (SELECT doc_id, {', '.join(f'{_RESUME(ws)} AS {k}' for k, ws in text.RESUME_WORDS.items())} FROM documents)")
def resume_like_documents(spark, sf_dir):
    """Which kinds of words of a resume each text holds, and whether they make it look like one."""
    has = {k: text.holds(F.col("text"), *ws).alias(k) for k, ws in text.RESUME_WORDS.items()}
    return table(spark, sf_dir, "documents").select("doc_id", *has.values(), text.resume_like(F.col("text")).alias("resume_like"))


@query(r"""SELECT doc_id, array_to_string(list_filter(list_transform(regexp_split_to_array(text, '(?i)[,;|/&]|\sand\s|\sor\s'), lambda x: trim(regexp_replace(regexp_replace(x, '^[:\-\s]+|[:\-\s]+$', '', 'g'), '\s+', ' ', 'g'))), lambda x: length(x) BETWEEN 2 AND 50 AND NOT regexp_full_match(x, '\d+') AND lower(x) NOT IN ('others', 'and', 'in', 'of', 'the', 'with', 'using', 'etc', 'various')), '|') AS skills FROM documents""")
def split_skill_lists(spark, sf_dir):
    """Free lists as arrays of skills."""
    return table(spark, sf_dir, "documents").select("doc_id", F.array_join(text.split_skills(F.col("text")), "|").alias("skills"))


@query("SELECT event_type, count(*) AS n, sum((props->>'k')::int)::bigint AS k FROM events GROUP BY 1")
def json_properties(spark, sf_dir):
    """Values read out of JSON strings."""
    rows = table(spark, sf_dir, "events").select("event_type", F.from_json("props", "k int")["k"].alias("k"))
    return rows.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("k").alias("k"))


@query("SELECT c_custkey::varchar AS c_custkey, trim(c_name) AS c_name, '[\"' || c_mktsegment || '\",' || '\"x\"]' AS tags, '{\"n\":' || c_nationkey || '}' AS place FROM customer")
def stringified_rows(spark, sf_dir):
    """All columns as text, nested ones as JSON, without vectors."""
    rows = table(spark, sf_dir, "customer").select("c_custkey", "c_name", F.array("c_mktsegment", F.lit("x")).alias("tags"), F.struct(F.col("c_nationkey").alias("n")).alias("place"), F.array(F.lit(0.5)).alias("text_vector"))
    return tables.as_text(tables.without_suffix(rows))


@query("SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_discount >= 0.05")
def thresholds(spark, sf_dir):
    """Rows that reach a score; a threshold of 0 lets all pass."""
    rows = tables.at_least(table(spark, sf_dir, "lineitem").withColumn("score", F.col("l_discount")), "score", 0.05)
    return tables.at_least(rows, "score", 0).select("l_orderkey", "l_linenumber")


@query("SELECT o_orderkey FROM orders WHERE o_custkey = 7 AND o_orderkey <> 33")
def others_of_a_value(spark, sf_dir):
    """Rows other than one's own with a value."""
    return tables.others_with(table(spark, sf_dir, "orders"), "o_custkey", 7, "o_orderkey", 33).select("o_orderkey")


@query("SELECT vec_id, vec_id % 10 = 0 AS failed, round(CASE WHEN vec_id % 10 = 0 THEN embedding[1]::double ELSE length(vec_id::varchar) END, 5) AS lead FROM embeddings")
def embedded_again(spark, sf_dir):
    """Vectors made anew by an embedding function; where it fails the old one stays."""
    size = F.length(F.col("vec_id").cast("string")).cast("float")
    made = F.when(F.col("vec_id") % 10 != 0, F.array(size, size))
    return tables.embedded(table(spark, sf_dir, "embeddings"), made, "embedding").select("vec_id", "failed", F.round(F.col("embedding")[0].cast("double"), 5).alias("lead"))


@query("""SELECT o_orderkey, CASE WHEN o_orderkey % 50 = 3 THEN 'X' ELSE o_orderstatus END AS status, CASE WHEN o_orderkey % 50 = 3 AND o_totalprice > 100000 THEN 0.0 ELSE o_totalprice END AS price FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_quantity = 50 AND l_discount > 0.09)
UNION ALL SELECT -o_orderkey, 'new', NULL FROM orders WHERE o_orderkey % 50 = 3 AND o_totalprice > 100000 AND -o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_quantity = 50 AND l_discount > 0.09)""")
def updated_buckets(spark, sf_dir):
    """A stored table after new values, new keys and deletions, each of which rewrites the buckets it touches."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_orderstatus").alias("status"), F.col("o_totalprice").alias("price"))
    stored = BucketTable.create(orders, f"{folder(spark)}/buckets-{uuid.uuid4().hex}", "o_orderkey", 16)
    some = orders.filter("o_orderkey % 50 = 3")
    dear = F.col("price") > 100_000
    stored = stored.upsert(some.select("o_orderkey", F.lit("X").alias("status"), F.when(dear, 0.0).alias("price")))
    stored = stored.upsert(some.filter(dear).select((-F.col("o_orderkey")).alias("o_orderkey"), F.lit("new").alias("status")))
    gone = table(spark, sf_dir, "lineitem").filter("l_quantity = 50 AND l_discount > 0.09").select(F.col("l_orderkey").alias("o_orderkey")).distinct()
    return stored.delete(gone).rows()
