import random

from pyspark.sql import functions as F

from talentloom.operators import containment, terms


def test_pairs_are_those_of_a_theta_join(spark, monkeypatch):
    rng = random.Random(1)
    words = ["".join(rng.choice("aàb c") for _ in range(rng.randint(1, 6))) for _ in range(120)] + ["", "  ", None, "A", " abc "]
    texts = [(i, "".join(rng.choice("aàbB c") for _ in range(rng.randint(0, 60)))) for i in range(80)] + [(500, None), (501, ""), (3, "abc"), (None, "xx a"), (7, "ab" * 20_000)]
    df = spark.createDataFrame([(*t, "term", 1) for t in texts], "id long, text string, term string, __text int").repartition(4)
    vocabulary = spark.createDataFrame([(w, 0) for w in words], "w string, id int")
    norm = {w.lower().strip(" ") for w in words if w} - {""}
    want = sorted((i is None, i or 0, w) for i, t in texts if t is not None for w in norm if w in t.lower())
    for block in (containment.BLOCK_BYTES, 40):
        monkeypatch.setattr(containment, "BLOCK_BYTES", block)
        monkeypatch.setattr(containment, "PAIRS", 7)
        found = containment.contained(df, "id", "text", vocabulary, "w")
        assert sorted((r.id is None, r.id or 0, r.term) for r in found.collect()) == want
    plan = found._jdf.queryExecution().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    assert containment.contained(df, "id", "text", vocabulary.limit(0), "w").count() == 0 == containment.contained(df.limit(0), "id", "text", vocabulary, "w").count()


def test_a_table_of_keywords_gives_what_each_list_gives(spark):
    vocabulary = spark.createDataFrame([(w,) for w in ("python", "Python scripting", "pyth", "java", "machine learning", "deep machine", "sql server", "c", "", None)], "skill string")
    positions = {"dev": ["python", "sql"], "ml": ["Machine Learning engineer", "learning"], "none": ["cobol"]}
    table = spark.createDataFrame([(p, k) for p, ks in positions.items() for k in (*ks, ks[0], "", None)], "position string, keyword string")
    got = {(r.position, r.skill): r.relevance for r in containment.keyword_relevance(vocabulary, "skill", table, "position", "keyword").collect()}
    want = {}
    for p, ks in positions.items():
        rows = terms.keyword_relevance(vocabulary.select(F.lower(F.trim("skill")).alias("skill")).filter("skill <> ''"), "skill", ks)
        want |= {(p, r.skill): r.relevance for r in rows.collect()}
    assert got == want and got["dev", "python"] == 10 and got["dev", "python scripting"] == 8 and got["dev", "pyth"] == 6
