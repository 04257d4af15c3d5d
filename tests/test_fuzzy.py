import random
from difflib import SequenceMatcher

from pyspark.sql import functions as F

from talentloom.operators import fuzzy, terms


def test_postings_miss_no_similar_term(spark):
    rng = random.Random(6)
    vocabulary = {"".join(rng.choice("abcé ") for _ in range(rng.randint(1, 14))).strip() for _ in range(1500)} - {""}
    vocabulary |= {"abc", "axbxc", "aaaa", "a"}
    posted = fuzzy.postings(spark.createDataFrame([(v.upper() if i % 3 else v,) for i, v in enumerate(sorted(vocabulary))] + [("",), (None,), ("ABC",)], "t string"), "t").cache()
    for prefix in ("abc", "Abcab", "aabbcc é", "a", "zz"):
        p = prefix.lower()
        want = {v: SequenceMatcher(None, p, v).ratio() for v in vocabulary}
        want = {v: r for v, r in want.items() if r > 0.7}
        got = {r.term: r.alike for r in fuzzy.similar(posted, prefix).collect()}
        assert got == want
        assert fuzzy.candidates(posted, prefix).count() < 0.5 * len(vocabulary)
    posted.unpersist()


def test_completions_are_those_of_the_full_scan(spark):
    counts = spark.createDataFrame([("python", 9), ("pyhton", 2), ("pythn", 1), ("jython", 3), ("java", 5), ("Pythno", 1), ("p y t h o n s t a c k", 1), ("the", 40)], "term string, n long")
    relations = spark.createDataFrame([("java", "pythom", 0.1)], "term string, other string, strength double")
    got = {r.term: r.score for r in terms.completions(counts, relations, "pythom").collect()}
    base = {r.term: r.s for r in counts.select("term", terms.completion_score(F.col("term"), "pythom").alias("s")).collect()}
    assert set(got) == {t for t, s in base.items() if s > 0} == {"python", "pythn", "Pythno"}
    assert "the" not in got and base["python"] == SequenceMatcher(None, "pythom", "python").ratio() * 0.5
