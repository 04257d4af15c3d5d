import random

import pytest
from pyspark.sql import functions as F

from talentloom.operators import scans, tables


def joined(periods):
    """Periods of one key, merged one after the other."""
    out = []
    for s, e in sorted(periods):
        if out and s <= out[-1][1] + 1:
            out[-1][1] = max(out[-1][1], e)
        else:
            out.append([s, e])
    return sorted(map(tuple, out))


@pytest.mark.parametrize("parts", [1, 7, 256])
def test_periods_of_a_hot_key(spark, monkeypatch, parts):
    monkeypatch.setattr(scans, "PARTS", parts)
    rng = random.Random(parts)
    rows = [("hot", s, s + rng.choice([0, 1, 3, 5000])) for s in (rng.randrange(60_000) for _ in range(3000))]
    rows += [(rng.choice(["a", "b", None]), s, s + rng.randrange(9)) for s in (rng.randrange(200) for _ in range(60))] + [("long", 0, 10**6), ("long", 5, 6), ("long", 10**6 + 1, 10**6 + 2), ("long", 10**6 + 4, 10**6 + 4)]
    df = spark.createDataFrame(rows, "k string, s long, e long").repartition(6)
    got: dict = {}
    for r in tables.merged_periods(df, "k", "s", "e").collect():
        got.setdefault(r.k, []).append((r.s, r.e))
    assert {k: sorted(v) for k, v in got.items()} == {k: joined([x[1:] for x in rows if x[0] == k]) for k in {x[0] for x in rows}}
    assert tables.merged_periods(df.limit(0), "k", "s", "e").count() == 0


def test_a_hot_key_is_in_many_ranges(spark, monkeypatch):
    monkeypatch.setattr(scans, "PARTS", 32)
    df = spark.range(20_000).select(F.lit("hot").alias("k"), F.col("id").alias("s"))
    sizes = [r["count"] for r in scans.in_ranges(df, ["k", "s"]).groupBy("__part").count().collect()]
    assert len(sizes) >= 28 and max(sizes) < 3000
    order = [r["__part"] for r in scans.in_ranges(df, ["k", "s"]).orderBy("k", "s").collect()]
    assert order == sorted(order)


def test_sums_and_maxima_before(spark, monkeypatch):
    monkeypatch.setattr(scans, "PARTS", 9)
    rng = random.Random(8)
    rows = [(g, i, rng.choice([None, 1, 5, -2])) for g in ("x", None) for i in range(300)]
    df = scans.in_ranges(spark.createDataFrame(rows, "g string, i int, v int"), ["g", "i"])
    got = {(r.g, r.i): (r.total, r.top) for r in scans.before(df, ["g"], ["i"], {"total": ("sum", F.col("v")), "top": ("max", F.col("v"))}).collect()}
    for g in ("x", None):
        seen = []
        for _, i, v in sorted((x for x in rows if x[0] == g), key=lambda x: x[1]):
            assert got[g, i] == (sum(seen) if seen else None, max(seen, default=None))
            seen += [] if v is None else [v]


def test_ranks_of_one_score(spark):
    """All rows have one score and one beginning of the name: they are still in many ranges."""
    rows = [(f"abc{i:05}", 3) for i in range(4000)] + [("z", None), (None, 3), (None, None), ("a", 9)]
    df = spark.createDataFrame(rows, "name string, score int").repartition(5)
    got = {(r.name, r.score): r.rank for r in tables.ranked(df, "score", "name").collect()}
    order = [("a", 9), (None, 3), *((f"abc{i:05}", 3) for i in range(4000)), (None, None), ("z", None)]
    assert got == {x: k + 1 for k, x in enumerate(order)}
