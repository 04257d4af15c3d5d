import random

import pytest
from pyspark.sql import functions as F

from talentloom.streaming import history

SCHEMA = "user_id long, search_id long, ts_us long, change string, version string"
LIMITS = {"recent": 5, "saved": 3}


def changes(seed):
    """Users with few and many searches, repeats, ties in time, deletions before and after, of ids that never come, and of all that a user has."""
    rng = random.Random(seed)
    rows = [(u, s, rng.randrange(8), rng.choice(["recent", "saved"]), "x") for s in range(90) for u in [rng.choice([1, 1, 1, 2, 3, None])]]
    rows += rng.sample(rows, 10)
    rows += [(u, s, None, "delete", None) for u, s, *_ in rng.sample(rows, 25)]
    rows += [(4, 900, 1, "recent", "x"), (4, 900, None, "delete", "x"), (4, 901, None, "recent", "x"), (5, 902, 1, "delete", "x"), (1, None, 1, "recent", "x"), (1, 903, 9, "other", "x"), (1, 904, 9, None, "x")]
    rng.shuffle(rows)
    return rows


def plain(rows):
    out = set()
    gone = {(u, s) for u, s, _, c, _ in rows if c == "delete"}
    for user in {r[0] for r in rows}:
        for name, limit in LIMITS.items():
            times = {}
            for u, s, ts, c, _ in rows:
                if u == user and c == name and s is not None:
                    ts = history.NO_TIME if ts is None else ts
                    times[s] = max(ts, times.get(s, ts))
            kept = sorted(times, key=lambda s: (times[s], s), reverse=True)[:limit]
            out |= {(user, name, s, times[s]) for s in kept if (user, s) not in gone}
    return out


def found(df):
    rows = [tuple(r) for r in df.select("user_id", "list", "search_id", "ts_us").collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


@pytest.mark.parametrize("seed", [1, 2])
def test_a_batch_keeps_what_brute_force_keeps(spark, seed):
    rows = changes(seed)
    assert found(history.kept_searches(spark.createDataFrame(rows, SCHEMA), LIMITS)) == plain(rows)


@pytest.mark.parametrize("seed", [3, 4])
def test_a_stream_keeps_the_same_after_restarts(spark, tmp_path, seed):
    rows, source = changes(seed), f"{tmp_path}/in"
    third = len(rows) // 3
    for k, part in enumerate((rows[:third], rows[third : 2 * third], rows[2 * third :])):
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(SCHEMA).parquet(source)
        got = found(history.search_lists_replay(stream, f"{tmp_path}/run", LIMITS))
        assert got == plain(rows[: third * (k + 1)] if k < 2 else rows)


def test_a_table_without_changes(spark):
    assert found(history.kept_searches(spark.createDataFrame([], SCHEMA))) == set()


def test_the_newest_version_wins_when_nothing_is_left(spark, tmp_path):
    source = f"{tmp_path}/in"
    for part in ([(1, 1, 1, "recent", "x")], [(1, 1, 1, "delete", "x")]):
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.mode("append").parquet(source)
        got = history.search_lists_replay(spark.readStream.schema(SCHEMA).parquet(source), f"{tmp_path}/run")
    assert got.count() == 0
    assert got.filter(F.col("list") == "recent").count() == 0
