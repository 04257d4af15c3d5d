import os

import pytest
from pyspark.sql import functions as F

from talentloom.sources.buckets import BucketTable


def files(path, bucket_of=None):
    found = {}
    for folder, _, names in os.walk(f"{path}/rows"):
        found |= {f"{folder}/{n}": os.stat(f"{folder}/{n}").st_mtime_ns for n in names if n.endswith(".parquet")}
    return found


def content(t):
    return sorted(tuple(r) for r in t.rows().collect())


@pytest.fixture
def stored(spark, tmp_path):
    df = spark.range(200).select(F.col("id").alias("k"), F.concat(F.lit("v"), "id").alias("v"), F.lit(1.5).alias("bucket_size"))
    return str(tmp_path / "t"), BucketTable.create(df, str(tmp_path / "t"), "k", 8)


def test_a_change_leaves_other_buckets_alone(spark, stored):
    path, t = stored
    before, was = files(path), dict(t.manifest)
    changes = spark.createDataFrame([(7, "new", None), (None, "lost", None)], "k long, v string, bucket_size double")
    t = t.upsert(changes)
    want = sorted((k, "new" if k == 7 else f"v{k}", 1.5) for k in range(200))
    assert content(t) == want
    after = files(path)
    assert {f: after[f] for f in before} == before and len(t.manifest) == 8
    assert sorted(v[:2] for v in t.manifest.values()) == ["0-"] * 7 + ["1-"] and len([f for f in after if f not in before]) == 1
    assert {b: v for b, v in t.manifest.items() if v[:2] == "0-"}.items() <= was.items()
    t = t.delete(spark.createDataFrame([(7,), (8,), (9999,)], "k long"))
    assert content(t) == [x for x in want if x[0] not in (7, 8)] and content(BucketTable(spark, path)) == content(t)


def test_a_writer_that_ends_early_changes_nothing(spark, stored, monkeypatch):
    path, t = stored
    from talentloom.sources import buckets

    def fails(*a):
        raise OSError("lost")

    was = content(t)
    monkeypatch.setattr(buckets, "_commit", fails)
    with pytest.raises(OSError):
        t.delete(spark.range(50).withColumnRenamed("id", "k"))
    monkeypatch.undo()
    os.makedirs(f"{path}/manifest/1")  # begun, but not committed
    again = BucketTable(spark, path)
    assert again.version == 0 and content(again) == was
    os.rmdir(f"{path}/manifest/1")
    assert len(content(again.delete(spark.range(50).withColumnRenamed("id", "k")))) == 150


def test_the_second_of_two_writers_fails(spark, stored):
    path, t = stored
    other = BucketTable(spark, path)
    t.delete(spark.createDataFrame([(1,)], "k long"))
    with pytest.raises(Exception, match="(?i)exist"):
        other.delete(spark.createDataFrame([(2,)], "k long"))
    assert {r.k for r in BucketTable(spark, path).rows().collect()} == set(range(200)) - {1}


def test_nothing_to_change_and_nothing_left(spark, stored):
    path, t = stored
    assert t.upsert(t.rows().limit(0)).version == 0
    t = t.delete(t.rows().select("k"))
    assert content(t) == [] and t.rows().columns == ["k", "v", "bucket_size"]
    t = t.upsert(spark.createDataFrame([(5, "five")], "k long, v string"))
    assert content(t) == [(5, "five", None)]
