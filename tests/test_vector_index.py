import numpy as np
import pytest
from pyspark.sql import functions as F

from talentloom.operators import vector_index


def clustered(n=3000, d=16, centres=12, seed=1):
    rng = np.random.default_rng(seed)
    c = rng.normal(size=(centres, d))
    v = c[rng.integers(0, centres, n)] + 0.15 * rng.normal(size=(n, d))
    v[: n // 3] = c[0] + 0.001 * rng.normal(size=(n // 3, d))  # a third of all rows nearly alike
    v[5] = v[4] = v[3]
    return v


def brute(rows, queries, k):
    unit = lambda x: x / np.linalg.norm(x, axis=1, keepdims=True)
    cos = unit(queries) @ unit(rows).T
    return [sorted(range(len(rows)), key=lambda j: (-round(c[j], 10), j))[:k] for c in cos]


@pytest.fixture(scope="module")
def index(spark, tmp_path_factory):
    v = clustered()
    rows = [(i, x.tolist()) for i, x in enumerate(v)] + [(9000, None), (9001, []), (9002, [0.0] * 16), (9003, [float("nan")] * 16), (None, [1.0] * 16)]
    df = spark.createDataFrame([(*r, 1, "p") for r in rows], "id long, vector array<double>, cell int, piece string").repartition(5)
    return v, vector_index.build(df, "id", "vector", str(tmp_path_factory.mktemp("index")))


def test_rows_are_those_of_a_scan(spark, index):
    v, built = index
    rng = np.random.default_rng(2)
    queries = np.concatenate([v[::150], rng.normal(size=(6, 16))])
    df = spark.createDataFrame([(i, q.tolist()) for i, q in enumerate(queries)] + [(99, None), (98, [0.0] * 16)], "q long, vector array<double>")
    for k in (1, 10):
        found, read = vector_index.nearest_of_many(built, df, "q", "vector", k)
        got: dict = {}
        for r in found.collect():
            got.setdefault(r.q, {})[r["rank"]] = r
        assert set(got) == set(range(len(queries)))
        want = brute(v, queries, k)
        unit = lambda x: x / np.linalg.norm(x)
        for i, best in enumerate(want):
            assert sorted(got[i]) == list(range(1, k + 1))
            near = [unit(v[j]) @ unit(queries[i]) for j in best]
            assert np.allclose([got[i][n + 1].cosine for n in range(k)], near, atol=1e-9)
            assert len({got[i][n + 1]["id"] for n in range(k)}) == k
        assert read["rows_in_index"] == len(v)
        assert read["rows_compared"] < 0.6 * len(queries) * len(v)  # random queries look farther than others


def test_a_near_query_reads_little(spark, index):
    v, built = index
    query = v[np.argmin(v @ v[0])]  # not of the crowd
    found, read = vector_index.nearest_of_many(built, spark.createDataFrame([(7, query.tolist())], "q long, vector array<double>"), "q", "vector", 3)
    assert found.count() == 3 and read["rows_compared"] < 0.3 * len(v) and read["rows_scanned"] < 0.3 * len(v)
    again = vector_index.opened(spark, built.rows.inputFiles()[0].removeprefix("file:").split("/rows/")[0])
    assert [tuple(r) for r in vector_index.nearest_of_many(again, spark.createDataFrame([(7, query.tolist())], "q long, vector array<double>"), "q", "vector", 3)[0].orderBy("rank").collect()] == [tuple(r) for r in found.orderBy("rank").collect()]


def test_a_crowd_is_parted(index):
    v, built = index
    assert built.pieces["n"].sum() == len(v)
    assert built.pieces["n"].max() <= 2 * vector_index.PIECE_ROWS


def test_many_blocks_of_queries_and_few_rows(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(vector_index, "QUERIES", 3)
    df = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 2.0]), (3, [1.0, 1.0])], "id long, vector array<float>")
    built = vector_index.build(df, "id", "vector", str(tmp_path / "a"))
    queries = spark.range(10).select("id", F.array(F.lit(1.0), F.col("id") / 10).alias("v"))
    found, _ = vector_index.nearest_of_many(built, queries.withColumnRenamed("id", "q"), "q", "v", 5)
    rows = found.collect()
    assert len(rows) == 30 and [r["id"] for r in sorted(rows, key=lambda r: (r.q, r["rank"]))][:3] == [1, 3, 2]
    none = vector_index.build(df.limit(0), "id", "vector", str(tmp_path / "b"))
    assert vector_index.nearest_of_many(none, queries.withColumnRenamed("id", "q"), "q", "v", 5)[0].count() == 0


def test_the_driver_starts_few_jobs(spark, index):
    _, built = index
    queries = spark.range(600).select("id", F.transform(F.sequence(F.lit(1), F.lit(16)), lambda x: F.sin(F.col("id") * x + x)).alias("v"))
    sc = spark.sparkContext
    sc.setJobGroup("few", "few")
    try:
        found, _ = vector_index.nearest_of_many(built, queries.withColumnRenamed("id", "q"), "q", "v", 5)
        jobs = len(sc.statusTracker().getJobIdsForGroup("few"))
    finally:
        sc.setLocalProperty("spark.jobGroup.id", None)
    assert jobs <= 6 and found.count() == 3000


def test_chunks_of_queries(spark, index, monkeypatch):
    _, built = index
    queries = spark.range(40).select(F.col("id").alias("q"), F.transform(F.sequence(F.lit(1), F.lit(16)), lambda x: F.sin(F.col("id") * x + x)).alias("v"))
    rows = lambda: sorted((r.q, r["rank"], r["id"], round(r.cosine, 9)) for r in vector_index.nearest_of_many(built, queries, "q", "v", 7)[0].collect())
    whole = rows()
    monkeypatch.setattr(vector_index, "CHUNK", 9)
    assert rows() == whole and len(whole) == 280
