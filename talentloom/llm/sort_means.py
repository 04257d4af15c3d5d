"""Centroid clustering by sort-means: exact k-means rounds that skip what the triangle inequality rules out."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from talentloom.llm import textbytes
from talentloom.llm.cuts import cut

CLUSTERS, ROUNDS, COMPONENTS, STEPS = 16, 3, 64, 64
#: Magnitude up to which squared distances of COMPONENTS integers fit in 64 bits.
LARGEST = 1 << 27
#: Vectors that are worked on at once.
BLOCK = 8192


class Centroids:
    """Centroids with, for each, all of them by their distance from it."""

    def __init__(self, rows: list[list[int]]):
        self.rows = np.array(rows, np.int64).reshape(len(rows), -1)
        apart = ((self.rows[:, None] - self.rows[None]) ** 2).sum(2)
        self.order = np.lexsort((np.broadcast_to(np.arange(len(rows)), apart.shape), apart), axis=1)
        self.apart = np.take_along_axis(apart, self.order, 1)

    def distances(self, vectors: np.ndarray, k: int) -> np.ndarray:
        away = vectors - self.rows[k]
        return np.einsum("ij,ij->i", away, away)

    def nearest(self, vectors: np.ndarray, before: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
        """The nearest centroid of each vector (the smaller number of equally near ones), its squared distance, and how many distances were worked out.

        From the centroid that a vector had before, the others are scanned in the order of their distance from it, as long as that is at most twice the vector's own:
        one strictly beyond is farther from the vector than the centroid it had.
        """
        best, least, n = before.copy(), np.empty(len(vectors), np.int64), 0
        for k in np.unique(before).tolist():
            rows = np.flatnonzero(before == k)
            own = self.distances(vectors[rows], k)
            least[rows], n = own, n + len(rows)
            for j, apart in zip(self.order[k].tolist(), self.apart[k].tolist()):
                if j == k:
                    continue
                near = own >= (apart + 3) // 4  # apart <= 4 * own, which might not fit in 64 bits
                rows, own = rows[near], own[near]
                if not len(rows):
                    break
                d, n = self.distances(vectors[rows], j), n + len(rows)
                better = (d < least[rows]) | ((d == least[rows]) & (j < best[rows]))
                least[rows[better]], best[rows[better]] = d[better], j
        return best, least, n


def _matrix(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), "<i8").reshape(len(column), COMPONENTS)


def _whole(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """``vec_id, vector, cluster``: the vectors that are kept, as packed integers, each with centroid 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column("vector")
            raw = column.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False).reshape(-1, COMPONENTS)
            whole = np.floor(raw * STEPS)
            if (np.abs(whole) > LARGEST).any():
                raise ValueError(f"a component is beyond {LARGEST // STEPS}: squared distances would not fit in 64 bits")
            packed = [x.tobytes() for x in whole.astype("<i8")]
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), pa.array(packed, pa.binary()), pa.array(np.zeros(len(packed), np.int32))], names=["vec_id", "vector", "cluster"])

    x = F.col(vector_col)
    finite = lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < float("inf"))
    kept = vectors.filter((F.size(x) == COMPONENTS) & F.forall(x, finite)).select(F.col(id_col).alias("vec_id"), x.cast("array<double>").alias("vector"))
    return kept.mapInArrow(textbytes.of_batches(run), f"vec_id {kept.schema['vec_id'].dataType.simpleString()}, vector binary, cluster int")


def _assigned(whole: DataFrame, centroids: Centroids) -> DataFrame:
    """The same vectors with their nearest centroid and ``distance``."""
    shared = whole.sparkSession.sparkContext.broadcast(centroids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low in range(0, batch.num_rows, BLOCK):
                part = batch.slice(low, BLOCK)
                cluster, distance, _ = shared.value.nearest(_matrix(part.column("vector")), part.column("cluster").to_numpy())
                yield pa.RecordBatch.from_arrays([part.column("vec_id"), part.column("vector"), pa.array(cluster.astype(np.int32)), pa.array(distance)], names=["vec_id", "vector", "cluster", "distance"])

    return whole.mapInArrow(textbytes.of_batches(run), f"vec_id {whole.schema['vec_id'].dataType.simpleString()}, vector binary, cluster int, distance long")


def _moved(assigned: DataFrame, centroids: Centroids) -> Centroids:
    """Each centroid at the floor of its vectors' mean; one without vectors stays. A task sends one row of sums for each of its clusters; the driver sees a row for each cluster."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            cluster, vectors = batch.column("cluster").to_numpy(), _matrix(batch.column("vector"))
            for k in np.unique(cluster).tolist():
                own = vectors[cluster == k]
                sums[k] = sums.get(k, 0) + np.append(own.sum(0), len(own))
        if sums:
            yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([x.tolist() for x in sums.values()], pa.list_(pa.int64()))], names=["cluster", "sums"])

    parts = assigned.select("cluster", "vector").mapInArrow(textbytes.of_batches(run), "cluster int, sums array<long>")
    rows = centroids.rows.tolist()
    for x in parts.groupBy("cluster").agg(F.array(*(F.sum(F.get("sums", F.lit(k)).cast("decimal(38,0)")) for k in range(COMPONENTS + 1))).alias("sums")).collect():
        *sums, n = map(int, x.sums)
        rows[x.cluster] = [s // n for s in sums]
    return Centroids(rows)


def sort_means(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", clusters: int = CLUSTERS, rounds: int = ROUNDS) -> DataFrame:
    """``vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256`` for every vector of 64 finite components.

    Components become whole numbers, ``floor(64 x)``. The ``clusters`` vectors whose ``1:<vec_id>`` has the least SHA-256 are the first centroids. Each round assigns every vector to the nearest
    centroid (ties: the smaller number) and moves the centroids to the floors of their means; vectors are assigned once more at the end. All distances are squared
    and exact. A round is one pass by sort-means from the assignment before, written to the shared folder, and one sum with a row for each task and cluster: nothing else is shuffled, so
    no cluster's size matters. What is broadcast are the centroids and their order, ``clusters`` squared numbers.

    Vectors of another length, null, or with a null, NaN or infinite component are left out. A null id counts as ``1:``; rows that share an id each count and
    come in the order of their components among the first centroids. With fewer vectors than clusters there are fewer centroids; no vectors give no rows. Components beyond
    two million raise an error. Other columns are left out.
    """
    spark = vectors.sparkSession
    now = cut(_whole(vectors, id_col, vector_col))
    seed = F.sha2(F.concat(F.lit("1:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), 256)
    first = now.orderBy(seed, "vector").limit(clusters).collect()
    result = f"vec_id {now.schema['vec_id'].dataType.simpleString()}, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"
    if not first:
        return spark.createDataFrame([], result)
    centroids = Centroids([np.frombuffer(x.vector, "<i8").tolist() for x in first])
    for _ in range(rounds):
        now = cut(_assigned(now, centroids))
        centroids = _moved(now, centroids)
    found = cut(_assigned(now, centroids).select("vec_id", "cluster", "distance"))
    inertia = {x.cluster: int(x.inertia) for x in found.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("inertia")).collect()}
    names = [hashlib.sha256(",".join(map(str, x)).encode()).hexdigest() for x in centroids.rows.tolist()]
    each = spark.createDataFrame([(k, x, sum(inertia.values()), names[k]) for k, x in inertia.items()], "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return found.join(F.broadcast(each), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def op11_sort_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sort_means(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def _sql() -> str:
    nearest = lambda k, of: f"""a{k} AS MATERIALIZED (
    SELECT vec_id, v, arg_min(c.cluster, (d, c.cluster)) AS cluster, min(d) AS distance FROM (
        SELECT w.vec_id, w.v, c.cluster, list_sum(list_transform(list_zip(w.v, c.v), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT AS d FROM whole w, {of} c
    ) c GROUP BY vec_id, v
)"""  # noqa: E731
    moved = lambda k: f"""m{k} AS MATERIALIZED (
    SELECT c.cluster, coalesce(any_value(n.v), any_value(c.v)) AS v FROM c{k} c LEFT JOIN (
        SELECT cluster, list(mean ORDER BY i) AS v FROM (
            SELECT cluster, i, ((sum(x) - ((sum(x) % count(*)) + count(*)) % count(*)) // count(*))::BIGINT AS mean FROM (SELECT cluster, unnest(v) AS x, generate_subscripts(v, 1) AS i FROM a{k}) GROUP BY cluster, i
        ) GROUP BY cluster
    ) n USING (cluster) GROUP BY c.cluster
), c{k + 1} AS MATERIALIZED (SELECT * FROM m{k})"""  # noqa: E731
    steps = ", ".join(x for k in range(ROUNDS) for x in (nearest(k, f"c{k}"), moved(k)))
    return f"""
WITH whole AS MATERIALIZED (
    SELECT vec_id, list_transform(embedding, lambda x: floor({STEPS} * x::DOUBLE)::BIGINT) AS v FROM embeddings
    WHERE len(embedding) = {COMPONENTS} AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = {COMPONENTS}
), c0 AS MATERIALIZED (
    SELECT (row_number() OVER (ORDER BY sha256('1:' || vec_id)) - 1)::INT AS cluster, v FROM whole QUALIFY cluster < {CLUSTERS}
), {steps}, {nearest(ROUNDS, f"c{ROUNDS}")}
SELECT vec_id, a.cluster, distance, (sum(distance) OVER (PARTITION BY a.cluster))::BIGINT AS cluster_inertia, (sum(distance) OVER ())::BIGINT AS inertia, sha256(array_to_string(c.v, ',')) AS centroid_sha256
FROM a{ROUNDS} a JOIN c{ROUNDS} c USING (cluster)
"""


OP11_SQL = _sql()
