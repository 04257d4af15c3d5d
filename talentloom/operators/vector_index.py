"""An exact index of vectors: rows stored by centroid and by angle from it, searched only where the triangle inequality can't rule them out."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Vectors that centroids are fitted on, chosen by a hash; centroids, at most; rounds of fitting.
FITTED, CELLS, ROUNDS = 4096, 256, 5
#: Width of a band of angles within a cell; rows of a piece of a band, at least; pieces of an index, about.
BAND, PIECE_ROWS, PIECES = np.pi / 48, 2000, 20_000
#: Query vectors that are searched for by one pair of scans, and of these compared at once.
QUERIES, CHUNK = 8192, 256
#: By how much an angle may be off.
SLACK = 1e-7


def _normal(x: np.ndarray) -> np.ndarray:
    return x / np.linalg.norm(x, axis=-1, keepdims=True)


def _angles(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(a @ b.T, -1.0, 1.0))


def centroids_of(units: np.ndarray, cells: int) -> np.ndarray:
    """Centroids of unit vectors by a few rounds of spherical k-means, from vectors spread over them."""
    out = units[np.linspace(0, len(units) - 1, min(cells, len(units))).astype(int)]
    for _ in range(ROUNDS if len(out) else 0):
        cell = (units @ out.T).argmax(1)
        for k in range(len(out)):
            total = units[cell == k].sum(0)
            if (size := np.linalg.norm(total)) > 0:
                out[k] = total / size
    return out


@dataclass
class Index:
    """``rows``: key, unit vector, cell, piece and angle from the cell's centroid. ``pieces``: for each piece its cell, least and largest angle, and rows."""

    key: str
    rows: DataFrame
    centroids: np.ndarray
    pieces: np.ndarray

    def bounds(self, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each query and piece the least angle that a row of the piece can have, and the angle to its centroid."""
        away = _angles(queries, self.centroids)[:, self.pieces["cell"]]
        return np.maximum(0, np.maximum(away - self.pieces["high"], self.pieces["low"] - away) - SLACK), away


_PIECE = np.dtype([("cell", int), ("piece", int), ("low", float), ("high", float), ("n", int)])


def _usable(df: DataFrame, vector: str) -> DataFrame:
    finite = lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < float("inf"))
    return df.filter((F.size(vector) > 0) & F.forall(vector, finite) & F.exists(vector, lambda e: e != 0))


def build(df: DataFrame, key: str, vector: str, path: str, cells: int = CELLS) -> Index:
    """Writes the index of a table's vectors to a folder.

    Centroids are fitted on a bounded number of rows; every row is indexed: it goes to its nearest centroid, and there to the band of its angle, and a crowded band is parted by a hash
    of the key into pieces of ``PIECE_ROWS`` rows or, in a large table, as many as make ``PIECES`` pieces; so a piece is bounded however alike the vectors are. Files hold one cell each.
    Vectors that are null, empty, zero or not finite, and rows without a key, are left out; the others have one length.
    """
    spark, usable = df.sparkSession, _usable(df.select(key, vector).filter(F.col(key).isNotNull()), vector)
    some = usable.orderBy(F.xxhash64(key), key).limit(FITTED).collect()
    n = usable.count()
    units = _normal(np.array([x[1] for x in some], float)) if some else np.zeros((0, 1))
    centroids = centroids_of(units, max(1, min(cells, int(n**0.5))))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                units = _normal(np.array(batch.column(1).to_pylist(), float))
                cosine = units @ centroids.T
                cell = cosine.argmax(1)
                angle = np.arccos(np.clip(cosine[np.arange(len(cell)), cell], -1.0, 1.0))
                made = [pa.array(list(units), pa.list_(pa.float64())), pa.array(cell.astype(np.int32)), pa.array((angle / BAND).astype(np.int32)), pa.array(angle)]
                yield pa.RecordBatch.from_arrays([batch.column(0), *made], names=[key, "unit", "cell", "band", "angle"])

    schema = f"`{key}` {df.schema[key].dataType.simpleString()}, unit array<double>, cell int, band int, angle double"
    placed = usable.mapInArrow(place, schema)
    crowd = placed.groupBy("cell", "band").agg(F.count(F.lit(1)).alias("n")).withColumn("parts", F.ceil(F.col("n") / max(PIECE_ROWS, n // PIECES)).cast("int"))
    piece = F.struct("cell", "band", F.pmod(F.xxhash64(key), F.col("parts")).cast("int").alias("part"))
    rows = placed.join(F.broadcast(crowd.drop("n")), ["cell", "band"]).withColumn("piece", F.hash(piece))  # at most 48 bands a cell
    rows.select(key, "unit", "angle", "piece", "cell").repartition("cell", "piece").write.partitionBy("cell").mode("overwrite").parquet(f"{path}/rows")
    df.select(key).limit(0).coalesce(1).write.mode("overwrite").parquet(f"{path}/key")
    stored = _stored(spark, path)
    stored.groupBy("cell", "piece").agg(F.min("angle").alias("low"), F.max("angle").alias("high"), F.count(F.lit(1)).alias("n")).write.mode("overwrite").parquet(f"{path}/pieces")
    spark.createDataFrame([(k, x.tolist()) for k, x in enumerate(centroids)], "cell int, unit array<double>").coalesce(1).write.mode("overwrite").parquet(f"{path}/centroids")
    return opened(spark, path)


def _stored(spark: SparkSession, path: str) -> DataFrame:
    """The rows of an index; the key's name and type come from a table of its own, as an index without rows has no files of rows."""
    key = spark.read.parquet(f"{path}/key").schema[0]
    return spark.read.schema(f"`{key.name}` {key.dataType.simpleString()}, unit array<double>, angle double, piece int, cell int").parquet(f"{path}/rows")


def opened(spark: SparkSession, path: str) -> Index:
    """An index that ``build`` has written."""
    rows = _stored(spark, path)
    pieces = np.array(sorted(tuple(x) for x in spark.read.parquet(f"{path}/pieces").select("cell", "piece", "low", "high", "n").collect()), _PIECE)
    centroids = np.array([x.unit for x in spark.read.parquet(f"{path}/centroids").orderBy("cell").collect()], float)
    return Index(rows.columns[0], rows, centroids, pieces)


def _read(index: Index, asked: DataFrame, number: np.ndarray, units: np.ndarray, cells: np.ndarray, k: int, named: dict[int, np.ndarray] | None = None, reach: np.ndarray | None = None) -> DataFrame:
    """``query, key, cosine``: of the pieces that a query wants its ``k`` nearest rows of each batch; cells that nobody wants are not read.

    ``named`` holds for each piece's number the queries that want it; without it a task finds out from ``reach``, the largest angle that each query looks at.
    """
    shared = asked.sparkSession.sparkContext.broadcast((number, units, index.centroids, index.pieces, named, reach))
    key = index.key
    schema = f"query long, `{key}` {index.rows.schema[key].dataType.simpleString()}, cosine double"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, queries, centroids, pieces, named, reach = shared.value
        at_piece = {place: i for i, place in enumerate(zip(pieces["cell"].tolist(), pieces["piece"].tolist()))}
        for batch in batches:
            if not batch.num_rows:
                continue
            place = np.column_stack([batch.column(c).to_numpy() for c in ("cell", "piece")])
            order = np.lexsort(place.T)
            new = np.flatnonzero(np.concatenate(([True], (place[order][1:] != place[order][:-1]).any(1))))
            rows = batch.column("unit").flatten().to_numpy().reshape(batch.num_rows, -1)
            keys = np.array(batch.column(key).to_pylist())
            groups = [(order[a:z], at_piece[tuple(place[order[a]].tolist())]) for a, z in zip(new, np.append(new[1:], len(order)))]
            for low in range(0, len(number), CHUNK):
                some = queries[low : low + CHUNK]
                away = {} if named is not None else {c: _angles(some, centroids[c][None])[:, 0] for c in np.unique(place[:, 0]).tolist()}
                query, at, cosine = [], [], []
                for own, p in groups:
                    if named is not None:
                        asking = named.get(p, np.zeros(0, int))
                        asking = asking[(asking >= low) & (asking < low + CHUNK)] - low
                    else:
                        far = away[int(pieces["cell"][p])]
                        asking = np.flatnonzero(np.maximum(0, np.maximum(far - pieces["high"][p], pieces["low"][p] - far) - SLACK) <= reach[low : low + CHUNK] + SLACK)
                    if not len(asking):
                        continue
                    found = some[asking] @ rows[own].T
                    least = np.partition(found, -k, axis=1)[:, -k] if found.shape[1] > k else np.full(len(asking), -np.inf)
                    i, j = np.nonzero(found >= least[:, None])
                    query.append(asking[i] + low)
                    at.append(own[j])
                    cosine.append(found[i, j])
                if query:
                    query, at, cosine = (np.concatenate(x) for x in (query, at, cosine))
                    best = np.lexsort((keys[at], -cosine, query))
                    query, at, cosine = query[best], at[best], cosine[best]
                    start = np.flatnonzero(np.concatenate(([True], query[1:] != query[:-1])))
                    first = np.arange(len(query)) - np.repeat(start, np.diff(np.append(start, len(query)))) < k
                    yield pa.RecordBatch.from_arrays([pa.array(number[query[first]]), batch.column(key).take(pa.array(at[first])), pa.array(cosine[first])], names=["query", key, "cosine"])

    return index.rows.filter(F.col("cell").isin(cells.tolist())).select(key, "unit", "cell", "piece").mapInArrow(run, schema)


def nearest_of_many(index: Index, queries: DataFrame, query: str, vector: str, k: int) -> tuple[DataFrame, dict[str, int]]:
    """``query, key, cosine, rank``: for each query vector the ``k`` rows of the index with the largest cosine (ties: the smaller key), and how much was read.

    Exact. Queries are searched for in blocks of ``QUERIES``, which pass the driver one after another. A first pass reads for each query the pieces that can be nearest, until they hold k rows; the k-th
    angle found bounds what a second pass has to read: pieces whose least possible angle is not larger, which tasks find out from the query and that angle. Each pass is one scan of the cells concerned, by blocked
    products, for all queries of a block; a task keeps k rows of a batch for each query. ``rows_compared`` counts pairs of query and row, ``rows_scanned`` the rows of the pieces that any query of a block wants, ``rows_in_index`` what a scan compares each query with.

    Query vectors that are null, empty, zero or not finite find nothing; those of another length are an error. ``query`` numbers are whole and differ. An index or table without rows gives no rows.
    """
    out, read = [], {"rows_compared": 0, "rows_scanned": 0, "rows_in_index": int(index.pieces["n"].sum())}
    asked = _usable(queries.select(F.col(query).cast("long").alias("query"), F.col(vector).alias("vector")), "vector")
    blocks = max(1, -(-asked.count() // QUERIES))
    for b in range(blocks if len(index.pieces) else 0):
        block = asked.filter(F.pmod(F.xxhash64("query"), F.lit(blocks)) == b).toArrow()
        if not block.num_rows:
            continue
        number, units = block.column("query").to_numpy(), _normal(np.array(block.column("vector").to_pylist(), float))
        n, named = index.pieces["n"], {}
        chunks = [slice(low, low + CHUNK) for low in range(0, len(number), CHUNK)]
        for chunk in chunks:
            bound, away = index.bounds(units[chunk])
            order = np.lexsort((away, bound), axis=1)
            enough = np.cumsum(n[order], 1)
            chosen, place = np.nonzero(np.concatenate([np.zeros((len(bound), 1), int), enough[:, :-1]], 1) < k)
            for query_at, p in zip(chosen.tolist(), order[chosen, place].tolist()):
                named.setdefault(p, []).append(chunk.start + query_at)
        named = {p: np.array(x) for p, x in named.items()}
        firsts = np.array(sorted(named))
        found = _best(_read(index, asked, number, units, np.unique(index.pieces["cell"][firsts]), k, named=named), index.key, k)
        held = {x.query: x for x in found.groupBy("query").agg(F.min("cosine").alias("least"), F.count(F.lit(1)).alias("n")).collect()}
        reach = np.array([np.arccos(np.clip(held[q].least, -1, 1)) if q in held and held[q].n >= k else np.pi for q in number.tolist()])
        wanted = np.zeros(len(n), bool)
        for chunk in chunks:
            second = index.bounds(units[chunk])[0] <= reach[chunk][:, None] + SLACK
            wanted |= second.any(0)
            read["rows_compared"] += int((second * n).sum())
        out.append(_read(index, asked, number, units, np.unique(index.pieces["cell"][wanted]), k, reach=reach))
        read["rows_compared"] += sum(int(n[p]) * len(x) for p, x in named.items())
        read["rows_scanned"] += int(n[firsts].sum() + n[wanted].sum())
    every = reduce(DataFrame.unionByName, out) if out else queries.sparkSession.createDataFrame([], "query long").crossJoin(index.rows.select(index.key).limit(0)).withColumn("cosine", F.lit(0.0))
    ranked = _best(every, index.key, k)
    return ranked.withColumnRenamed("query", query), read


def _best(found: DataFrame, key: str, k: int) -> DataFrame:
    place = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("cosine"), key))  # of k rows from each batch
    return found.withColumn("rank", place).filter(F.col("rank") <= k)
