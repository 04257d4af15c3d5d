"""Near-duplicate embeddings by spherical-cap filters: random product codes, decoded to all filter directions that a vector exceeds."""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from talentloom.llm import textbytes
from talentloom.llm.components import components
from talentloom.llm.cuts import checked, cut

THRESHOLD = 0.95
#: Pairs at exactly the threshold, made up at random, on which codes are added until so many of them share a filter.
PAIRS, RECALL, MOST_CODES = 3000, 0.998, 63
#: Directions that a code would list for a vector if they were independent; bounds of a cap's height, in standard deviations of a random score and as a cosine.
LISTED, HIGHEST, NARROWEST = 3, 5.0, 0.625
#: Rows that a unit of verification has of one side, at most; rows of a verifying task, about; representatives that are broadcast.
BLOCK, TASK_ROWS, REPRESENTATIVES = 1024, 20_000, 20_000
#: Vectors that are decoded at once.
BATCH = 2048


class ProductCode:
    """A random rotation, and for each block of coordinates some random unit words: a direction takes one word of each block."""

    def __init__(self, d: int, blocks: int, size: int, seed: int):
        rng = np.random.default_rng([seed, d])
        self.rotation = np.linalg.qr(rng.normal(size=(d, d)))[0]
        self.parts, self.words = np.array_split(np.arange(d), blocks), []
        for part in self.parts:
            words = rng.normal(size=(size, len(part)))
            self.words.append(words / np.linalg.norm(words, axis=1, keepdims=True) / np.sqrt(blocks))

    def decode(self, units: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray]:
        """Row and number of every direction whose product with a unit vector is ``least`` or more.

        Lists grow block by block; a beginning is dropped as soon as the best words of the other blocks can't lift it to ``least``.
        """
        turned = units @ self.rotation
        scores = [turned[:, part] @ words.T for part, words in zip(self.parts, self.words)]
        best = [s.max(1) for s in scores]
        every = sum(best)
        row, code, total, tail = np.arange(len(units)), np.zeros(len(units), np.int64), np.zeros(len(units)), every
        for s, top in zip(scores, best):
            tail = tail - top
            of, word = np.nonzero(s >= (least - every + top)[:, None])  # others can't be part of any direction
            score = s[of, word]
            order = np.lexsort((-score, of))
            of, word, score = of[order], word[order], score[order]
            first = np.searchsorted(of, row)
            # rows apart by more than scores ever are, so that one search finds each row's own bound
            n = np.maximum(np.searchsorted(4.0 * of - score, 4.0 * row - (least - total - tail[row]), "right") - first, 0)
            pick = np.repeat(first - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
            row, total, code = np.repeat(row, n), np.repeat(total, n) + score[pick], np.repeat(code, n) * s.shape[1] + word[pick]
        return row, code


def _height(d: int, share: float) -> float:
    """The cosine that this share of random directions exceeds, within the bounds of a cap."""
    x = np.linspace(-1, 1, 20_001)
    weight = np.maximum(1 - x * x, 1e-12) ** ((d - 3) / 2)
    above = np.cumsum(weight[::-1])[::-1] / weight.sum()
    return float(min(x[min(int(np.searchsorted(-above, -share)), len(x) - 1)], HIGHEST / np.sqrt(d), NARROWEST))


@cache
def filters_of(d: int, power: int, threshold: float = THRESHOLD) -> tuple[list[ProductCode], float]:
    """Codes, and the height of their caps, for about 2 ** power vectors of d components.

    Caps are so high that a vector shares a filter with few others by chance. Codes, each with a rotation of its own, are added until random pairs at the threshold share a filter often enough.
    All of it follows from fixed seeds.
    """
    height = _height(d, 0.2 / 2**power)
    x = np.linspace(-1, 1, 20_001)
    weight = np.maximum(1 - x * x, 1e-12) ** ((d - 3) / 2)
    share = weight[x >= height].sum() / weight.sum()
    blocks = 1 if d < 8 else 2
    size = int(np.ceil((LISTED / share) ** (1 / blocks)))
    rng = np.random.default_rng([d, power])
    u, v = rng.normal(size=(2, PAIRS, d))
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    v -= (u * v).sum(1, keepdims=True) * u
    v = threshold * u + np.sqrt(1 - threshold**2) * v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-300)
    codes, met = [], np.zeros(PAIRS, bool)
    while met.mean() < RECALL and len(codes) < MOST_CODES:
        codes.append(ProductCode(d, blocks, size, len(codes)))
        a, b = (row * (size**blocks) + code for row, code in (codes[-1].decode(w / np.linalg.norm(w, axis=1, keepdims=True), height) for w in (u, v)))
        met[np.intersect1d(a, b) // size**blocks] = True
    return codes, height


def _units(rows: list[bytes], kind: str) -> np.ndarray:
    """Unit vectors, in double precision, of packed vectors of one length."""
    x = np.frombuffer(b"".join(rows), kind).reshape(len(rows), -1).astype(np.float64)
    x /= np.abs(x).max(1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _decoded(numbered: DataFrame, kind: str, power: int) -> DataFrame:
    """``row, vector, filters``: packed vectors and the filters that each exceeds; a filter's number holds the vectors' length and the code's number too."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for low in range(0, whole.num_rows, BATCH):
                batch = whole.slice(low, BATCH)
                rows = [np.array(x, kind).tobytes() for x in batch.column("vector").to_pylist()]
                found = [[] for _ in rows]
                by_size: dict[int, list[int]] = {}
                for i, x in enumerate(rows):
                    by_size.setdefault(len(x) // np.dtype(kind).itemsize, []).append(i)
                for d, some in by_size.items():
                    codes, height = filters_of(d, power)
                    units = _units([rows[i] for i in some], kind)
                    for k, c in enumerate(codes):
                        row, code = c.decode(units, height)
                        code = code | (k << 40) | (d << 46)
                        for i, own in zip(some, np.split(code, np.searchsorted(row, np.arange(1, len(some))))):
                            found[i].append(own)
                filters = [np.sort(np.concatenate(x)) for x in found]
                yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(rows, pa.binary()), pa.array(filters, pa.list_(pa.int64()))], names=["row", "vector", "filters"])

    return numbered.select("row", "vector").mapInArrow(textbytes.of_batches(run), "row long, vector binary, filters array<long>")


def _balls(met: DataFrame, kind: str) -> DataFrame:
    """``row, ball``: of the vectors in crowded filters those so near one of them, ``ball``, that all of these link with each other.

    Two vectors within half the threshold's angle of a third are within the whole angle of each other, so their links are known without a comparison.
    """
    near = np.sqrt((1 + THRESHOLD) / 2) + 1e-9
    crowded = met.withColumn("main", F.array_max(F.transform("sizes", lambda s: F.struct(s["n"], -s["filter"])))).filter(F.col("main.n") > BLOCK).select("row", "vector", "main")
    reps = cut(crowded.groupBy("main").agg(F.min_by(F.struct("row", "vector"), F.xxhash64("row")).alias("rep")).select("main", F.col("rep.row").alias("ball"), F.col("rep.vector").alias("centre")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for low in range(0, batch.num_rows, BATCH):
                part = batch.slice(low, BATCH)
                # a filter's number holds the vectors' length, so both sides have one
                size = np.array([len(x) for x in part.column("vector").to_pylist()])
                mask = np.zeros(len(size), bool)
                for s in np.unique(size).tolist():
                    own = np.flatnonzero(size == s)
                    a, b = (_units(part.column(c).take(pa.array(own)).to_pylist(), kind) for c in ("vector", "centre"))
                    mask[own] = np.einsum("ij,ij->i", a, b) >= near
                keep.append(mask)
            kept = batch.select(["row", "ball"]).filter(pa.array(np.concatenate(keep))) if keep else batch.select(["row", "ball"])
            yield kept

    return crowded.join(checked(reps, REPRESENTATIVES), "main").select("row", "vector", "ball", "centre").mapInArrow(textbytes.of_batches(run), "row long, ball long")


def _units_of_work(met: DataFrame) -> DataFrame:
    """``row, filter, block, low, high``: each vector with the blocks of its filters that it is compared with.

    A filter of at most ``BLOCK`` vectors is one block. A larger one is parted by ball, and every ball, and what lies in none, in blocks of that size; blocks of one ball never meet.
    """
    hits = met.select("row", "ball", F.inline("sizes"))
    large = hits.filter(F.col("n") > BLOCK).groupBy("filter", "ball").agg(F.count(F.lit(1)).alias("n"))
    large = large.groupBy("filter").agg(F.array_sort(F.collect_list(F.struct(F.coalesce("ball", F.lit(-1)).alias("ball"), F.ceil(F.col("n") / BLOCK).cast("int").alias("parts")))).alias("balls"))
    before = F.transform("balls", lambda b, i: F.struct(b["ball"], b["parts"], F.aggregate(F.slice("balls", 1, i), F.lit(0), lambda a, x: a + x["parts"]).alias("first")))
    large = cut(large.filter((F.size("balls") > 1) | (F.get("balls", F.lit(0))["ball"] == -1)).withColumn("balls", before))
    small = hits.filter(F.col("n") <= BLOCK).select("row", "filter", F.lit(0).alias("block"), F.lit(0).alias("low"), F.lit(0).alias("high"))
    mine = F.coalesce("ball", F.lit(-1))
    own = F.get(F.filter("balls", lambda b: b["ball"] == mine), F.lit(0))
    parted = hits.filter(F.col("n") > BLOCK).join(checked(large), "filter").withColumn("block", (own["first"] + F.pmod(F.xxhash64("row", "filter"), own["parts"])).cast("int"))
    others = F.filter("balls", lambda b: (b["ball"] != mine) | (b["ball"] == -1))
    with_ = F.flatten(F.transform(others, lambda b: F.sequence(b["first"], b["first"] + b["parts"] - 1)))
    parted = parted.select("row", "filter", "block", F.explode(with_).alias("other")).select("row", "filter", "block", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"))
    return small.unionByName(parted)


def _shared_before(filters: list[np.ndarray], bound: int) -> np.ndarray:
    """For each two rows whether both exceed a filter whose number is below ``bound``."""
    n = len(filters)
    every = np.concatenate(filters)
    owner = np.repeat(np.arange(n), [len(x) for x in filters])
    owner, every = owner[every < bound], every[every < bound]
    number, times = np.unique(every, return_inverse=True, return_counts=True)[1:]
    some = times[number] > 1
    owner, number = owner[some], np.unique(number[some], return_inverse=True)[1]
    shared = np.zeros((n, n), bool)
    for low in range(0, int(number.max(initial=-1)) + 1, BLOCK):
        part = (number >= low) & (number < low + BLOCK)
        has = np.zeros((n, BLOCK), np.float32)
        has[owner[part], number[part] - low] = 1
        shared |= has @ has.T > 0
    return shared


def _verified(work: DataFrame, met: DataFrame, kind: str) -> DataFrame:
    """``row, n_links, root``: links that a task has found for a vector, and the least row that they connect it with there.

    A pair counts in the first filter that its vectors share, so nowhere twice. Pairs are counted as they are found and never sent.
    """
    rows = work.count()
    task = F.pmod(F.xxhash64("filter", "low", "high"), F.lit(max(1, -(-rows // TASK_ROWS))))
    full = work.join(met.select("row", "vector", "ball", F.transform("sizes", lambda s: s["filter"]).alias("filters")), "row").withColumn("task", task).drop("n")

    def run(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        keys = np.column_stack([table.column(c).to_numpy() for c in ("high", "low", "filter")])
        order = np.lexsort(keys.T)
        row, block = table.column("row").to_numpy(), table.column("block").to_numpy()
        ball = table.column("ball").fill_null(-1).to_numpy()
        filters = table.column("filters")
        start = np.flatnonzero(np.concatenate(([True], (keys[order][1:] != keys[order][:-1]).any(1))))
        known, one, number = np.unique(row, return_index=True, return_inverse=True)
        stored = table.column("vector").take(pa.array(one)).to_pylist()
        length, units, place = np.array([len(x) for x in stored]), {}, np.zeros(len(stored), np.int64)
        for d in np.unique(length).tolist():
            own = np.flatnonzero(length == d)
            units[d], place[own] = _units([stored[i] for i in own], kind), np.arange(len(own))
        count, root = np.zeros(len(known), np.int64), np.arange(len(known))

        def find(i: int) -> int:
            while root[i] != i:
                root[i] = root[root[i]]
                i = int(root[i])
            return i

        def settle(at: np.ndarray, open_: np.ndarray) -> None:
            """Counts and connects the near pairs of one unit's rows that no earlier unit has."""
            low, high, f = keys[at[0], 1], keys[at[0], 0], keys[at[0], 2]
            np.fill_diagonal(open_, False)
            own = ball[at]
            open_ &= (own[:, None] != own[None]) | (own == -1)[:, None]
            if low != high:
                open_ &= block[at][:, None] != block[at][None]
            some = np.flatnonzero(open_.any(1))
            if not len(some):
                return
            at, open_ = at[some], open_[np.ix_(some, some)]
            open_ &= ~_shared_before([np.array(x, np.int64) for x in filters.take(pa.array(at)).to_pylist()], f)
            count[number[at]] += open_.sum(1)  # a row is in a unit once
            left = open_.any(1)
            while left.any():  # each connected part once: from a row to all that it reaches
                reached, edge = np.zeros(len(at), bool), np.zeros(len(at), bool)
                edge[np.argmax(left)] = True
                while edge.any():
                    reached |= edge
                    edge = open_[edge].any(0) & ~reached
                left &= ~reached
                roots = [find(int(x)) for x in np.unique(number[at[reached]])]
                root[roots] = min(roots)

        size = np.diff(np.append(start, len(order)))
        for n in np.unique(size[size > 1]).tolist():  # units of one size are multiplied at once
            every = start[size == n]
            step = max(1, TASK_ROWS // (n * n))
            for k in range(0, len(every), step):
                at = order[every[k : k + step, None] + np.arange(n)]
                lengths = length[number[at[:, 0]]]
                for d in np.unique(lengths).tolist():
                    own = at[lengths == d]
                    x = units[d][place[number[own]]]
                    near = x @ x.transpose(0, 2, 1) >= THRESHOLD
                    for i in np.flatnonzero(near.sum((1, 2)) > n).tolist():
                        settle(own[i], near[i])
        root = np.array([find(i) for i in range(len(known))])
        some = count > 0
        return pa.Table.from_arrays([pa.array(known[some]), pa.array(count[some]), pa.array(known[root[some]])], names=["row", "n_links", "root"])

    return full.groupBy("task").applyInArrow(textbytes.of_group(run), "row long, n_links long, root long")


def near_vectors(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """``vec_id, n_links, component_id, kept`` for every vector: the others that it links with at a cosine of 0.95 or more, and the smallest id that it reaches by links.

    Every vector is decoded to all directions of some random product codes that it exceeds. Vectors meet at the filters they share; filters of a single vector drop out before any vector
    travels. Each pair that shares a filter is compared in double precision, once. Of random pairs at the threshold 998 in 1000 share a filter, of nearer ones more; so a link may be missed, and none is made up.

    Where more than ``BLOCK`` vectors share a filter, those within half the threshold's angle of one of them are a ball: all of them link with each other, which is counted and not compared.
    What is not in one ball is compared in blocks. So a large group of near copies costs what its size is, not the square. Links are counted in the tasks; components are found by star steps.

    Vectors that are null, empty or zero, or that hold null, NaN or infinite components, link with nothing; vectors of different length never link. ``kept`` says whether a vector has its component's
    smallest id. A null id is smallest only where there is no other in its component. Rows that share an id count as different vectors, and stay or go together. No vectors give no rows. Other columns are left out.
    """
    kind = "<f4" if vectors.schema[vector_col].dataType.elementType.simpleString() == "float" else "<f8"
    numbered = cut(vectors.select(F.col(id_col).alias("vec_id"), F.col(vector_col).alias("vector")).withColumn("row", F.monotonically_increasing_id()))
    finite = lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < float("inf"))
    valid = numbered.filter((F.size("vector") > 0) & F.forall("vector", finite) & F.exists("vector", lambda e: e != 0))
    power = max(8, numbered.count().bit_length())
    decoded = cut(_decoded(valid, kind, power))
    hits = decoded.select("row", F.explode("filters").alias("filter"))
    sizes = hits.groupBy("filter").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    shared = cut(hits.join(sizes, "filter").groupBy("row").agg(F.array_sort(F.collect_list(F.struct("filter", "n"))).alias("sizes")))
    met = cut(decoded.select("row", "vector").join(checked(shared), "row"))
    balls = cut(_balls(met, kind))
    met = cut(met.join(checked(balls), "row", "left"))
    found = cut(_verified(cut(_units_of_work(met)), met, kind))
    in_ball = balls.join(checked(cut(balls.groupBy("ball").agg((F.count(F.lit(1)) - 1).alias("n_links")))), "ball")
    counts = found.select("row", "n_links").unionByName(in_ball.select("row", "n_links")).groupBy("row").agg(F.sum("n_links").alias("n_links"))
    roots = components(found.select(F.col("row").alias("u"), F.col("root").alias("v")).unionByName(balls.select(F.col("row").alias("u"), F.col("ball").alias("v"))))
    named = cut(roots.withColumnRenamed("node", "row").join(numbered.select("row", "vec_id"), "row"))
    least = cut(named.groupBy("root").agg(F.min("vec_id").alias("component_id")))
    linked = cut(counts.join(named.select("row", "root"), "row", "left").join(checked(least), "root", "left").select("row", "n_links", F.col("root").isNotNull().alias("joined"), "component_id"))
    component = F.when(F.coalesce("joined", F.lit(False)), F.col("component_id")).otherwise(F.col("vec_id"))
    return numbered.select("row", "vec_id").join(checked(linked), "row", "left").select("vec_id", F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"), component.alias("component_id"), F.col("vec_id").eqNullSafe(component).alias("kept"))


def op12_cap_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


OP12_SQL = f"""
WITH RECURSIVE valid AS (
    SELECT vec_id, embedding::DOUBLE[] AS v, sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])) AS length FROM embeddings
    WHERE len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = len(embedding) AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), pairs AS MATERIALIZED (
    SELECT a.vec_id AS u, b.vec_id AS v FROM valid a JOIN valid b ON a.vec_id <> b.vec_id AND len(a.v) = len(b.v) WHERE list_dot_product(a.v, b.v) / (a.length * b.length) >= {THRESHOLD}
), reached AS (
    SELECT vec_id AS u, vec_id AS v FROM embeddings UNION SELECT r.u, p.v FROM reached r JOIN pairs p ON p.u = r.v
), least AS (
    SELECT u AS vec_id, min(v) AS component_id FROM reached GROUP BY u
), linked AS (
    SELECT u AS vec_id, count(*) AS n_links FROM pairs GROUP BY u
)
SELECT vec_id, coalesce(n_links, 0) AS n_links, component_id, vec_id = component_id AS kept FROM least LEFT JOIN linked USING (vec_id)
"""
