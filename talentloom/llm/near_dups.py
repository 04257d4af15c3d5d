"""N-gram Jaccard join: documents linked by the similarity of their word shingles, by prefix filters under several token orders."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from talentloom.llm import textbytes
from talentloom.llm.components import components
from talentloom.llm.cuts import checked, cut
from talentloom.llm.shards import batch_of, buckets, member, packed, runs, scaled, sharded, text_bytes, unpacked
from talentloom.llm.textbytes import mix

SIZE = 5
#: Bytes of packed tokens that one bucket's task sees, about.
BUCKET_BYTES = 5 << 20
#: Shingles of the sets that one verifying task holds, about, and that one part of a large group holds.
TASK_SHINGLES, PART_SHINGLES = 1_000_000, 400_000
#: Rounds in which the sets of a large cluster are compared with one of them, and rows of such representatives that are broadcast.
ROUNDS, REPRESENTATIVES = 3, 2000
#: Tokens of so many sets, and of one in so many, are frequent among sets that are compared; rows of products made at a time.
OFTEN, OFTEN_SHARE, ROWS = 32, 8, 64
#: Seeds of the further token orders.
ORDERS = (0x2545F4914F6CDD1D, 0x9E6C63D0876A9A47)
#: Stands for the token where a cluster's sets meet as one group; tokens are not negative.
NO_TOKEN = -1

_U = np.uint64


def prefix_length(n: int) -> int:
    """Tokens of a set of n, first in an order, one of which any set of similarity 0.8 has among its own first ones."""
    return n - -(-4 * n // 5) + 1


def counted(shingles: np.ndarray) -> np.ndarray:
    """Whether a token belongs to the half that is counted and precedes the other half in the first order."""
    return (shingles & _U(1)) == 0


def first_prefix(shingles: np.ndarray, tokens: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """48-bit tokens of the prefix under the first order that another set may have too.

    The first order: counted tokens before the others, rare ones before frequent ones, then by hash. ``tokens`` and ``counts``
    (sorted) hold the counted tokens that occur in several sets; the counted ones not there occur in this set only.
    """
    p = prefix_length(len(shingles))
    half = counted(shingles)
    own = shingles[half] >> _U(16)
    here, at = member(own, tokens)
    times = np.where(here, counts[at] if len(counts) else 1, 1)
    chosen = np.lexsort((own, times))[:p]
    out = own[chosen][here[chosen]]
    if len(own) < p:
        out = np.concatenate([out, np.sort(shingles[~half] >> _U(16))[: p - len(own)]])
    return np.unique(out)


def _sets(batch: pa.RecordBatch, secret: tuple) -> Iterator[np.ndarray]:
    for part in textbytes.slices(batch, "text"):
        yield from textbytes.shingle_sets(*textbytes.buffers(part.column("text")), SIZE, secret)


def _token_counts(texts: DataFrame, n: int, secret: tuple) -> DataFrame:
    """``shard, tokens, counts``: the counted tokens of a shard that occur in more than one set, with the number of sets."""

    def gather(table: pa.Table) -> pa.Table:
        seen, parts = set(), []
        for s in _sets(batch_of(table), secret):
            if len(s) and (key := hashlib.blake2b(s.tobytes(), digest_size=16).digest()) not in seen:
                seen.add(key)
                parts.append(s[counted(s)] >> _U(16))
        tokens, counts = np.unique(np.concatenate(parts) if parts else np.zeros(0, np.uint64), return_counts=True)
        shard, out, b = table.column("shard")[0].as_py(), [], buckets(tokens, n)
        starts = runs(b)
        for a, z in zip(starts, np.append(starts[1:], len(b))):
            out.append((int(b[a]), shard, packed(tokens[a:z]), np.minimum(counts[a:z], 65535).astype("<u2").tobytes()))
        return pa.Table.from_arrays([pa.array(x, t) for x, t in zip(zip(*out) if out else [()] * 4, (pa.int32(), pa.int32(), pa.binary(), pa.binary()))], names=["bucket", "shard", "tokens", "counts"])

    def meet(table: pa.Table) -> pa.Table:
        parts = [unpacked(x.as_py()) for x in table.column("tokens")]
        tokens, counts = np.concatenate(parts), np.frombuffer(b"".join(x.as_py() for x in table.column("counts")), "<u2").astype(np.int64)
        order = np.argsort(tokens, kind="stable")
        first = runs(tokens[order])
        total = np.empty(len(tokens), np.int64)
        total[order] = np.repeat(np.add.reduceat(counts[order], first), np.diff(np.append(first, len(tokens))))
        out, ends = [], np.cumsum([len(x) for x in parts])
        for own, z, shard in zip(parts, ends.tolist(), table.column("shard").to_pylist()):
            n_sets = total[z - len(own) : z]
            if (n_sets > 1).any():
                out.append((shard, packed(own[n_sets > 1]), n_sets[n_sets > 1].astype("<u4").tobytes()))
        return pa.Table.from_arrays([pa.array(x, t) for x, t in zip(zip(*out) if out else [()] * 3, (pa.int32(), pa.binary(), pa.binary()))], names=["shard", "tokens", "counts"])

    return texts.groupBy("shard").applyInArrow(textbytes.of_group(gather), "bucket int, shard int, tokens binary, counts binary").groupBy("bucket").applyInArrow(textbytes.of_group(meet), "shard int, tokens binary, counts binary")


def _prefixes(texts: DataFrame, told: DataFrame, secret: tuple) -> DataFrame:
    """``doc_id, class, n, prefix, shingles``: every document's set as a class of equal sets, its size; the first of a class in its shard with what may link it."""

    def gather(table: pa.Table, known: pa.Table) -> pa.Table:
        tokens = unpacked(b"".join(x.as_py() for x in known.column("tokens")))
        counts = np.frombuffer(b"".join(x.as_py() for x in known.column("counts")), "<u4").astype(np.int64)
        order = np.argsort(tokens, kind="stable")
        tokens, counts = tokens[order], counts[order]
        batch, seen, out = batch_of(table), set(), []
        for s in _sets(batch, secret):
            name = hashlib.blake2b(s.tobytes(), digest_size=16).hexdigest() if len(s) else None
            prefix = None
            if name and name not in seen:
                seen.add(name)
                found = first_prefix(s, tokens, counts)
                prefix = found.astype(np.int64) if len(found) else None
            out.append((name, len(s), prefix, s.tobytes() if prefix is not None else None))
        kinds = (pa.string(), pa.int64(), pa.list_(pa.int64()), pa.binary())
        return pa.Table.from_arrays([batch.column("doc_id"), *(pa.array(x, t) for x, t in zip(zip(*out) if out else [()] * 4, kinds))], names=["doc_id", "class", "n", "prefix", "shingles"])

    kind = texts.schema["doc_id"].dataType.simpleString()
    return texts.groupBy("shard").cogroup(told.groupBy("shard")).applyInArrow(textbytes.of_cogroup(gather), f"doc_id {kind}, class string, n long, prefix array<long>, shingles binary")


class Postings:
    """For each token of some sets the sets that have it. Tokens of many sets are columns of a table of zeros and ones instead; products of its rows count them."""

    def __init__(self, sets: list[np.ndarray]):
        self.of = np.concatenate(([0], np.cumsum([len(x) for x in sets])))
        every = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
        owner = np.repeat(np.arange(len(sets)), np.diff(self.of))
        order = np.argsort(every, kind="stable")
        starts = runs(every[order])
        length = np.diff(np.append(starts, len(every)))
        often = (length >= OFTEN) & (OFTEN_SHARE * length >= len(sets))
        self.table, self.block, self.products = None, -1, None
        if often.any():
            hot = np.repeat(often, length)
            self.table = np.zeros((len(sets), int(often.sum())), np.float32)
            self.table[owner[order[hot]], np.repeat(np.cumsum(often) - 1, length)[hot]] = 1
            rare = np.ones(len(every), bool)
            rare[order[hot]] = False
            self.of = np.concatenate(([0], np.cumsum(rare)))[self.of]
            order = np.cumsum(rare)[order[~hot]] - 1
            owner, length = owner[rare], length[~often]
            starts = np.cumsum(length) - length
        self.owners = owner[order]
        self.low = np.empty(len(owner), np.int64)
        self.size = np.empty(len(owner), np.int64)
        self.low[order], self.size[order] = np.repeat(starts, length), np.repeat(length, length)

    def counts(self, i: int, n: int) -> np.ndarray:
        """How many tokens of set i each of the n sets has."""
        own = slice(self.of[i], self.of[i + 1])
        low, size = self.low[own], self.size[own]
        at = np.repeat(low - np.concatenate(([0], np.cumsum(size)[:-1])), size) + np.arange(int(size.sum()))
        found = np.bincount(self.owners[at], minlength=n)
        return found if self.table is None else found + self._often(i)

    def _often(self, i: int) -> np.ndarray:
        """How many of the frequent tokens of set i each set has; products are made for ``ROWS`` sets at a time, when one of them is asked for."""
        block = i // ROWS
        if block != self.block:
            self.block, self.products = block, self.table[block * ROWS : (block + 1) * ROWS] @ self.table.T
        return self.products[i - block * ROWS].astype(np.int64)


def linked(sets: list[np.ndarray], side: np.ndarray | None = None, groups: np.ndarray | None = None) -> list[tuple[int, int]]:
    """Links (set, least set of its group) that connect whatever the similar pairs among the sets connect.

    A pair is a candidate if it shares prefix tokens under each further order too; only candidates from different groups
    so far are verified, by the exact overlap. ``side``: only pairs of sets from different sides count. ``groups``: what is connected already.
    """
    n = len(sets)
    size = np.array([len(x) for x in sets])
    filters = [Postings([np.sort(mix(x ^ _U(seed)))[: prefix_length(len(x))] for x in sets]) for seed in ORDERS]
    whole = Postings(sets)
    root = np.arange(n)
    if groups is not None and n:
        _, first, which = np.unique(groups, return_index=True, return_inverse=True)
        root = first[which]
    for i in range(n - 1):
        open_ = root != root[i]
        open_[: i + 1] = False
        if side is not None:
            open_ &= side != side[i]
        open_ &= (5 * size >= 4 * size[i]) & (5 * size[i] >= 4 * size)
        for f in filters:
            if not open_.any():
                break
            open_ &= f.counts(i, n) > 0
        if open_.any():
            both = whole.counts(i, n)
            similar = np.flatnonzero(open_ & (100 * both >= 80 * (size + size[i] - both)))
            if len(similar):
                met = np.unique(np.append(root[similar], root[i]))
                root[np.isin(root, met)] = met[0]
    return [(i, int(r)) for i, r in enumerate(root) if r != i]


def _represented(large: DataFrame, nodes: DataFrame) -> DataFrame:
    """``class, label`` for the sets of large clusters: the representative that a set is similar to, itself where there is none.

    In each round one set of each cluster, chosen by a hash among those without a label, is compared with all others without one: linear in the cluster, and
    near copies of one text are all settled by it.
    """
    open_, found = cut(large.select("class", "cluster").join(nodes.select("class", "n", "shingles"), "class")), []

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            stored, theirs, reps = (batch.column(c) for c in ("shingles", "rep_shingles", "rep"))
            label = []
            for i in range(batch.num_rows):
                a, b = (np.frombuffer(x[i].as_py(), np.uint64) for x in (stored, theirs))
                both = int(member(a, b)[0].sum())
                label.append(reps[i].as_py() if 100 * both >= 80 * (len(a) + len(b) - both) else None)
            left = pa.array([None if x else y.as_py() for x, y in zip(label, stored)], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column("class"), batch.column("cluster"), batch.column("n"), left, pa.array(label, pa.string())], names=["class", "cluster", "n", "shingles", "label"])

    for k in range(ROUNDS):
        chosen = open_.groupBy("cluster").agg(F.min_by("class", F.xxhash64("class", F.lit(k))).alias("rep"))
        chosen = cut(chosen.join(nodes.select(F.col("class").alias("rep"), F.col("shingles").alias("rep_shingles")), "rep"))
        joined = open_.join(checked(chosen, REPRESENTATIVES), "cluster").select("class", "cluster", "n", "shingles", "rep", "rep_shingles")
        judged = cut(joined.mapInArrow(textbytes.of_batches(compare), "class string, cluster string, n long, shingles binary, label string"))
        found.append(judged.filter("label IS NOT NULL").select("class", "label"))
        open_ = judged.filter("label IS NULL").drop("label")
    return cut(reduce(DataFrame.unionByName, [*found, open_.select("class", F.col("class").alias("label"))]))


def _parted(shared: DataFrame, large: DataFrame, labels: DataFrame) -> DataFrame:
    """``class, label, token, cluster, part, low, high``: the sets of large clusters by token, in parts of which each pair is a task's work.

    Tokens whose sets all have one label are done. Where the others would send a cluster's sets more often than its parts meet (families of texts with the same tokens), its sets meet as one
    group, in place of a group for each token. Of a group's sets those of the most common label are parted by themselves and meet only parts of the rest.
    """
    parts = lambda w: F.ceil(w / PART_SHINGLES).cast("int")
    own = cut(shared.select("class", "n", "token").join(labels, "class").join(large, "class"))
    open_ = cut(own.groupBy("cluster", "whole", "token").agg(F.sum("n").alias("w"), F.min("label").alias("a"), F.max("label").alias("b")).filter("a <> b").select("cluster", "whole", "token", "w"))
    at_once = cut(open_.groupBy("cluster", "whole").agg(F.sum(F.col("w") * parts(F.col("w"))).alias("sent")).filter(F.col("whole") * parts(F.col("whole")) <= F.col("sent")).select("cluster", F.lit(True).alias("at_once")))
    own = own.join(checked(open_.select("cluster", "token")), ["cluster", "token"]).join(checked(at_once), "cluster", "left").withColumn("token", F.when(F.col("at_once"), NO_TOKEN).otherwise(F.col("token")))
    own = cut(own.select("class", "n", "label", "cluster", "token").distinct())
    by_label = own.groupBy("cluster", "token", "label").agg(F.sum("n").alias("w"))
    tokens = by_label.groupBy("cluster", "token").agg(F.max_by("label", F.struct("w", "label")).alias("major"), F.sum("w").alias("all"), F.max("w").alias("most"))
    some = F.col("all") > PART_SHINGLES
    tokens = cut(tokens.select("cluster", "token", F.when(some, F.col("major")).alias("major"), F.when(some, parts(F.col("most"))).otherwise(0).alias("common"), F.when(some, parts(F.col("all") - F.col("most"))).otherwise(1).alias("rest")))
    rows = own.join(checked(tokens), ["cluster", "token"]).withColumn("is_common", F.col("label").eqNullSafe(F.col("major")))
    deal = lambda k: F.pmod(F.xxhash64("class", "token"), F.greatest(F.lit(1), k)).cast("int")
    part = F.when(F.col("is_common"), deal(F.col("common"))).otherwise(F.col("common") + deal(F.col("rest")))
    rows = rows.withColumn("part", part)
    with_ = F.sequence(F.when(F.col("is_common"), F.col("common")).otherwise(0), F.col("common") + F.col("rest") - 1)
    pairs = F.transform(with_, lambda j: F.struct(F.least(F.col("part"), j).alias("low"), F.greatest(F.col("part"), j).alias("high")))
    return rows.select("class", "label", "token", "cluster", "part", F.inline(pairs))


def _links(nodes: DataFrame) -> DataFrame:
    """``u, v``: links between classes, enough to connect what similar pairs connect.

    Classes meet at the tokens of their prefixes; tokens with the same classes count once. What hangs together by such tokens is a cluster, which
    travels to one task, each set once, if it has at most ``TASK_SHINGLES``. The sets of a larger cluster are compared with a few representatives
    first; what that leaves open is verified token by token, or at once where that sends less, and part by part where either has more shingles than ``PART_SHINGLES``.
    """
    met = nodes.select("class", "n", F.explode("prefix").alias("token"))
    groups = met.groupBy("token").agg(F.count(F.lit(1)).alias("classes"), F.min("class").alias("hub"), F.bit_xor(F.xxhash64("class")).alias("x"), F.bit_xor(F.xxhash64("class", F.lit(7))).alias("y")).filter("classes > 1")
    groups = cut(groups.groupBy("classes", "hub", "x", "y").agg(F.min("token").alias("token")).select("token", "hub"))
    shared = cut(met.join(checked(groups), "token"))
    cluster = components(shared.select(F.col("class").alias("u"), F.col("hub").alias("v"))).select(F.col("node").alias("class"), F.col("root").alias("cluster"))
    sizes = cut(cluster.join(nodes.select("class", "n"), "class").groupBy("cluster").agg(F.sum("n").alias("whole")))
    placed = cut(cluster.join(sizes, "cluster"))
    whole = placed.filter(F.col("whole") <= TASK_SHINGLES).select("class", F.lit(None).cast("string").alias("label"), F.lit(0).cast("long").alias("token"), "cluster", F.lit(0).alias("part"), F.lit(0).alias("low"), F.lit(0).alias("high"))
    large = placed.filter(F.col("whole") > TASK_SHINGLES).select("class", "cluster", "whole")
    links, work = None, whole
    if large.limit(1).count():
        labels = _represented(large, nodes)
        links = labels.filter(F.col("class") != F.col("label")).select(F.col("class").alias("u"), F.col("label").alias("v"))
        work = cut(whole.unionByName(_parted(shared, large, labels)))
    total = work.join(nodes.select("class", "n"), "class").agg(F.sum("n")).first()[0] or 0
    task = F.pmod(F.xxhash64("token", "low", "high", "cluster"), F.lit(max(1, -(-2 * total // TASK_SHINGLES))))
    work = work.join(nodes.select("class", "shingles"), "class").withColumn("key", F.xxhash64("cluster")).withColumn("task", task)

    def verify(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        keys = np.column_stack([table.column(c).to_numpy() for c in ("key", "token", "low", "high")])
        labels, classes, part, stored = table.column("label").to_pylist(), table.column("class").to_pylist(), table.column("part").to_numpy(), table.column("shingles")
        order = np.lexsort(keys.T)
        new = np.flatnonzero(np.concatenate(([True], (keys[order][1:] != keys[order][:-1]).any(1))))
        out = []
        for a, z in zip(new, np.append(new[1:], len(order))):
            rows = order[a:z]
            sets = [np.frombuffer(stored[int(i)].as_py(), np.uint64) for i in rows]
            side = part[rows] if keys[rows[0], 2] != keys[rows[0], 3] else None
            groups = np.array([labels[i] for i in rows]) if labels[rows[0]] else None
            out += [(classes[rows[i]], classes[rows[j]]) for i, j in linked(sets, side, groups)]
        return pa.Table.from_arrays([pa.array(x, pa.string()) for x in (zip(*out) if out else ((), ()))], names=["u", "v"])

    verified = work.groupBy("task").applyInArrow(textbytes.of_group(verify), "u string, v string")
    return verified if links is None else verified.unionByName(links)


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_shingles, component_id`` for every document: the smallest id that it reaches by links.

    A document's set holds its distinct runs of five words (all its words where it has fewer), A-Z lower-cased; two documents link at a Jaccard
    similarity of 0.8 or more. Texts are dealt out to shards by their id. One exchange of packed tokens counts in how many
    sets half of all tokens occur; that gives the first global order (rare tokens first), under which most documents have no prefix token
    in common with any other and drop out. What is left meets by prefix token; candidates must share prefix tokens under two further
    orders as well, and only pairs that are not connected yet are verified, exactly. Equal sets are one class
    throughout, so copies are never compared. No group is capped; components are found by distributed star steps.
    Shingles are 64-bit hashes out of numbers drawn for each run: nobody can write texts whose shingles collide, and by chance two of a pair of texts with
    100,000 shingles each do once in two thousand million pairs, which changes their overlap by one.

    Null texts, and texts without words, have no shingles and link with nothing. A null id is no candidate for
    ``component_id`` (null where a component has no other). Rows that repeat an id are kept. A text of any length is one set, in one task's
    memory. No rows give no rows. Other columns are left out.
    """
    texts = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    total = text_bytes(texts)
    own = sharded(texts, total)
    secret = textbytes.drawn()
    found = cut(_prefixes(own, _token_counts(own, max(8, -(-total // scaled(2 * BUCKET_BYTES, total))), secret), secret))
    nodes = cut(found.filter("prefix IS NOT NULL").select("class", "n", "prefix", "shingles").dropDuplicates(["class"]))
    roots = components(_links(nodes))
    ids = found.filter("class IS NOT NULL").groupBy("class").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("docs"))
    ids = ids.join(roots.withColumnRenamed("node", "class"), "class", "left").filter("docs > 1 OR root IS NOT NULL").withColumn("root", F.coalesce("root", "class"))
    ids = cut(ids.select("class", "root", "least"))
    named = ids.select("class", "root").join(ids.groupBy("root").agg(F.min("least").alias("component_id")), "root").select("class", "component_id", F.lit(True).alias("joined"))
    return found.select("doc_id", "class", "n").join(named, "class", "left").select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("joined"), F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))


def op7_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
