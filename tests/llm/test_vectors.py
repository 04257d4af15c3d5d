import numpy as np
import pytest

from talentloom.llm import cap_filters, filter_audit, sort_means
from talentloom.llm.sort_means import Centroids

NAN, INF = float("nan"), float("inf")


def brute_links(rows):
    """vec_id -> links and smallest id reached, for distinct ids."""
    units = {}
    for i, v in rows:
        if v and all(x is not None and np.isfinite(x) for x in v) and any(v):
            units[i] = np.array(v, np.float32).astype(float)
    cos = lambda a, b: len(a) == len(b) and a @ b / np.sqrt((a @ a) * (b @ b)) >= 0.95
    near = {i: [j for j in units if j != i and cos(units[i], units[j])] for i in units}
    out = {}
    for i, _ in rows:
        reached, edge = {i}, [i]
        while edge:
            edge = [j for x in edge for j in near.get(x, []) if j not in reached]
            reached |= set(edge)
        out[i] = (len(near.get(i, [])), min(reached), min(reached) == i)
    return out


def planted(n=300, d=64, seed=3):
    """Random vectors, groups of near copies from two to many, chains whose ends don't link, and vectors that can't link."""
    rng = np.random.default_rng(seed)
    rows = [rng.normal(size=d) for _ in range(n)]
    for size, noise in ((2, 0.02), (60, 0.01), (40, 0.02), (25, 0.035)):
        c = rng.normal(size=d)
        c /= np.linalg.norm(c)
        rows += [c + noise * rng.normal(size=d) for _ in range(size)]
    a, b = np.linalg.qr(rng.normal(size=(d, 2)))[0].T
    rows += [np.cos(t) * a + np.sin(t) * b for t in np.arange(0, 1.5, 0.2)]
    rows = [r.tolist() for r in rows] + [(5 * np.array(rows[0])).tolist(), None, [0.0] * d, [NAN] * d, [None] + [1.0] * (d - 1), [INF] + [0.0] * (d - 1), [], [1.0, 2.0], [2.0, 4.0], [3.0], [4.0], [-4.0]]
    return [(i * 7 % len(rows), r) for i, r in enumerate(rows)]


@pytest.mark.parametrize("block", [cap_filters.BLOCK, 8])
def test_links(spark, monkeypatch, block):
    monkeypatch.setattr(cap_filters, "BLOCK", block)  # balls and parted filters
    rows = planted()
    df = spark.createDataFrame([(i, v, i, "x") for i, v in rows], "vec_id long, embedding array<float>, row long, filter string").repartition(5)
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in cap_filters.near_vectors(df).collect()}
    assert got == brute_links(rows)


def test_balls_are_used(spark, monkeypatch):
    """Large groups of near copies are settled without comparing their members: the work does not hold their pairs of blocks."""
    monkeypatch.setattr(cap_filters, "BLOCK", 8)
    work = []
    verified = cap_filters._verified
    monkeypatch.setattr(cap_filters, "_verified", lambda w, *a: (work.append(w), verified(w, *a))[1])
    rng = np.random.default_rng(5)
    c = rng.normal(size=64)
    rows = [(i, (c + 0.02 * rng.normal(size=64)).tolist()) for i in range(400)]
    got = cap_filters.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    assert {(r.n_links, r.component_id) for r in got} == {(399, 0)}
    most = work[0].groupBy("row").count().agg({"count": "max"}).first()[0]
    assert most <= 3 * 63 + 50  # small filters, and the rest of large ones; 400 rows in blocks of 8 would be 50 blocks in each of some 30 filters


def test_odd_vector_rows(spark):
    rows = [(None, [1.0, 0.0]), (5, [2.0, 0.01]), (5, [2.0, 0.02]), (9, [0.0, 1.0]), (None, [0.0, -1.0])]
    got = sorted(((r.vec_id is None, r.vec_id or 0), r.n_links, r.component_id, r.kept) for r in cap_filters.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect())
    assert got[:3] == [((False, 5), 2, 5, True), ((False, 5), 2, 5, True), ((False, 9), 0, 9, True)]
    assert sorted(x[1:] for x in got[3:] if x[1]) == [(2, 5, False)] and [x[1:] for x in got[3:] if not x[1]] == [(0, None, True)]
    none = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert cap_filters.near_vectors(none).count() == 0 and sort_means.sort_means(none).count() == 0


def test_codes_reach_their_recall():
    codes, height = cap_filters.filters_of(64, 14)
    rng = np.random.default_rng(99)
    u, v = rng.normal(size=(2, 600, 64))
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    v -= (u * v).sum(1, keepdims=True) * u
    v = 0.95 * u + np.sqrt(1 - 0.95**2) * v / np.linalg.norm(v, axis=1, keepdims=True)
    met = np.zeros(600, bool)
    for c in codes:
        lists = [set(zip(*(x.tolist() for x in c.decode(w, height)))) for w in (u, v)]
        met[[r for r, _ in lists[0] & lists[1]]] = True
    assert met.mean() > 0.985


def test_decoding_is_complete():
    code = cap_filters.ProductCode(16, 2, 12, 0)
    rng = np.random.default_rng(1)
    u = rng.normal(size=(50, 16))
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    a, b = (np.zeros((12, 16)) for _ in range(2))
    a[:, :8], b[:, 8:] = code.words
    every = ((a[:, None] + b[None]).reshape(144, 16) @ code.rotation.T @ u.T).T
    want = {(i, k) for i, k in zip(*np.nonzero(every >= 0.3))}
    assert want and set(zip(*(x.tolist() for x in code.decode(u, 0.3)))) == want


def test_nearest_is_exact_with_ties_and_skips():
    rng = np.random.default_rng(0)
    v = rng.integers(-3, 3, (2000, 64))
    v[::3] //= 3
    c = Centroids([*v[:9].tolist(), *v[:3].tolist(), *(v[20:24] * 40).tolist()])  # repeated and far centroids
    d = ((v[:, None] - c.rows[None]) ** 2).sum(2)
    for before in (np.zeros(2000, np.int64), rng.integers(0, 16, 2000)):
        cluster, distance, n = c.nearest(v, before)
        assert (cluster == d.argmin(1)).all() and (distance == d.min(1)).all()
    assert n < 2000 * 16
    assert c.nearest(v, cluster)[2] < n


def test_clusters_of_odd_rows(spark):
    rng = np.random.default_rng(2)
    good = [(i, rng.normal(size=64).tolist()) for i in range(12)]
    rows = [*good, (3, good[3][1]), (None, good[4][1]), (90, None), (91, []), (92, [1.0] * 63), (93, [NAN] + [0.0] * 63), (94, [None] + [0.0] * 63), (95, [INF] + [0.0] * 63)]
    df = spark.createDataFrame([(i, v, 1, 2) for i, v in rows], "vec_id long, embedding array<double>, cluster int, vector int").repartition(3)
    got = sort_means.sort_means(df).collect()
    assert sorted((r.vec_id is None, r.vec_id or 0) for r in got) == sorted((i is None, i or 0) for i, _ in rows[:14])
    assert len({r.cluster for r in got}) == 12 and {r.inertia for r in got} == {0}
    with pytest.raises(Exception, match="beyond"):
        sort_means.sort_means(spark.createDataFrame([(1, [1e9] * 64)], "vec_id long, embedding array<double>")).collect()


def test_audit_of_odd_rows(spark):
    long = " ".join(f"w{k}" for k in range(30_000))
    docs = [(1, None, None), (2, "", None), (3, long, "a"), (4, long, "a"), (4, long, "a"), (None, long, "a"), (5, "x " * 500, "a"), (6, "A# " * 3, "b")]
    df = spark.createDataFrame([(i, t, s, 0, "f") for i, t, s in docs], "doc_id long, text string, source string, own int, failures string")
    labels = spark.createDataFrame([(3, 1, None), (4, 1, 1), (4, 0, 0), (None, 1, 1), (6, None, 1)], "doc_id long, quality int, toxic int")
    got = {(r.part, r.filter_order, r.step): r for r in filter_audit.audit(df, labels).collect()}
    assert len(got) == 3 * 600
    x = got["a", "EABCD", 1]
    assert (x.kept, x.removed, x.redundant, x.unique_fails, x.good_lost, x.toxic_lost) == (3, 2, 0, 2, 2, 2) and x.shapley == 240
    x = got["", "AEBCD", 2]
    assert (x.kept, x.removed, x.redundant, x.unique_fails) == (0, 0, 1, 0)
    x = got["b", "DCABE", 3]
    assert (x.removed, x.redundant, x.toxic_lost) == (0, 1, 0) and got["b", "DCABE", 1].toxic_lost == 1
    assert filter_audit.audit(df.filter("doc_id > 99"), labels).count() == 0
