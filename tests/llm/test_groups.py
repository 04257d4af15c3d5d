import random
import re

from pyspark.sql import functions as F

from talentloom.llm import decontaminate, exact_dedup, near_dups, repeats, shards
from talentloom.llm.components import components
from tests.llm import brute


def unique(df):
    return [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]


def removed(df):
    n = F.aggregate("spans", F.lit(0).cast("long"), lambda a, x: a + x["end"] - x["start"])
    rows = df.select("doc_id", "n_bytes", n.alias("n"), F.size("spans").alias("s"), F.sha2("kept", 256).alias("k")).collect()
    return {r.doc_id: (r.n_bytes, r.n, r.s, r.k) for r in rows}


def test_filters_merge_without_loss(monkeypatch):
    import numpy as np

    rng, made = np.random.default_rng(3), exact_dedup.QuotientFilter
    monkeypatch.setattr(exact_dedup, "STRETCH", 64)
    for prefix, n in ((0, 4), (0, 5000), (4, 3000), (9, 700)):
        lead = np.uint64(5 << (64 - prefix)) if prefix else np.uint64(0)
        space = rng.integers(0, 2 ** (63 - prefix), n, dtype=np.uint64)
        space[: n // 3] = np.arange(n // 3)  # crowded quotients, and remainders that look like counters
        parts, filters = [lead | rng.choice(space, n) for _ in range(5)], []
        parts.append(np.full(200_000, lead, np.uint64))
        for x in parts:
            keys, counts = np.unique(x, return_counts=True)
            stored = made.of(keys, counts, prefix).packed()
            assert n < 500 or len(stored) < 8 * (len(keys) + 2 * (counts > 1).sum()) or len(x) > n
            filters.append(made.unpacked(stored))
            got = [np.concatenate(y) for y in zip(*exact_dedup.merged_filters(filters[-1:]))]
            assert np.array_equal(got[0], keys) and np.array_equal(got[1], counts)
        keys, counts = np.unique(np.concatenate(parts), return_counts=True)
        got = [np.concatenate(y) for y in zip(*exact_dedup.merged_filters(filters))]
        assert np.array_equal(got[0], keys) and np.array_equal(got[1], counts)


def test_exact_groups(odd, none):
    rows = {(r.doc_id, r.text_sha256): r for r in exact_dedup.exact_dedup(odd).collect()}
    by_id = {r.doc_id: r for r in rows.values()}
    assert exact_dedup.exact_dedup(odd).count() == odd.count()
    assert (by_id[6].keep_id, by_id[7].keep_id, by_id[7].kept) == (6, 6, False)
    assert by_id[1].keep_id == by_id[2].keep_id == 3 and by_id[3].group_size == 4
    assert by_id[10].keep_id == by_id[12].keep_id == 11
    assert by_id[4].keep_id == -3 and by_id[9].group_size == 2 and by_id[9].kept
    assert exact_dedup.exact_dedup(none).count() == 0


def test_repeats_against_brute_force(spark, small, monkeypatch):
    monkeypatch.setattr(shards, "SHARD_BYTES", 100_000)
    docs = spark.read.parquet(f"{small}/documents.parquet")
    want = brute.repeats(unique(docs))
    assert removed(repeats.remove_repeats(docs)) == want
    assert removed(repeats.remove_repeats(docs, hot=1, parts=1)) == want


def test_texts_written_to_collide_stay(spark):
    """Each pair has one key under hashes with fixed numbers."""
    pair = [(1, "V4b5GKSu(duAOCjdadk)nT1quEs(m,47iBSIUVUe?N;t .ne V"), (2, "r)Ry.mCF\"Ej@~I2!adk)nT1quEs(m,47iBSIUVUe?N;t .ne V")]
    got = removed(repeats.remove_repeats(spark.createDataFrame(pair, "doc_id long, text string")))
    assert got == brute.repeats(pair) and got[2][1] == 0
    pair = [(1, "rs18bf38 il5pj3jo xtda514t 3lq2ekeq 9eno6hsj"), (2, "882jyouh il5pj3jo xtda514t 3lq2ekeq :q8g+o,y")]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_dups.near_duplicates(spark.createDataFrame(pair, "doc_id long, text string")).collect()}
    assert got == {1: (1, 1), 2: (1, 2)} == brute.components(pair)


def test_colliding_keys_with_other_triggers_differ():
    import numpy as np

    keys, triggers = (np.array(x, np.uint64) for x in ([3, 1, 3, 3, 1, 7], [5, 2, 6, 5, 2, 0]))
    order, start = repeats.alike(keys, triggers)
    groups = [sorted(x.tolist()) for x in np.split(order, start[1:])]
    assert groups == [[1, 4], [0, 3], [2], [5]]


def test_repeats_of_short_periods(spark):
    rng = random.Random(1)
    rows = [(i, "".join(rng.choice("ab") for _ in range(30)) * rng.randint(0, 9) + "ñ" * rng.randint(0, 60)) for i in range(40)] + [(77, "a" * 50), (78, "a" * 51), (79, "a" * 49)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert removed(repeats.remove_repeats(docs)) == brute.repeats(rows)


def test_stretches_of_a_text_hold_its_strings_once(monkeypatch):
    import numpy as np
    import pyarrow as pa

    rng = random.Random(4)
    pool = ["".join(rng.choice("abcd e") for _ in range(rng.randint(20, 160))) for _ in range(30)]
    texts = ["".join(rng.choice(pool) for _ in range(60)) + "z" * 200, "short", "".join(rng.choice("ab") for _ in range(3000))]

    def strings():
        batch = pa.RecordBatch.from_pydict({"text": texts})
        out = {}
        for _, byte, doc, places, triggers, low, high, _ in repeats.occurrences(batch, np.zeros(0, np.uint64)):
            for d, p, t, a, z in zip(doc.tolist(), places.tolist(), triggers.tolist(), low.tolist(), high.tolist()):
                for k in range(a, z + 1):
                    assert (key := k + byte) not in out
                    out[key] = d, t, p - k
        return out

    monkeypatch.setattr(repeats, "SLICE", 10)
    whole = strings()
    assert len(whole) == sum(max(0, len(t) - 49) for t in texts)
    for size in (70, 333, 1000):
        monkeypatch.setattr(repeats, "STRETCH", size)
        assert strings() == whole


def test_repeats_of_odd_rows(odd, none):
    got = repeats.remove_repeats(odd)
    assert got.count() == odd.count() and repeats.remove_repeats(none).count() == 0
    by_id = {r.doc_id: r for r in got.collect()}
    assert bytes(by_id[7].kept) == b"" and bytes(by_id[14].kept) == b"before  after" and by_id[9].spans == [] and by_id[8].spans == []


def test_components_against_brute_force(spark, small, monkeypatch):
    monkeypatch.setattr(shards, "SHARD_BYTES", 100_000)
    docs = spark.read.parquet(f"{small}/documents.parquet")
    base = [f"w{i}" for i in range(120)]
    rng = random.Random(2)
    more = []
    for i in range(80):
        words = base[:]
        for _ in range(rng.randint(0, 4)):
            words[rng.randrange(120)] = f"new{rng.randrange(50)}"
        more.append((5000 + i, " ".join(words)))
    docs = docs.select("doc_id", "text").unionByName(spark.createDataFrame(more, "doc_id long, text string"))
    want = brute.components(unique(docs))
    for task, part in ((1_000_000, 400_000), (2000, 400_000), (2000, 500)):
        monkeypatch.setattr(near_dups, "TASK_SHINGLES", task)
        monkeypatch.setattr(near_dups, "PART_SHINGLES", part)
        assert {r.doc_id: (r.n_shingles, r.component_id) for r in near_dups.near_duplicates(docs).collect()} == want


def test_a_family_meets_at_once_not_at_each_token(spark, monkeypatch):
    """texts of one family have many tokens in common; a task for each of them sent every set dozens of times, and the more the larger the family."""
    base, rng = [f"w{i}" for i in range(120)], random.Random(4)
    rows = []
    for i in range(60):
        words = base[:]
        for _ in range(rng.randint(0, 9)):
            words[rng.randrange(120)] = f"new{rng.randrange(5000)}"
        rows.append((i, " ".join(words)))
    docs, sent = spark.createDataFrame(rows, "doc_id long, text string"), []
    parted = near_dups._parted

    def counted(*given):
        sent.append(parted(*given).groupBy("class").count().agg(F.max("count")).first()[0])
        return parted(*given)

    monkeypatch.setattr(near_dups, "_parted", counted)
    monkeypatch.setattr(near_dups, "TASK_SHINGLES", 2000)
    monkeypatch.setattr(near_dups, "PART_SHINGLES", 2500)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in near_dups.near_duplicates(docs).collect()} == brute.components(rows)
    assert len(sent) == 1 and sent[0] <= 4  # 60 sets of at most 116 shingles are three parts, and one more as two labels are parted


def test_frequent_and_rare_tokens_are_counted_alike(monkeypatch):
    import numpy as np

    rng = np.random.default_rng(6)
    sets = [np.unique(rng.integers(0, 40 if i % 3 else 4000, rng.integers(1, 60), dtype=np.uint64)) for i in range(150)] + [np.zeros(0, np.uint64)]
    for often in (1, 32, 1000):
        monkeypatch.setattr(near_dups, "OFTEN", often)
        found = near_dups.Postings(sets)
        assert (found.table is None) == (often == 1000)
        for i in (0, 149, 70, 3, 150):
            assert found.counts(i, len(sets)).tolist() == [len(np.intersect1d(sets[i], x)) for x in sets]


def test_components_of_odd_rows(odd, none):
    rows = near_dups.near_duplicates(odd).collect()
    by_id = {r.doc_id: (r.n_shingles, r.component_id) for r in rows}
    assert len(rows) == odd.count() and near_dups.near_duplicates(none).count() == 0
    assert by_id[1] == (0, 1) and by_id[3] == (0, 3) and by_id[4] == (1, -3) and by_id[7] == (by_id[6][0], 6) and by_id[5] == (1, 5)


def test_chains_become_one_component(spark):
    links = spark.createDataFrame([(f"{i:03}", f"{i + 1:03}") for i in range(60)] + [("900", "901")], "u string, v string")
    got = {r.node: r.root for r in components(links).collect()}
    assert got == {f"{i:03}": "000" for i in range(61)} | {"900": "900", "901": "900"}


def passages(rows, items, window=10):
    import re

    def words(t):
        return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", brute.lowered(t))

    wanted = {}
    for name, t in items:
        w = words(t)
        n = min(window, len(w))
        for k in range(len(w) - n + 1 if n else 0):
            wanted.setdefault(tuple(w[k : k + n]), set()).add(str(name))
    out = []
    for i, t in rows:
        w, hit, found = words(t), set(), set()
        for n in {len(x) for x in wanted}:
            for k in range(len(w) - n + 1):
                if own := wanted.get(tuple(w[k : k + n])):
                    hit.update(range(k, k + n))
                    found |= own
        out.append((str(i), len(w), len(hit), sorted(found)))
    return sorted(out)


def contaminated(df):
    return sorted((str(r.doc_id), r.n_words, r.n_hit, r["items"]) for r in df.collect())


def test_passages_against_brute_force(spark, small, odd, none, monkeypatch):
    docs, items = spark.read.parquet(f"{small}/documents.parquet"), spark.read.parquet(f"{small}/benchmark.parquet")
    more = items.unionByName(spark.createDataFrame([(900, "of the"), (901, None), (902, "fox jumps OVER the lazy")], "item_id long, text string"))
    for b in (items, more):
        pairs = [(r.item_id, r.text) for r in b.collect()]
        assert contaminated(decontaminate.contamination(docs, b)) == passages(unique(docs), pairs)
    pairs = [(r.item_id, r.text) for r in more.collect()]
    assert contaminated(decontaminate.contamination(odd, more)) == passages(unique(odd), pairs)
    monkeypatch.setattr(decontaminate, "BLOCK_WORDS", 300)
    assert contaminated(decontaminate.contamination(docs, more)) == passages(unique(docs), pairs)
    assert decontaminate.contamination(none, items).count() == 0
    assert contaminated(decontaminate.contamination(odd, items.filter("item_id < 0"))) == passages(unique(odd), [])


def test_passages_are_cut_out(spark):
    item = "one two three four five six seven eight nine ten eleven"
    docs = spark.createDataFrame([(1, f"Keep, {item.upper()}! and this", 5), (2, "clean text", 6)], "doc_id long, text string, n_words int")
    got = decontaminate.decontaminate(docs, spark.createDataFrame([(1, item)], "item_id long, text string")).collect()
    assert [tuple(r) for r in sorted(got)] == [(1, "Keep, ! and this", 5), (2, "clean text", 6)]


def test_overlapping_items_of_several_blocks_are_cut_once(spark, monkeypatch):
    pick = random.Random(7)
    base = [f"w{i}" for i in range(60)]
    items = [(i, " ".join(base[i * 3 : i * 3 + 20])) for i in range(14)] + [(90, "w2 w50 tail")]
    rows = [(1, " ".join(base[:25])), (2, None), (3, ""), (4, "w2 " + " ".join(base[10:30]) + " w50 tail"), (4, "clean words only")]
    for i in range(40):
        a, b = sorted(pick.sample(range(60), 2))
        rows.append((100 + i, "Vor; " + ", ".join(base[a:b]) + " é w2 w50 " + pick.choice(["tail", "w50", ""])))
    docs = spark.createDataFrame([(i, t, i, None) for i, t in rows], "doc_id long, text string, ROW long, spans string").repartition(3)
    benchmark = spark.createDataFrame(items, "item_id long, text string")

    def clean(text):
        if text is None:
            return None
        words = [(m.start(), m.end(), m[0].lower()) for m in re.finditer(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", text)]
        hit = set()
        for _, item in items:
            w = item.split()
            n = min(10, len(w))
            for k in range(len(w) - n + 1):
                for j in range(len(words) - n + 1):
                    if [x[2] for x in words[j : j + n]] == w[k : k + n]:
                        hit.update(range(j, j + n))
        gone = set()
        for k in hit:
            gone.update(range(words[k][0], words[k + 1][0] if k + 1 in hit else words[k][1]))
        return "".join(c for k, c in enumerate(text) if k not in gone)

    want = sorted((i, repr(clean(t)), i) for i, t in rows)
    for words in (decontaminate.BLOCK_WORDS, 40, 5):
        monkeypatch.setattr(decontaminate, "BLOCK_WORDS", words)
        got = decontaminate.decontaminate(docs, benchmark)
        assert got.columns == docs.columns
        assert sorted((r.doc_id, repr(r.text), r.ROW) for r in got.collect()) == want


def test_long_texts_are_indexed_in_stretches(spark, small, monkeypatch):
    import pyarrow as pa

    docs, items = unique(spark.read.parquet(f"{small}/documents.parquet")), [(r.item_id, r.text) for r in spark.read.parquet(f"{small}/benchmark.parquet").collect()]
    phrases = decontaminate.Phrases([(str(i), t or "") for i, t in items])
    want = {i: (hit, found) for i, _, hit, found in passages(docs, items)}
    for words in (400_000, 5000, 300):
        monkeypatch.setattr(decontaminate, "SHARD_WORDS", words)
        shard = decontaminate.Shard(phrases)
        shard.add(pa.RecordBatch.from_pydict({"text": [t for _, t in docs]}), "text")
        spans, found = shard.found()
        hits = [0] * len(docs)
        for d, first, last, _, _ in spans.tolist():
            hits[d] += last - first
        assert {str(i): (hits[k], found[k]) for k, (i, _) in enumerate(docs)} == want


def test_words_that_a_linear_hash_confuses(spark):
    pairs = []
    for k in range(10, 14):
        word = "".join("ab"[bin(i).count("1") % 2] for i in range(1 << k))
        pairs.append((word, word.translate(str.maketrans("ab", "ba"))))
    rows = [(2 * k + side, f"some words around {w} and behind it") for k, pair in enumerate(pairs) for side, w in enumerate(pair)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.doc_id: r.component_id for r in near_dups.near_duplicates(docs).collect()} == {i: i for i, _ in rows}
    items = [(k, a) for k, (a, _) in enumerate(pairs)]
    got = contaminated(decontaminate.contamination(docs, spark.createDataFrame(items, "item_id long, text string")))
    assert got == passages(rows, items) and sum(x[2] for x in got) == len(pairs)


def test_words_with_one_hash_are_told_apart_by_bytes(spark, monkeypatch):
    from talentloom.llm import textbytes

    items = [(1, "alphas beta gam")]
    monkeypatch.setattr(textbytes, "word_hashes", lambda raw, starts, ends: (ends - starts).astype("uint64"))
    phrases = decontaminate.Phrases([("1", "alphas beta gam")])
    shard = decontaminate.Shard(phrases)
    import pyarrow as pa

    rows = [(0, "deltas beta gam alphas BETA gam"), (1, "deltas zeta gam")]
    shard.add(pa.RecordBatch.from_pydict({"text": [t for _, t in rows]}), "text")
    spans, found = shard.found()
    assert spans[:, :3].tolist() == [[0, 3, 6]] and found == [["1"], []] and [x[2] for x in passages(rows, items)] == [3, 0]
