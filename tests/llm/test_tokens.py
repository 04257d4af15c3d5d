import random
import zlib

import numpy as np
from tokenizers import Tokenizer

from talentloom.llm import packing, token_counts, wordbpe


def test_encoder_equals_the_library(tokenizer):
    library, own = Tokenizer.from_file(tokenizer), wordbpe.Encoder(tokenizer)
    counter = wordbpe.Counter(own)
    rng = random.Random(7)
    alphabet = [*"aAbB'sStT 019.,!?-_\n\t\x0b\x1c\x1f\x85\xa0éÉßÀÞİıªº²½¼ǅΣςΆѐ中文", "e\u0301", "\u0340", "\u200b", "\u3000", "😀", "\u00ad", "<|", "|>", "<|endoftext|>", "'re", "'LL", "don't", "the"]
    for _ in range(4000):
        text = "".join(rng.choice(alphabet) for _ in range(rng.randint(1, 30)))
        want = library.encode(text, add_special_tokens=False).ids
        assert np.frombuffer(own.encode(text), "<u4").tolist() == want, repr(text)
        assert counter.count(text) == len(want)


def test_whole_tokens_are_proven(tokenizer):
    library, whole = Tokenizer.from_file(tokenizer), wordbpe.whole_tokens(tokenizer)
    assert whole["the"] == library.encode("the", add_special_tokens=False).ids[0]
    for word in list(whole)[::997]:
        assert [x.id for x in library.model.tokenize(word)] == [whole[word]]


def test_counts(odd, none, tokenizer):
    library = Tokenizer.from_file(tokenizer)
    got = sorted((str(r.doc_id), r.n_bytes, r.n_tokens, r.over_limit) for r in token_counts.token_counts(odd, tokenizer).collect())
    want = []
    for r in odd.collect():
        text = r.text or ""
        n = len(library.encode(text, add_special_tokens=False).ids)
        want.append((str(r.doc_id), len(text.encode()), n, n > 2048))
    assert got == sorted(want)
    assert token_counts.token_counts(none, tokenizer).count() == 0


def check_pieces(rows, docs, tokenizer, capacity):
    library = Tokenizer.from_file(tokenizer)
    ids = {}
    for r in docs:
        ids.setdefault(r.doc_id, []).append(library.encode(r.text or "", add_special_tokens=False).ids + [2])
    sequences = {}
    for p in rows:
        sequences.setdefault(p.sequence_id, []).append(p)
        assert any(list(np.frombuffer(p.ids, "<u4")) == x[p.start : p.start + p.length] and len(x) == p.doc_tokens for x in ids[p.doc_id])
    for parts in sequences.values():
        at = 0
        for p in sorted(parts, key=lambda p: p.offset):
            assert p.offset == at and p.length == len(p.ids) // 4 > 0
            at += p.length
        assert at <= capacity
    assert sum(p.length for p in rows) == sum(len(x) for v in ids.values() for x in v)
    for i, texts in ids.items():
        if len(texts) == 1:
            own = sorted((p.start, p.length) for p in rows if p.doc_id == i)
            assert [s for s, _ in own] == [0, *np.cumsum([n for _, n in own])[:-1]]
    return sequences


def test_pieces(spark, odd, none, small, tokenizer):
    docs = odd.collect()
    check_pieces(packing.pack(odd, tokenizer).collect(), docs, tokenizer, 4096)
    check_pieces(packing.pack(odd.repartition(3), tokenizer, capacity=64).collect(), docs, tokenizer, 64)
    assert packing.pack(none, tokenizer).count() == 0
    table = spark.read.parquet(f"{small}/documents.parquet")
    rows = packing.pack(table, tokenizer).collect()
    sequences = check_pieces(rows, table.collect(), tokenizer, 4096)
    sums = [sum(p.length for p in x) for x in sequences.values()]
    padding = sum(4096 - n for n in sums if n & (n - 1))
    assert padding < 0.01 * sum(sums)
    digests = {(r.doc_id, r.start): r.ids_crc32 for r in packing.digest(packing.pack(table, tokenizer)).collect()}
    assert all(digests[p.doc_id, p.start] == zlib.crc32(p.ids) for p in rows)


def test_fullest_multiset():
    rng = random.Random(3)
    for _ in range(200):
        counts = {rng.randint(1, 40): rng.randint(1, 3) for _ in range(rng.randint(1, 6))}
        used = packing.fullest(counts, sorted(counts), 60)
        reach = {0}
        for n, k in {**counts, max(counts): counts[max(counts)] - 1}.items():
            reach |= {s + n * j for s in reach for j in range(k + 1) if s + n * j <= 60 - max(counts)}
        assert sum(n * k for n, k in used.items()) == max(counts) + max(reach)
        assert all(k <= counts[n] for n, k in used.items())
