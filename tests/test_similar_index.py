import random
from difflib import SequenceMatcher

import pyarrow as pa
import pytest

from talentloom.operators.similar_texts import Block, reached

WORDS = random.Random(8)
WORDS = ["".join(WORDS.choice("etaoinshrdlu" * 4 + "cmfwypvbgkqjxz") for _ in range(WORDS.randint(2, 9))) for _ in range(4000)]


def said(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


def block(texts, owners=None):
    return Block(pa.table({"owner": owners or [""] * len(texts), "key": list(range(len(texts))), "text": texts}))


def test_of_long_texts_only_those_that_share_stretches_are_compared():
    rng = random.Random(1)
    texts = [said(rng, n) for n in (1500, 1600, 1700, 1800, 2500, 2600) for _ in range(5)]
    copies = [" ".join(w if rng.random() > 0.02 else rng.choice(WORDS) for w in t.split()) for t in texts[::6]]
    new = block(texts + copies)
    tried = similar = 0
    for old in texts[::3] + copies:
        some = set(new.candidates("", old, 0.7))
        tried += len(some)
        for k, text in enumerate(texts + copies):
            if SequenceMatcher(None, text, old).quick_ratio() >= 0.7 and reached(SequenceMatcher(None, text, old), 0.7) is not None:
                similar += 1
                assert k in some
    assert similar >= 12 and tried < 2 * similar, (similar, tried)


def test_short_texts_by_common_subsequence():
    rng = random.Random(2)
    texts = [said(rng, rng.randint(0, 25)) for _ in range(90)]
    texts += [" ".join(w for w in t.split() if rng.random() > 0.2) for t in texts] + ["", "a"]
    owners = [rng.choice("xy") for _ in texts]
    new = block(texts, owners)
    tried = similar = 0
    for old in texts[::2]:
        some = new.candidates("x", old, 0.7)
        assert len(some) == len(set(some)) and all(owners[k] == "x" for k in some)
        tried += len(some)
        for k, text in enumerate(texts):
            if owners[k] == "x" and SequenceMatcher(None, text, old).ratio() >= 0.7:
                similar += 1
                assert k in some
    assert similar > 50 and tried < 3 * similar, (similar, tried)
    assert new.candidates("z", "a", 0.7) == []


@pytest.mark.parametrize("letters", ["ab", "abcdefgh ", "etaoin shrdlucmfwypvbgkqjxz", "eeeeettttaaoo nnqz"])
def test_ratio_is_the_matchers(letters):
    rng = random.Random(letters)
    for n in (0, 1, 5, 60, 199, 200, 201, 300, 700) * 6:
        old = "".join(rng.choice(letters) for _ in range(n))
        text = list(old)
        for _ in range(rng.choice((0, 1, 6, 40))):
            k, size = rng.randrange(n + 1), rng.choice((1, 5, 30))
            text[k : k + size] = [rng.choice(letters) for _ in range(rng.choice((0, size, 2 * size)))]
        half = rng.choice((0, len(text) // 2))
        text = "".join(text[half:] + text[:half])
        ratio = SequenceMatcher(None, text, old).ratio()
        for threshold in (0.0, 0.4, 0.7, 0.95):
            assert reached(SequenceMatcher(None, text, old), threshold) == (ratio if ratio >= threshold else None)
            assert ratio < threshold or 1 in block(["other", text]).candidates("", old, threshold)
