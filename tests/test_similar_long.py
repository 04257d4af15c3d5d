import random
from difflib import SequenceMatcher

import pyarrow as pa

from talentloom.operators.similar_texts import Block


def test_runs_leave_out_no_similar_text():
    rng = random.Random(3)
    words = ["".join(rng.choice("etaoinshrdlucmfwypvbgkqjxz"[: rng.choice((8, 14, 26))]) for _ in range(rng.randint(2, 9))) for _ in range(150)]
    say = lambda n: " ".join(rng.choice(words) for _ in range(n))
    texts = [say(rng.randint(30, 160)) for _ in range(25)]
    for t in texts[:15]:
        for share in (0.02, 0.1, 0.3):
            texts.append(" ".join(rng.choice(words) if rng.random() < share else w for w in t.split()))
        w = t.split()
        texts += [" ".join(w[len(w) // 5 :] + say(len(w) // 6).split()), " ".join(w[len(w) // 2 :] + w[: len(w) // 2])]
    block = Block(pa.table({"owner": [""] * len(texts), "key": list(range(len(texts))), "text": texts}))
    tried, similar = 0, 0
    for old in texts:
        some = set(block.candidates("", old, 0.7))
        tried += len(some)
        for k, new in enumerate(texts):
            if SequenceMatcher(None, new, old).ratio() >= 0.7:
                similar += 1
                assert k in some
    assert similar > 150 and tried < 0.4 * len(texts) ** 2
