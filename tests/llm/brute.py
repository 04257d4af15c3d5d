"""Plain restatements of the operators, for small inputs."""

from __future__ import annotations

import hashlib
import re


def lowered(text: str) -> str:
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def repeats(rows: list[tuple[int, str]], length: int = 50) -> dict[int, tuple]:
    """doc_id -> n_bytes, n_removed, n_spans, sha256 of what is kept; ids are unique."""
    first: dict[bytes, int] = {}
    texts = {i: (t or "").encode() for i, t in rows}
    for i in sorted(texts):
        for k in range(len(texts[i]) - length + 1):
            first.setdefault(texts[i][k : k + length], i)
    out = {}
    for i, b in texts.items():
        gone = bytearray(len(b))
        for k in range(len(b) - length + 1):
            if first[b[k : k + length]] < i:
                gone[k : k + length] = b"\x01" * length
        spans = len(re.findall(rb"\x01+", bytes(gone)))
        kept = bytes(x for x, g in zip(b, gone) if not g)
        out[i] = (len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest())
    return out


def components(rows: list[tuple[int, str]], size: int = 5) -> dict[int, tuple[int, int]]:
    """doc_id -> shingles, smallest id reachable by links of similarity 0.8 or more."""
    sets = {}
    for i, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", lowered(t))
        sets[i] = {tuple(w[k : k + size]) for k in range(len(w) - size + 1)} if len(w) >= size else ({tuple(w)} if w else set())
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {i: (len(sets[i]), find(i)) for i in ids}
