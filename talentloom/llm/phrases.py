"""Prefix-free parsing of byte texts: trigger strings by a modulus of a rolling hash, and the phrases between them."""

from __future__ import annotations

import os

import numpy as np

from talentloom.llm.textbytes import _FIRST, eights, mix

_U = np.uint64
#: Odd multipliers of the hashes; ``drawn`` gives others.
FIXED = _A, _B, _C = _U(0x9E3779B97F4A7C15), _U(0xD6E8FEB86659FD93), _U(0xA0761D6478BD642F)

#: Bytes of a repeat and of a trigger string, and the places that a trigger can have in a string of LENGTH bytes.
LENGTH, TRIGGER = 50, 24
PLACES = LENGTH - TRIGGER + 1
#: Bytes of a string of LENGTH bytes beside its trigger.
SIDE = LENGTH - TRIGGER
#: A position is a trigger if its hash is 0 modulo this power of two.
MODULUS = 32


def drawn() -> tuple[np.uint64, np.uint64, np.uint64]:
    """Random multipliers for one run in place of ``FIXED``. Who writes texts can't know them, so texts can't be made to collide."""
    a, b, c = np.frombuffer(os.urandom(24), np.uint64) | _U(1)
    return a, b, c


def rolling_hashes(raw: np.ndarray, secret: tuple = FIXED) -> np.ndarray:
    """Hashes of the TRIGGER bytes from each position on, out of three numbers of eight bytes."""
    a, b, c = secret
    n = len(raw) - TRIGGER + 1
    h = eights(raw) * a
    h ^= h >> _U(32)
    h = h[:n] * a + h[8 : n + 8] * b + h[16 : n + 16] * c
    h ^= h >> _U(29)
    h *= b
    h ^= h >> _U(32)
    return h


def least_places(values: np.ndarray) -> np.ndarray:
    """For each run of PLACES values the place of the least one in it, the first of equal ones, by doubling."""
    place = np.zeros(len(values), np.int8)
    for step in (1, 2, 4, 8, PLACES - 16):
        less = values[step:] < values[:-step]
        place = np.where(less, place[step:] + np.int8(step), place[:-step])
        values = np.minimum(values[step:], values[:-step])
    return place


def parse(raw: np.ndarray, at: np.ndarray, secret: tuple = FIXED) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Triggers, their keys, and the first and last start of the strings of LENGTH bytes that belong to each.

    A string belongs to its first trigger whose hash is 0 modulo MODULUS. Strings without one, within long phrases, belong to their least hash (the first of
    equal ones). Both depend on the string's own bytes alone, so equal strings belong to equal triggers at equal places; every string belongs to one.
    The starts that belong to a trigger follow each other: they lie in the phrase that the trigger ends.
    """
    none = np.zeros(0, np.int64)
    if len(raw) < LENGTH:
        return none, none.astype(np.uint64), none, none
    hashes = rolling_hashes(raw, secret)
    found = np.flatnonzero((hashes & _U(MODULUS - 1)) == 0)
    doc = np.searchsorted(at, found, "right") - 1
    inside = found + TRIGGER <= at[doc + 1]
    found, doc = found[inside], doc[inside]
    low = np.maximum(np.maximum(found - SIDE, at[doc]), np.concatenate(([0], found[:-1] + 1)))
    high = np.minimum(found, at[doc + 1] - LENGTH)
    some = low <= high
    found, low, high = found[some], low[some], high[some]

    n = len(raw) - LENGTH + 1
    change = np.zeros(n + 1, np.int8)
    change[low] += 1
    change[high + 1] -= 1
    open_ = np.cumsum(change[:n], dtype=np.int8) == 0
    for end in at[1:]:
        open_[max(0, end - LENGTH + 1) : end] = False
    starts = np.flatnonzero(open_)
    least = starts + least_places(hashes)[starts] if len(starts) else none
    first = np.flatnonzero(np.concatenate(([True], (least[1:] != least[:-1]) | (starts[1:] != starts[:-1] + 1)))) if len(starts) else none
    last = np.append(first[1:], len(starts))[: len(first)] - 1
    found, low, high = np.concatenate([found, least[first]]), np.concatenate([low, starts[first]]), np.concatenate([high, starts[last]])
    return found, mix(hashes[found]), low, high


def phrase_keys(raw: np.ndarray, places: np.ndarray, low: np.ndarray, high: np.ndarray, secret: tuple = FIXED) -> np.ndarray:
    """64-bit keys of the bytes that the strings from ``low`` to ``high`` cover, and of the trigger's place in them."""
    a, b, c = secret
    padded, size = eights(np.append(raw, np.zeros(LENGTH + SIDE, np.uint8))), high + LENGTH - low
    out = mix((places - low).astype(np.uint64) * a + size.astype(np.uint64) * c)
    for k in range(0, LENGTH + SIDE, 8):
        number = padded[low + k] & _FIRST[np.clip(size - k, 0, 8)]
        number *= b
        number ^= number >> _U(31)
        number += out
        out = number * a
        out ^= out >> _U(33)
    return mix(out)


def single(places: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Every string by itself: which trigger it belongs to, and its start."""
    n = high - low + 1
    which = np.repeat(np.arange(len(places)), n)
    return which, np.repeat(low - (np.cumsum(n) - n), n) + np.arange(len(which))


def padded_rows(raw: np.ndarray, start: np.ndarray, size: np.ndarray, width: int) -> np.ndarray:
    """``size`` bytes from each start, zeros behind them, ``width`` a row."""
    offset = np.arange(width)
    index = np.minimum(start[:, None] + offset, max(0, len(raw) - 1))
    return np.where(offset < size[:, None], raw[index], 0).astype(np.uint8)


def ordered(rows: np.ndarray, groups: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """The rows' order (by group, then bytes), and for each row in it how many bytes it shares with the one before; -1 where a group starts."""
    wide = np.zeros((len(rows), -(-rows.shape[1] // 8) * 8), np.uint8)
    wide[:, : rows.shape[1]] = rows
    numbers = wide.view(">u8").astype(np.uint64).T[::-1]
    order = np.lexsort(numbers if groups is None else (*numbers, groups))
    same = rows[order[1:]] == rows[order[:-1]]
    shared = np.where(same.all(1), rows.shape[1], np.argmin(same, 1)).astype(np.int64)
    if groups is not None:
        shared[groups[order[1:]] != groups[order[:-1]]] = -1
    return order, np.concatenate(([-1], shared))[: len(rows)]


def string_minima(phrase: np.ndarray, phrases: np.ndarray, left: np.ndarray, trigger: np.ndarray, following: np.ndarray, right: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Entries, places and smallest documents of the strings that an entry with a smaller document than its own has too.

    ``phrases`` is the dictionary: what precedes a trigger, backwards. An entry of the parse is a phrase (``phrase``, ``left`` bytes of it), its trigger and the
    bytes that follow (``right`` of them). The suffix array of the dictionary orders phrases from their ends, so phrases with the same
    suffix of any length are neighbours; that of the parse orders what follows each trigger. A place (bytes before the trigger) takes from both the classes of what
    is equal at its lengths; sorted by the two, equal strings are neighbours in the corpus order and share LENGTH bytes.
    """
    order, shared = ordered(phrases)
    of_phrase, of_rest = np.empty((2, len(phrases)), np.int64), np.empty((2, len(phrase)), np.int64)
    of_phrase[0, order], of_phrase[1] = np.arange(len(order)), shared
    after, common = ordered(following, trigger)
    of_rest[0, after], of_rest[1] = np.arange(len(after)), common
    out = []
    for place in range(PLACES):
        some = np.flatnonzero((left >= place) & (right >= SIDE - place))
        if len(some) < 2:
            continue
        suffix = np.cumsum(of_phrase[1] < place)[of_phrase[0, phrase[some]]]
        rest = np.cumsum(of_rest[1] < SIDE - place)[of_rest[0, some]]
        key = suffix * (len(phrase) + 1) + rest
        corpus = np.argsort(key, kind="stable")
        start = np.flatnonzero(np.concatenate(([True], key[corpus][1:] != key[corpus][:-1])))
        least = np.empty(len(some), np.int64)
        least[corpus] = np.repeat(np.minimum.reduceat(first[some[corpus]], start), np.diff(np.append(start, len(some))))
        odd = np.flatnonzero(least < first[some])
        out.append((some[odd], np.full(len(odd), place), least[odd]))
    entry, place, least = (np.concatenate(x) for x in zip(*out)) if out else (np.zeros(0, np.int64),) * 3
    by_entry = np.argsort(entry, kind="stable")
    return entry[by_entry], place[by_entry], least[by_entry]
