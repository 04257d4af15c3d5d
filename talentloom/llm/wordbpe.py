"""Token ids of a byte-level, end-of-word BPE vocabulary (a ``tokenizers`` JSON file), with a whole-token shortcut.

``whole_tokens`` proves once, on the driver, which vocabulary strings the merges return as one token when
they stand alone. A pre-token among them needs no merging. The others are merged by the library's own model
and remembered, up to a bound. Files with another normaliser or pre-tokeniser, texts with special strings and
words with characters beyond the plain ones go to the library as they are, so ids always equal the library's.
"""

from __future__ import annotations

import json
import re
import unicodedata
from functools import cache
from struct import pack

from tokenizers import Tokenizer

#: Pre-tokens, and chunks between white space, that a worker remembers; beyond that it starts anew.
REMEMBERED = 400_000

#: The pre-token pattern that is known here, as the file has it.
_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


def _class(*kinds: str) -> str:
    return "".join(re.escape(chr(c)) for c in range(0x250) if unicodedata.category(chr(c))[0] in kinds)


#: The same for texts of characters below U+0250 only. There, and with U+0130 left out, each character is stable under NFC and lower-cases by itself.
_SPACE = "\t-\r \x85\xa0"
_PRE_TOKEN = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{_class('L')}]+|[{_class('N')}]|[^{_SPACE}{_class('L', 'N')}]+")
_RARE = re.compile("[^\x00-\u012f\u0131-\u024f]")
#: Python splits at these, the library's white space has them not.
_SEPARATOR = re.compile("[\x1c-\x1f]")


@cache
def byte_alphabet() -> dict[int, str]:
    """The printable stand-in of every byte: itself where Latin-1 prints it, else the next code point from 256 on."""
    printable = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = [b for b in range(256) if b not in printable]
    return {b: chr(b) for b in printable} | {b: chr(256 + i) for i, b in enumerate(others)}


def spelled(pre_token: str) -> str:
    return pre_token if pre_token.isascii() and pre_token.isprintable() else pre_token.encode().decode("latin-1").translate(byte_alphabet())


@cache
def load(path: str) -> tuple[Tokenizer, bool]:
    """The library's tokenizer, and whether its steps are those known here."""
    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_padding()
    tokenizer.no_truncation()
    said = json.loads(tokenizer.to_str())
    steps = [x["type"] for x in (said["normalizer"] or {}).get("normalizers", [])]
    cuts = (said["pre_tokenizer"] or {}).get("pretokenizers", [])
    return tokenizer, (
        steps == ["NFC", "Replace", "Lowercase"]
        and [x["type"] for x in cuts] == ["Split", "ByteLevel"]
        and cuts[0] == cuts[0] | {"pattern": {"Regex": _PATTERN}, "behavior": "Removed", "invert": True}
        and cuts[1] == cuts[1] | {"add_prefix_space": False, "use_regex": False}
        and said["model"]["type"] == "BPE"
    )


@cache
def whole_tokens(path: str) -> dict[str, int]:
    """Byte-spelled strings that stand for one pre-token and for which merging from scratch gives one token, with their ids."""
    tokenizer, known = load(path)
    if not known:
        return {}
    found, suffix = {}, json.loads(tokenizer.to_str())["model"]["end_of_word_suffix"] or ""
    for token, number in tokenizer.get_vocab(with_added_tokens=False).items():
        alone = token.removesuffix(suffix) if suffix and token.endswith(suffix) else token
        if alone and [x.id for x in tokenizer.model.tokenize(alone)] == [number]:
            found[alone] = number
    return found


class _Words(dict):
    """Packed ids of pre-tokens; those of proven whole tokens are there from the start."""

    def __init__(self, model, whole: dict[str, int]):
        self.tokenize, self.whole = model.tokenize, whole
        self.restart()

    def restart(self) -> None:
        self.clear()
        self.update({w: pack("<I", i) for w, i in self.whole.items() if w.isascii() and w.isprintable()})

    def __missing__(self, word: str) -> bytes:
        key = spelled(word)
        one = self.whole.get(key)
        out = pack("<I", one) if one is not None else b"".join([pack("<I", x.id) for x in self.tokenize(key)])
        self[word] = out
        return out


class _Chunks(dict):
    """Packed ids of lower-cased chunks between white space."""

    def __init__(self, words: _Words):
        self.words = words

    def __missing__(self, chunk: str) -> bytes:
        self[chunk] = out = b"".join(map(self.words.__getitem__, _PRE_TOKEN.findall(chunk)))
        return out


class Encoder:
    """Ids as packed little-endian unsigned 32-bit integers, or their number; without added special tokens."""

    def __init__(self, path: str, whole: dict[str, int] | None = None):
        self.tokenizer, self.known = load(path)
        self.added = [x.content for x in self.tokenizer.get_added_tokens_decoder().values()]
        self.words = _Words(self.tokenizer.model, whole_tokens(path) if whole is None else whole)
        self.chunks = _Chunks(self.words)

    def forget(self) -> None:
        """Drops what is remembered, at the end of a task: a worker that waits for its next one needs little memory."""
        self.words.restart()
        self.chunks.clear()

    def by_library(self, text: str) -> bytes:
        ids = self.tokenizer.encode(text, add_special_tokens=False).ids
        return pack(f"<{len(ids)}I", *ids)

    def encode(self, text: str | None) -> bytes:
        if not text:
            return b""
        if len(self.words) > REMEMBERED:
            self.words.restart()
        if not self.known or any(x in text for x in self.added):
            return self.by_library(text)
        if _SEPARATOR.search(text):
            return self.by_library(text)
        if len(self.chunks) > REMEMBERED:
            self.chunks.clear()
        # white space parts pre-tokens and takes no part in NFC, so each chunk stands alone
        if _RARE.search(text) is None:
            return b"".join(map(self.chunks.__getitem__, text.lower().split()))
        return b"".join([self.by_library(x) if _RARE.search(x) else self.chunks[x.lower()] for x in text.split()])



class _WordCounts(dict):
    """Numbers of tokens of pre-tokens: one for a proven whole token, else what merging gives."""

    def __init__(self, encoder: Encoder):
        self.tokenize, self.whole = encoder.tokenizer.model.tokenize, encoder.words.whole

    def __missing__(self, word: str) -> int:
        key = spelled(word)
        self[word] = n = 1 if key in self.whole else len(self.tokenize(key))
        return n


class _ChunkCounts(dict):
    """Numbers of tokens of lower-cased chunks between white space."""

    def __init__(self, words: _WordCounts):
        self.words = words

    def __missing__(self, chunk: str) -> int:
        self[chunk] = n = sum(map(self.words.__getitem__, _PRE_TOKEN.findall(chunk)))
        return n


class Counter:
    """Counts tokens without making their ids: pre-tokens that are whole tokens count as one each, only the rest is merged."""

    def __init__(self, encoder: Encoder):
        self.encoder = encoder
        self.words = _WordCounts(encoder)
        self.chunks = _ChunkCounts(self.words)

    def count(self, text: str | None) -> int:
        if not text:
            return 0
        enc = self.encoder
        if not enc.known or any(x in text for x in enc.added) or _SEPARATOR.search(text):
            return len(enc.by_library(text)) // 4
        if len(self.words) > REMEMBERED:
            self.words.clear()
        if len(self.chunks) > REMEMBERED:
            self.chunks.clear()
        if _RARE.search(text) is None:
            return sum(map(self.chunks.__getitem__, text.lower().split()))
        return sum(len(enc.by_library(x)) // 4 if _RARE.search(x) else self.chunks[x.lower()] for x in text.split())


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str, whole: dict[str, int]) -> Encoder:
    """One encoder for each Python worker and file."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path, whole)
    return _ENCODERS[path]
