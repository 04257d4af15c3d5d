"""JSON out of what language models write around it, in it and instead of it."""

from __future__ import annotations

import json
import re
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# What is no JSON but stands for a value, and what an unreadable answer becomes.
WORDS = {"none": "null", "nil": "null", "undefined": "null", "nan": "null", "null": "null", "true": "true", "false": "false", "yes": '"yes"', "no": '"no"'}
UNREADABLE = "{}"
NUMBER = re.compile(r"-?(?:0|[1-9]\d*)(?:\.\d+)?(?:[eE][+-]?\d+)?\Z")
#: Comments, strings in three kinds of quotes (to the end, if they never close), marks, and bare words up to the next mark or line.
TOKEN = re.compile(r"""(?://[^\n]*|/\*.*?(?:\*/|\Z))|"(?:[^"\\]|\\.)*(?:"|\\?\Z)|'(?:[^'\\]|\\.|'(?=[A-Za-z]))*(?:'|\\?\Z)|“[^”]*(?:”|\Z)|[{}\[\],:]|[^\s{}\[\],:"“][^{}\[\],:"“\n]*""", re.S)
CLOSES = {"{": "}", "[": "]"}


def _string(token: str) -> str:
    """A quoted or bare token as a JSON string; control characters and escaped line ends go, unknown escapes lose their backslash."""
    quote = token[0]
    body = token[1:-1] if quote in "\"'“" and len(token) > 1 and token[-1] == {"“": "”"}.get(quote, quote) else token[1:] if quote in "\"'“" else token.strip()
    body = re.sub(r"[\x00-\x1f\x7f-\x9f]|\\n", "", body)
    plain = re.sub(r"""\\(u[0-9a-fA-F]{4}|.|\Z)""", lambda m: m[0] if m[1][:1] in '"\\/bfrt' and m[1] or len(m[1]) == 5 else m[1], body, flags=re.S)
    return '"' + re.sub(r'(?<!\\)((?:\\\\)*)"', r'\1\\"', plain) + '"'


def _value(token: str) -> str:
    if token[0] in "\"'“":
        return _string(token)
    bare = token.strip()
    return bare if NUMBER.match(bare) else WORDS.get(bare.lower(), _string(bare))


def repaired(text: str | None) -> str:
    """The first object of a text as valid JSON, by one pass over its tokens with a stack of open brackets.

    Fences and text around the object go. Open brackets and strings are closed at the end, a bracket that closes an outer one closes the inner ones too, and one that closes nothing
    is passed over. Missing commas and colons are put in, superfluous ones go, a key without a value has null. Bare keys and words become strings. ``{}`` for a text without an object.
    """
    text = re.sub(r"```(?:json)?", " ", text or "", flags=re.I)
    start = text.find("{")
    if start < 0:
        return UNREADABLE
    out: list[str] = []
    stack: list[str] = []  # expected closing marks
    want: list[str] = []  # for each open bracket what comes next: key, colon, value, comma

    def close() -> None:
        if want[-1] in ("colon", "value") and stack[-1] == "}":
            out.append(":null" if want[-1] == "colon" else "null")
        if out[-1] == ",":
            out.pop()
        out.append(stack.pop())
        want.pop()
        if want:
            want[-1] = "comma"

    def before_value() -> None:
        if want and want[-1] == "colon":
            out.append(":")
        elif want and want[-1] == "comma":
            out.append(",")

    for m in TOKEN.finditer(text, start):
        token = m[0]
        if token.startswith(("//", "/*")):
            continue
        if token in "}]":
            if token in stack:
                while stack[-1] != token:
                    close()
                close()
        elif token == ",":
            if want[-1] in ("colon", "value") and stack[-1] == "}":
                out.append(":null" if want[-1] == "colon" else "null")
                want[-1] = "comma"
            if want[-1] == "comma":
                out.append(",")
                want[-1] = "key" if stack[-1] == "}" else "value"
        elif token == ":":
            if want[-1] == "colon":
                out.append(":")
                want[-1] = "value"
        elif token in "{[" and not (want and stack[-1] == "}" and want[-1] in ("key", "comma")):
            before_value()
            out.append(token)
            stack.append(CLOSES[token])
            want.append("key" if token == "{" else "value")
        elif token not in "{[":
            if stack[-1] == "}" and want[-1] in ("key", "comma"):
                before_value()
                out.append(_string(token))
                want[-1] = "colon"
            else:
                before_value()
                out.append(_value(token))
                want[-1] = "comma"
        if not stack:
            break
    while stack:
        close()
    found = "".join(out)
    try:
        json.loads(found, strict=False)
    except (ValueError, RecursionError):
        return UNREADABLE
    return found


def _each(text: pd.Series) -> pd.Series:
    return text.map(repaired, na_action=None)


def tolerant_json(text: Column) -> Column:
    """``repaired`` for a column, in time proportional to the text: what is open decides what a mark means, which no expression over columns says in one pass. Null becomes ``{}``."""
    udf: Callable[[Column], Column] = F.pandas_udf(_each, StringType())
    return udf(text)
