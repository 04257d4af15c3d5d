import json

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from talentloom.functions.loose_json import repaired, tolerant_json

PLAIN = {"id": 7, "name": "Ann O'Hara", "tags": ["a", "b c"], "job": {"title": "dev", "years": 2.5, "open": True, "until": None}}
SAID = json.dumps(PLAIN)

DAMAGED = {
    "untouched": SAID,
    "fences": f"```json\n{SAID}\n```",
    "repeated fences": "```json```json\n" + SAID + "``` ```",
    "prose": f"Sure! Here it is:\n{SAID}\nAnything else?",
    "second object": SAID + "\n{\"id\": 8}",
    "trailing commas": SAID.replace("]", ",]").replace("}", ", }"),
    "doubled commas": SAID.replace(", ", ",, "),
    "single quotes": SAID.replace("Ann O'Hara", "Ann O\\'Hara").replace('"', "'"),
    "curly quotes": SAID.replace('"tags"', "“tags”").replace('"dev"', "“dev”"),
    "bare keys": SAID.replace('"id"', "id").replace('"title"', "title"),
    "bare words": SAID.replace('"b c"', "b c").replace('"dev"', "dev"),
    "python words": SAID.replace("true", "True").replace("null", "None"),
    "undefined": SAID.replace("null", "undefined"),
    "comments": SAID.replace('"tags"', '// a list\n "tags"').replace('"job"', '/* and { one } */ "job"'),
    "missing commas": SAID.replace('", "', '" "').replace("], ", "] "),
    "missing colon": SAID.replace('"title": ', '"title" '),
    "line ends in strings": SAID.replace("b c", "b\n c").replace("dev", "d\tev"),
    "cut at the end": SAID[:-2],
    "inner bracket left open": SAID.replace("}}", "}"),
}


@pytest.mark.parametrize("kind", DAMAGED)
def test_damage(kind):
    assert json.loads(repaired(DAMAGED[kind])) == PLAIN


@pytest.mark.parametrize("said, want", [
    ('{"a": 1, "b', {"a": 1, "b": None}), ('{"a": [1, 2, {"b": "c', {"a": [1, 2, {"b": "c"}]}), ('{"a": [1, 2}', {"a": [1, 2]}), ('{"a":, "b":}', {"a": None, "b": None}), ('{"a": 1]}', {"a": 1}), ("{}", {}), ("{,}", {}),
    ('{"a": "say "hi" now"}', None), ('{"a": 01, "b": .5}', {"a": "01", "b": ".5"}), ('{"a": "x\\qy\\u00e9\\"z"}', {"a": 'xqyé"z'}), ("{a: 'it''s'}", None), ("no braces", {}), ("", {}), (None, {}), ("-", {}), ("[1, 2]", {}), ("{" * 5000, {}),
])
def test_what_is_left(said, want):
    got = json.loads(repaired(said))
    assert want is None or got == want


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet='{}[],:"\'\\ab1 \n/*“”tn', max_size=60))
def test_anything_gives_an_object(text):
    assert isinstance(json.loads(repaired(text)), dict)


values = st.recursive(st.none() | st.booleans() | st.integers() | st.text(alphabet=st.characters(blacklist_categories=("Cc", "Cs"), blacklist_characters="\\`"), max_size=8), lambda v: st.lists(v, max_size=3) | st.dictionaries(st.text(alphabet="abc\"'é", max_size=4), v, max_size=3), max_leaves=8)


@settings(max_examples=300, deadline=None)
@given(st.dictionaries(st.text(alphabet="abc xyz", max_size=4), values, max_size=4))
def test_valid_objects_stay(value):
    for ascii_only in (True, False):
        assert json.loads(repaired(json.dumps(value, ensure_ascii=ascii_only))) == value


def test_column(spark):
    long = '{"a": "' + "x" * 2_000_000
    rows = spark.createDataFrame([(1, SAID[:-2], "y"), (2, None, "y"), (3, long, "y")], "id int, text string, repaired string")
    got = [json.loads(r[0]) for r in rows.orderBy("id").select(tolerant_json(rows["text"])).collect()]
    assert got == [PLAIN, {}, {"a": "x" * 2_000_000}]
