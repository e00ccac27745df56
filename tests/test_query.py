"""The query language: keys, literals, construction rules and their error codes."""

from __future__ import annotations

import json

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from riverbed.plans.errors import QueryError
from riverbed.plans.paths import offset_of, parse_key, path_text
from riverbed.plans.query import Literal, Prefix, Range, parse, parse_literal

segment = st.text(max_size=12)


def escape(s: str) -> str:
    return s.replace("~", "~0").replace("/", "~1")


@given(st.lists(segment, min_size=1, max_size=8), st.booleans())
def test_pointers_decode(segments, root):
    text = ("../" if root else "/") + "/".join(map(escape, segments))
    if not root and text.startswith("../"):
        return
    assert parse_key(text) == (() if root else ("data",)) + tuple(segments)


@given(segment.filter(lambda s: not s.startswith(("/", "../"))))
def test_bare_keys_are_literal(key):
    assert parse_key(key) == ("data", key)


@pytest.mark.parametrize("key,path", [("/", ("data", "")), ("../", ("",)), ("/a/", ("data", "a", "")), ("../type", ("type",)), ("a~2", ("data", "a~2")), ("/02", ("data", "02"))])
def test_key_forms(key, path):
    assert parse_key(key) == path


@given(st.characters().filter(lambda c: c not in "01"))
def test_bad_escapes(c):
    for key in (f"/a~{c}", "/a~", f"../x/~{c}b"):
        with pytest.raises(QueryError) as e:
            parse_key(key)
        assert e.value.code == "invalid-json-pointer" and e.value.status == 400


@given(st.lists(segment, min_size=1), st.lists(segment, min_size=1))
def test_path_text_is_unambiguous(a, b):
    assert (path_text(tuple(a)) == path_text(tuple(b))) == (a == b)


def test_offsets_are_canonical():
    assert [offset_of(s) for s in ("0", "7", "02", "-1", "", "٣", "99999999999")] == [0, 7, None, None, None, None, None]


@given(st.one_of(st.none(), st.booleans(), st.floats(allow_nan=False, allow_infinity=False), st.text(max_size=40)))
def test_json_scalars(v):
    got = parse_literal(json.dumps(v))
    assert got.value == v and got.tag == ("null" if v is None else "bool" if isinstance(v, bool) else "number" if isinstance(v, float) else "string")


@pytest.mark.parametrize("text", ["abc", "[1]", '{"a":1}', '"open', "NaN", "Infinity", "01", "1, 2", "tru"])
def test_anything_else_is_a_string(text):
    assert parse_literal(text) == Literal("string", text)


def code(text, **options):
    with pytest.raises(QueryError) as e:
        parse(text, **options)
    assert e.value.body()["code"] == e.value.code
    return e.value.code


def test_error_codes():
    assert code("/a~2=1") == code("/a~=1") == "invalid-json-pointer"
    assert code("&".join(f"k{i}={i}" for i in range(33))) == "too-many-terms"
    assert code("a=1&a=2") == "equality-operator-already-used"
    for text in ("a=<1&b=>2", "a=<1&a=<2", "a=<1&a=>0&a=>-1", "a=~x&b=<1", "b=<1&a=~x", "a=~x&a=~y"):
        assert code(text) == "inequality-operator-already-used", text
    assert code('a=>1&a=<"x"') == "incompatible-types-in-between"
    assert code("a=~5") == code("a=~null") == "non-string-for-starts-with"
    assert code("a=" + "x" * 300, max_value_bytes=256) == "string-too-long"
    assert code("a=1", body="{}") == "unexpected-body"
    assert code("a=1;b=1&b=2") == "equality-operator-already-used"  # one wrong part refuses the whole


def test_term_limit_is_for_each_conjunction():
    one = "&".join(f"k{i}={i}" for i in range(32))
    assert len(parse(f"{one};{one}").conjunctions) == 2


def test_equality_and_inequality_on_one_key():
    a = ("data", "a")
    (c,) = parse("a=<5&a=3").conjunctions
    assert c.equal == {a: Literal("number", 3.0)} and c.inequality is None and c.unequal == ((a, Literal("number", 5.0)),)
    (c,) = parse("a=3&a=<=5").conjunctions
    assert not c.equal and c.inequality == Range(a, high=Literal("number", 5.0))


def test_ranges_and_prefixes():
    a = ("data", "a")
    for text in ("a=>10&a=<50", "a=<50&a=>10", "a=>50&a=<10"):
        (c,) = parse(text).conjunctions
        assert c.inequality == Range(a, Literal("number", 10.0), Literal("number", 50.0)) and len(c.unequal) == 2
    (c,) = parse("a=~").conjunctions
    assert c.inequality == Prefix(a, "")
    (c,) = parse("a=~%C3%A9").conjunctions
    assert c.inequality == Prefix(a, "é")


def test_empty_values_and_disjuncts():
    (c,) = parse("a&b=&a=").conjunctions
    assert c.equal == {("data", "a"): Literal("string", ""), ("data", "b"): Literal("string", "")}
    assert parse("").conjunctions[0].positive == 0
    assert [c.positive for c in parse("a=1;").conjunctions] == [1, 0]


@settings(max_examples=200)
@given(st.text(max_size=60))
def test_any_text_parses_or_is_refused_with_a_code(text):
    try:
        parse(text)
    except QueryError as e:
        assert e.status == 400 and e.code
