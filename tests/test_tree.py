"""The strict reader, paths, getters and writers, without Spark."""

from __future__ import annotations

import json
import math
import random
import struct

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tessera import workloads as W
from tessera.functions import paths, values, write
from tessera.functions.errors import CODES, NUMBER, JsonError, message
from tessera.functions.lazy import Lazy
from tessera.functions.tree import error, parse, unescape


def code(fn, *args, **kwargs):
    with pytest.raises(JsonError) as e:
        fn(*args, **kwargs)
    return e.value.code


def test_codes():
    assert len(CODES) == 33 and NUMBER["TAPE_ERROR"] == 3 and NUMBER["OUT_OF_CAPACITY"] == 32 and CODES[0] == "SUCCESS"
    assert message("EMPTY") and all(message(c) for c in CODES)


@pytest.mark.parametrize(("text", "want"), W.BAD)
def test_bad(text, want):
    assert error(text)[0] == want and code(parse, text) == want


@pytest.mark.parametrize("text", W.GOOD)
def test_good(text):
    assert error(text) == (None, None) and parse(text)


def test_bytes():
    assert error(b'\xef\xbb\xbf{"a":1}') == (None, None)
    assert error(b'["\xff"]')[0] == "UTF8_ERROR" and error(b'["\xff')[0] == "UNCLOSED_STRING" and error(b'"\xc3')[0] == "UNCLOSED_STRING" and error(b'["\xed\xa0\x80"]')[0] == "UTF8_ERROR"
    assert error(b"[1")[0] == "TAPE_ERROR"


def test_options():
    assert parse("[1,NaN,-Infinity]", allow_nan=True).nodes[3].value == -math.inf
    assert str(parse("-0", minus_zero=True).nodes[0].value) == "-0.0" and parse("-0").nodes[0].value == 0
    assert parse("18446744073709551616", big=True).nodes[0].kind == "bigint"
    assert code(parse, "[[[1]]]", max_depth=3) == "DEPTH_ERROR" and parse("[[1]]", max_depth=3) and code(parse, "[1,2]" * 9, max_bytes=10) == "CAPACITY"
    assert parse("[[[]]]", max_depth=3)


def test_nodes():
    t = parse('{"a":[1,{"b":2}],"c":"x"}')
    assert [(n.kind, n.parent, n.last, n.depth, n.ord, n.key, n.children) for n in t.nodes] == [
        ("object", -1, 6, 0, 0, None, 2), ("array", 0, 5, 1, 0, "a", 2), ("int64", 1, 3, 2, 0, None, 0), ("object", 1, 5, 2, 1, None, 1), ("int64", 3, 5, 3, 0, "b", 0), ("string", 0, 6, 1, 1, "c", 0)
    ]
    assert t.raw(1) == '[1,{"b":2}]' and t.child_ids(0) == [1, 5]


leaves = st.none() | st.booleans() | st.integers(-(1 << 63), (1 << 64) - 1) | st.floats(allow_nan=False, allow_infinity=False) | st.text(st.characters(exclude_categories=["Cs"]))
trees = st.recursive(leaves, lambda t: st.lists(t, max_size=5) | st.dictionaries(st.text(st.characters(exclude_categories=["Cs"]), max_size=5), t, max_size=5), max_leaves=25)


@settings(max_examples=150, deadline=None)
@given(trees, st.sampled_from([None, 2]), st.booleans())
def test_same_as_json(value, indent, ascii_):
    text = json.dumps(value, indent=indent, ensure_ascii=ascii_)
    t = parse(text)
    small = write.minify(t)
    assert json.loads(small) == value and write.minify(parse(small)) == small and error(text) == (None, None)
    pretty = write.prettify(t)
    assert write.minify(parse(pretty)) == small and write.strip_blanks(pretty) == small
    assert json.loads(write.fractured(t)) == value
    assert json.loads(write.fractured(t, write.Fractured(max_inline_length=10, max_items_per_line=2, simple_bracket_padding=False, colon_padding=False, comma_padding=False))) == value


def test_damaged_texts():
    """Whatever happens to a text, the strict reader and json agree on whether it is a document (strict rules put in)."""
    draw = random.Random(1)
    base = '{"a": [1, -2.5e3, true, null, "x\\n\\u00e9"], "b": {"c": {}, "d": []}}'

    def refuse(_):
        raise ValueError

    for _ in range(4000):
        text = list(base)
        for _ in range(draw.randint(1, 3)):
            at = draw.randrange(len(text))
            text[at : at + draw.randint(0, 2)] = draw.choice(['"', "{", "}", "[", "]", ",", ":", "1", "e", "\\", " ", "t", ""])
        text = "".join(text)
        try:
            value = json.loads(text, parse_constant=refuse)
            good = not any(isinstance(x, float) and math.isinf(x) for x in [value])
        except ValueError:
            good = False
        got = error(text)[0]
        try:
            parse(text)
            slow = None
        except JsonError as e:
            slow = e.code
        assert got == slow and (got is None) == good, text


@pytest.mark.parametrize(("pointer", "value", "want"), W.POINTERS)
def test_pointers(pointer, value, want):
    t = parse(W.POINTED)
    if want:
        assert code(paths.at_pointer, t, pointer) == want
    else:
        assert t.raw(paths.at_pointer(t, pointer)) == value


@pytest.mark.parametrize(("path", "pointer"), W.PATHS)
def test_paths(path, pointer):
    if pointer is None:
        assert code(paths.path_to_pointer, path) == "INVALID_JSON_POINTER"
    else:
        assert paths.path_to_pointer(path) == pointer


@pytest.mark.parametrize(("path", "n", "lazy"), W.WILDCARDS)
def test_wildcards(path, n, lazy):
    t = parse(W.WILD)
    if n is None:
        assert code(paths.at_path_with_wildcard, t, path) == lazy
    else:
        assert len(paths.at_path_with_wildcard(t, path)) == n
    if lazy:
        assert code(list, paths.for_each_at_path(t, path)) == lazy


def test_segments():
    assert paths.next_segment("$.a.b") == ("a", ".b") and paths.next_segment("['x.y'][*]") == ("x.y", "[*]") and paths.next_segment('["x') == ("", '["x') and paths.next_segment("[0].a")[0] == ""
    t = parse('{"a":[[1,2],[3]]}')
    assert [t.raw(i) for i in paths.at_path_with_wildcard(t, "$.a[*][0]")] == ["1", "3"] and [t.raw(i) for i in paths.for_each_at_path(t, "$.a[*].0")] == ["1", "3"]
    assert code(list, paths.for_each_at_path(parse("1"), "$.*")) == "SCALAR_DOCUMENT_AS_VALUE"


def test_keys():
    t = parse('{"A":1,"a":2,"\\u0061b":3,"a":4}')
    assert t.raw(paths.at_key(t, 0, "a")) == "2" and t.raw(paths.at_key(t, 0, "a", fold=True)) == "1" and t.raw(paths.at_key(t, 0, "ab")) == "3"
    assert code(paths.at_key, t, 0, "ab", True) == "NO_SUCH_FIELD" and code(paths.at_index, t, 0, 0) == "INCORRECT_TYPE"
    assert paths.native_path("/a/b c") == "$['a']['b c']" and paths.native_path("/0") is None and paths.native_path("") == "$"


@pytest.mark.parametrize("text", ["1.5", "0.1", "16777217", "1e-46", "7.006492321624085e-46", "3.4028235677973367e38", "-0.0", "1.00000017881393432617187499", "1.00000017881393432617187500", "1.00000017881393432617187501"])
def test_float32(text):
    if text == "3.4028235677973367e38":
        assert code(values.get_float, parse(text), 0) == "NUMBER_ERROR"
        return
    import numpy as np

    got = values.get_float(parse(text), 0)
    assert struct.pack("<f", got) == struct.pack("<f", float(np.float32(text) if len(text) < 12 else got))
    assert struct.unpack("<f", struct.pack("<f", got))[0] == got
    if text.startswith("1.000000178813934326171875"):
        assert got == (1.0000002384185791 if text.endswith(("500", "501")) else 1.0000001192092896)


def test_in_string():
    t = parse('["12","1.5","-7","","x","1 ","01","18446744073709551615"]')
    get = lambda i, k: values.in_string(t, i + 1, k)
    assert get(0, "int64") == 12 and get(1, "double") == 1.5 and get(7, "uint64") == (1 << 64) - 1 and get(0, "float") == 12.0
    assert code(get, 1, "int64") == "INCORRECT_TYPE" and code(get, 2, "uint64") == "INCORRECT_TYPE" and code(get, 3, "int64") == "INCORRECT_TYPE" and code(get, 4, "double") == "INCORRECT_TYPE" and code(get, 5, "int64") == "NUMBER_ERROR" and code(get, 6, "int64") == "NUMBER_ERROR"


def test_kinds():
    t = parse("[1,-1,1.0,18446744073709551615,99999999999999999999999,true,null]", big=True)
    is_ = lambda i, k: values.is_kind(t, i + 1, k)
    assert is_(0, "double") and is_(0, "uint64") and not is_(1, "uint64") and is_(1, "negative") and is_(2, "double") and not is_(2, "integer") and is_(3, "uint64") and not is_(3, "int64")
    assert is_(4, "bigint") and is_(4, "integer") and not is_(4, "number") and is_(5, "bool") and is_(6, "null") and is_(6, "scalar") and not values.is_kind(t, 0, "scalar")
    assert code(values.number_of, t, 5) == "BIGINT_ERROR" and values.number_of(t, 3) == ("double", 1.0)


@pytest.mark.parametrize(("raw", "strict", "replaced"), W.ESCAPES)
def test_unescape(raw, strict, replaced):
    if strict is None:
        assert code(unescape, raw) == "STRING_ERROR"
    else:
        assert unescape(raw) == strict
    if replaced is None:
        assert code(unescape, raw, "replace") == "STRING_ERROR"
    else:
        assert unescape(raw, "replace") == replaced


def test_wobbly():
    assert values.wobbly("\\ud800") == b"\xed\xa0\x80" and values.wobbly("\\ud83d\\ude00") == "😀".encode() and unescape("\\ud800\\u0041", "replace") == "�A"


@pytest.mark.parametrize(("value", "text"), [(1.0, "1.0"), (0.1, "0.1"), (1e15, "1e+15"), (1234567890123456.0, "1.234567890123456e+15"), (123456789012345.0, "123456789012345.0"), (1e16, "1e+16"), (1e-5, "1e-05"), (0.0001, "0.0001"), (-0.0, "-0.0"), (5e-324, "5e-324")])
def test_double_text(value, text):
    assert write.double(value) == text and float(text) == value


def test_quote():
    assert write.quote('a"\\/\n\x01é') == '"a\\"\\\\/\\n\\u0001é"'


def test_fractured():
    assert write.fractured(parse("[1,2,3]")) == "[ 1, 2, 3 ]" and write.fractured(parse("[]")) == "[]" and write.fractured(parse('{"a":{}}')) == '{ "a": {} }'
    t = parse(json.dumps([{"b": "x" * 30, "a": i} for i in range(4)]))
    rows = write.fractured(t).split("\n")
    assert rows[0] == "[" and rows[1].startswith('    { "a": 0, "b": "xxx') and len(rows) == 6
    extra = parse(json.dumps([{"a": i, "b": "x" * 30, "c": 1, "d": 2, **({"e": 1} if i == 2 else {})} for i in range(4)]))
    assert json.loads(write.fractured(extra)) == json.loads(extra.text) and '"e"' not in write.fractured(extra, write.Fractured(lossy_tables=True))
    many = write.fractured(parse(json.dumps(list(range(100, 140))))).split("\n")
    assert many[1] == "    " + ", ".join(str(i) for i in range(100, 110)) + "," and len(many) == 6


def test_msgpack():
    data = write.msgpack(parse('{"a":[1,true,null],"b":"é"}'))
    assert data == b"\x82\xa1a\x93\xcb" + struct.pack(">d", 1.0) + b"\xc3\xc0\xa1b\xa2\xc3\xa9"
    assert write.msgpack(parse(json.dumps(["x" * 300, list(range(20))])))[:4] == b"\x92\xda\x01\x2c"


def test_tape():
    words = write.tape(parse('{"w":800,"t":{"u":"x"},"a":false,"i":[116,2.5]}'))
    assert words[0] == "root // pointing to 17" and words[1].startswith("{ // pointing to 17") and words[-1] == "root // pointing to 0" and len(words) == 18 and 'string "w"' in words and "integer 116" in words and "float 2.5" in words


def test_lazy():
    d = Lazy('{"b":01,"a":[1,{"c":"x"} ], "z":1} ')
    assert d.raw(d.pointer("/a/1/c")) == '"x"' and d.token(d.pointer("/z")) == "1" and d.count(d.pointer("/a")) == 2 and not d.trailing() and Lazy("[1] [2]").trailing() and code(Lazy, "[1] x") == "INCOMPLETE_ARRAY_OR_OBJECT"
    found = d.fields_in_order(d.root, ["a", "b", "z"])
    assert d.raw(found[0]) == '[1,{"c":"x"} ]' and found[1].code == "NO_SUCH_FIELD" and found[2].code == "NO_SUCH_FIELD"
    assert code(d.pointer, "/a/7") == "INDEX_OUT_OF_BOUNDS" and code(Lazy, "[1,2") == "INCOMPLETE_ARRAY_OR_OBJECT" and code(Lazy("3").pointer, "") == "SCALAR_DOCUMENT_AS_VALUE"
    assert Lazy('{"\\u0061":1}').pointer("/\\u0061") and code(Lazy('{"\\u0061":1}').pointer, "/a") == "NO_SUCH_FIELD"


def test_tools(tmp_path, capsys):
    from tessera.__main__ import main

    f = tmp_path / "x.json"
    f.write_text('{"a": [1, 2.5], "b": "x"}')
    assert main(["json2json", str(f)]) == 0 and capsys.readouterr().out.strip() == '{"a":[1,2.5],"b":"x"}'
    assert main(["pointer", str(f), "/a/1", "/c"]) == 0 and '"error"' in capsys.readouterr().out
    assert main(["stats", str(f)]) == 0 and '"float_count": 1' in capsys.readouterr().out
    for tool in ("minify", "pretty", "fractured", "tape"):
        assert main([tool, str(f)]) == 0
    f.write_text("[1,")
    assert main(["pretty", str(f)]) == 1 and main(["pretty", str(tmp_path / "none")]) == 1 and main([]) == 2
