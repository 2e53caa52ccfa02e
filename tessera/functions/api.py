"""Column functions over JSON text.

Strict functions run in Arrow-batched Python and return a struct<value, error>: a value, or the code that says why there is
none. A missing key, a null and a malformed document stay three things. Native functions (names ending in _native, and those
whose results agree with the strict ones on every text) are expressions that stay in the JVM.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from decimal import Decimal

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

from . import batch as B
from . import batch_write, paths, values, write
from .errors import JsonError
from .lazy import Lazy
from .tree import Tree, error, parse, plain_value, unescape

#: Spark types of getters' values. Unsigned 64-bit integers don't fit a bigint.
TYPES = {
    "int64": "bigint", "uint64": "decimal(20,0)", "int32": "int", "uint32": "bigint", "double": "double", "float": "float", "bool": "boolean", "string": "string", "bigint": "string", "null": "string",
}


def _column(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _attempt(fn: Callable, *args) -> tuple[object, str | None]:
    try:
        return fn(*args), None
    except JsonError as e:
        return None, e.code


class _Last:
    """The tree of the last text: several functions of one column in a row read it once."""

    text: object = None
    options: tuple = ()
    tree: Tree | None = None

    @classmethod
    def get(cls, text, options: tuple) -> Tree:
        if cls.tree is None or cls.text is not text or cls.options != options:
            cls.tree = parse(text, **dict(options))
            cls.text, cls.options = text, options
        return cls.tree


class _Plain:
    """The value of the last text that the C decoder read. Getters try it first; what they don't find there is asked of the reader."""

    text: object = None
    value: tuple[bool, object] = (False, None)

    #: Kinds whose values are Python's own, and the types that stand for them.
    TYPES = {"int64": (int,), "double": (int, float), "string": (str,), "bool": (bool,)}

    @classmethod
    def get(cls, text, kind: str, keys: tuple[str, ...] | None) -> object:
        """The value that the keys lead to, or None where there is none, or none that is sure."""
        if keys is None or kind not in cls.TYPES:
            return None
        if cls.text is not text:
            cls.text, cls.value = text, plain_value(text)
        plain, value = cls.value
        if not plain:
            return None
        for key in keys:
            if type(value) is dict and key in value:
                value = value[key]
            elif type(value) is list and key.isdecimal() and key.isascii() and (key == "0" or key[0] != "0") and int(key) < len(value):
                value = value[int(key)]
            else:
                return None
        if type(value) not in cls.TYPES[kind]:
            return None
        return float(value) if kind == "double" else value

    @staticmethod
    def keys(pointer: str | None, dialect: str, options: tuple) -> tuple[str, ...] | None:
        """A pointer's keys, if it is one that plain values can be asked for."""
        if pointer is None or dialect != "dom" or options or not pointer.startswith("/") or "~" in pointer:
            return None
        return tuple(pointer[1:].split("/"))


def _struct(fn: Callable[[object], object], kind: str):
    """A strict function of one text as a column function with a struct<value, error> result."""

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            got = [_attempt(fn, t) if t is not None else (None, None) for t in texts]
            yield pd.DataFrame({"value": pd.Series([v for v, _ in got], dtype=object), "error": pd.Series([e for _, e in got], dtype=object)})

    return F.pandas_udf(run, f"value {kind}, error string")


#: Arrow types of getters' values, as TYPES has Spark's.
_ARROW = {
    "int64": pa.int64(), "uint64": pa.decimal128(20, 0), "int32": pa.int32(), "uint32": pa.int64(), "double": pa.float64(), "float": pa.float32(), "bool": pa.bool_(), "string": pa.string(),
    "bigint": pa.string(), "null": pa.string(),
}
#: Options under which batches are read as the reader of one document reads.
_KNOWN = {"big"}
_NEITHER = {"value": None, "error": None}


def _batched(c: Column | str, kind: pa.DataType, quick: Callable, fn: Callable[[object], object], options: tuple = ()) -> Column:
    """struct<value, error> by quick(Batch) for plain documents, by a strict function of one text for others."""

    def slow(t) -> dict:
        value, code = _attempt(fn, t)
        return {"value": value, "error": code}

    o = dict(options)
    return B.column(_column(c), B.result(kind), quick if set(o) <= _KNOWN else lambda _: None, slow, bool(o.get("big")), _NEITHER)


def _typed(batch: B.Batch, kind: str, at: np.ndarray, codes: np.ndarray) -> tuple[pa.Array, np.ndarray] | None:
    """Getters' values of nodes (below 0: none, with its code), and their codes; None for kinds that are read one by one."""
    there = at >= 0
    found = np.where(there, batch.kind[np.where(there, at, 0)], -1)
    place, codes = np.where(there, at, 0), codes.copy()
    if kind in ("int64", "int32", "uint32"):
        fits = found == B.INT64
        codes[found == B.UINT64] = "NUMBER_OUT_OF_RANGE"
        wrong = there & ~fits & (found != B.UINT64)
        low, high = {"int64": (-(1 << 63), (1 << 63) - 1), "int32": (-(1 << 31), (1 << 31) - 1), "uint32": (0, (1 << 32) - 1)}[kind]
        over = fits & ((batch.value[place] < low) | (batch.value[place] > high))
        codes[over] = "NUMBER_OUT_OF_RANGE"
        fits &= ~over
        value = pa.array(np.where(fits, batch.value[place], 0), _ARROW[kind], mask=~fits)
    elif kind == "uint64":
        fits = (found == B.UINT64) | (found == B.INT64) & (batch.value[place] >= 0)
        codes[(found == B.INT64) & ~fits] = "NUMBER_OUT_OF_RANGE"
        wrong = there & ~fits & (found != B.INT64)
        value = batch.raw(np.where(fits, at, -1)).cast(pa.decimal128(20, 0))
    elif kind == "double":
        fits = (found == B.INT64) | (found == B.UINT64) | (found == B.DOUBLE)
        wrong = there & ~fits
        value = pa.array(batch.real[place], mask=~fits)
    elif kind == "bool":
        fits = found == B.BOOL
        wrong = there & ~fits
        value = pa.array(batch.value[place] != 0, mask=~fits)
    elif kind == "string":
        fits = found == B.STRING
        wrong = there & ~fits
        value = batch.strings(np.where(fits, at, -1))
    elif kind == "bigint":
        fits = found == B.BIGINT
        wrong = there & ~fits
        value = batch.raw(np.where(fits, at, -1))
    elif kind == "float":
        fits = (found == B.INT64) | (found == B.UINT64) | (found == B.DOUBLE)
        wrong = there & ~fits
        value = batch.raw(np.where(fits, at, -1))
        seen: dict[str, float] = {}
        out = []
        for t in value.to_pylist():
            if t is not None and t not in seen:
                try:
                    seen[t] = values.nearest_float32(t)
                except JsonError:
                    return None
            out.append(None if t is None else seen[t])
        value = pa.array(out, pa.float32())
    else:
        return None
    codes[wrong] = "INCORRECT_TYPE"
    return value, codes


def _plain(fn: Callable[[object], object], kind: str):
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series([None if t is None else fn(t) for t in texts], dtype=object)

    return F.pandas_udf(run, kind)


def _options(options: dict) -> tuple:
    allowed = {"max_depth", "max_bytes", "big", "allow_nan", "minus_zero", "incomplete"}
    if bad := set(options) - allowed:
        raise ValueError(f"unknown options {sorted(bad)}")
    return tuple(sorted(options.items()))


# --- validation ---------------------------------------------------------------------------------------------------------


def json_error(c: Column | str, **options) -> Column:
    """The code of what is wrong with a document; null for a good one and for null."""
    o = dict(_options(options))
    return _plain(lambda t: error(t, **o)[0], "string")(_column(c))


def json_error_at(c: Column | str, **options) -> Column:
    """struct<code, at>: the code and the place, in code points, of what is wrong."""
    o = dict(_options(options))

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            got = [(None, None) if t is None else error(t, **o) for t in texts]
            yield pd.DataFrame({"code": pd.Series([g[0] for g in got], dtype=object), "at": pd.Series([g[1] for g in got], dtype=object)})

    return F.pandas_udf(run, "code string, at int")(_column(c))


def json_valid(c: Column | str, **options) -> Column:
    return json_error(c, **options).isNull() & _column(c).isNotNull()


def stage1_error(c: Column | str) -> Column:
    """What the first pass finds: strings, control characters, emptiness and encoding, but no grammar."""
    return _struct(lambda t: Lazy(t) and None, "string")(_column(c)).getField("error")


def utf8_valid(c: Column | str) -> Column:
    """Whether bytes are UTF-8. Native."""
    return F.is_valid_utf8(_column(c))


def has_trailing(c: Column | str) -> Column:
    """struct<value, error>: whether something follows the document's first value."""
    return _struct(lambda t: Lazy(t).trailing(), "boolean")(_column(c))


def strip_bom(c: Column | str) -> Column:
    """A text without its byte order mark. Native."""
    return F.regexp_replace(_column(c), "^\\uFEFF", "")


# --- navigation ---------------------------------------------------------------------------------------------------------


def _locate(pointer: str | None, path: str | None, dialect: str) -> Callable[[Tree], int]:
    if (pointer is None) == (path is None):
        raise ValueError("give a pointer or a path")
    raw = dialect == "ondemand"
    if dialect not in ("dom", "ondemand", "legacy"):
        raise ValueError("dialects are dom, ondemand and legacy")
    if dialect == "legacy" and pointer:  # the older form goes without the first slash
        pointer = "/" + pointer.removeprefix("/")
    if path is not None:
        return lambda tree: paths.at_path(tree, path, raw=raw)
    return lambda tree: paths.at_pointer(tree, pointer, raw=raw)


def json_raw(c: Column | str, pointer: str | None = None, path: str | None = None, dialect: str = "dom", **options) -> Column:
    """struct<value, error>: the text of the value that a pointer or path names, as written."""
    find, o = _locate(pointer, path, dialect), _options(options)

    def get(t):
        tree = _Last.get(t, o)
        return tree.raw(find(tree))

    def quick(batch: B.Batch):
        if pointer is None or dialect == "legacy" or dialect == "ondemand" and "~" in pointer:
            return None
        at, codes = batch.at_pointer(pointer)
        return B.struct(batch.raw(at), codes)

    return _batched(c, pa.string(), quick, get, o)


def json_get(c: Column | str, kind: str, pointer: str | None = None, path: str | None = None, dialect: str = "dom", **options) -> Column:
    """struct<value, error>: a typed value. kind: int64 uint64 int32 uint32 double float bool string bigint null."""
    if kind not in TYPES:
        raise ValueError(f"unknown kind {kind!r}")
    find, getter, wide = _locate(pointer, path, dialect), values.GETTERS[kind], kind == "uint64"
    o = _options({"big": kind == "bigint"} | options)
    keys = _Plain.keys(pointer, dialect, _options(options))

    def get(t):
        if (quick := _Plain.get(t, kind, keys)) is not None:
            return quick
        tree = _Last.get(t, o)
        value = getter(tree, find(tree))
        return Decimal(value) if wide else value

    def quick(batch: B.Batch):
        got = _typed(batch, kind, *batch.at_pointer(pointer)) if dialect == "dom" and pointer is not None else None
        return got and B.struct(*got)

    return _batched(c, _ARROW[kind], quick, get, o)


def json_get_in_string(c: Column | str, kind: str, pointer: str | None = None, path: str | None = None, dialect: str = "dom") -> Column:
    """struct<value, error>: a number that stands inside a string."""
    find, wide = _locate(pointer, path, dialect), kind == "uint64"

    def get(t):
        tree = _Last.get(t, ())
        value = values.in_string(tree, find(tree), kind)
        return Decimal(value) if wide else value

    return _struct(get, TYPES[kind])(_column(c))


def json_get_many(c: Column | str, fields: dict[str, tuple[str, str]], dialect: str = "dom", **options) -> Column:
    """One reading for many values: name -> (kind, pointer), as struct<name: struct<value, error>, ...>."""
    o = _options(options)
    plan = [(name, values.GETTERS[kind], _locate(pointer, None, dialect), kind == "uint64") for name, (kind, pointer) in fields.items()]
    quick = [(kind, _Plain.keys(pointer, dialect, o)) for kind, pointer in fields.values()]

    def one(t) -> list:
        plain = [(_Plain.get(t, kind, keys), None) for kind, keys in quick]
        if all(v is not None for v, _ in plain):
            return plain
        try:
            tree = _Last.get(t, o)
        except JsonError as e:
            return [(None, e.code)] * len(plan)
        got = [_attempt(lambda g=getter, f=find: g(tree, f(tree))) for _, getter, find, _ in plan]
        return [(Decimal(v), e) if wide and v is not None else (v, e) for (v, e), (_, _, _, wide) in zip(got, plan, strict=True)]

    kinds = pa.struct([(name, B.result(_ARROW[kind])) for name, (kind, _) in fields.items()])

    def slow(t) -> dict:
        return {name: {"value": v, "error": e} for name, (v, e) in zip(fields, one(t), strict=True)}

    def fast(batch: B.Batch):
        got = [_typed(batch, kind, *batch.at_pointer(pointer)) for kind, pointer in fields.values()]
        return None if any(g is None for g in got) else pa.StructArray.from_arrays([B.struct(*g) for g in got], list(fields))

    return B.column(_column(c), kinds, fast if dialect == "dom" and {k for k, _ in o} <= _KNOWN else lambda _: None, slow, bool(dict(o).get("big")), dict.fromkeys(fields, _NEITHER))


def json_pointers(c: Column | str, pointers: list[str], **options) -> Column:
    """array<struct<pointer, value, error>>: the texts that several pointers name."""
    o = _options(options)

    def one(t):
        tree, code = _attempt(_Last.get, t, o)
        out = []
        for p in pointers:
            value, why = _attempt(lambda p=p: tree.raw(paths.at_pointer(tree, p))) if tree else (None, code)
            out.append({"pointer": p, "value": value, "error": why})
        return out

    found = pa.struct([("pointer", pa.string()), ("value", pa.string()), ("error", pa.string())])

    def quick(batch: B.Batch):
        n, got = len(batch), [batch.at_pointer(p) for p in pointers]
        names = pa.concat_arrays([pa.array([p] * n, pa.string()) for p in pointers])
        every = pa.StructArray.from_arrays([names, pa.concat_arrays([batch.raw(at) for at, _ in got]), pa.array(np.concatenate([codes for _, codes in got]), pa.string())], ["pointer", "value", "error"])
        turn = np.arange(n * len(pointers)).reshape(len(pointers), n).T.ravel()
        return pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * len(pointers), pa.int32()), every.take(pa.array(turn)))

    return B.column(_column(c), pa.list_(found), quick if pointers and {k for k, _ in o} <= _KNOWN else lambda _: None, one, bool(dict(o).get("big")))


def json_wildcard(c: Column | str, path: str, dialect: str = "dom", **options) -> Column:
    """struct<value array<string>, error>: the texts that a path with wildcards names.

    In the "ondemand" dialect the values before the branch that failed are there, with its code.
    """
    o = _options(options)
    if dialect == "dom":

        def get(t):
            tree = _Last.get(t, o)
            return [tree.raw(i) for i in paths.at_path_with_wildcard(tree, path)]

        def every(batch: B.Batch):
            at = batch.at_wildcard(path)
            return None if at is None else B.struct(batch.lists(at, batch.raw(at)), np.full(len(batch), None, object))

        return _batched(c, pa.list_(pa.string()), every, get, o)

    def one(t):
        out: list[str] = []
        try:
            tree = _Last.get(t, o)
            for i in paths.for_each_at_path(tree, path):
                out.append(tree.raw(i))
        except JsonError as e:
            return out, e.code
        return out, None

    def quick(batch: B.Batch):
        if (got := batch.each_at_path(path)) is None or path in ("", "$"):
            return None
        at, failed = got
        return B.struct(batch.lists(at, batch.raw(at)), np.full(len(batch), None, object)), failed

    def slow(t) -> dict:
        value, code = one(t)
        return {"value": value, "error": code}

    return B.column(_column(c), B.result(pa.list_(pa.string())), quick if {k for k, _ in o} <= _KNOWN else lambda _: None, slow, bool(dict(o).get("big")), _NEITHER)


def json_at_key(c: Column | str, key: str, case_insensitive: bool = False, raw: bool = False) -> Column:
    """struct<value, error>: the text of the first value with a key. raw: keys are compared as they are written."""
    return _struct(lambda t: (tree := _Last.get(t, ())).raw(paths.at_key(tree, 0, key, raw, case_insensitive)), "string")(_column(c))


def json_at(c: Column | str, index: int) -> Column:
    """struct<value, error>: the text of an array's element."""

    def quick(batch: B.Batch):
        roots = batch.first[:-1]
        arrays = batch.kind[roots] == B.ARRAY
        at = np.where(arrays, batch.child_at_index(roots, index), -1)
        return B.struct(batch.raw(at), np.where(at >= 0, None, np.where(arrays, "INDEX_OUT_OF_BOUNDS", "INCORRECT_TYPE").astype(object)))

    return _batched(c, pa.string(), quick, lambda t: (tree := _Last.get(t, ())).raw(paths.at_index(tree, 0, index)))


def json_find_fields(c: Column | str, keys: list[str]) -> Column:
    """array<struct<key, value, error>>: keys looked for in the order given, without going back."""

    def one(t):
        lazy, code = _attempt(Lazy, t)
        places = _attempt(lambda: lazy.fields_in_order(lazy.root, keys)) if lazy else (None, code)
        if places[1]:
            return [{"key": k, "value": None, "error": places[1]} for k in keys]
        return [{"key": k, "value": None if isinstance(p, JsonError) else lazy.raw(p), "error": p.code if isinstance(p, JsonError) else None} for k, p in zip(keys, places[0], strict=True)]

    return _plain(one, "array<struct<key:string,value:string,error:string>>")(_column(c))


def json_touch(c: Column | str, pointer: str, incomplete: bool = False) -> Column:
    """struct<value, error>: as json_raw, but only what the pointer touches is checked. incomplete: documents may be cut off."""
    return _struct(lambda t: (lazy := Lazy(t, incomplete)).raw(lazy.pointer(pointer)), "string")(_column(c))


# --- kinds --------------------------------------------------------------------------------------------------------------


def json_type(c: Column | str, pointer: str = "", **options) -> Column:
    """struct<value, error>: array object string int64 uint64 double bigint bool null."""
    o = _options(options)

    def quick(batch: B.Batch):
        at, codes = batch.at_pointer(pointer)
        kinds = np.array([*B.KINDS, None], object)
        return B.struct(pa.array(kinds[np.where(at >= 0, batch.kind[at], len(B.KINDS))], pa.string()), codes)

    return _batched(c, pa.string(), quick, lambda t: (tree := _Last.get(t, o)).nodes[paths.at_pointer(tree, pointer)].kind, o)


def json_type_coarse(c: Column | str) -> Column:
    """array object number string boolean null unknown, by the first character. Native."""
    first = F.substring(F.ltrim(_column(c), F.lit(" \t\n\r")), 1, 1)
    out = F.when(first.rlike("[-0-9]"), "number")
    for marks, kind in (("{", "object"), ("[", "array"), ('"', "string"), ("tf", "boolean"), ("n", "null")):
        out = out.when(first.isin(*marks), kind)
    return F.when(_column(c).isNotNull(), out.otherwise("unknown"))


def json_is(c: Column | str, kind: str, pointer: str = "") -> Column:
    """struct<value, error>: whether a value has a kind, that is, whether its getter would succeed."""
    if kind not in values.GETTERS and kind not in ("object", "array", "number", "scalar", "integer", "negative"):
        raise ValueError(f"unknown kind {kind!r}")
    return json_are(c, {"one": (kind, pointer)})["one"]


def json_are(c: Column | str, tests: dict[str, tuple[str, str]]) -> Column:
    """One reading for many tests of kinds: name -> (kind, pointer), as struct<name: struct<value, error>, ...>."""
    big = (("big", True),)

    def quick(batch: B.Batch):
        out = []
        for kind, pointer in tests.values():
            at, codes = batch.at_pointer(pointer)
            there = at >= 0
            place = np.where(there, at, 0)
            found = batch.kind[place]
            if kind in ("object", "array", "string", "int64", "double", "bool", "bigint", "null"):
                hit = found == B.KINDS.index(kind)
                if kind == "double":  # whose getter takes integers too
                    hit |= (found == B.INT64) | (found == B.UINT64)
            elif kind == "number":
                hit = (found == B.INT64) | (found == B.UINT64) | (found == B.DOUBLE)
            elif kind == "scalar":
                hit = found > B.ARRAY
            elif kind == "integer":
                hit = (found == B.INT64) | (found == B.UINT64) | (found == B.BIGINT)
            elif kind == "negative":
                hit = batch.data[batch.start[place]] == ord("-")
            else:
                return None
            out.append(B.struct(pa.array(hit, mask=~there), codes))
        return pa.StructArray.from_arrays(out, list(tests))

    def slow(t) -> dict:
        tree, code = _attempt(_Last.get, t, big)
        out = {}
        for name, (kind, pointer) in tests.items():
            value, why = _attempt(lambda k=kind, p=pointer: values.is_kind(tree, paths.at_pointer(tree, p), k)) if tree else (None, code)
            out[name] = {"value": value, "error": why}
        return out

    return B.column(_column(c), pa.struct([(name, B.result(pa.bool_())) for name in tests]), quick, slow, True, dict.fromkeys(tests, _NEITHER))


def json_is_integer_text(c: Column | str) -> Column:
    """Whether a scalar's text is digits alone. Native."""
    return _column(c).rlike("^-?[0-9]+$")


def json_number(c: Column | str, pointer: str = "") -> Column:
    """struct<kind, i64, u64, f64, raw, error>: the dynamic number."""

    def one(t):
        try:
            tree = _Last.get(t, (("big", True),))
            i = paths.at_pointer(tree, pointer)
            raw = tree.raw(i)
            kind, value = values.number_of(tree, i)
        except JsonError as e:
            return (None, None, None, None, raw if e.code == "BIGINT_ERROR" else None, e.code)
        return (kind, value if kind == "int64" else None, Decimal(value) if kind == "uint64" else None, value if kind == "double" else None, raw, None)

    names = ("kind", "i64", "u64", "f64", "raw", "error")

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            rows = [one(t) if t is not None else (None,) * 6 for t in texts]
            yield pd.DataFrame({n: pd.Series([r[i] for r in rows], dtype=object) for i, n in enumerate(names)})

    return F.pandas_udf(run, "kind string, i64 bigint, u64 decimal(20,0), f64 double, raw string, error string")(_column(c))


def json_unescape(c: Column | str, lone: str = "error") -> Column:
    """struct<value, error>: a raw string's content. lone: error or replace (U+FFFD) half surrogates."""
    if lone not in ("error", "replace"):
        raise ValueError("lone is error or replace")
    return _struct(lambda t: unescape(t, lone), "string")(_column(c))


def json_wobbly(c: Column | str) -> Column:
    """struct<value binary, error>: a raw string's content as WTF-8, with half surrogates kept."""
    return _struct(values.wobbly, "binary")(_column(c))


def json_quote(c: Column | str) -> Column:
    """A string in quotes with what must be escaped escaped. Native."""
    one = F.to_json(F.struct(_column(c).alias("v")))
    return F.when(_column(c).isNotNull(), F.substring(one, F.lit(6), F.length(one) - 6))


# --- collections --------------------------------------------------------------------------------------------------------


def json_each(c: Column | str, pointer: str = "", **options) -> Column:
    """struct<value array<struct<ord, key, raw_key, kind, raw>>, error>: children in document order, repeated keys kept."""
    o = _options(options)

    def get(t):
        tree = _Last.get(t, o)
        i = paths.at_pointer(tree, pointer)
        if tree.nodes[i].kind not in ("object", "array"):
            raise JsonError("INCORRECT_TYPE")
        return [{"ord": (n := tree.nodes[x]).ord, "key": n.key, "raw_key": n.raw_key, "kind": n.kind, "raw": tree.raw(x)} for x in tree.child_ids(i)]

    return _struct(get, "array<struct<ord:int,key:string,raw_key:string,kind:string,raw:string>>")(_column(c))


def json_size(c: Column | str, pointer: str = "") -> Column:
    """struct<value, error>: how many elements or fields."""

    def get(t):
        tree = _Last.get(t, ())
        node = tree.nodes[paths.at_pointer(tree, pointer)]
        if node.kind not in ("object", "array"):
            raise JsonError("INCORRECT_TYPE")
        return node.children

    def quick(batch: B.Batch):
        return _sized(batch, pointer)

    return _batched(c, pa.int32(), quick, get)


def _sized(batch: B.Batch, pointer: str) -> pa.Array:
    at, codes = batch.at_pointer(pointer)
    held = (at >= 0) & (batch.kind[at] <= B.ARRAY)
    codes[(at >= 0) & ~held] = "INCORRECT_TYPE"
    return B.struct(pa.array(np.where(held, batch.children[at], 0), pa.int32(), mask=~held), codes)


def _slotted(batch: B.Batch, pointer: str) -> pa.Array:
    at, codes = batch.at_pointer(pointer)
    return B.struct(pa.array(np.where(at >= 0, batch.last[at] - at - 1, 0), pa.int32(), mask=at < 0), codes)


def json_sizes(c: Column | str, sizes: dict[str, str], slots: dict[str, str]) -> Column:
    """One reading for many of json_size and json_slots: name -> pointer, as struct<name: struct<value, error>, ...>."""

    def quick(batch: B.Batch):
        return pa.StructArray.from_arrays([*(_sized(batch, p) for p in sizes.values()), *(_slotted(batch, p) for p in slots.values())], [*sizes, *slots])

    def slow(t) -> dict:
        tree, code = _attempt(_Last.get, t, ())
        out = {}
        for name, pointer in [*sizes.items(), *slots.items()]:
            i, why = _attempt(paths.at_pointer, tree, pointer) if tree else (None, code)
            value = None
            if i is not None and name in slots:
                value = tree.nodes[i].last - i - 1
            elif i is not None:
                held = tree.nodes[i].kind in ("object", "array")
                value, why = (tree.nodes[i].children, None) if held else (None, "INCORRECT_TYPE")
            out[name] = {"value": value, "error": why}
        return out

    names = [*sizes, *slots]
    return B.column(_column(c), pa.struct([(name, B.result(pa.int32())) for name in names]), quick, slow, False, dict.fromkeys(names, _NEITHER))


def json_size_native(c: Column | str) -> Column:
    """How many elements or fields a good document has; null for a scalar. Native; repeated keys count each."""
    column = _column(c)
    return F.when(json_type_coarse(column) == "array", F.json_array_length(column)).when(json_type_coarse(column) == "object", F.size(F.json_object_keys(column)))


def json_slots(c: Column | str, pointer: str = "") -> Column:
    """struct<value, error>: how many nodes a subtree has below its root."""
    return _batched(c, pa.int32(), lambda batch: _slotted(batch, pointer), lambda t: (n := (tree := _Last.get(t, ())).nodes[(i := paths.at_pointer(tree, pointer))]).last - i - 1)


# --- texts --------------------------------------------------------------------------------------------------------------


def _good(text: pa.Array) -> pa.Array:
    return B.struct(text, np.full(len(text), None, object))


def json_minify(c: Column | str, **options) -> Column:
    """struct<value, error>: the document in the fewest characters, numbers in shortest form, keys in order."""
    o = _options({"big": True} | options)
    return _batched(c, pa.string(), lambda batch: _good(batch_write.minify(batch)), lambda t: write.minify(_Last.get(t, o)), o)


def json_prettify(c: Column | str, step: int = 4, **options) -> Column:
    """struct<value, error>: one value a line, indented."""
    o = _options({"big": True} | options)
    return _batched(c, pa.string(), lambda batch: _good(batch_write.prettify(batch, step)), lambda t: write.prettify(_Last.get(t, o), step=step), o)


def json_fractured(c: Column | str, layout: write.Fractured | None = None) -> Column:
    """struct<value, error>: the human layout, with short parts on one line and uniform rows as a table."""
    layout = layout or write.Fractured()

    def quick(batch: B.Batch):
        text, left = batch_write.fractured(batch, layout)
        return _good(text), left

    return _batched(c, pa.string(), quick, lambda t: write.fractured(_Last.get(t, (("big", True),)), layout), (("big", True),))


def json_strip(c: Column | str) -> Column:
    """White space outside strings removed without parsing; null where a string has no end. Native."""
    column = _column(c)
    bare = F.regexp_replace(column, r'("[^"\\]*+(?:\\[\s\S][^"\\]*+)*+")|[ \t\n\r]++', "$1")
    unescaped = F.regexp_replace(column, r"\\[\s\S]", "")
    open_ = (F.length(unescaped) - F.length(F.replace(unescaped, F.lit('"'), F.lit("")))) % 2 == 1
    return F.when(~open_, bare)


def json_msgpack(c: Column | str) -> Column:
    """struct<value binary, error>: MessagePack, numbers as 64-bit floats."""
    return _struct(lambda t: write.msgpack(_Last.get(t, ())), "binary")(_column(c))


def json_tape(c: Column | str) -> Column:
    """struct<value array<string>, error>: one word a value, key and end of a container."""
    return _struct(lambda t: write.tape(_Last.get(t, ())), "array<string>")(_column(c))


# --- encoding -----------------------------------------------------------------------------------------------------------


def to_json_text(*columns: Column | str) -> Column:
    """A row's columns as a JSON object with nulls written. Native."""
    return F.to_json(F.struct(*columns), {"ignoreNullFields": "false"})


def schema_of_literal(text: str):
    """The type of a literal document, found before any data are read. Roots are objects or arrays, arrays are uniform."""
    tree = parse(text)
    if tree.nodes[0].kind not in ("object", "array"):
        raise ValueError("the root must be an object or an array")

    def of(i: int) -> str:
        node = tree.nodes[i]
        if node.kind == "object":
            return "struct<" + ",".join(f"`{tree.nodes[x].key}`:{of(x)}" for x in tree.child_ids(i)) + ">"
        if node.kind == "array":
            kinds = {of(x) for x in tree.child_ids(i)}
            if len(kinds) > 1:
                raise ValueError("an array holds values of several types")
            return f"array<{kinds.pop() if kinds else 'string'}>"
        return {"int64": "bigint", "uint64": "decimal(20,0)", "double": "double", "bool": "boolean", "string": "string", "null": "string"}[node.kind]

    return of(0)


def literal(text: str) -> Column:
    """A literal document as a typed column."""
    parse(text)
    return F.from_json(F.lit(json.dumps(json.loads(text))), schema_of_literal(text))
