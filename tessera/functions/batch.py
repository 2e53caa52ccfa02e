"""Many documents read at once: the strict reader's nodes as arrays, for the documents that are plain.

A document is plain if it is acceptable and has no backslash, no byte order mark, no exponent of three digits and at most DEEP
levels. All others, the wrong ones among them, are left to the reader of one document, so results and codes are the same.
Texts are handled in slices of about SLICE bytes, whatever the size of the batches that Spark hands over.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

from .errors import JsonError
from .tree import number

#: Text that is read at once; arrays of some 40 bytes a byte are made for it.
SLICE = 1 << 19
DEEP = 64
OBJECT, ARRAY, STRING, INT64, UINT64, DOUBLE, BIGINT, BOOL, NULL = range(9)
KINDS = ("object", "array", "string", "int64", "uint64", "double", "bigint", "bool", "null")

_OTHER, _BLANK, _QUOTE, _CONTROL, _OPEN_OBJECT, _OPEN_ARRAY, _CLOSE_OBJECT, _CLOSE_ARRAY, _COMMA, _COLON = range(10)
_CLASS = np.zeros(256, np.uint8)
_CLASS[:32] = _CONTROL
for _marks, _class in ((" \t\n\r", _BLANK), ('"', _QUOTE), ("{", _OPEN_OBJECT), ("[", _OPEN_ARRAY), ("}", _CLOSE_OBJECT), ("]", _CLOSE_ARRAY), (",", _COMMA), (":", _COLON)):
    for _mark in _marks:
        _CLASS[ord(_mark)] = _class
_DELTA = np.array([0, 0, 0, 0, 1, 1, -1, -1, 0, 0], np.int32)
#: Such doubles can't be infinite.
_FRACTION = r"^-?(0|[1-9][0-9]*)(\.[0-9]+([eE][+-]?[0-9]{1,2})?|[eE][+-]?[0-9]{1,2})$"


def content(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of an array of texts without nulls, and where each begins, the end included."""
    texts = texts.cast(pa.large_string())
    if not len(texts):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = texts.buffers()
    at = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None else np.zeros(0, np.uint8)
    return data, at - at[0]


def gather(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pieces of some bytes one behind the other, and where each begins, the end included."""
    at = np.zeros(len(sizes) + 1, np.int64)
    np.cumsum(sizes, out=at[1:])
    places = np.arange(at[-1], dtype=np.int64)
    places += np.repeat(starts - at[:-1], sizes)
    return data[places], at


def texts_of(data: np.ndarray, at: np.ndarray, kind: pa.DataType | None = None) -> pa.Array:
    return pa.Array.from_buffers(kind or pa.string(), len(at) - 1, [None, pa.py_buffer(at.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(data))])


class Batch:
    """The nodes of the plain documents of an array of texts, in document order.

    plain: which texts they are. first: the number of each one's first node, and the count of all. For each node: kind, doc (the
    how-manieth plain text), start, end (in data), key_start, key_end (-1 without a key), parent (-1 for roots), depth, ord,
    last, children and value (of int64, double and bool; as int64 and double).
    """

    def __init__(self, texts: pa.Array, big: bool = True):
        keep = np.asarray(pc.fill_null(pc.invert(pc.match_substring(texts, "\\")), False).to_numpy(zero_copy_only=False), bool)
        while True:
            self.data, self.at = content(texts.filter(pa.array(keep)))
            bad = self._read(big)
            if not bad.any():
                break
            keep[np.flatnonzero(keep)[bad]] = False
        self.plain = keep

    def __len__(self) -> int:
        return len(self.at) - 1

    def _read(self, big: bool) -> np.ndarray:
        """Which texts are not plain; if there are none, the nodes are there."""
        data, at, n = self.data, self.at, len(self)
        bad = np.diff(at) == 0
        if bad.any() or not n:
            if not n:
                self._empty()
            return bad
        of = lambda places: np.searchsorted(at, places, "right") - 1
        cls = _CLASS[data]
        bad[of(np.flatnonzero(cls == _CONTROL))] = True
        quotes = np.flatnonzero(cls == _QUOTE)
        bad |= np.diff(np.searchsorted(quotes, at)) % 2 == 1
        if bad.any():
            return bad
        opening, closing = quotes[0::2], quotes[1::2]
        inside = np.zeros(len(data), np.int8)
        inside[opening], inside[closing] = 1, -1
        np.cumsum(inside, out=inside)
        inside = inside.view(bool)
        bad[of(np.flatnonzero(inside & (cls == _BLANK) & (data != 32)))] = True
        if bad.any():
            return bad
        bare = (cls == _OTHER) & ~inside
        begins, ends = bare.copy(), bare.copy()
        begins[1:] &= ~bare[:-1]
        ends[:-1] &= ~bare[1:]
        begins[at[:-1]], ends[at[1:] - 1] = bare[at[:-1]], bare[at[1:] - 1]
        token = (cls >= _OPEN_OBJECT) & ~inside
        token |= begins
        token[opening] = True
        pos = np.flatnonzero(token)
        self.pos, self.type = pos, (t := cls[pos])
        stop = pos + 1
        stop[t == _QUOTE], stop[t == _OTHER] = closing + 1, np.flatnonzero(ends) + 1
        self.stop = stop
        firsts = np.searchsorted(pos, at)
        counts = np.diff(firsts)
        bad |= counts == 0
        if bad.any():
            return bad
        doc = np.repeat(np.arange(n), counts)
        self.token_doc = doc
        delta = _DELTA[t]
        level = np.cumsum(delta)
        level -= np.repeat(level[firsts[:-1]] - delta[firsts[:-1]], counts)
        opens, closes = delta > 0, delta < 0
        bad |= (level[firsts[1:] - 1] != 0) | (np.minimum.reduceat(level, firsts[:-1]) < 0) | (np.maximum.reduceat(level, firsts[:-1]) > DEEP)
        if bad.any():
            return bad
        level -= opens
        self.level = level
        holder = np.full(len(pos), -1, np.int64)  # the container of a token; of a closing mark, the one that it closes
        for depth in range(1, int(level.max(initial=0)) + 2):
            some = np.flatnonzero((level == depth) | ((level == depth - 1) & (opens | closes)))
            above = level[some] == depth - 1
            start = above & opens[some]
            last = some[np.maximum.accumulate(np.where(start, np.arange(len(some)), 0))] if len(some) else some
            holder[some[~start]] = last[~start]
        self.holder = holder
        held = np.where(holder >= 0, t[holder], 0)
        before, after = np.empty(len(t), np.int8), np.empty(len(t), np.int8)
        before[1:], after[:-1] = t[:-1], t[1:]
        before[firsts[:-1]], after[firsts[1:] - 1] = -1, -1
        is_key = (t == _QUOTE) & (after == _COLON)
        done = np.zeros(len(t), bool)  # what stands before a token is a value's end
        done[1:] = ((t == _OTHER) | closes | (t == _QUOTE) & ~is_key)[:-1]
        done[firsts[:-1]] = False
        is_value = (t == _OTHER) | opens | (t == _QUOTE) & ~is_key
        in_object, in_array = (held == _OPEN_OBJECT) & ~closes, (held == _OPEN_ARRAY) & ~closes
        good = is_key & in_object & ((before == _OPEN_OBJECT) | (before == _COMMA))
        good |= (t == _COLON) & (before == _QUOTE) & (holder >= 0)
        good |= (t == _COMMA) & (holder >= 0) & done
        good |= is_value & np.where(in_object, before == _COLON, np.where(in_array, (before == _OPEN_ARRAY) | (before == _COMMA), before == -1))
        good |= (t == _CLOSE_OBJECT) & (held == _OPEN_OBJECT) & ((before == _OPEN_OBJECT) | done)
        good |= (t == _CLOSE_ARRAY) & (held == _OPEN_ARRAY) & ((before == _OPEN_ARRAY) | done)
        bad[doc[~good]] = True
        if bad.any():
            return bad
        kind, value, real, wrong = self._scalars(np.flatnonzero(t == _OTHER), big)
        bad[doc[wrong]] = True
        if bad.any():
            return bad

        self.is_node, ids = is_value, np.flatnonzero(is_value)
        self.tokens, self.doc, self.depth = ids, doc[ids], level[ids].astype(np.int32)
        number_of = np.cumsum(is_value) - 1
        self.node_of = number_of
        self.kind = np.array([_OTHER, 0, STRING, 0, OBJECT, ARRAY, 0, 0, 0, 0], np.int8)[t[ids]]
        self.value, self.real = np.zeros(len(ids), np.int64), np.zeros(len(ids))
        bare_nodes = number_of[t == _OTHER]
        self.kind[bare_nodes], self.value[bare_nodes], self.real[bare_nodes] = kind, value, real
        self.start, self.end = pos[ids], stop[ids]
        self.last = np.arange(1, len(ids) + 1)
        shut = np.flatnonzero(closes)
        whose = number_of[holder[shut]]
        self.end[whose], self.last[whose] = pos[shut] + 1, number_of[shut] + 1
        self.close = np.full(len(ids), -1, np.int64)  # the token that closes a container
        self.close[whose] = shut
        holders = holder[ids]
        self.parent = np.where(holders >= 0, number_of[holders], -1)
        keyed = held[ids] == _OPEN_OBJECT
        self.key_start, self.key_end = np.full(len(ids), -1, np.int64), np.full(len(ids), -1, np.int64)
        keys = ids[keyed] - 2
        self.key_start[keyed], self.key_end[keyed] = pos[keys] + 1, stop[keys] - 1
        self.children = np.bincount(self.parent[self.parent >= 0], minlength=len(ids)).astype(np.int32)
        self.ord = np.zeros(len(ids), np.int32)
        for depth in range(1, int(self.depth.max(initial=0)) + 1):
            some = np.flatnonzero(self.depth == depth)
            new = np.ones(len(some), bool)
            new[1:] = np.diff(self.parent[some]) != 0
            here = np.arange(len(some))
            self.ord[some] = here - np.maximum.accumulate(np.where(new, here, 0))
        self.first = np.searchsorted(self.doc, np.arange(n + 1))
        return bad

    def _empty(self) -> None:
        none = np.zeros(0, np.int64)
        self.pos = self.stop = self.type = self.token_doc = self.level = self.holder = self.tokens = self.doc = self.depth = self.node_of = self.value = self.start = self.end = self.last = self.close = self.parent = none
        self.key_start = self.key_end = self.children = self.ord = none
        self.kind, self.real, self.is_node, self.first = np.zeros(0, np.int8), np.zeros(0), np.zeros(0, bool), np.zeros(1, np.int64)

    def _scalars(self, ids: np.ndarray, big: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Kinds and values of tokens that are neither marks nor strings, and the tokens that are not plain."""
        size = self.stop[ids] - self.pos[ids]
        kind, value, real = np.full(len(ids), -1, np.int8), np.zeros(len(ids), np.int64), np.zeros(len(ids))
        if not len(ids):
            return kind, value, real, ids
        data, at = gather(self.data, self.pos[ids], size)
        minus = data[at[:-1]] == ord("-")
        strange = np.add.reduceat(((data < 48) | (data > 57)).astype(np.int32), at[:-1])
        digits = size - minus
        lead = data[np.minimum(at[:-1] + minus, len(data) - 1)]
        integer = (strange == minus) & (digits > 0) & ((lead != 48) | (digits == 1))
        texts = texts_of(data, at, pa.binary())
        short = integer & (size < 19)
        some = np.flatnonzero(short)
        kind[some] = INT64
        value[some] = texts.take(pa.array(some)).cast(pa.string()).cast(pa.int64()).to_numpy()
        real[some] = value[some]
        for i in np.flatnonzero(integer & ~short):
            name, v = number(texts[i].as_py().decode())
            if name == "bigint" and not big:
                continue
            kind[i], value[i], real[i] = KINDS.index(name), v if name == "int64" else 0, float(v) if name != "bigint" else 0
        rest = np.flatnonzero(~integer)
        others = texts.take(pa.array(rest))
        for text, code, truth in ((b"true", BOOL, 1), (b"false", BOOL, 0), (b"null", NULL, 0)):
            hit = rest[np.asarray(pc.equal(others, text))]
            kind[hit], value[hit] = code, truth
        fraction = np.asarray(pc.match_substring_regex(others, _FRACTION)) & (size[rest] < 100)
        hit = rest[fraction]
        kind[hit] = DOUBLE
        real[hit] = others.filter(pa.array(fraction)).cast(pa.string()).cast(pa.float64()).to_numpy()
        return kind, value, real, ids[kind < 0]

    # --- asking -------------------------------------------------------------------------------------------------------

    def raw(self, nodes: np.ndarray) -> pa.Array:
        """The texts of nodes, as they are written; null for numbers below 0."""
        there = nodes >= 0
        nodes = np.where(there, nodes, 0)
        if not len(self.start):
            return pa.nulls(len(nodes), pa.string())
        return self._texts(self.start[nodes], np.where(there, self.end[nodes] - self.start[nodes], 0), there)

    def strings(self, nodes: np.ndarray) -> pa.Array:
        """The contents of nodes that are strings; null for others."""
        there = nodes >= 0
        nodes = np.where(there, nodes, 0)
        if not len(self.start):
            return pa.nulls(len(nodes), pa.string())
        there &= self.kind[nodes] == STRING
        return self._texts(self.start[nodes] + 1, np.where(there, self.end[nodes] - self.start[nodes] - 2, 0), there)

    def keys(self, nodes: np.ndarray) -> pa.Array:
        start = self.key_start[nodes]
        return self._texts(start, np.where(start >= 0, self.key_end[nodes] - start, 0), start >= 0)

    def _texts(self, starts: np.ndarray, sizes: np.ndarray, there: np.ndarray) -> pa.Array:
        data, at = gather(self.data, starts, sizes)
        out = texts_of(data, at)
        return out if there.all() else pc.if_else(pa.array(there), out, pa.scalar(None, pa.string()))

    def with_key(self, key: str) -> np.ndarray:
        """The nodes that have a key."""
        name = key.encode("utf-8", "surrogatepass")
        some = np.flatnonzero((self.key_start >= 0) & (self.key_end - self.key_start == len(name)))
        for i, byte in enumerate(name):
            some = some[self.data[self.key_start[some] + i] == byte]
        return some

    def child_at_key(self, nodes: np.ndarray, key: str) -> np.ndarray:
        """The first child with a key of each node, or -1."""
        found, some = np.full(len(self.kind) + 1, -1, np.int64), self.with_key(key)[::-1]
        found[self.parent[some]] = some
        return found[nodes]

    def child_at_index(self, nodes: np.ndarray, index: int) -> np.ndarray:
        found, some = np.full(len(self.kind) + 1, -1, np.int64), np.flatnonzero((self.ord == index) & (self.parent >= 0))
        found[self.parent[some]] = some
        return found[nodes]

    def child_ids(self, nodes: np.ndarray) -> np.ndarray:
        """The children of nodes that don't hold one another, in document order."""
        chosen = np.zeros(len(self.kind) + 1, bool)
        chosen[nodes] = True
        chosen[-1] = False
        return np.flatnonzero(chosen[self.parent])

    def at_pointer(self, pointer: str, nodes: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """The node that a pointer names in each document, or -1, and the code of why there is none."""
        from .paths import _well_formed, pointer_index, pointer_key

        at = (self.first[:-1] if nodes is None else nodes).copy()
        codes = np.full(len(at), None, object)

        def fail(which: np.ndarray, code: str) -> None:
            codes[which], at[which] = code, -1

        while pointer:
            live = np.flatnonzero(at >= 0)
            kind = self.kind[at[live]]
            fail(live[kind > ARRAY], "NO_SUCH_FIELD" if _well_formed(pointer) else "INVALID_JSON_POINTER")
            token, slash, rest = pointer[1:].partition("/")
            for which, code in ((live[kind == OBJECT], "NO_SUCH_FIELD"), (live[kind == ARRAY], "INDEX_OUT_OF_BOUNDS")):
                try:
                    if pointer[0] != "/":
                        raise JsonError("INVALID_JSON_POINTER")
                    if code == "NO_SUCH_FIELD":
                        found = self.child_at_key(at[which], pointer_key(token))
                    else:
                        if pointer == "/-":
                            raise JsonError("INDEX_OUT_OF_BOUNDS")
                        found = self.child_at_index(at[which], pointer_index(token if token != "-" else "x"))
                except JsonError as e:
                    fail(which, e.code)
                    continue
                at[which] = found
                fail(which[found < 0], code)
            pointer = slash + rest
        return at, codes

    def at_wildcard(self, path: str) -> np.ndarray | None:
        """All nodes that a path with a wildcard names, branches that fail left out; None for paths that are not simple enough."""
        from .paths import next_segment, path_to_pointer

        at = self.first[:-1]
        body = path.removeprefix("$")
        if "*" not in body or body[:1] not in (".", "["):
            return None
        try:
            while True:
                at = at[self.kind[at] <= ARRAY]
                if "*" not in body:
                    found, _ = self.at_pointer(path_to_pointer(body), at)
                    return found[found >= 0]
                if body in ("[*]", ".*"):
                    return self.child_ids(at)
                key, rest = next_segment(body)
                if not key or rest[:1] not in (".", "[") or body.startswith("$"):
                    return None
                at = self.child_ids(at) if key == "*" else (found := self.at_pointer("/" + key, at)[0])[found >= 0]
                body = rest
        except JsonError:
            return None

    def each_at_path(self, path: str) -> tuple[np.ndarray, np.ndarray] | None:
        """The nodes that a path names, and the documents in which a branch fails; None for paths that are not simple enough."""
        from .paths import next_segment, pointer_index

        at, failed = self.first[:-1], np.zeros(len(self), bool)
        body = path.removeprefix("$")
        while body:
            if body[0] not in ".[":
                return None
            failed[self.doc[at[self.kind[at] > ARRAY]]] = True
            at = at[self.kind[at] <= ARRAY]
            key, rest = next_segment(body)
            if not key:
                return None
            if key == "*":
                at = self.child_ids(at)
            else:
                found = self.child_at_key(at, key)
                arrays = self.kind[at] == ARRAY
                if arrays.any():
                    try:
                        found[arrays] = self.child_at_index(at[arrays], pointer_index(key))
                    except JsonError:
                        found[arrays] = -1
                failed[self.doc[at[found < 0]]] = True
                at = found[found >= 0]
            body = rest
        return at, failed

    def lists(self, nodes: np.ndarray, values: pa.Array) -> pa.Array:
        """One list a document of values of nodes in document order."""
        return pa.ListArray.from_arrays(pa.array(np.searchsorted(self.doc[nodes], np.arange(len(self) + 1)).astype(np.int32)), values)


def slices(texts: pa.Array) -> Iterator[pa.Array]:
    """A batch in slices of about SLICE bytes, by rows."""
    sizes = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < len(texts):
        end = max(at + 1, int(np.searchsorted(sizes, (sizes[at - 1] if at else 0) + SLICE, "right")))
        yield texts.slice(at, end - at)
        at = end


def merged(texts: pa.Array, kind: pa.DataType, quick: Callable[[Batch], pa.Array | tuple[pa.Array, np.ndarray] | None], slow: Callable[[str], object], big: bool = True, nothing: object = None) -> pa.Array:
    """quick's results for plain documents, and slow's for the others and for those that quick gives up (its second result); `nothing` for null."""
    batch = Batch(texts, big)
    got, left = None, None
    if len(batch):
        got = quick(batch)
        if isinstance(got, tuple):
            got, left = got
    if got is None:
        return pa.array([nothing if t is None else slow(t) for t in texts.to_pylist()], kind)
    done = batch.plain.copy()
    if left is not None and left.any():
        done[np.flatnonzero(done)[left]] = False
        got = got.filter(pa.array(~left))
    got = got.cast(kind)
    if done.all():
        return got
    rest = pa.array([nothing if t is None else slow(t) for t in texts.filter(pa.array(~done)).to_pylist()], kind)
    place = np.empty(len(texts), np.int64)
    place[done], place[~done] = np.arange(done.sum()), done.sum() + np.arange((~done).sum())
    return pa.concat_arrays([got, rest]).take(pa.array(place))


def column(c: Column, kind: pa.DataType, quick, slow, big: bool = True, nothing: object = None) -> Column:
    """A function of texts as a column: quick of a Batch where that is possible, slow of one text elsewhere."""
    from pyspark.sql.pandas.types import from_arrow_type

    # Not over an iterator of batches: Spark gives such functions one evaluation each, and these share one.
    def run(texts: pa.Array) -> pa.Array:
        done = [merged(part, kind, quick, slow, big, nothing) for part in slices(texts)]
        return pa.concat_arrays(done) if done else pa.array([], kind)

    return F.arrow_udf(run, from_arrow_type(kind))(c)


def result(kind: pa.DataType) -> pa.DataType:
    return pa.struct([("value", kind), ("error", pa.string())])


def struct(value: pa.Array, codes: np.ndarray) -> pa.Array:
    """struct<value, error>."""
    return pa.StructArray.from_arrays([value, pa.array(codes, pa.string())], ["value", "error"])
