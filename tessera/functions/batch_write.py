"""Texts of many plain documents at once: what write.py writes, put together from the tokens of a Batch and the gaps before them."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from . import batch as B
from .write import _FracturedWriter, Fractured, double

_FIRST = 255


def _before(batch: B.Batch) -> np.ndarray:
    """The class of the token before each, none for a document's first."""
    out = np.empty(len(batch.type), np.uint8)
    out[1:] = batch.type[:-1]
    out[np.searchsorted(batch.token_doc, np.arange(len(batch)))] = _FIRST
    return out


def _join(batch: B.Batch, lines: np.ndarray, indents: np.ndarray, blanks: np.ndarray) -> pa.Array:
    """Each document's tokens, with numbers in shortest form. Before a token stand a line break with blanks behind it where
    `lines`, and else one blank where `blanks`."""
    starts, sizes = batch.pos.copy(), batch.stop - batch.pos
    reals = np.flatnonzero(batch.kind == B.DOUBLE)
    zeros = batch.tokens[(batch.kind == B.INT64) & (batch.value == 0) & (batch.end - batch.start == 2)]  # -0
    starts[zeros], sizes[zeros] = starts[zeros] + 1, 1
    shown = "".join(texts := [double(v) for v in batch.real[reals].tolist()]).encode()
    width = np.fromiter(map(len, texts), np.int64, len(texts))
    whose = batch.tokens[reals]
    starts[whose], sizes[whose] = len(batch.data) + np.cumsum(width) - width, width
    gap = b"\n" + b" " * int(indents.max(initial=0)) + b" "
    piece, size = np.empty(2 * len(starts), np.int64), np.empty(2 * len(starts), np.int64)
    piece[0::2], piece[1::2] = len(batch.data) + len(shown) + np.where(lines, 0, 1), starts
    size[0::2], size[1::2] = np.where(lines, 1 + indents, blanks), sizes
    data, at = B.gather(np.concatenate([batch.data, np.frombuffer(shown + gap, np.uint8)]), piece, size)
    firsts = np.searchsorted(batch.token_doc, np.arange(len(batch) + 1))
    return B.texts_of(data, at[2 * firsts])


def minify(batch: B.Batch) -> pa.Array:
    none = np.zeros(len(batch.pos), bool)
    return _join(batch, none, np.zeros(len(none), np.int64), none)


def _places(batch: B.Batch) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Which tokens open a container's content, follow a comma, close a content, and follow a colon."""
    before = _before(batch)
    closes = (batch.type == B._CLOSE_OBJECT) | (batch.type == B._CLOSE_ARRAY)
    opened = (before == B._OPEN_OBJECT) | (before == B._OPEN_ARRAY)
    return opened & ~closes, before == B._COMMA, closes & ~opened, before == B._COLON


def prettify(batch: B.Batch, step: int) -> pa.Array:
    begin, next_, end, member = _places(batch)
    return _join(batch, begin | next_ | end, batch.level * step, member)


def fractured(batch: B.Batch, o: Fractured) -> tuple[pa.Array, np.ndarray]:
    """The human layout, and the documents that have tables, or lines of several items inside a line, which are not written here."""
    kind, parent, depth, children = batch.kind, batch.parent, batch.depth, batch.children
    held = kind <= B.ARRAY
    width = np.where(held, 0, batch.end - batch.start)
    width[(kind == B.INT64) & (batch.value == 0)] = 1
    reals = np.flatnonzero(kind == B.DOUBLE)
    width[reals] = [len(f"{v:.17g}") for v in batch.real[reals].tolist()]
    width[held] = 2 + 2 * np.maximum(0, children[held] - 1)
    own = np.where(batch.key_start >= 0, batch.key_end - batch.key_start + 4, 0)  # a key, its quotes, colon and blank
    deepest, objects = np.zeros(len(kind), np.int64), np.zeros(len(kind), np.int64)
    levels = [np.flatnonzero(depth == d) for d in range(int(depth.max(initial=0)) + 1)]
    for some in levels[:0:-1]:
        width += np.bincount(parent[some], width[some] + own[some], len(kind)).astype(np.int64)
        np.maximum.at(deepest, parent[some], np.where(held[some], 1 + deepest[some], 0))
        objects += np.bincount(parent[some], kind[some] == B.OBJECT, len(kind)).astype(np.int64)
    line = held & ((children == 0) | (1 + deepest <= o.max_inline_complexity) & (width <= o.max_inline_length))
    several = held & ~line & (kind == B.ARRAY) & (deepest <= o.max_compact_array_complexity) & o.enable_compact_multiline
    left = np.zeros(len(batch), bool)
    if o.enable_table_format:
        left[batch.doc[held & ~line & (kind == B.ARRAY) & (children >= o.min_table_rows) & (objects == children)]] = True

    flat = np.zeros(len(kind), bool)
    for some in levels[1:]:
        above = parent[some]
        flat[some] = line[above] | several[above] | flat[above]
    left[batch.doc[several & flat]] = True
    several &= ~left[batch.doc]

    # Blanks of parts that are written on one line.
    comma, colon, pad = int(o.comma_padding), int(o.colon_padding), int(o.simple_bracket_padding)
    inner = np.where(held & line & (children > 0), 2 * pad + comma * (children - 1), 0) + np.where(kind == B.OBJECT, colon * children, 0)
    for some in levels[:0:-1]:
        inner += np.bincount(parent[some], inner[some], len(kind)).astype(np.int64)
    breaks = np.zeros(len(kind), bool)  # an item before which a line of several ends
    at = np.flatnonzero(several)
    kids = batch.child_ids(at)
    kid, many = np.searchsorted(kids, at), children[at]
    used, items = (depth[at] + 1) * o.indent_spaces, np.zeros(len(at), np.int64)
    for n in range(int(many.max(initial=0))):
        live = np.flatnonzero(many > n)
        item = kids[kid[live] + n]
        if n:
            full = (items[live] >= o.max_items_per_line) | (used[live] + _FracturedWriter.NEXT_ITEM > o.max_total_line_length)
            breaks[item[full]] = True
            used[live] = np.where(full, (depth[at[live]] + 1) * o.indent_spaces, used[live] + comma)
            items[live] = np.where(full, 0, items[live])
        used[live] += inner[item]
        items[live] += 1

    begin, next_, end, member = _places(batch)
    whose = np.where(batch.holder >= 0, batch.node_of[batch.holder], -1)  # of closing marks, the container that they close
    one, own_line = line[whose], ~line[whose] & ~flat[whose]
    is_several = several[whose]
    new = next_ & is_several & breaks[batch.node_of]
    lines = (begin | end) & own_line | next_ & own_line & ~is_several | new
    blanks = np.where((begin | end) & one, pad, 0) + np.where(next_ & (one | is_several & ~new), comma, 0) + np.where(member, colon, 0)
    return _join(batch, lines, batch.level * o.indent_spaces, blanks), left
