"""Texts from trees: minified, pretty and fractured JSON, MessagePack, and the tree as a table of words."""

from __future__ import annotations

import re
import struct
from dataclasses import dataclass

from .tree import Tree

_SPECIAL = re.compile(r'["\\\x00-\x1f]')
#: The characters that have a short escape.
_SHORT = {'"': '\\"', "\\": "\\\\", "\b": "\\b", "\t": "\\t", "\n": "\\n", "\f": "\\f", "\r": "\\r"}


def quote(text: str) -> str:
    """A string in quotes. Only quotes, backslashes and control characters are escaped."""
    return '"' + _SPECIAL.sub(lambda m: _SHORT.get(m[0]) or f"\\u{ord(m[0]):04x}", text) + '"'


def double(value: float) -> str:
    """The shortest text that reads back as the same double, always with a point or an exponent; fixed point below 1e15."""
    if value != value:
        return "NaN"
    if value in (float("inf"), float("-inf")):
        return "Infinity" if value > 0 else "-Infinity"
    out = repr(value)
    if 1e15 <= abs(value) < 1e16:
        sign, digits = ("-", out[1:]) if out[0] == "-" else ("", out)
        digits = digits.replace(".", "").rstrip("0")
        return f"{sign}{digits[0]}{'.' + digits[1:] if len(digits) > 1 else ''}e+15"
    return out


def leaf(tree: Tree, i: int) -> str:
    """A scalar's text."""
    node = tree.nodes[i]
    if node.kind == "string":
        return quote(node.value)
    if node.kind == "double":
        return double(node.value)
    if node.kind == "bool":
        return "true" if node.value else "false"
    return "null" if node.kind == "null" else str(node.value)


def minify(tree: Tree, i: int = 0) -> str:
    return _plain(tree, i, ",", ":", None, 0)


def prettify(tree: Tree, i: int = 0, step: int = 4) -> str:
    return _plain(tree, i, ",", ": ", step, 0)


def _plain(tree: Tree, i: int, comma: str, colon: str, step: int | None, depth: int) -> str:
    # A stack of pending pieces rather than recursion, as documents nest a thousand deep.
    out: list[str] = []
    todo: list = [(i, depth)]
    while todo:
        item = todo.pop()
        if isinstance(item, str):
            out.append(item)
            continue
        at, depth = item
        node = tree.nodes[at]
        if node.kind not in ("object", "array"):
            out.append(leaf(tree, at))
            continue
        opens, closes = "{}" if node.kind == "object" else "[]"
        children = tree.child_ids(at)
        if not children:
            out.append(opens + closes)
            continue
        inner, outer = ("", "") if step is None else ("\n" + " " * (step * (depth + 1)), "\n" + " " * (step * depth))
        pending: list = []
        for n, child in enumerate(children):
            lead = (comma if n else opens) + inner
            if node.kind == "object":
                lead += quote(tree.nodes[child].key) + colon
            pending += [lead, (child, depth + 1)]
        pending.append(outer + closes)
        todo += reversed(pending)
    return "".join(out)


_STRING_OR_BLANK = re.compile(r'("(?:[^"\\]|\\.)*")|[ \t\n\r]+', re.S)


def strip_blanks(text: str) -> str:
    """White space outside strings goes; nothing is parsed."""
    return _STRING_OR_BLANK.sub(lambda m: m[1] or "", text)


@dataclass(frozen=True)
class Fractured:
    """Options of the human layout."""

    max_total_line_length: int = 120
    max_inline_length: int = 80
    max_inline_complexity: int = 2
    max_compact_array_complexity: int = 1
    indent_spaces: int = 4
    enable_table_format: bool = True
    min_table_rows: int = 3
    table_similarity_threshold: float = 0.8
    enable_compact_multiline: bool = True
    max_items_per_line: int = 10
    simple_bracket_padding: bool = True
    colon_padding: bool = True
    comma_padding: bool = True
    #: Tables show common keys alone, and lose others. Off, such arrays are expanded.
    lossy_tables: bool = False


@dataclass(slots=True)
class _Shape:
    complexity: int = 0
    width: int = 0
    layout: str = "line"
    common: tuple[str, ...] = ()


class _FracturedWriter:
    """Lays out a tree: on a line, as lines of several items, as a table, or one item a line."""

    #: What the next item is taken to need when a line of several is filled.
    NEXT_ITEM = 20

    def __init__(self, tree: Tree, options: Fractured):
        self.tree, self.o, self.shape, self.out, self.blanks = tree, options, {}, [], 0
        self.gap = {"comma": "," + " " * options.comma_padding, "colon": ":" + " " * options.colon_padding, "pad": " " * options.simple_bracket_padding}
        for i in range(len(tree.nodes) - 1, -1, -1):  # children have larger numbers
            self.shape[i] = self._measure(i)

    def _string_width(self, text: str) -> int:
        return 2 + len(text.encode("utf-8", "surrogatepass")) + len(_SPECIAL.findall(text))

    def _measure(self, i: int) -> _Shape:
        node, o = self.tree.nodes[i], self.o
        if node.kind == "string":
            return _Shape(width=self._string_width(node.value))
        if node.kind == "double":
            return _Shape(width=len(f"{node.value:.17g}"))
        if node.kind not in ("object", "array"):
            return _Shape(width=len(leaf(self.tree, i)))
        children = self.tree.child_ids(i)
        inner = [self.shape[c] for c in children]
        width = 2 + sum(s.width for s in inner) + 2 * max(0, len(children) - 1)
        if node.kind == "object":
            width += sum(self._string_width(self.tree.nodes[c].key) + 2 for c in children)
        deepest = max((s.complexity for s in inner), default=0)
        out = _Shape(1 + deepest, width)
        if not children or out.complexity <= o.max_inline_complexity and width <= o.max_inline_length:
            return out
        out.layout = "expanded"
        if node.kind == "array":
            out.common = self._common(children)
            if out.common:
                out.layout = "table"
            elif o.enable_compact_multiline and deepest <= o.max_compact_array_complexity:
                out.layout = "several"
        return out

    def _common(self, rows: list[int]) -> tuple[str, ...]:
        """The keys that all rows of a table share, sorted; none if they are no table."""
        o, tree = self.o, self.tree
        if not o.enable_table_format or len(rows) < o.min_table_rows or any(tree.nodes[r].kind != "object" for r in rows):
            return ()
        keys = [{tree.nodes[c].key for c in tree.child_ids(r)} for r in rows]
        for other in keys[1:]:
            union = keys[0] | other
            if union and len(keys[0] & other) / len(union) < o.table_similarity_threshold:
                return ()
        shared = set.intersection(*keys)
        if not o.lossy_tables and any(len(tree.child_ids(r)) != len(shared) for r in rows):
            return ()
        return tuple(sorted(shared))

    def _blank(self, text: str) -> None:
        self.out.append(text)
        self.blanks += text.count(" ")

    def _line(self, depth: int, flat: bool) -> None:
        if not flat:
            self.out.append("\n")
            self.blanks = 0
            self._blank(" " * (depth * self.o.indent_spaces))

    def text(self, i: int = 0) -> str:
        self._value(i, 0, False)
        return "".join(self.out)

    def _value(self, i: int, depth: int, flat: bool) -> None:
        node = self.tree.nodes[i]
        if node.kind not in ("object", "array"):
            self.out.append(leaf(self.tree, i))
            return
        children = self.tree.child_ids(i)
        layout = self.shape[i].layout
        opens, closes = "{}" if node.kind == "object" else "[]"
        self.out.append(opens)
        if layout == "line":
            for n, child in enumerate(children):
                self._blank(self.gap["comma"] if n else self.gap["pad"])
                self._key(child)
                self._value(child, 0, True)
            if children:
                self._blank(self.gap["pad"])
        elif layout == "several":
            self._line(depth + 1, flat)
            held = 0
            for n, child in enumerate(children):
                if n and (held >= self.o.max_items_per_line or self.blanks + self.NEXT_ITEM > self.o.max_total_line_length):
                    self.out.append(",")
                    self._line(depth + 1, flat)
                    held = 0
                elif n:
                    self._blank(self.gap["comma"])
                self._value(child, depth + 1, True)
                held += 1
            self._line(depth, flat)
        elif layout == "table":
            self._table(i, children, depth, flat)
        else:
            for n, child in enumerate(children):
                self.out.append("," * bool(n))
                self._line(depth + 1, flat)
                self._key(child)
                self._value(child, depth + 1, flat)
            self._line(depth, flat)
        self.out.append(closes)

    def _key(self, child: int) -> None:
        if self.tree.nodes[child].key is not None:
            self.out.append(quote(self.tree.nodes[child].key))
            self._blank(self.gap["colon"])

    def _table(self, i: int, rows: list[int], depth: int, flat: bool) -> None:
        common = self.shape[i].common
        cells = [{} for _ in rows]
        for row, held in zip(rows, cells, strict=True):
            for c in self.tree.child_ids(row):
                held.setdefault(self.tree.nodes[c].key, c)
        widths = [max(self._width(held[k]) for held in cells) for k in common]
        for n, held in enumerate(cells):
            self.out.append("," * bool(n))
            self._line(depth + 1, flat)
            self.out.append("{")
            self._blank(self.gap["pad"])
            for c, key in enumerate(common):
                self._blank(self.gap["comma"] if c else "")
                self._key(held[key])
                self._value(held[key], depth + 1, True)
                if c + 1 < len(common):
                    self.out.append(" " * (widths[c] - self._width(held[key])))
            self._blank(self.gap["pad"])
            self.out.append("}")
        self._line(depth, flat)

    def _width(self, i: int) -> int:
        return self.shape[i].width


def fractured(tree: Tree, options: Fractured | None = None) -> str:
    return _FracturedWriter(tree, options or Fractured()).text()


def msgpack(tree: Tree, i: int = 0) -> bytes:
    """MessagePack; every number is a 64-bit float."""
    out: list[bytes] = []

    def head(n: int, small: int, limit: int, codes: tuple[int | None, int, int]) -> bytes:
        if n < limit:
            return bytes([small | n])
        if codes[0] is not None and n < 1 << 8:
            return struct.pack(">BB", codes[0], n)
        return struct.pack(">BH", codes[1], n) if n < 1 << 16 else struct.pack(">BI", codes[2], n)

    def string(text: str) -> None:
        data = text.encode("utf-8", "surrogatepass")
        out.append(head(len(data), 0xA0, 32, (0xD9, 0xDA, 0xDB)) + data)

    for at in range(i, tree.nodes[i].last):  # nodes stand in the order in which they are written
        node = tree.nodes[at]
        if at > i and node.key is not None:
            string(node.key)
        if node.kind == "object":
            out.append(head(node.children, 0x80, 16, (None, 0xDE, 0xDF)))
        elif node.kind == "array":
            out.append(head(node.children, 0x90, 16, (None, 0xDC, 0xDD)))
        elif node.kind == "string":
            string(node.value)
        elif node.kind == "bool":
            out.append(b"\xc3" if node.value else b"\xc2")
        elif node.kind == "null":
            out.append(b"\xc0")
        else:
            out.append(struct.pack(">Bd", 0xCB, float(node.value)))
    return b"".join(out)


def tape(tree: Tree) -> list[str]:
    """The document as one word a value, key, and end of a container, in document order; containers name where they end."""
    words: list[str] = []

    def open_(at: int) -> None:
        todo: list = [at]
        while todo:
            item = todo.pop()
            if isinstance(item, tuple):
                mark, start = item
                words[start] = f"{words[start]} // pointing to {len(words) + 1}"
                words.append(f"{mark} // pointing to {start}")
                continue
            node = tree.nodes[item]
            if node.key is not None and item:
                words.append(f"string {quote(node.key)}")
            if node.kind in ("object", "array"):
                opens, closes = "{}" if node.kind == "object" else "[]"
                words.append(opens)
                todo.append((closes, len(words) - 1))
                todo += reversed(tree.child_ids(item))
            elif node.kind in ("bool", "null"):
                words.append(leaf(tree, item))
            else:
                words.append(f"{ {'int64': 'integer', 'uint64': 'unsigned integer', 'double': 'float', 'bigint': 'bigint', 'string': 'string'}[node.kind]} {leaf(tree, item)}")

    words.append("root")
    open_(0)
    words[0] = f"root // pointing to {len(words)}"
    words.append("root // pointing to 0")
    return words
