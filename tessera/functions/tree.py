"""The strict reader: a text to a list of nodes in document order, or the code of what is wrong with it.

Acceptable texts are read by one pass of two regular expressions. What is wrong with others is found out in the order in
which the checks count: the ends of strings, control characters, emptiness, the encoding, then the grammar from the left.
"""

from __future__ import annotations

import json
import math
import re
from dataclasses import dataclass

from .errors import JsonError

MAX_DEPTH = 1024
MAX_BYTES = 0xFFFFFFFF
INT64, UINT64 = 1 << 63, 1 << 64

#: White space, then a mark, a string (with its quotes), or a run of anything else.
_TOKEN = re.compile(r'[ \t\n\r]*(?:([{}\[\],:])|("(?:[^"\\]|\\.)*")|([^ \t\n\r{}\[\],:"][^ \t\n\r{}\[\],:]*))', re.S)
_BLANK = re.compile(r"[ \t\n\r]*")
_INTEGER = re.compile(r"-?(?:0|[1-9][0-9]*)")
_NUMBER = re.compile(r"-?(?:0|[1-9][0-9]*)(?:\.[0-9]+)?(?:[eE][+-]?[0-9]+)?")
_ESCAPE = re.compile(r"\\(?:([\"\\/bfnrt])|u([0-9a-fA-F]{4})|)", re.S)
_PAIR = re.compile(r"\\.", re.S)
_CONTROL = re.compile(r"[\x00-\x1f]")
#: The short escapes.
SHORT = {'"': '"', "\\": "\\", "/": "/", "b": "\b", "f": "\f", "n": "\n", "r": "\r", "t": "\t"}


@dataclass(slots=True)
class Node:
    """One value. `start` and `end` are its text's; the subtree is the nodes from its own number to `last`, the end excluded."""

    kind: str  # array object string int64 uint64 double bigint bool null
    start: int
    end: int
    key: str | None
    raw_key: str | None
    parent: int
    depth: int
    ord: int
    last: int = 0
    children: int = 0
    value: object = None


@dataclass(slots=True)
class Tree:
    text: str
    nodes: list[Node]

    def raw(self, i: int) -> str:
        return self.text[self.nodes[i].start : self.nodes[i].end]

    def child_ids(self, i: int) -> list[int]:
        out, at, last = [], i + 1, self.nodes[i].last
        while at < last:
            out.append(at)
            at = self.nodes[at].last
        return out


def unescape(raw: str, lone: str = "error") -> str:
    """A string's content without its escapes. lone: what becomes of half a surrogate pair: error, replace or keep."""
    if "\\" not in raw:
        return raw
    out, at, n = [], 0, len(raw)
    while (b := raw.find("\\", at)) >= 0:
        out.append(raw[at:b])
        m = _ESCAPE.match(raw, b)
        if m[1]:
            out.append(SHORT[m[1]])
            at = m.end()
            continue
        if not m[2]:
            raise JsonError("STRING_ERROR", b)
        code, at = int(m[2], 16), m.end()
        if 0xD800 <= code < 0xDC00:
            low = _ESCAPE.match(raw, at) if at < n and raw[at] == "\\" else None
            value = int(low[2], 16) if low and low[2] else 0
            if 0xDC00 <= value < 0xE000:
                code, at = 0x10000 + ((code - 0xD800) << 10) + value - 0xDC00, low.end()
        if 0xD800 <= code < 0xE000:
            if lone == "error":
                raise JsonError("STRING_ERROR", b)
            code = 0xFFFD if lone == "replace" else code
        out.append(chr(code))
    out.append(raw[at:])
    return "".join(out)


def number(raw: str, at: int = 0, allow_nan: bool = False, minus_zero: bool = False) -> tuple[str, object]:
    """Kind and value of a number's text; integers beyond 64 bits are kind "bigint" with their digits."""
    if _INTEGER.fullmatch(raw):
        if len(raw) < 19:
            return ("double", -0.0) if minus_zero and raw == "-0" else ("int64", int(raw))
        negative, digits = raw[0] == "-", raw.lstrip("-")
        value = int(raw) if len(digits) <= 20 else None
        if value is None or value >= UINT64 or value < -INT64:
            return "bigint", raw
        return ("int64" if negative or value < INT64 else "uint64"), value
    if _NUMBER.fullmatch(raw):
        value = float(raw)
        if math.isinf(value):
            raise JsonError("NUMBER_ERROR", at)
        return "double", value
    if allow_nan:
        sign, body = (-1, raw[1:]) if raw[:1] == "-" else (1, raw)
        if body.lower() == "nan":
            return "double", math.nan
        if body.lower() in ("inf", "infinity"):
            return "double", sign * math.inf
    raise JsonError("NUMBER_ERROR", at)


_ATOM = {"t": ("true", "bool", True, "T_ATOM_ERROR"), "f": ("false", "bool", False, "F_ATOM_ERROR"), "n": ("null", "null", None, "N_ATOM_ERROR")}


def scalar(raw: str, at: int, big: bool = False, allow_nan: bool = False, minus_zero: bool = False) -> tuple[str, object]:
    """Kind and value of a token that is neither a mark nor a string."""
    first = raw[0]
    if allow_nan and raw.lstrip("-").lower() in ("nan", "inf", "infinity"):
        return number(raw, at, True)
    if first in _ATOM:
        text, kind, value, code = _ATOM[first]
        if raw != text:
            raise JsonError(code, at)
        return kind, value
    if first == "-" or "0" <= first <= "9":
        kind, value = number(raw, at, allow_nan, minus_zero)
        if kind == "bigint" and not big:
            raise JsonError("BIGINT_ERROR", at)
        return kind, value
    raise JsonError("TAPE_ERROR", at)


def first_pass(text: str, incomplete: bool = False, utf8: bool = True) -> None:
    """The checks that come before the grammar."""
    marks = _PAIR.sub("..", text) if "\\" in text else text
    parts = marks.split('"')
    if len(parts) % 2 == 0 and not incomplete:
        raise JsonError("UNCLOSED_STRING", len(text) - len(parts[-1]) - 1)
    if _CONTROL.search(text):
        at = 0
        for i, part in enumerate(parts):
            if i % 2 and (m := _CONTROL.search(text, at, at + len(part))):
                raise JsonError("UNESCAPED_CHARS", m.start())
            at += len(part) + 1
    if not text.strip(" \t\n\r"):
        raise JsonError("EMPTY", 0)
    if not utf8:
        raise JsonError("UTF8_ERROR")


def decode(data: bytes | str | None) -> tuple[str, bool]:
    """The text of some input without its byte order mark, and whether it was UTF-8."""
    if data is None:
        return "", True
    if isinstance(data, str):
        text, good = data, True
    else:
        try:
            text, good = bytes(data).decode("utf-8"), True
        except UnicodeDecodeError:
            text, good = bytes(data).decode("utf-8", "replace"), False
    return text.removeprefix("\ufeff"), good


def parse(data: bytes | str | None, max_depth: int = MAX_DEPTH, max_bytes: int = MAX_BYTES, big: bool = False, allow_nan: bool = False, minus_zero: bool = False, incomplete: bool = False) -> Tree:
    """The nodes of a document. Raises JsonError."""
    text, utf8 = decode(data)
    if len(text) > max_bytes // 4 and len(text.encode("utf-8", "surrogatepass")) > max_bytes:
        raise JsonError("CAPACITY")
    try:
        if not utf8:
            raise JsonError("UTF8_ERROR")
        return _parse(text, max_depth, big, allow_nan, minus_zero, incomplete)
    except JsonError:
        first_pass(text, incomplete, utf8)  # whose findings go before those of the grammar
        raise


def _parse(text: str, max_depth: int, big: bool, allow_nan: bool, minus_zero: bool, incomplete: bool) -> Tree:
    match, nodes, at, n = _TOKEN.match, [], 0, len(text)
    stack: list[int] = []
    state, key, raw_key = "value", None, None
    end = len(text.rstrip(" \t\n\r"))
    m = match(text, 0)
    if m and m[1] in ("{", "[") and text[end - 1] != ("}" if m[1] == "{" else "]") and not incomplete:
        raise JsonError("TAPE_ERROR", m.start(1))
    while True:
        m = match(text, at)
        if not m:
            at = _BLANK.match(text, at).end()
            if not nodes and at == n:
                raise JsonError("EMPTY", 0)
            raise JsonError("UNCLOSED_STRING" if at < n else "TAPE_ERROR", at)
        mark, string, other = m.groups()
        here, at = m.start(m.lastindex), m.end()
        if state == "end":
            raise JsonError("TAPE_ERROR", here)
        if state in ("value", "first"):
            parent = stack[-1] if stack else -1
            if state == "first" and mark == "]":
                pass
            else:
                if mark and mark not in "{[":
                    raise JsonError("TAPE_ERROR", here)
                node = Node("", here, at, key, raw_key, parent, len(stack), nodes[parent].children if stack else 0)
                if stack:
                    nodes[parent].children += 1
                nodes.append(node)
                key = raw_key = None
                if mark:
                    node.kind = "object" if mark == "{" else "array"
                    after = match(text, at)
                    if after and after[1] == ("}" if mark == "{" else "]"):
                        at = node.end = after.end()
                        node.last = len(nodes)
                    else:
                        stack.append(len(nodes) - 1)
                        if len(stack) >= max_depth:
                            raise JsonError("DEPTH_ERROR", here)
                        state = "key" if mark == "{" else "value"
                        continue
                else:
                    if string:
                        if "\\" in string:
                            try:
                                node.value = unescape(string[1:-1])
                            except JsonError as e:
                                raise JsonError(e.code, here + 1 + (e.at or 0)) from None
                        else:
                            node.value = string[1:-1]
                        if _CONTROL.search(string):
                            raise JsonError("UNESCAPED_CHARS", here)
                        node.kind = "string"
                    else:
                        node.kind, node.value = scalar(other, here, big, allow_nan, minus_zero)
                    node.last = len(nodes)
                state = "next"
        elif state == "key":
            if not string:
                raise JsonError("TAPE_ERROR", here)
            raw_key = string[1:-1]
            if _CONTROL.search(raw_key):
                raise JsonError("UNESCAPED_CHARS", here)
            try:
                key = unescape(raw_key)
            except JsonError as e:
                raise JsonError(e.code, here + 1 + (e.at or 0)) from None
            m = match(text, at)
            if not m or m[1] != ":":
                raise JsonError("TAPE_ERROR", m.start(m.lastindex) if m else at)
            at, state = m.end(), "value"
            continue
        else:  # after a value inside a container
            inside = nodes[stack[-1]].kind
            if mark == ",":
                state = "key" if inside == "object" else "value"
                continue
            if mark != ("}" if inside == "object" else "]"):
                raise JsonError("TAPE_ERROR", here)
            done = nodes[stack.pop()]
            done.end, done.last = at, len(nodes)
        if not stack:
            if _BLANK.match(text, at).end() == n:
                return Tree(text, nodes)
            state = "end"


_SUSPECT = re.compile(r"\\u[dD][89a-fA-F]|[0-9]{19}|[0-9][eE]\+?[0-9]{3}|[0-9]{300}")


def _refuse(_: str) -> None:
    raise ValueError


_quick = json.JSONDecoder(parse_constant=_refuse).decode


def _unrepeated(pairs: list[tuple[str, object]]) -> dict[str, object]:
    out = dict(pairs)
    if len(out) != len(pairs):
        raise ValueError
    return out


_quick_values = json.JSONDecoder(parse_constant=_refuse, object_pairs_hook=_unrepeated).decode


def _simple(data: object) -> bool:
    """Whether the C decoder is as strict as the reader on this text, if it accepts it."""
    return isinstance(data, str) and len(data) < MAX_BYTES // 4 and not _SUSPECT.search(data) and data.count("[") + data.count("{") < 900


def plain_value(data: object) -> tuple[bool, object]:
    """Whether a document is plain, and its value as Python's: good, without repeated keys, and without numbers that Python reads otherwise."""
    if _simple(data) and "-0" not in data:
        try:
            return True, _quick_values(data)
        except (ValueError, RecursionError):
            pass
    return False, None


def error(data: bytes | str | None, **options) -> tuple[str | None, int | None]:
    """The code of what is wrong with a document and where, or two Nones. Plain documents take a short way through C."""
    if data is None:
        return "EMPTY", 0
    if not options and _simple(data):
        try:
            _quick(data)
            return None, None
        except (ValueError, RecursionError):
            pass
    try:
        parse(data, **options)
    except JsonError as e:
        return e.code, e.at
    return None, None
