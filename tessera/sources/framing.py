"""Cutting a text that holds many documents into one piece a document.

whitespace   documents follow each other, with or without white space between (NDJSON, pretty-printed, concatenated)
newline      one line a document
sequence     each document after a record separator (0x1E)
comma        documents between commas
comma_array  the elements of one array
"""

from __future__ import annotations

import re
from collections.abc import Iterator

from ..functions.errors import JsonError

FORMATS = ("whitespace", "newline", "sequence", "comma", "comma_array")
DEFAULT_BATCH, LEAST_BATCH = 1_000_000, 32

_MARK = re.compile(r'"(?:[^"\\]|\\.)*"|[{}\[\]]|,|[^ \t\n\r{}\[\],:"]+|"', re.S)
_BLANK = " \t\n\r"


def _whitespace(text: str) -> Iterator[tuple[int, int, bool]]:
    """(begin, end, complete) of each document."""
    depth, begin = 0, None
    for m in _MARK.finditer(text):
        c = m[0][0]
        if begin is None:
            begin = m.start()
        if c == '"' and len(m[0]) == 1:  # a string without an end
            yield begin, len(text), False
            return
        if c in "{[":
            depth += 1
        elif c in "}]":
            depth -= 1
        if depth <= 0:
            yield begin, m.end(), True
            begin, depth = None, 0
    if begin is not None:
        yield begin, len(text), False


def _newline(text: str) -> Iterator[tuple[int, int, bool]]:
    at = 0
    for line in text.split("\n"):
        if line.strip(_BLANK):
            yield at, at + len(line), True
        at += len(line) + 1


def _sequence(text: str) -> Iterator[tuple[int, int, bool]]:
    at = 0
    for part in text.split("\x1e"):
        if part.strip(_BLANK):
            yield at, at + len(part), True
        at += len(part) + 1


def _comma(text: str) -> Iterator[tuple[int, int, bool]]:
    depth, begin = 0, 0
    for m in _MARK.finditer(text):
        c = m[0][0]
        if c == '"' and len(m[0]) == 1:
            yield begin, len(text), False
            return
        depth += (c in "{[") - (c in "}]")
        if c == "," and depth == 0:
            if text[begin : m.start()].strip(_BLANK):
                yield begin, m.start(), True
            begin = m.end()
    if text[begin:].strip(_BLANK):
        yield begin, len(text), depth == 0


_CUT = {"whitespace": _whitespace, "newline": _newline, "sequence": _sequence, "comma": _comma}


def split(text: str, framing: str = "whitespace") -> Iterator[tuple[int, str, bool]]:
    """(offset in code points, document, complete) of each document. The offset is that of the document's first character."""
    if framing not in FORMATS:
        raise ValueError(f"framings are {FORMATS}")
    base = 1 if text.startswith("\ufeff") else 0
    text = text[base:]
    if framing == "comma_array":
        body = text.strip(_BLANK)
        lead = len(text) - len(text.lstrip(_BLANK))
        if not body.startswith("[") or not body.endswith("]") or len(body) < 2:
            raise JsonError("TAPE_ERROR", base + lead)
        base, text, framing = base + lead + 1, body[1:-1], "comma"
    for begin, end, complete in _CUT[framing](text):
        piece = text[begin:end]
        lead = len(piece) - len(piece.lstrip(_BLANK))
        yield base + begin + lead, piece.strip(_BLANK), complete


def slice_at(data: bytes, delimiter: bytes, block: int, i: int) -> bytes:
    """The i-th block of some bytes with its edges moved on to the next delimiter, so that all blocks together are the whole."""
    if block <= 0 or len(delimiter) != 1:
        raise ValueError("a block has a byte at least, and a delimiter one")

    def edge(at: int) -> int:
        if at <= 0 or at >= len(data):
            return max(0, min(at, len(data)))
        found = data.find(delimiter, at - 1)
        return len(data) if found < 0 else found + 1

    return data[edge(i * block) : edge((i + 1) * block)]
