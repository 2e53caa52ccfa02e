"""Reading only what is asked for: a cursor over a text whose untouched parts are not checked beyond their brackets.

The first pass (strings, control characters, encoding) is made over the whole text; keys are compared as they are written.
"""

from __future__ import annotations

import re

from .errors import JsonError
from .paths import pointer_index, pointer_key
from .tree import Node, Tree, decode, first_pass, parse

_SKIP = re.compile(r'"(?:[^"\\]|\\.)*"|[{}\[\]]', re.S)
_BLANK = re.compile(r"[ \t\n\r]*")
_STRING = re.compile(r'"((?:[^"\\]|\\.)*)"', re.S)
_BARE = re.compile(r"[^ \t\n\r{}\[\],:]+")


class Lazy:
    """A document that is read on demand. Places are offsets of a value's first character. incomplete: the text may be cut off."""

    def __init__(self, data: bytes | str | None, incomplete: bool = False):
        self.text, utf8 = decode(data)
        first_pass(self.text, incomplete, utf8)
        self.root = self._blank(0)
        first, last = self.text[self.root], self.text.rstrip(" \t\n\r")[-1]
        if not incomplete and first in "{[" and last != ("}" if first == "{" else "]"):
            raise JsonError("INCOMPLETE_ARRAY_OR_OBJECT")

    def _blank(self, at: int) -> int:
        return _BLANK.match(self.text, at).end()

    def end(self, at: int) -> int:
        """Where the value at a place ends."""
        c = self.text[at : at + 1]
        if c == '"':
            m = _STRING.match(self.text, at)
            if not m:
                raise JsonError("TAPE_ERROR", at)
            return m.end()
        if c not in ("{", "["):
            m = _BARE.match(self.text, at)
            if not m:
                raise JsonError("TAPE_ERROR", at)
            return m.end()
        depth = 0
        for m in _SKIP.finditer(self.text, at):
            depth += {"{": 1, "[": 1, "}": -1, "]": -1}.get(m[0], 0)
            if not depth:
                return m.end()
        raise JsonError("INCOMPLETE_ARRAY_OR_OBJECT", at)

    def children(self, at: int):
        """(raw key or None, place) of each child in turn."""
        opens = self.text[at : at + 1]
        if opens not in ("{", "["):
            raise JsonError("INCORRECT_TYPE", at)
        closes, at = "}" if opens == "{" else "]", self._blank(at + 1)
        if self.text[at : at + 1] == closes:
            return
        while True:
            key = None
            if opens == "{":
                m = _STRING.match(self.text, at)
                if not m:
                    raise JsonError("TAPE_ERROR", at)
                key, at = m[1], self._blank(m.end())
                if self.text[at : at + 1] != ":":
                    raise JsonError("TAPE_ERROR", at)
                at = self._blank(at + 1)
            yield key, at
            at = self._blank(self.end(at))
            c = self.text[at : at + 1]
            if c == closes:
                return
            if c != ",":
                raise JsonError("TAPE_ERROR" if c else "INCOMPLETE_ARRAY_OR_OBJECT", at)
            at = self._blank(at + 1)

    def field(self, at: int, key: str) -> int:
        if self.text[at : at + 1] != "{":
            raise JsonError("INCORRECT_TYPE", at)
        for name, place in self.children(at):
            if name == key:
                return place
        raise JsonError("NO_SUCH_FIELD", at)

    def fields_in_order(self, at: int, keys: list[str]) -> list[int | JsonError]:
        """Keys looked for one after the other without going back."""
        if self.text[at : at + 1] != "{":
            raise JsonError("INCORRECT_TYPE", at)
        out: list[int | JsonError] = []
        walk = self.children(at)
        for key in keys:
            out.append(next((place for name, place in walk if name == key), JsonError("NO_SUCH_FIELD")))
        return out

    def element(self, at: int, index: int) -> int:
        if self.text[at : at + 1] != "[":
            raise JsonError("INCORRECT_TYPE", at)
        for n, (_, place) in enumerate(self.children(at)):
            if n == index:
                return place
        raise JsonError("INDEX_OUT_OF_BOUNDS", at)

    def pointer(self, pointer: str) -> int:
        at = self.root
        if self.text[at] not in "{[":
            raise JsonError("SCALAR_DOCUMENT_AS_VALUE" if not pointer else "INVALID_JSON_POINTER" if pointer[0] != "/" else "NO_SUCH_FIELD")
        while pointer:
            if pointer[0] != "/":
                raise JsonError("INVALID_JSON_POINTER")
            token, slash, rest = pointer[1:].partition("/")
            c = self.text[at : at + 1]
            if c == "{":
                at = self.field(at, pointer_key(token))
            elif c == "[":
                at = self.element(at, pointer_index(token))
            else:
                raise JsonError("NO_SUCH_FIELD")
            pointer = slash + rest
        return at

    def raw(self, at: int) -> str:
        return self.text[at : self.end(at)]

    def token(self, at: int) -> str:
        """A scalar's text with the white space behind it, or a container's first character."""
        if self.text[at] in "{[":
            return self.text[at]
        end = self.end(at)
        return self.text[at : self._blank(end)]

    def value(self, at: int) -> tuple[Tree, Node]:
        """The value at a place, now checked in full."""
        tree = parse(self.raw(at), big=True)
        return tree, tree.nodes[0]

    def trailing(self) -> bool:
        """Whether something follows the document."""
        return self._blank(self.end(self.root)) < len(self.text)

    def count(self, at: int) -> int:
        return sum(1 for _ in self.children(at))
