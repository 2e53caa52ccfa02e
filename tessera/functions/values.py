"""Typed values of nodes: each getter gives a value or raises the code that says why not."""

from __future__ import annotations

import re
import struct
from decimal import Decimal
from fractions import Fraction

from .errors import JsonError
from .tree import INT64, UINT64, Tree, number, unescape

_DIGITS = re.compile(r"-?[0-9]+")


def get_int64(tree: Tree, i: int) -> int:
    node = tree.nodes[i]
    if node.kind == "int64":
        return node.value
    raise JsonError("NUMBER_OUT_OF_RANGE" if node.kind == "uint64" else "INCORRECT_TYPE")


def get_uint64(tree: Tree, i: int) -> int:
    node = tree.nodes[i]
    if node.kind == "uint64" or node.kind == "int64" and node.value >= 0:
        return node.value
    raise JsonError("NUMBER_OUT_OF_RANGE" if node.kind == "int64" else "INCORRECT_TYPE")


def _narrow(low: int, high: int, wide):
    def get(tree: Tree, i: int) -> int:
        value = wide(tree, i)
        if not low <= value <= high:
            raise JsonError("NUMBER_OUT_OF_RANGE")
        return value

    return get


get_int32 = _narrow(-(1 << 31), (1 << 31) - 1, get_int64)
get_uint32 = _narrow(0, (1 << 32) - 1, get_uint64)


def get_double(tree: Tree, i: int) -> float:
    node = tree.nodes[i]
    if node.kind in ("int64", "uint64", "double"):
        return float(node.value)
    raise JsonError("INCORRECT_TYPE")


def nearest_float32(raw: str) -> float:
    """The binary32 value nearest to a decimal text, rounded once; ties go to the even one."""
    exact = Fraction(Decimal(raw))
    near = struct.unpack("<f", struct.pack("<f", max(-3.4028234663852886e38, min(3.4028234663852886e38, float(raw)))))[0]
    bits = struct.unpack("<i", struct.pack("<f", near))[0]
    best = (abs(Fraction(near) - exact), bits & 1, near)
    for step in (-1, 1):
        other = struct.unpack("<f", struct.pack("<I", (bits + step) & 0xFFFFFFFF))[0]
        if other == other and abs(other) != float("inf"):
            best = min(best, (abs(Fraction(other) - exact), (bits + step) & 1, other))
    if abs(exact) >= Fraction(2) ** 128 - Fraction(2) ** 103:
        raise JsonError("NUMBER_ERROR")
    return -0.0 if best[2] == 0 and raw.startswith("-") and not _DIGITS.fullmatch(raw) else best[2]


def get_float(tree: Tree, i: int) -> float:
    if tree.nodes[i].kind not in ("int64", "uint64", "double"):
        raise JsonError("INCORRECT_TYPE")
    return nearest_float32(tree.raw(i))


def get_bool(tree: Tree, i: int) -> bool:
    if tree.nodes[i].kind != "bool":
        raise JsonError("INCORRECT_TYPE")
    return tree.nodes[i].value


def get_string(tree: Tree, i: int) -> str:
    if tree.nodes[i].kind != "string":
        raise JsonError("INCORRECT_TYPE")
    return tree.nodes[i].value


def get_bigint(tree: Tree, i: int) -> str:
    if tree.nodes[i].kind != "bigint":
        raise JsonError("INCORRECT_TYPE")
    return tree.nodes[i].value


def get_null(tree: Tree, i: int) -> None:
    if tree.nodes[i].kind != "null":
        raise JsonError("INCORRECT_TYPE")


GETTERS = {
    "int64": get_int64, "uint64": get_uint64, "int32": get_int32, "uint32": get_uint32, "double": get_double, "float": get_float, "bool": get_bool, "string": get_string,
    "bigint": get_bigint, "null": get_null,
}


def in_string(tree: Tree, i: int, kind: str) -> int | float:
    """A number written inside a string, without blanks."""
    text = get_string(tree, i)
    if not text or text[0] not in "-0123456789":
        raise JsonError("INCORRECT_TYPE")
    found, value = number(text)
    if kind in ("int64", "uint64", "int32", "uint32"):
        if found not in ("int64", "uint64"):
            raise JsonError("INCORRECT_TYPE")
        low, high = {"int64": (-INT64, INT64 - 1), "uint64": (0, UINT64 - 1), "int32": (-(1 << 31), (1 << 31) - 1), "uint32": (0, (1 << 32) - 1)}[kind]
        if not low <= value <= high:
            raise JsonError("INCORRECT_TYPE")
        return value
    return nearest_float32(text) if kind == "float" else float(value)


def number_of(tree: Tree, i: int) -> tuple[str, int | float]:
    """The dynamic number: its kind and value."""
    kind = tree.nodes[i].kind
    if kind == "bigint":
        raise JsonError("BIGINT_ERROR")
    if kind not in ("int64", "uint64", "double"):
        raise JsonError("INCORRECT_TYPE")
    return kind, tree.nodes[i].value


def wobbly(raw: str) -> bytes:
    """A string's content as WTF-8: halves of surrogate pairs are kept as three bytes each."""
    return unescape(raw, "keep").encode("utf-8", "surrogatepass")


def coarse(raw: str) -> str:
    """The kind of a value by its first character alone."""
    first = raw.lstrip(" \t\n\r")[:1]
    if first == "-" or first.isdigit():
        return "number"
    return {"{": "object", "[": "array", '"': "string", "t": "boolean", "f": "boolean", "n": "null"}.get(first, "unknown")


def is_kind(tree: Tree, i: int, kind: str) -> bool:
    """Whether a getter of this name would succeed; "number", "scalar", "integer" and "negative" look at the value's form."""
    found = tree.nodes[i].kind
    if kind in ("object", "array"):
        return found == kind
    if kind == "number":
        return found in ("int64", "uint64", "double")
    if kind == "scalar":
        return found not in ("object", "array")
    if kind == "integer":
        return bool(_DIGITS.fullmatch(tree.raw(i)))
    if kind == "negative":
        return tree.raw(i).startswith("-")
    try:
        GETTERS[kind](tree, i)
    except JsonError:
        return False
    return True
