"""Rows and JSON: a StructType says which members a document has.

Field metadata: "json_name" renames a member, "json_skip" leaves it out, "json_enum" lists the allowed names of an enum.
A member that is not nullable must be there; missing nullable members are null; unknown members are ignored; of repeated
keys the first counts.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from decimal import Decimal

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import values
from .api import to_json_text
from .errors import JsonError
from .tree import Tree, parse

_custom: dict[str, tuple[T.DataType, Callable]] = {}


def register(name: str, kind: T.DataType | str, fn: Callable[[Tree, int], object]) -> None:
    """A decoder of one's own: fields with metadata {"json_decoder": name} are read by fn(tree, node)."""
    _custom[name] = (T._parse_datatype_string(kind) if isinstance(kind, str) else kind, fn)


def members(schema: T.StructType) -> list[tuple[str, T.StructField]]:
    """(name in JSON, field) of the members that are not skipped."""
    return [((f.metadata or {}).get("json_name", f.name), f) for f in schema.fields if not (f.metadata or {}).get("json_skip")]


def _decode(tree: Tree, i: int, kind: T.DataType, meta: dict) -> object:
    if meta.get("json_decoder"):
        return meta["json_decoder"](tree, i)
    node = tree.nodes[i]
    if isinstance(kind, T.StructType):
        if node.kind != "object":
            raise JsonError("INCORRECT_TYPE")
        found: dict[str, int] = {}
        for child in tree.child_ids(i):
            found.setdefault(tree.nodes[child].key, child)
        out = {}
        for name, f in members(kind):
            if name not in found or f.nullable and tree.nodes[found[name]].kind == "null":
                if not f.nullable:
                    raise JsonError("NO_SUCH_FIELD")
                out[f.name] = None
            else:
                out[f.name] = _decode(tree, found[name], f.dataType, f.metadata or {})
        return out
    if isinstance(kind, T.ArrayType):
        if node.kind != "array":
            raise JsonError("INCORRECT_TYPE")
        return [None if kind.containsNull and tree.nodes[c].kind == "null" else _decode(tree, c, kind.elementType, {}) for c in tree.child_ids(i)]
    if isinstance(kind, T.MapType):
        if node.kind != "object":
            raise JsonError("INCORRECT_TYPE")
        pairs: dict[str, object] = {}
        for c in tree.child_ids(i):
            if tree.nodes[c].key not in pairs:
                pairs[tree.nodes[c].key] = None if kind.valueContainsNull and tree.nodes[c].kind == "null" else _decode(tree, c, kind.valueType, {})
        return pairs
    if isinstance(kind, T.StringType):
        text = values.get_string(tree, i)
        if meta.get("json_enum") and text not in meta["json_enum"]:
            raise JsonError("INCORRECT_TYPE")
        if meta.get("json_char") and len(text) != 1:
            raise JsonError("INCORRECT_TYPE")
        return text
    if isinstance(kind, T.DecimalType):
        return Decimal(values.get_uint64(tree, i))
    bits = {T.ByteType: 8, T.ShortType: 16, T.IntegerType: 32}.get(type(kind))
    if bits:
        value = values.get_int64(tree, i)
        if not -(1 << bits - 1) <= value < 1 << bits - 1:
            raise JsonError("NUMBER_OUT_OF_RANGE")
        return value
    getter = {T.LongType: values.get_int64, T.DoubleType: values.get_double, T.FloatType: values.get_float, T.BooleanType: values.get_bool}.get(type(kind))
    if not getter:
        raise JsonError("INCORRECT_TYPE")
    return getter(tree, i)


def _visible(schema: T.DataType) -> T.DataType:
    """The schema without skipped members and without demands, as a result type."""
    if isinstance(schema, T.StructType):
        return T.StructType([T.StructField(f.name, _visible(_custom[f.metadata["json_decoder"]][0] if (f.metadata or {}).get("json_decoder") else f.dataType)) for _, f in members(schema)])
    if isinstance(schema, T.ArrayType):
        return T.ArrayType(_visible(schema.elementType))
    if isinstance(schema, T.MapType):
        return T.MapType(schema.keyType, _visible(schema.valueType))
    return schema


def _with_decoders(schema: T.DataType) -> T.DataType:
    """A copy whose metadata hold the decoders themselves, for the workers."""
    if isinstance(schema, T.StructType):
        fields = []
        for f in schema.fields:
            meta = dict(f.metadata or {})
            if meta.get("json_decoder"):
                meta["json_decoder"] = _custom[meta["json_decoder"]][1]
            fields.append(T.StructField(f.name, _with_decoders(f.dataType), f.nullable, meta))
        return T.StructType(fields)
    if isinstance(schema, T.ArrayType):
        return T.ArrayType(_with_decoders(schema.elementType), schema.containsNull)
    if isinstance(schema, T.MapType):
        return T.MapType(schema.keyType, _with_decoders(schema.valueType), schema.valueContainsNull)
    return schema


def decode(c: Column | str, schema: T.StructType) -> Column:
    """struct<value, error>: documents as rows of a schema."""
    plan = _with_decoders(schema)

    def one(text):
        try:
            return _decode(parse(text, big=True), 0, plan, {}), None
        except JsonError as e:
            return None, e.code

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            got = [(None, None) if t is None else one(t) for t in texts]
            yield pd.DataFrame({"value": pd.Series([g[0] for g in got], dtype=object), "error": pd.Series([g[1] for g in got], dtype=object)})

    kind = T.StructType([T.StructField("value", _visible(schema)), T.StructField("error", T.StringType())])
    return F.pandas_udf(run, kind)(F.col(c) if isinstance(c, str) else c)


def _encoded(c: Column, kind: T.DataType) -> Column:
    if isinstance(kind, T.StructType):
        inner = F.struct(*(_encoded(c[f.name], f.dataType).alias(name) for name, f in members(kind)))
        return F.when(c.isNotNull(), inner)
    if isinstance(kind, T.ArrayType):
        return F.transform(c, lambda x: _encoded(x, kind.elementType))
    if isinstance(kind, T.MapType):
        return F.transform_values(c, lambda _, v: _encoded(v, kind.valueType))
    return c


def encode(c: Column | str, schema: T.StructType) -> Column:
    """Rows as JSON text, members renamed and left out as the schema says, nulls written. Native."""
    return F.to_json(_encoded(F.col(c) if isinstance(c, str) else c, schema), {"ignoreNullFields": "false"})


def extract_from(*columns: Column | str) -> Column:
    """Some columns as a JSON object. Native: the others are not read."""
    return to_json_text(*columns)


class From:
    """One-line decoding: from_(column).to(schema), .get(kind), .array(kind), .optional(kind)."""

    def __init__(self, c: Column | str):
        self.c = c

    def to(self, schema: T.StructType) -> Column:
        return decode(self.c, schema)

    def get(self, kind: str, pointer: str = "") -> Column:
        from .api import json_get

        return json_get(self.c, kind, pointer=pointer)

    def array(self, kind: str) -> Column:
        wrapped = T.StructType([T.StructField("a", T.ArrayType(T._parse_datatype_string(kind), False), False)])
        text = F.concat(F.lit('{"a":'), F.col(self.c) if isinstance(self.c, str) else self.c, F.lit("}"))
        out = decode(text, wrapped)
        return F.struct(out["value"]["a"].alias("value"), out["error"].alias("error"))

    def optional(self, kind: str, pointer: str = "") -> Column:
        """The value, or null where it is missing or null; other errors stay."""
        out = self.get(kind, pointer)
        from .api import json_type

        empty = (out["error"] == "NO_SUCH_FIELD") | (json_type(self.c, pointer)["value"] == "null")
        return F.struct(out["value"].alias("value"), F.when(F.coalesce(empty, F.lit(False)), None).otherwise(out["error"]).alias("error"))

    def number(self, pointer: str = "") -> Column:
        from .api import json_number

        return json_number(self.c, pointer)


from_ = From
