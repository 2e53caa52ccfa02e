"""Reading many fields of a document once, in the lane that is right for it.

The native lane is one from_json with a schema of the asked fields alone, so Spark prunes the rest; it is for documents that are
known to be good and don't repeat an asked key. The strict lane is one Python function a document, which takes the C decoder's
value where the document is plain and the strict reader's where not. `auto` is the native lane where a flag column says
that a document is known to be plain, and the strict one for all others; without a flag it is the strict lane. Python functions
inside a `when` run for every row, so the strict lane is given null in place of the documents that it needn't read.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import api
from ..functions.paths import pointer_key

LANES = ("auto", "native", "strict")


class KeySelector:
    """A fixed set of keys of one object. Keys are distinct, of 1 to 63 bytes, at most 255, without quotes and backslashes."""

    def __init__(self, *keys: str):
        if not 0 < len(keys) <= 255 or len(set(keys)) != len(keys):
            raise ValueError("a selector has 1 to 255 distinct keys")
        for key in keys:
            if not 0 < len(key.encode()) <= 63 or any(c in key for c in '\\"\0'):
                raise ValueError(f"{key!r} can't be a selector's key")
        self.keys = keys

    def __len__(self) -> int:
        return len(self.keys)

    def key_at(self, i: int) -> str:
        return self.keys[i]

    def match_raw(self, raw: str) -> int | None:
        """The number of a raw key, or None."""
        return self.keys.index(raw) if raw in self.keys else None

    def describe(self) -> str:
        return f"{len(self.keys)} keys: " + ", ".join(self.keys)

    def raws(self, c: Column | str) -> Column:
        """struct<value map of texts, matched, error>: the first text of each key that is there, in one reading."""
        keys = self.keys
        each = api.json_each(c)
        children = F.filter(each["value"], lambda f: f["raw_key"].isin(*keys))
        first = F.aggregate(
            children,
            F.expr("cast(map() as map<string,string>)"),
            lambda m, f: F.when(F.map_contains_key(m, f["raw_key"]), m).otherwise(F.map_concat(m, F.create_map(f["raw_key"], f["raw"]))),
        )
        return F.struct(first.alias("value"), F.size(first).alias("matched"), each["error"].alias("error"))


def native_fields(c: Column | str, schema: T.StructType | str) -> Column:
    """One native reading of many fields of good documents; null where one doesn't fit. Without options, Spark prunes what isn't used."""
    return F.from_json(c if isinstance(c, Column) else F.col(c), schema)


def fields(c: Column | str, wanted: dict[str, tuple[str, str]], lane: str = "auto", plain: Column | None = None) -> Column:
    """struct<name: value, ...> for name -> (kind, pointer to a top-level key), null where there is no such value.

    plain: in the lane `auto`, which documents are known to be good and without repeated keys.
    """
    if lane not in LANES:
        raise ValueError(f"lanes are {LANES}")
    column = c if isinstance(c, Column) else F.col(c)
    names = {name: pointer_key(pointer[1:]) for name, (_, pointer) in wanted.items()}
    top = not any("/" in pointer[1:] for _, pointer in wanted.values()) and len(set(names.values())) == len(names)

    def strict(document: Column) -> Column:
        got = api.json_get_many(document, wanted)
        return F.struct(*(got[name]["value"].alias(name) for name in wanted))

    if lane == "strict" or not top or (lane == "auto" and plain is None):
        return strict(column)
    read = native_fields(column, ", ".join(f"`{names[name]}` {api.TYPES[kind]}" for name, (kind, _) in wanted.items()))
    native = F.struct(*(read[names[name]].alias(name) for name in wanted))
    if lane == "native":
        return native
    known = F.coalesce(plain, F.lit(False))
    return F.when(known, native).otherwise(strict(F.when(~known, column)))


def extract(c: Column | str, pointer: str, kind: str, schema: T.StructType | None = None) -> Column:
    """A path that is checked against a schema before the query runs, then read."""
    if schema is not None:
        from ..functions.paths import check_pointer

        check_pointer(pointer, schema)
    return api.json_get(c, kind, pointer=pointer)
