"""Documents as a table of nodes, and what is counted over it.

One row a value, in document order: the subtree of node n is node_id > n and node_id < end_id of the same document. Joins on
it always have doc_id as a key, so they need no more than the partitioning that the table already has.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from decimal import Decimal

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import batch as B
from ..functions.errors import JsonError
from ..functions.tree import Tree, parse
from ..shipping import ship

SCHEMA = """doc_id bigint, node_id int, parent_id int, end_id int, depth int, ord int, key string, raw_key string, kind string, raw string,
 s string, i bigint, u decimal(20,0), d double, b boolean, child_count int, error string"""
_ARROW = pa.schema(
    [
        ("doc_id", pa.int64()), ("node_id", pa.int32()), ("parent_id", pa.int32()), ("end_id", pa.int32()), ("depth", pa.int32()), ("ord", pa.int32()), ("key", pa.string()), ("raw_key", pa.string()),
        ("kind", pa.string()), ("raw", pa.string()), ("s", pa.string()), ("i", pa.int64()), ("u", pa.decimal128(20, 0)), ("d", pa.float64()), ("b", pa.bool_()), ("child_count", pa.int32()), ("error", pa.string()),
    ]
)
#: Nodes that one batch holds before it is handed on.
BATCH = 20_000


def rows_of(tree: Tree, containers: bool = True) -> list[tuple]:
    """A tree's nodes as rows of SCHEMA between doc_id and error."""
    out = []
    for n, node in enumerate(tree.nodes):
        k, v = node.kind, node.value
        raw = tree.raw(n) if containers or k not in ("object", "array") else None
        out.append(
            (
                n, node.parent, node.last, node.depth, node.ord, node.key, node.raw_key, k, raw, v if k in ("string", "bigint") else None, v if k == "int64" else None,
                Decimal(v) if k == "uint64" else None, v if k == "double" else None, v if k == "bool" else None, node.children,
            )
        )
    return out


def arrays_of(batch: B.Batch, some: np.ndarray, names: Sequence[str], containers: bool = True) -> dict[str, pa.Array]:
    """The same of some nodes of a batch, as columns with these names."""
    kind, base = batch.kind[some], batch.first[batch.doc[some]]
    small = lambda v: pa.array(v, pa.int32())
    of = {
        "node_id": lambda: small(some - base), "parent_id": lambda: small(np.where(batch.parent[some] >= 0, batch.parent[some] - base, -1)), "end_id": lambda: small(batch.last[some] - base),
        "depth": lambda: small(batch.depth[some]), "ord": lambda: small(batch.ord[some]), "key": lambda: batch.keys(some), "raw_key": lambda: batch.keys(some),
        "kind": lambda: pa.array(B.KINDS, pa.string()).take(pa.array(kind)), "raw": lambda: batch.raw(some if containers else np.where(kind > B.ARRAY, some, -1)),
        "s": lambda: pc.coalesce(batch.strings(some), batch.raw(np.where(kind == B.BIGINT, some, -1))), "i": lambda: pa.array(batch.value[some], mask=kind != B.INT64),
        "u": lambda: batch.raw(np.where(kind == B.UINT64, some, -1)).cast(pa.decimal128(20, 0)), "d": lambda: pa.array(batch.real[some], mask=kind != B.DOUBLE),
        "b": lambda: pa.array(batch.value[some] != 0, mask=kind != B.BOOL), "child_count": lambda: small(batch.children[some]),
    }
    return {name: of[name]() for name in names}


def nodes(docs: DataFrame, doc_id: str = "doc_id", text: str = "json", containers: bool = True, columns: Sequence[str] | None = None, **options) -> DataFrame:
    """All nodes of all documents. A document that can't be read gives one row with its code. containers: their raw text too.
    columns: those of the table that are wanted, as Spark can't leave others out for itself."""
    ship(docs.sparkSession)
    options = {"big": True} | options
    wanted = [f for f in _ARROW if columns is None or f.name in columns]
    schema, names = pa.schema(wanted), [f.name for f in wanted]
    quick = set(options) == {"big"}

    def slow(doc, text_) -> list[tuple]:
        try:
            return [(doc, *row, None) for row in rows_of(parse(text_, **options), containers)]
        except JsonError as e:
            return [(doc, *[None] * 15, e.code)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for given in batches:
            given = given.filter(pc.is_valid(given.column(1)))
            at = 0
            for part in B.slices(given.column(1)):
                docs_, at = given.column(0).slice(at, len(part)), at + len(part)
                plain = np.zeros(len(part), bool)
                if quick:
                    batch = B.Batch(part, options["big"])
                    plain = batch.plain
                    some = np.arange(len(batch.kind))
                    made = arrays_of(batch, some, [n for n in names if n not in ("doc_id", "error")], containers)
                    made["doc_id"] = docs_.filter(pa.array(plain)).take(pa.array(batch.doc))
                    made["error"] = pa.nulls(len(some), pa.string())
                    if len(some):
                        yield pa.record_batch([made[n] for n in names], schema=schema)
                held: list[tuple] = []
                for doc, t in zip(docs_.filter(pa.array(~plain)).to_pylist(), part.filter(pa.array(~plain)).to_pylist(), strict=True):
                    held += slow(doc, t)
                    if len(held) >= BATCH:
                        yield _rows(held, schema)
                        held = []
                if held:
                    yield _rows(held, schema)

    return docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text)).mapInArrow(run, ", ".join(c for c in SCHEMA.split(", ") if c.split()[0] in names) if columns else SCHEMA)


def _rows(held: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = dict(zip(_ARROW.names, zip(*held, strict=True), strict=True))
    return pa.record_batch([pa.array(columns[f.name], f.type) for f in schema], schema=schema)


def below_key(docs: DataFrame, key: str, columns: Sequence[str], doc_id: str = "doc_id", text: str = "json", case_insensitive: bool = False) -> DataFrame:
    """doc_id, root_id and these columns of all nodes below the first child with a key of each object, the child included: what
    subtrees(t, select_key(t, key)) gives for documents with ids of their own, without a table of all nodes."""
    ship(docs.sparkSession)
    fold = lambda k: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in k) if case_insensitive else k
    name = fold(key)
    row = pa.struct([("root_id", pa.int32()), *((f.name, f.type) for f in _ARROW if f.name in columns)])
    names = [f.name for f in row][1:]
    places = [_ARROW.names.index(n) - 1 for n in names]

    def quick(batch: B.Batch) -> pa.Array:
        hit = np.flatnonzero(np.asarray(pc.equal(pc.ascii_lower(batch.keys(np.arange(len(batch.kind)))), name).fill_null(False))) if case_insensitive else batch.with_key(name)
        hit = hit[np.sort(np.unique(batch.parent[hit], return_index=True)[1])]
        size = batch.last[hit] - hit
        at = np.cumsum(size) - size
        some = np.arange(size.sum()) + np.repeat(hit - at, size)
        made = arrays_of(batch, some, names)
        root = pa.array(np.repeat(hit - batch.first[batch.doc[hit]], size), pa.int32())
        lists = np.searchsorted(np.repeat(batch.doc[hit], size), np.arange(len(batch) + 1))
        return pa.ListArray.from_arrays(pa.array(lists, pa.int32()), pa.StructArray.from_arrays([root, *(made[n] for n in names)], [f.name for f in row]))

    def slow(t: str) -> list[dict]:
        try:
            tree = parse(t, big=True)
        except JsonError:
            return []
        rows, seen, out = rows_of(tree), set(), []
        for i, node in enumerate(tree.nodes):
            if node.key is not None and fold(node.key) == name and node.parent not in seen:
                seen.add(node.parent)
                out += [{"root_id": i} | {n: rows[j][p] for n, p in zip(names, places, strict=True)} for j in range(i, node.last)]
        return out

    found = B.column(F.col(text), pa.list_(row), quick, slow)
    return docs.select(F.col(doc_id).alias("doc_id"), F.explode(found).alias("n")).select("doc_id", "n.*")


_COUNTERS = ("integer_count", "float_count", "object_count", "array_count", "null_count", "true_count", "false_count", "key_count", "repeated_key_count", "maximum_depth", "maximum_object_size", "maximum_array_size")


def document_statistics(docs: DataFrame, doc_id: str = "doc_id", text: str = "json") -> DataFrame:
    """doc_id and those of the counters of `statistics` that need no texts, for each document that can be read, without a table of nodes."""
    ship(docs.sparkSession)
    row = pa.struct([(n, pa.int32() if n.startswith("maximum") else pa.int64()) for n in _COUNTERS])

    def quick(batch: B.Batch) -> pa.Array:
        kind, doc, n = batch.kind, batch.doc, len(batch)
        count = lambda some: np.bincount(doc[some], minlength=n)
        keyed = np.flatnonzero(batch.key_start >= 0)
        codes = batch.keys(keyed).dictionary_encode()
        names = max(1, len(codes.dictionary))
        pairs = doc[keyed] * names + codes.indices.to_numpy()
        if n * names <= 1 << 22:
            seen = np.zeros(n * names, bool)
            seen[pairs] = True
            pairs = np.flatnonzero(seen)
        else:
            pairs = np.unique(pairs)
        keys = count(keyed)

        def largest(which: int) -> pa.Array:
            out = np.maximum.reduceat(np.where(kind == which, batch.children, -1), batch.first[:-1]).astype(np.int32)
            return pa.array(out, mask=out < 0)

        columns = [
            count((kind == B.INT64) | (kind == B.UINT64)), count(kind == B.DOUBLE), count(kind == B.OBJECT), count(kind == B.ARRAY), count(kind == B.NULL), count((kind == B.BOOL) & (batch.value != 0)),
            count((kind == B.BOOL) & (batch.value == 0)), keys, keys - np.bincount(pairs // names, minlength=n),
        ]
        rows = pa.StructArray.from_arrays([*map(pa.array, columns), pa.array(np.maximum.reduceat(batch.depth, batch.first[:-1])), largest(B.OBJECT), largest(B.ARRAY)], list(_COUNTERS))
        return pa.ListArray.from_arrays(pa.array(np.arange(n + 1), pa.int32()), rows)

    def slow(t: str) -> list[dict]:
        try:
            found = parse(t, big=True).nodes
        except JsonError:
            return []
        count = lambda *kinds: sum(n.kind in kinds for n in found)
        keys = [n.key for n in found if n.key is not None]
        size = lambda kind: max((n.children for n in found if n.kind == kind), default=None)
        true = sum(n.kind == "bool" and n.value for n in found)
        values = (
            count("int64", "uint64"), count("double"), count("object"), count("array"), count("null"), true, count("bool") - true, len(keys), len(keys) - len(set(keys)), max(n.depth for n in found), size("object"),
            size("array"),
        )
        return [dict(zip(_COUNTERS, values, strict=True))]

    # A list of one or none: a filter on a function's result would be evaluated apart, and read every document again.
    got = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.explode(B.column(F.col(text), pa.list_(row), quick, slow)).alias("g"))
    return got.select("doc_id", "g.*")


def statistics(table: DataFrame) -> DataFrame:
    """Counters of each document, from its nodes: one aggregation, combined before it is shuffled."""
    has = lambda cond: F.count_if(cond)
    of = lambda *kinds: F.col("kind").isin(*kinds)
    ascii_ = lambda c: F.octet_length(c) == F.length(c)
    return table.where("error is null").groupBy("doc_id").agg(
        has(of("int64", "uint64")).alias("integer_count"),
        has(of("int64") & F.col("i").between(-(1 << 31), (1 << 31) - 1)).alias("integer32_count"),
        has(of("int64") & F.col("i").between(0, (1 << 32) - 1)).alias("unsigned_integer32_count"),
        has(of("uint64") | (of("int64") & (F.col("i") >= 0))).alias("unsigned_integer_count"),
        has(of("double")).alias("float_count"),
        (has(of("string")) + F.count("key")).alias("string_count"),
        (F.coalesce(F.sum(F.when(of("string"), F.octet_length("s"))), F.lit(0)) + F.coalesce(F.sum(F.octet_length("key")), F.lit(0))).alias("string_byte_count"),
        has(of("string") & ascii_(F.col("s"))).alias("ascii_string_count"),
        F.max(F.when(of("string"), F.octet_length("s"))).alias("string_maximum_length"),
        has(of("object")).alias("object_count"), has(of("array")).alias("array_count"), has(of("null")).alias("null_count"),
        has(of("bool") & F.col("b")).alias("true_count"), has(of("bool") & ~F.col("b")).alias("false_count"),
        F.count("key").alias("key_count"), F.max(F.octet_length("key")).alias("key_maximum_length"), has(F.col("key").isNotNull() & ascii_(F.col("key"))).alias("ascii_key_count"),
        (F.count("key") - F.count_distinct("key")).alias("repeated_key_count"),
        F.max("depth").alias("maximum_depth"),
        F.max(F.when(of("object"), F.col("child_count"))).alias("maximum_object_size"), F.max(F.when(of("array"), F.col("child_count"))).alias("maximum_array_size"),
        F.max(F.when(F.col("node_id") == 0, F.octet_length("raw"))).alias("byte_count"),
        F.coalesce(F.sum(F.when(F.col("node_id") == 0, F.length(F.regexp_replace("raw", r"[^\\]", "")))), F.lit(0)).alias("backslash_count"),
        F.coalesce(F.sum(F.when(F.col("node_id") == 0, F.octet_length(F.regexp_replace("raw", r"[\x00-\x7F]", "")))), F.lit(0)).alias("non_ascii_byte_count"),
    )


def children(table: DataFrame, parents: DataFrame) -> DataFrame:
    """The nodes whose parents are these (doc_id, node_id)."""
    p = parents.select(F.col("doc_id"), F.col("node_id").alias("parent_id"))
    return table.join(p, ["doc_id", "parent_id"], "left_semi")


def subtrees(table: DataFrame, roots: DataFrame) -> DataFrame:
    """All nodes below these (doc_id, node_id, end_id), the roots included, with `root_id`."""
    r = roots.select(F.col("doc_id").alias("_doc"), F.col("node_id").alias("root_id"), F.col("end_id").alias("_end"))
    inside = (F.col("doc_id") == F.col("_doc")) & (F.col("node_id") >= F.col("root_id")) & (F.col("node_id") < F.col("_end"))
    return table.join(r, inside).drop("_doc", "_end")


def select_key(table: DataFrame, key: str, case_insensitive: bool = False) -> DataFrame:
    """The first child with a key of each object."""
    name: Column = F.col("key")
    if case_insensitive:
        upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
        name, key = F.translate(name, upper, lower), key.translate(str.maketrans(upper, lower))
    hit = table.where(name == key)
    first = hit.groupBy("doc_id", "parent_id").agg(F.min("node_id").alias("node_id"))
    return hit.join(first.select("doc_id", "node_id"), ["doc_id", "node_id"], "left_semi")
