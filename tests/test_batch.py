"""Documents read many at once are those that the strict reader reads, and queries ask them once."""

from __future__ import annotations

import random

import numpy as np
import pyarrow as pa
import pytest

from tessera import workloads as W
from tessera.functions import batch as B
from tessera.functions import api, batch_write, paths, write
from tessera.functions.errors import JsonError
from tessera.functions.tree import Tree, parse
from tessera.functions.write import Fractured
from tessera.operators import nodes as N

SF = "/root/testdata/sf0.001"
ATOMS = (
    "1", "-0", "0", "1.5", "1e3", "true", "null", "false", '"x"', '"é"', '""', '"\\u00e9"', "12345678901234567890", "18446744073709551616", "-9223372036854775808", "9223372036854775807", "[]", "{}", " { } ",
    "[0,[1,2]]", '{"a":1}', '{"a":1,"a":2}', "nul", '"a\tb"', " 7 ", "01", "-", "1.", "1e400", "1E-7", "é", "﻿1", "[[[[1]]]]", '{"lines":[{"q":1.5},{"q":2},{"r":1},3]}', '"{[,:]}"',
)


def texts(draw: random.Random, n: int) -> list[str | None]:
    """Documents, some of them spoilt, and nulls."""

    def value(depth: int) -> str:
        r, blank = draw.random(), draw.choice(["", " ", "\n"])
        if depth > 4 or r < 0.5:
            return draw.choice(ATOMS)
        if r < 0.75:
            return "[" + blank + ("," + blank).join(value(depth + 1) for _ in range(draw.randint(0, 4))) + blank + "]"
        return "{" + blank + (blank + ",").join(f'"{draw.choice(["a", "b", "lines", "q"])}"{blank}:{value(depth + 1)}' for _ in range(draw.randint(0, 4))) + "}"

    out: list[str | None] = []
    for _ in range(n):
        t = value(0)
        if draw.random() < 0.2:
            i = draw.randrange(len(t))
            t = t[:i] + draw.choice(["", ",", "}", "]", "[", "{", '"', ":", "1", " "]) + t[i + draw.randint(0, 1) :]
        out.append(t if draw.random() > 0.02 else None)
    return out


def tree_of(text: str | None, big: bool) -> Tree | None:
    try:
        return None if text is None else parse(text, big=big)
    except JsonError:
        return None


def trees(docs: list[str | None], big: bool) -> tuple[B.Batch, list[Tree]]:
    batch = B.Batch(pa.array(docs, pa.string()), big)
    return batch, [tree_of(t, big) for t, plain in zip(docs, batch.plain, strict=True) if plain]


@pytest.mark.parametrize("seed", range(4))
def test_nodes_equal_the_readers(seed):
    draw, met = random.Random(seed), 0
    for _ in range(40):
        docs, big = texts(draw, 40), draw.random() < 0.5
        batch, want = trees(docs, big)
        for d, tree in enumerate(want):
            assert tree is not None
            low, high = batch.first[d], batch.first[d + 1]
            some = np.arange(low, high)
            assert len(some) == len(tree.nodes)
            raws, keys, strings = batch.raw(some).to_pylist(), batch.keys(some).to_pylist(), batch.strings(some).to_pylist()
            for i, node in enumerate(tree.nodes):
                j, parent = low + i, batch.parent[low + i]
                assert (B.KINDS[batch.kind[j]], raws[i], keys[i], batch.depth[j], batch.ord[j], batch.children[j], batch.last[j] - low, parent - low if parent >= 0 else -1) == (
                    node.kind, tree.raw(i), node.key, node.depth, node.ord, node.children, node.last, node.parent,
                ), (tree.text, i)
                assert strings[i] == (node.value if node.kind == "string" else None)
                if node.kind in ("int64", "double", "bool"):
                    assert (batch.real if node.kind == "double" else batch.value)[j] == node.value
            met += 1
        left = [t for t, plain in zip(docs, batch.plain, strict=True) if not plain and tree_of(t, big)]
        assert all("\\" in t or t.startswith("﻿") or "e1" in t.lower() for t in left), left
    assert met > 300


@pytest.mark.parametrize("seed", range(4))
def test_paths_equal_the_readers(seed):
    def said(fn):
        try:
            return fn()
        except JsonError as e:
            return e.code

    draw = random.Random(seed)
    for _ in range(20):
        batch, want = trees(texts(draw, 40), True)
        for pointer in ("", "/a", "/a/0", "/lines/1/q", "/", "/-", "/a/-", "/a/01", "x", "/a~1", "/a~", "/0", "/lines/x", "/a/b/q"):
            at, codes = batch.at_pointer(pointer)
            for d, tree in enumerate(want):
                assert (at[d] - batch.first[d] if at[d] >= 0 else codes[d]) == said(lambda t=tree, p=pointer: paths.at_pointer(t, p)), (tree.text, pointer)
        for path in ("$.lines[*].q", "$.*", "$[*]", "$.a.*.b", "$[*][*]", "$.*.lines[*].q", "$.lines.*.q", "$.a[0]", "$.*.a"):
            at = batch.at_wildcard(path)
            each, failed = batch.each_at_path(path) or (None, None)
            for d, tree in enumerate(want):
                if at is not None:
                    assert list(at[batch.doc[at] == d] - batch.first[d]) == paths.at_path_with_wildcard(tree, path), (tree.text, path)
                got = said(lambda t=tree, p=path: list(paths.for_each_at_path(t, p)))
                if each is not None:
                    assert failed[d] == isinstance(got, str), (tree.text, path)
                    assert failed[d] or list(each[batch.doc[each] == d] - batch.first[d]) == got


LAYOUTS = (
    Fractured(), Fractured(max_inline_length=60, max_items_per_line=3, enable_table_format=False), Fractured(max_inline_length=10, max_total_line_length=40, enable_table_format=False, colon_padding=False, comma_padding=False),
    Fractured(max_inline_complexity=0, max_compact_array_complexity=3, simple_bracket_padding=False, enable_table_format=False, indent_spaces=1, max_total_line_length=25), Fractured(enable_compact_multiline=False, max_inline_length=12, min_table_rows=1),
)


@pytest.mark.parametrize("seed", range(4))
def test_texts_equal_the_writers(seed):
    draw, wrote = random.Random(seed), 0
    for _ in range(30):
        batch, want = trees(texts(draw, 40), True)
        assert batch_write.minify(batch).to_pylist() == [write.minify(t) for t in want]
        step = draw.choice([0, 1, 4])
        assert batch_write.prettify(batch, step).to_pylist() == [write.prettify(t, step=step) for t in want]
        for layout in LAYOUTS:
            got, left = batch_write.fractured(batch, layout)
            for text, no, tree in zip(got.to_pylist(), left, want, strict=True):
                assert no or text == write.fractured(tree, layout), (tree.text, layout)
                wrote += not no
    assert wrote > 1000


def test_slices():
    docs = pa.array(["x" * (B.SLICE // 3)] * 10 + [None, "y" * B.SLICE * 2, "z"])
    parts = list(B.slices(docs))
    assert pa.concat_arrays(parts).equals(docs) and len(parts) > 3 and all(len(p) == 1 or sum(len(t or "") for t in p.to_pylist()) <= B.SLICE for p in parts)


def evaluations(df) -> int:
    return df._jdf.queryExecution().executedPlan().toString().count("ArrowEvalPython")


def test_sizes_read_once(spark):
    assert evaluations(W.sizes(spark, SF)) == 1


def test_lines_are_shuffled_as_rows(spark):
    """Below the shuffle of lines nothing is aggregated."""
    plan = W.order_documents(spark, SF)._jdf.queryExecution().executedPlan().toString()
    shuffles = [i for i, line in enumerate(plan.splitlines()) if "hashpartitioning(l_orderkey" in line]
    assert len(shuffles) == 1 and "Aggregate" not in "\n".join(plan.splitlines()[shuffles[0] :]).split("hashpartitioning(o_orderkey")[0]


def test_small_tables_are_spread(spark):
    """One file of customers or parts is more than one task's work, and a document's tests and getters share an evaluation."""
    for query in (W.kind_tests, W.typed_getters):
        plan = query(spark, SF)._jdf.queryExecution().executedPlan().toString()
        assert "RoundRobinPartitioning" in plan and plan.count("ArrowEvalPython") == 1


def test_node_tables_agree(spark):
    """Nodes, subtrees and counters that are made for batches are those of the reader of one document, wrong documents among them."""
    draw = random.Random(9)
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts(draw, 600))], "doc_id bigint, json string").repartition(3)
    rows = lambda df, names: sorted(map(repr, df.select(*names).collect()))
    table = N.nodes(docs).cache()
    slow = N.nodes(docs, minus_zero=False)  # an option that batches don't know
    names = [c for c in table.columns if c != "u"]
    assert rows(table, names) == rows(slow, names) and table.where("error is not null").count() > 20
    assert rows(N.nodes(docs, columns=("doc_id", "kind", "error")), ["doc_id", "kind", "error"]) == rows(table, ["doc_id", "kind", "error"])
    for key, fold in (("LINES", True), ("a", False)):
        want = N.subtrees(table, N.select_key(table, key, case_insensitive=fold))
        some = ["doc_id", "root_id", "node_id", "key", "i", "kind", "raw"]
        got = N.below_key(docs, key, some[2:], case_insensitive=fold)
        assert rows(got, some) == rows(want, some) and got.count() > 20
    counters = N.document_statistics(docs)
    assert rows(counters, counters.columns) == rows(N.statistics(table), counters.columns)


def test_order_nodes_are_not_shuffled(spark):
    """Nodes of orders are neither written nor shuffled: what is counted of a document is one row, made where the document is."""
    for query in (W.nodes_subtree, W.nodes_statistics):
        plan = query(spark, SF)._jdf.queryExecution().executedPlan().toString()
        assert plan.count("ArrowEvalPython") == 1 and plan.count("FileScan") == 2 and "MapInArrow" not in plan
        lines = plan[: plan.index("ArrowEvalPython")].splitlines()
        shuffles = [i for i, line in enumerate(lines) if "Exchange" in line]
        assert all("partial_count" in lines[i + 1] for i in shuffles)


def test_batched_columns_agree(spark):
    """The columns that several documents' batches give are those of one document at a time."""
    docs = spark.createDataFrame([(t,) for t in texts(random.Random(5), 500)], "json string")
    get = {"x": ("int64", "/a"), "y": ("string", "/lines/0/q"), "z": ("double", "/0"), "w": ("uint32", "/b"), "f": ("float", "/q"), "u": ("uint64", "/a")}
    for make in (
        lambda **o: api.json_wildcard("json", "$.lines[*].q", **o), lambda **o: api.json_wildcard("json", "$.a.*", dialect="ondemand", **o), lambda **o: api.json_pointers("json", ["", "/a", "/lines/1", "/a/-", "x"], **o),
        lambda **o: api.json_raw("json", pointer="/a", **o), lambda **o: api.json_type("json", "/b", **o), lambda **o: api.json_get_many("json", get, **o), lambda **o: api.json_get("json", "bool", pointer="/a", **o),
        lambda **o: api.json_minify("json", **o), lambda **o: api.json_prettify("json", **o),
    ):
        got = docs.select(make().alias("q"), make(minus_zero=False).alias("s")).collect()  # batches don't know this option
        assert all(r.q == r.s for r in got) and len(got) == 500


def test_pages_come_in_bounded_batches(spark):
    """A batch is bounded by its bytes, and one file of pages is more than one task's work."""
    plan = W.html_round_trip(spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "RoundRobinPartitioning" in plan and int(spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch").rstrip("b")) <= 8 << 20
