"""Queries against their SQL, streams of documents, lanes, binding and nodes, in Spark."""

from __future__ import annotations

import json

import duckdb
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera import queries as Q
from tessera.functions import api, binding
from tessera.functions.errors import JsonError
from tessera.functions.paths import check_pointer
from tessera.operators import nodes as N
from tessera.plans.selector import KeySelector, fields, native_fields
from tessera.sources import documents as D
from tessera.sources import framing
from tessera.streaming import documents as S

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{SF}/{t}.parquet')")
    return con


@pytest.mark.parametrize("name", Q.NAMES)
def test_query(spark, duck, name):
    got = Q.queries()[name](spark, SF)
    names = sorted(got.columns)
    rows = [tuple(r) for r in got.select(*names).collect()]
    cursor = duck.execute(Q.oracle_sql()[name])
    columns = [d[0] for d in cursor.description]
    assert sorted(columns) == names
    want = [tuple(r[columns.index(n)] for n in names) for r in cursor.fetchall()]
    near = lambda r: tuple(round(v, 6) if isinstance(v, float) else v for v in r)
    key = lambda r: tuple((v is None, str(v)) for v in r)
    assert sorted(map(near, rows), key=key) == sorted(map(near, want), key=key)


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


DOCS = ['{"a":1}', '{"a":[1,2,{"b":"x\\"}"}]}', "[]", '{"c":"é😀"}', "{}"]


@pytest.fixture
def streams(tmp_path):
    text = {
        "whitespace": "\n  ".join(DOCS), "newline": "\n".join(DOCS) + "\n", "sequence": "".join(f"\x1e{d}\n" for d in DOCS), "comma": " , ".join(DOCS), "comma_array": f" [{','.join(DOCS)}]\n",
    }
    for name, t in text.items():
        (tmp_path / name).mkdir()
        (tmp_path / name / "x.json").write_text(t, encoding="utf-8")
    return tmp_path, text


def test_framings(spark, streams):
    path, text = streams
    for name, t in text.items():
        got = D.read_documents(spark, str(path / name), name).orderBy("doc_id").collect()
        assert [r.json for r in got] == DOCS and all(r.error is None for r in got)
        for r in got:
            assert t.encode()[r.byte_offset :].decode().startswith(r.json)
        if name in ("newline", "sequence"):
            assert sorted(r.json for r in D.read_documents(spark, str(path / name), name, mode="skip").collect()) == sorted(DOCS)


def test_data_source(spark, streams):
    path, _ = streams
    D.register(spark)
    for name in framing.FORMATS:
        for block in (1, 7, 20, 1000):
            got = spark.read.format("tessera_json").option("path", str(path / name)).option("framing", name).option("blockBytes", block).load()
            assert sorted(r.json for r in got.collect()) == sorted(DOCS), (name, block)


def test_stream_errors(spark, tmp_path):
    f = tmp_path / "x.json"
    f.write_text('{"a":1}\n[1,]\n{"b":2}\n{"c":')
    stop = D.read_documents(spark, str(f)).orderBy("doc_id").collect()
    assert [(r.json, r.error) for r in stop] == [('{"a":1}', None), ("[1,]", "TAPE_ERROR")]
    skip = D.read_documents(spark, str(f), mode="skip")
    assert [(r.json, r.error) for r in skip.orderBy("doc_id").collect()] == [('{"a":1}', None), ("[1,]", "TAPE_ERROR"), ('{"b":2}', None)]
    assert D.stop_at_error(skip).count() == 2 and D.first_of_each(skip).first().json == '{"a":1}'
    assert [r.error for r in D.read_documents(spark, str(f), mode="skip", max_doc_bytes=2).collect()] == [None, "TAPE_ERROR", None]
    row = D.slices(spark, str(f)).first()
    assert (row.documents, row.truncated_bytes, row.size_in_bytes) == (3, 5, f.stat().st_size)
    f.write_text("1,2")
    assert D.read_documents(spark, str(f), "comma_array").first().error == "TAPE_ERROR"
    f.write_bytes(b"\xef\xbb\xbf[1]\n[2]")
    assert [(r.byte_offset, r.json) for r in D.read_documents(spark, str(f)).orderBy("doc_id").collect()] == [(3, "[1]"), (7, "[2]")]
    f.write_text("")
    assert D.read_documents(spark, str(f)).count() == 0
    with pytest.raises(ValueError):
        D.read_documents(spark, str(f), "tabs")


@pytest.mark.parametrize("size", [1, 2, 3, 5, 8, 13, 100])
def test_slices(size):
    data = "\n".join(DOCS).encode() + b"\n"
    parts = [framing.slice_at(data, b"\n", size, i) for i in range(-(-len(data) // size))]
    assert b"".join(parts) == data and all(p.endswith(b"\n") for p in parts if p)


def test_splits():
    cut = lambda t, f="whitespace": [p for _, p, done in framing.split(t, f) if done]
    assert cut('[1,2]{"a":1}3 "x" true') == ["[1,2]", '{"a":1}', "3", '"x"', "true"] and cut("") == [] and cut('{"a":') == [] and cut('1 "x') == ["1"]
    assert cut(",,1,,[2,3],", "comma") == ["1", "[2,3]"] and cut("[]", "comma_array") == [] and cut("\x1e1\n\x1e\n\x1e2", "sequence") == ["1", "2"]


def test_stream_of_files(spark, streams, tmp_path):
    path, _ = streams
    q = S.read_stream(spark, str(path / "newline")).writeStream.format("memory").queryName("files").start()
    q.processAllAvailable()
    q.stop()
    assert sorted(r.json for r in spark.sql("select * from files").collect()) == sorted(DOCS)


@pytest.mark.parametrize("name", ["whitespace", "newline", "sequence"])
def test_stream_of_chunks(spark, streams, tmp_path, name):
    """Bytes cut anywhere, in several batches, come out as the documents."""
    _, text = streams
    data = (text[name] + ("\n" if name == "whitespace" else "\x1e" if name == "sequence" else "")).encode()
    schema = "source string, seq long, data binary"
    for batch in range(3):
        part = data[batch * len(data) // 3 : (batch + 1) * len(data) // 3]
        rows = [("s", batch * 1000 + i, bytearray(part[i : i + 5])) for i in range(0, len(part), 5)]
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / "in" / f"batch{batch}"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))
    q = S.chunks(stream, name).writeStream.format("memory").queryName(f"chunks_{name}").outputMode("append").option("checkpointLocation", str(tmp_path / "state")).start()
    q.processAllAvailable()
    q.stop()
    got = spark.sql(f"select * from chunks_{name} order by doc_id").collect()
    assert [r.json for r in got] == DOCS and [r.doc_id for r in got] == list(range(len(DOCS))) and all(r.error is None for r in got)


def test_write(spark, tmp_path):
    D.write_documents(spark.createDataFrame([('{"a":\n1}',), ("[]",)], "json string"), str(tmp_path / "out"))
    assert sorted(r.json for r in D.read_documents(spark, str(tmp_path / "out"), "newline", "skip").collect()) == ["[]", '{"a": 1}']


def test_lanes(spark):
    texts = ['{"k":1,"v":"x"}', '{"k":1,"k":2}', '{"k":"1"}', '{"k":1} x', '{"k":18446744073709551615}', "{'k':1}", None, '{"v":"\\ud800"}', '{"k":null}']
    docs = spark.createDataFrame(list(enumerate(texts)), "id int, json string")
    want = {"k": ("int64", "/k"), "v": ("string", "/v")}
    rows = lambda lane: [tuple(r) for r in docs.select("id", fields("json", want, lane).alias("f")).select("id", "f.k", "f.v").orderBy("id").collect()]
    assert rows("auto") == rows("strict") == [(0, 1, "x"), (1, 1, None), (2, None, None), (3, None, None), (4, None, None), (5, None, None), (6, None, None), (7, None, None), (8, None, None)]
    plan = docs.select(native_fields("json", "k bigint, v string")["k"].alias("k"))._jdf.queryExecution().optimizedPlan().toString()
    assert "StructField(k" in plan and "StructField(v" not in plan
    with pytest.raises(ValueError):
        fields("json", want, "fast")


def test_selector(spark):
    s = KeySelector("a", "b")
    assert len(s) == 2 and s.key_at(1) == "b" and s.match_raw("b") == 1 and s.match_raw("c") is None and "2 keys" in s.describe()
    for bad in ((), ("a", "a"), ("",), ("x" * 64,), ('"',)):
        with pytest.raises(ValueError):
            KeySelector(*bad)
    row = spark.createDataFrame([('{"b":1,"x":0,"b":2}',)], "j string").select(s.raws("j").alias("g")).first().g
    assert row.matched == 1 and row.value == {"b": "1"} and row.error is None


def test_api(spark):
    doc = '{"a":{"b":[1,2.5,"7",null]},"big":18446744073709551616,"u":18446744073709551615,"e":"\\u00e9"}'
    df = spark.createDataFrame([(doc,), ("[1",), (None,)], "j string")
    one = lambda c: [r[0] for r in df.select(c.alias("x")).collect()]
    pair = lambda c: [None if r is None else (r.value, r.error) for r in one(c)]
    assert pair(api.json_get("j", "int64", pointer="/a/b/0", big=True)) == [(1, None), (None, "TAPE_ERROR"), (None, None)]
    assert pair(api.json_get("j", "uint64", path="$.u", big=True))[0][0] == 18446744073709551615
    assert pair(api.json_get("j", "bigint", pointer="/big"))[0] == ("18446744073709551616", None)
    assert pair(api.json_get("j", "int64", pointer="/a"))[0] == (None, "BIGINT_ERROR")
    assert pair(api.json_raw("j", path="$.a.b", big=True))[0] == ('[1,2.5,"7",null]', None)
    assert pair(api.json_type("j", "/a/b/3", big=True))[0] == ("null", None) and pair(api.json_is("j", "object", "/a"))[0] == (True, None)
    row = one(api.json_number("j", "/u"))[0]
    assert (row.kind, int(row.u64), row.i64, row.error) == ("uint64", 18446744073709551615, None, None) and one(api.json_number("j", "/big"))[0].error == "BIGINT_ERROR"
    assert one(api.json_error_at("j", big=True))[1].code == "TAPE_ERROR" and one(api.json_error("j", big=True)) == [None, "TAPE_ERROR", None]
    assert one(api.json_type_coarse("j")) == ["object", "array", None] and one(api.json_strip(F.lit(' { "a b" : 1 } '))) == ['{"a b":1}'] * 3 and one(api.json_strip(F.lit('"x'))) == [None] * 3
    assert pair(api.json_wobbly(F.lit("\\ud800")))[0][0] == b"\xed\xa0\x80" and one(api.json_quote(F.lit('a"b')))[0] == '"a\\"b"'
    assert one(api.stage1_error("j")) == [None, "INCOMPLETE_ARRAY_OR_OBJECT", None] and pair(api.has_trailing(F.lit("1 2")))[0] == (True, None)
    assert one(api.strip_bom(F.lit("\ufeffx")))[0] == "x" and pair(api.json_at(F.lit("[1,[2]]"), 1))[0] == ("[2]", None)
    assert pair(api.json_msgpack(F.lit("[]")))[0][0] == b"\x90" and pair(api.json_prettify(F.lit("[1]")))[0][0] == "[\n    1\n]"
    assert df.select(api.literal('{"a":[1,2],"b":"x"}').alias("l")).first().l.a == [1, 2]
    for bad in ("1", '[1,"x"]'):
        with pytest.raises(ValueError):
            api.schema_of_literal(bad)
    with pytest.raises(JsonError):
        api.literal("{")
    with pytest.raises(ValueError):
        api.json_get("j", "int64")
    with pytest.raises(ValueError):
        api.json_error("j", deep=True)


def test_binding(spark):
    binding.register("celsius", "double", lambda tree, i: (tree.nodes[i].value - 32) / 1.8)
    schema = T.StructType(
        [
            T.StructField("id", T.IntegerType(), False), T.StructField("color", T.StringType(), True, {"json_enum": ["red", "blue"]}), T.StructField("t", T.DoubleType(), True, {"json_decoder": "celsius"}),
            T.StructField("m", T.MapType(T.StringType(), T.LongType(), False), True), T.StructField("l", T.ArrayType(T.StringType()), True),
        ]
    )
    texts = ['{"id":1,"color":"red","t":212,"m":{"a":1,"a":2},"l":["x",null],"more":0}', '{"color":"red"}', '{"id":1,"color":"green"}', '{"id":3000000000}', "[]", '{"id":1,"id":2}', None]
    got = [r.g for r in spark.createDataFrame([(t,) for t in texts], "j string").select(binding.decode("j", schema).alias("g")).collect()]
    assert got[0].error is None and got[0].value.t == 100.0 and got[0].value.m == {"a": 1} and got[0].value.l == ["x", None]
    assert [g.error for g in got[1:]] == ["NO_SUCH_FIELD", "INCORRECT_TYPE", "NUMBER_OUT_OF_RANGE", "INCORRECT_TYPE", None, None] and got[5].value.id == 1
    df = spark.createDataFrame([('{"a":null,"b":2}',)], "j string")
    f = binding.from_("j")
    row = df.select(f.optional("int64", "/a").alias("a"), f.optional("int64", "/c").alias("c"), f.get("int64", "/b").alias("b"), f.number("/b").alias("n"), binding.from_(F.lit("[1,2]")).array("bigint").alias("l")).first()
    assert (row.a.value, row.a.error, row.c.error, row.b.value, row.n.kind, row.l.value) == (None, None, None, 2, "int64", [1, 2])


def test_check_pointer():
    schema = T.StructType().add("a", T.ArrayType(T.StructType().add("b", "long")))
    check_pointer("/a/0/b", schema)
    for bad in ("/x", "/a/0/c", "/a/0/b/c"):
        with pytest.raises(ValueError):
            check_pointer(bad, schema)
    with pytest.raises(JsonError):
        check_pointer("/a/x", schema)


def test_nodes(spark):
    docs = spark.createDataFrame([(1, '{"a":[1,{"b":"x"}],"A":2.5}'), (2, "[1"), (3, None), (4, "18446744073709551615")], "doc_id long, json string")
    t = N.nodes(docs).cache()
    assert t.count() == 8 and t.where("error is not null").first().error == "TAPE_ERROR"
    assert [r.raw for r in N.select_key(t, "a", case_insensitive=True).collect()] == ['[1,{"b":"x"}]']
    assert N.subtrees(t, N.select_key(t, "a")).count() == 4 and N.children(t, t.where("doc_id = 1 and node_id = 0")).count() == 2
    row = N.statistics(t).where("doc_id = 1").first()
    assert (row.integer_count, row.float_count, row.string_count, row.key_count, row.maximum_depth, row.byte_count) == (1, 1, 4, 3, 3, 27)
    assert int(t.where("doc_id = 4").first().u) == 18446744073709551615


def test_plans(spark):
    """Filters and columns reach the scan, and native queries stay out of Python."""
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    text = plan(Q.queries()["props_sum_by_type"](spark, SF))
    assert "ReadSchema: struct<event_type:string,props:string>" in text and "Python" not in text and "Arrow" not in text
    text = plan(Q.queries()["extract_subset"](spark, SF))
    assert "s_name" not in text and "s_acctbal" not in text


def test_json_size_agrees(spark):
    docs = spark.createDataFrame([(json.dumps(x),) for x in ([], [1, 2], {}, {"a": 1, "b": [1]}, 5)], "j string")
    got = docs.select(api.json_size("j").alias("s"), api.json_size_native("j").alias("n")).collect()
    assert [r.s.value for r in got] == [0, 2, 0, 2, None] and [r.n for r in got] == [0, 2, 0, 2, None]


def test_plain_values_equal_the_reader(spark):
    """What the C decoder's value gives is what the strict reader gives, or nothing."""
    import random

    from tessera.functions import values
    from tessera.functions.api import _Plain
    from tessera.functions.errors import JsonError
    from tessera.functions.paths import at_pointer
    from tessera.functions.tree import parse

    draw = random.Random(3)
    atoms = ["1", "-0", "0", "1.5", "1e3", "true", "null", '"x"', '"\\u00e9"', '"\\ud83d\\ude00"', "12345678901234567890", "[]", "{}", "[0,[1,2]]", '{"a":1}', '{"a":1,"a":2}', "nul", '"a\tb"', " 7 ", "01"]
    met = 0
    for _ in range(20_000):
        text = "{" + ",".join(f'"{draw.choice("abc")}":{draw.choice(atoms)}' for _ in range(draw.randint(0, 3))) + "}"
        if draw.random() < 0.1:
            text = text[: draw.randint(0, len(text))]
        pointer, kind = draw.choice(["/a", "/b", "/a/0", "/a/1/0", "/c/a", "/a/01", "/", "/a/-"]), draw.choice(["int64", "double", "string", "bool", "uint64"])
        got = _Plain.get(text, kind, _Plain.keys(pointer, "dom", ()))
        if got is None:
            continue
        try:
            tree = parse(text)
            want = values.GETTERS[kind](tree, at_pointer(tree, pointer))
        except JsonError as e:
            want = e.code
        assert (type(got), got) == (type(want), want), (text, pointer, kind)
        met += 1
    assert met > 100


def test_one_reading(spark):
    """Several fields are one Python evaluation, and the node table of a subtree query is made once."""
    from tessera import workloads as W

    sf = "/root/testdata/sf0.001"
    of = lambda df: df._jdf.queryExecution().executedPlan().toString()
    assert of(W.customer_fields(spark, sf)).count("ArrowEvalPython") == 1
    assert of(W.conversation_streams(spark, sf)).count("ArrowEvalPython") == 1
    assert "MapInArrow" not in of(W.nodes_subtree(spark, sf))


def test_known_documents_stay_native(spark):
    """With a flag, known documents are read natively and the strict lane gets null for them; results agree."""
    from pyspark.sql import functions as F

    from tessera.plans.selector import fields

    rows = [(1, '{"a":1,"b":"x"}', True), (2, '{"a":2,"a":3,"b":"y"}', False), (3, '{"a":', False), (4, '{"b":"z"}', None), (5, None, None)]
    docs = spark.createDataFrame(rows, "id int, json string, known boolean")
    wanted = {"a": ("int64", "/a"), "b": ("string", "/b")}
    got = docs.select("id", fields("json", wanted, plain=F.col("known")).alias("f"), fields("json", wanted, "strict").alias("s")).collect()
    assert all(r.f == r.s for r in got) and got[0].f.a == 1 and got[1].f.a == 2 and got[3].f.b == "z"


def test_legacy_pointers(spark):
    """The older form of pointers goes without the first slash."""
    from tessera.functions import api

    docs = spark.createDataFrame([('{"a":{"b":[1,2]}}',)], "json string")
    got = docs.select(api.json_get("json", "int64", pointer="a/b/1", dialect="legacy").alias("v"), api.json_get("json", "int64", pointer="/a/b/0", dialect="legacy").alias("w"), api.json_get("json", "int64", pointer="a/b/1").alias("x")).first()
    assert (got.v.value, got.w.value, got.x.error) == (2, 1, "INVALID_JSON_POINTER")
