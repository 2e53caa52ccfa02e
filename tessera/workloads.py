"""The analytic queries over JSON documents, as functions of tables.

Documents are made of the relational tables, so every result has plain SQL as its counterpart. Queries that read documents
which are known to be good stay in the native lane; others show the strict one.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .functions import api, binding, write
from .functions.paths import path_to_pointer
from .operators import nodes as N
from .plans.selector import KeySelector, extract, fields
from .shared import scratch
from .shipping import bound_batches, ship
from .sources import documents as D
from .sources.framing import split
from .streaming import documents as S


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(rows: DataFrame) -> DataFrame:
    """Rows over twice as many partitions as there are cores: narrow tables are small files, which one task would read and work off."""
    return rows.repartition(2 * rows.sparkSession.sparkContext.defaultParallelism)


def order_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """o_orderkey and one document an order, with its lines in order. One shuffle by order key, of plain rows: an order's lines are
    few and lie apart, so lists made before it would be sorted and written for nothing."""
    line = ("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_returnflag")
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", *line).repartition("l_orderkey").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct(*line))).alias("lines"))
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderpriority")
    joined = orders.join(lines, F.col("o_orderkey") == F.col("l_orderkey")).drop("l_orderkey")
    user = F.struct(F.col("o_custkey").alias("id"), F.concat(F.lit("customer "), F.col("o_custkey")).alias("name"))
    doc = F.struct("o_orderkey", user.alias("user"), "o_orderstatus", "o_totalprice", F.struct(F.col("o_orderpriority").alias("text")).alias("priority"), "lines")
    return joined.select("o_orderkey", F.to_json(doc).alias("json"))


# --- extraction ---------------------------------------------------------------------------------------------------------


def props_get_k(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", F.get_json_object("props", "$.k").cast("bigint").alias("k"))


def props_get_k_strict(spark, sf_dir):
    got = api.json_get("props", "int64", pointer="/k")
    return table(spark, sf_dir, "events").select("event_id", got["value"].alias("k"), got["error"].alias("error"))


def props_sum_by_type(spark, sf_dir):
    k = F.get_json_object("props", "$.k").cast("bigint")
    return table(spark, sf_dir, "events").groupBy("event_type").agg(F.sum(k).alias("sum_k"), F.count("*").alias("n"))


def props_type(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", api.json_type("props", "/k")["value"].alias("kind"))


def props_valid(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", api.json_valid("props").alias("valid"))


def order_pointer_first_line(spark, sf_dir):
    got = api.json_get("json", "int64", pointer="/lines/0/l_partkey")
    return order_documents(spark, sf_dir).select("o_orderkey", got["value"].alias("partkey"))


def order_path_native(spark, sf_dir):
    return order_documents(spark, sf_dir).select("o_orderkey", F.get_json_object("json", "$.user.id").cast("bigint").alias("custkey"), F.get_json_object("json", "$.lines[0].l_quantity").cast("double").alias("quantity"))


def order_wildcard_sum(spark, sf_dir):
    found = api.json_wildcard("json", "$.lines[*].l_quantity")["value"]
    total = F.aggregate(F.transform(found, lambda x: x.cast("double")), F.lit(0.0), lambda a, b: a + b)
    return order_documents(spark, sf_dir).select("o_orderkey", total.alias("quantity"), F.size(found).alias("n"))


def order_wildcard_each(spark, sf_dir):
    found = api.json_wildcard("json", "$.lines.*.l_partkey", dialect="ondemand")["value"]
    return order_documents(spark, sf_dir).select("o_orderkey", F.posexplode(found).alias("ord", "partkey")).select("o_orderkey", "ord", F.col("partkey").cast("bigint").alias("partkey"))


def order_pointers(spark, sf_dir):
    """Several pointers of one document, found and missing."""
    found = api.json_pointers("json", ["/o_orderkey", "/priority/text", "/lines/999", "/nothing"])
    rows = order_documents(spark, sf_dir).select("o_orderkey", F.explode(found).alias("f"))
    return rows.select("o_orderkey", F.col("f.pointer").alias("pointer"), F.col("f.value").alias("value"), F.col("f.error").alias("error"))


def accessor_depths(spark, sf_dir):
    docs = order_documents(spark, sf_dir)
    return docs.select("o_orderkey", F.get_json_object("json", "$.o_orderstatus").alias("one"), F.get_json_object("json", "$.priority.text").alias("two"), F.get_json_object("json", "$.lines[0].l_returnflag").alias("three"))


def accessor_checked(spark, sf_dir):
    """A pointer that is checked against a schema before the query runs."""
    schema = T.StructType().add("o_orderkey", "long").add("user", T.StructType().add("id", "long").add("name", "string"))
    return order_documents(spark, sf_dir).select("o_orderkey", extract("json", "/user/name", "string", schema)["value"].alias("name"))


def in_string_number(spark, sf_dir):
    docs = table(spark, sf_dir, "orders").select("o_orderkey", F.to_json(F.struct(F.col("o_totalprice").cast("string").alias("price"), F.col("o_custkey").cast("string").alias("key"))).alias("json"))
    return docs.select("o_orderkey", api.json_get_in_string("json", "double", pointer="/price")["value"].alias("price"), api.json_get_in_string("json", "int64", pointer="/key")["value"].alias("custkey"))


def text_round_trip(spark, sf_dir):
    """Texts through JSON and back: escapes and Unicode are lossless."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.to_json(F.struct("text")).alias("json"))
    return docs.select("doc_id", F.sha2(api.json_get("json", "string", pointer="/text")["value"], 256).alias("digest"))


def quote_text(spark, sf_dir):
    """Quoted texts, unquoted again by the raw reader."""
    docs = table(spark, sf_dir, "documents").select("doc_id", api.json_quote("text").alias("q"))
    raw = F.substring("q", F.lit(2), F.length("q") - 2)
    return docs.select("doc_id", F.sha2(api.json_unescape(raw)["value"], 256).alias("digest"))


# --- workloads ----------------------------------------------------------------------------------------------------------


def orders_doc_explode(spark, sf_dir):
    schema = "lines array<struct<l_linenumber:int,l_partkey:bigint,l_quantity:double>>"
    rows = order_documents(spark, sf_dir).select("o_orderkey", F.explode(F.from_json("json", schema)["lines"]).alias("l"))
    return rows.select("o_orderkey", F.col("l.l_linenumber").alias("linenumber"), F.col("l.l_partkey").alias("partkey"), F.col("l.l_quantity").alias("quantity"))


def customer_documents(spark, sf_dir):
    c = spread(table(spark, sf_dir, "customer"))
    user = F.struct(F.col("c_custkey").alias("id"), F.col("c_name").alias("screen_name"))
    reply = F.when(F.col("c_custkey") % 3 == 0, F.col("c_nationkey"))
    return c.select("c_custkey", F.to_json(F.struct(user.alias("user"), F.col("c_mktsegment").alias("text"), reply.alias("in_reply_to"), F.col("c_acctbal").alias("retweets")), {"ignoreNullFields": "false"}).alias("json"))


def customer_partial(spark, sf_dir):
    """Nested and nullable fields, one pruned reading."""
    read = F.from_json("json", "user struct<id:bigint,screen_name:string>, text string, in_reply_to int, retweets double")
    return customer_documents(spark, sf_dir).select(F.lit(1).alias("one"), read.alias("r")).select(F.col("r.user.id").alias("id"), F.col("r.user.screen_name").alias("name"), F.col("r.text").alias("text"), F.col("r.in_reply_to").alias("reply"), F.col("r.retweets").alias("retweets"))


def customer_selector(spark, sf_dir):
    """The same fields by a key selector: one strict reading, counting what matched."""
    docs = customer_documents(spark, sf_dir)
    got = KeySelector("text", "in_reply_to", "retweets", "absent").raws("json")
    rows = docs.select("c_custkey", got.alias("g"))
    return rows.select("c_custkey", F.col("g.matched").alias("matched"), F.col("g.value")["text"].alias("text"), F.col("g.value")["in_reply_to"].alias("reply"))


def customer_fields(spark, sf_dir):
    """Several fields by one strict reading, which takes the C decoder for plain documents."""
    got = fields("json", {"text": ("string", "/text"), "retweets": ("double", "/retweets")})
    return customer_documents(spark, sf_dir).select("c_custkey", got.alias("f")).select("c_custkey", "f.text", "f.retweets")


def find_order(spark, sf_dir):
    docs = order_documents(spark, sf_dir)
    return docs.where(F.get_json_object("json", "$.o_orderkey").cast("bigint") == 33).select(F.get_json_object("json", "$.priority.text").alias("text"), F.get_json_object("json", "$.user.id").cast("bigint").alias("custkey")).limit(1)


def top_order_last_tie(spark, sf_dir):
    """The largest price up to a bound; of equals the last. An aggregate, so nothing is sorted."""
    docs = order_documents(spark, sf_dir)
    price, key = F.get_json_object("json", "$.o_totalprice").cast("double"), F.get_json_object("json", "$.o_orderkey").cast("bigint")
    rows = docs.select(price.alias("price"), key.alias("key"), F.get_json_object("json", "$.priority.text").alias("text")).where("price <= 200000")
    best = F.max_by(F.struct("key", "price", "text"), F.struct("price", "key"))
    return rows.agg(best.alias("b")).select(F.col("b.key").alias("orderkey"), F.col("b.price").alias("price"), F.col("b.text").alias("text"))


def distinct_keys_union(spark, sf_dir):
    docs = order_documents(spark, sf_dir)
    read = F.from_json("json", "user struct<id:bigint>, lines array<struct<l_suppkey:bigint>>")
    ids = docs.select(F.explode(F.concat(F.array(read["user"]["id"]), read["lines"]["l_suppkey"])).alias("id"))
    return ids.where("id is not null").distinct()


def distinct_keys_pointer(spark, sf_dir):
    docs = order_documents(spark, sf_dir)
    one = api.json_get_many("json", {"user": ("int64", "/user/id"), "first": ("int64", "/lines/0/l_suppkey"), "third": ("int64", "/lines/2/l_suppkey")})
    rows = docs.select(one.alias("o")).select(F.explode(F.array("o.user.value", "o.first.value", "o.third.value")).alias("id"))
    return rows.where("id is not null").distinct()


def part_rows(spark, sf_dir):
    """One array a line, with a header line first."""
    rows = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("n"), F.to_json(F.array(F.col("p_partkey").cast("string"), "p_brand", "p_type", F.col("p_size").cast("string"), F.col("p_retailprice").cast("string"))).alias("value"))
    return spark.createDataFrame([(-1, '["key","brand","type","size","price"]')], "n bigint, value string").unionByName(rows)


def brand_ratings(spark, sf_dir):
    """Grouped sums over lines of arrays: price weighted by size, and sizes."""
    cells = part_rows(spark, sf_dir).where("n >= 0").select(F.from_json("value", "array<string>").alias("c"))
    size, price = F.col("c")[3].cast("bigint"), F.col("c")[4].cast("double")
    return cells.groupBy(F.col("c")[1].alias("brand")).agg(F.round(F.sum(price * size), 2).alias("weighted"), F.sum(size).alias("sizes"))


def points(spark, sf_dir):
    """Coordinates of one large array a document, exploded to doubles."""
    e = table(spark, sf_dir, "embeddings")
    docs = e.groupBy((F.col("vec_id") % 16).alias("doc")).agg(F.to_json(F.struct(F.array_sort(F.collect_list(F.struct("vec_id", F.col("embedding")[0].alias("x"), F.col("embedding")[1].alias("y"), F.col("embedding")[2].alias("z")))).alias("coordinates"))).alias("json"))
    rows = docs.select(F.explode(F.from_json("json", "coordinates array<struct<vec_id:bigint,x:float,y:float,z:float>>")["coordinates"]).alias("c"))
    return rows.select(F.col("c.vec_id").alias("vec_id"), F.col("c.x").alias("x"), F.col("c.y").alias("y"), F.col("c.z").alias("z"))


def region_documents(spark, sf_dir):
    nations = table(spark, sf_dir, "nation").groupBy("n_regionkey").agg(F.array_sort(F.collect_list(F.struct(F.col("n_nationkey").alias("key"), F.col("n_name").alias("name")))).alias("nations"))
    regions = table(spark, sf_dir, "region").join(nations, F.col("r_regionkey") == F.col("n_regionkey"))
    return regions.select("r_regionkey", F.struct(F.col("r_name").alias("name"), "nations").alias("r"))


_REGION = T.StructType(
    [
        T.StructField("name", T.StringType(), False, {"json_name": "Region-Name"}),
        T.StructField("nations", T.ArrayType(T.StructType([T.StructField("key", T.IntegerType(), False), T.StructField("name", T.StringType(), True)]), False), False),
        T.StructField("secret", T.StringType(), True, {"json_skip": True}),
    ]
)


def region_nation_nested(spark, sf_dir):
    """Rows bound to JSON with a renamed and a skipped member, and back."""
    rows = region_documents(spark, sf_dir).select("r_regionkey", F.struct("r.name", "r.nations", F.lit("x").alias("secret")).alias("r"))
    docs = rows.select("r_regionkey", binding.encode("r", _REGION).alias("json"))
    back = docs.select("r_regionkey", F.col("json").contains("secret").alias("leak"), binding.decode("json", _REGION).alias("d"))
    flat = back.select("r_regionkey", "leak", F.col("d.value.name").alias("region"), F.explode("d.value.nations").alias("n"))
    return flat.select(F.col("r_regionkey").alias("regionkey"), "leak", "region", F.col("n.key").alias("nationkey"), F.col("n.name").alias("nation"))


def extract_subset(spark, sf_dir):
    """Some columns as JSON, the others unread."""
    return table(spark, sf_dir, "supplier").select("s_suppkey", binding.extract_from("s_suppkey", "s_nationkey").alias("json"))


def bound_rows(spark, sf_dir):
    """Binding to a struct where some documents lack a member that must be there."""
    schema = T.StructType([T.StructField("key", T.LongType(), False), T.StructField("size", T.IntegerType(), False), T.StructField("brand", T.StringType(), True)])
    size = F.when(F.col("p_partkey") % 5 != 0, F.col("p_size"))
    docs = spread(table(spark, sf_dir, "part")).select("p_partkey", F.to_json(F.struct(F.col("p_partkey").alias("key"), size.alias("size"), F.col("p_type").alias("more"))).alias("json"))
    got = binding.decode("json", schema)
    return docs.select("p_partkey", got.alias("g")).select("p_partkey", F.col("g.value.size").alias("size"), F.col("g.value.brand").alias("brand"), F.col("g.error").alias("error"))


# --- nodes and texts ----------------------------------------------------------------------------------------------------


def order_texts(spark, sf_dir):
    return order_documents(spark, sf_dir).withColumnRenamed("o_orderkey", "doc_id")


def nodes_count_by_kind(spark, sf_dir):
    return N.nodes(order_texts(spark, sf_dir), columns=("kind",)).groupBy("kind").agg(F.count("*").alias("n"))


def nodes_statistics(spark, sf_dir):
    stats = N.document_statistics(order_texts(spark, sf_dir))
    return stats.select("doc_id", "integer_count", "float_count", "object_count", "array_count", "maximum_depth", "maximum_array_size", "key_count", "repeated_key_count", "null_count")


def nodes_subtree(spark, sf_dir):
    """Everything below the key `lines`. A document's nodes are in one batch, so no table of all of them is written and joined with itself."""
    return N.below_key(order_texts(spark, sf_dir), "LINES", ("key", "i"), case_insensitive=True).groupBy("doc_id").agg(F.count("*").alias("n"), F.sum(F.when(F.col("key") == "l_partkey", F.col("i"))).alias("partkeys"))


def object_each(spark, sf_dir):
    """Keys in document order."""
    rows = customer_documents(spark, sf_dir).select("c_custkey", F.explode(api.json_each("json")["value"]).alias("f"))
    return rows.select("c_custkey", F.col("f.ord").alias("ord"), F.col("f.key").alias("key"), F.col("f.kind").alias("kind"))


def sizes(spark, sf_dir):
    docs = order_documents(spark, sf_dir)
    rows = docs.select("o_orderkey", api.json_sizes("json", {"lines": "/lines", "fields": ""}, {"slots": "/user"}).alias("g"))
    return rows.select("o_orderkey", *(F.col(f"g.{name}.value").alias(name) for name in ("lines", "fields", "slots")))


def key_lookups(spark, sf_dir):
    docs = customer_documents(spark, sf_dir)
    found = api.json_find_fields("json", ["text", "user", "retweets"])
    return docs.select("c_custkey", api.json_at_key("json", "TEXT", case_insensitive=True)["value"].alias("any_case"), api.json_at_key("json", "TEXT")["error"].alias("exact"), found[0]["value"].alias("in_order"), found[1]["error"].alias("behind"))


def minify_roundtrip(spark, sf_dir):
    docs = order_documents(spark, sf_dir)
    pretty = api.json_prettify("json")["value"]
    return docs.select("o_orderkey", "json", pretty.alias("p")).select("o_orderkey", (api.json_minify("p")["value"] == api.json_minify("json")["value"]).alias("strict"), (api.json_strip("p") == api.json_minify("json")["value"]).alias("native"), F.size(F.split("p", "\n")).alias("lines"))


def prettify_regions(spark, sf_dir):
    return region_documents(spark, sf_dir).select("r_regionkey", api.json_prettify(F.to_json("r"))["value"].alias("text"))


def fractured_regions(spark, sf_dir):
    return region_documents(spark, sf_dir).select("r_regionkey", api.json_fractured(F.to_json("r"))["value"].alias("text"))


def fractured_round_trip(spark, sf_dir):
    """Laid out for people without tables (which sort their columns), it is the same document."""
    docs = order_documents(spark, sf_dir)
    laid = api.json_fractured("json", write.Fractured(max_inline_length=60, max_items_per_line=3, enable_table_format=False))["value"]
    return docs.select("o_orderkey", "json", laid.alias("t")).select("o_orderkey", (api.json_minify("t")["value"] == api.json_minify("json")["value"]).alias("same"))


def msgpack_sizes(spark, sf_dir):
    """The size follows from the document's parts, which gives SQL something to count."""
    docs = table(spark, sf_dir, "region").select("r_regionkey", F.to_json(F.struct(F.col("r_regionkey").alias("key"), F.col("r_name").alias("name"))).alias("json"))
    return docs.select("r_regionkey", F.octet_length(api.json_msgpack("json")["value"]).alias("size"))


def tape_words(spark, sf_dir):
    docs = table(spark, sf_dir, "region").select("r_regionkey", F.to_json(F.struct(F.col("r_regionkey").alias("key"), F.col("r_name").alias("name"))).alias("json"))
    return docs.select("r_regionkey", F.array_join(api.json_tape("json")["value"], "|").alias("words"))


def utf8_check(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", api.utf8_valid(F.encode("text", "UTF-8")).alias("good"), api.utf8_valid(F.concat(F.encode("text", "UTF-8"), F.unhex(F.lit("C3")))).alias("cut"))


def html_round_trip(spark, sf_dir):
    """Markup with quotes, tags and accents as JSON strings."""
    bound_batches(spark)
    docs = spread(table(spark, sf_dir, "pages")).select("page_id", F.to_json(F.struct("url", "html")).alias("json"))
    got = api.json_get_many("json", {"url": ("string", "/url"), "html": ("string", "/html")})
    return docs.select("page_id", got.alias("g")).select("page_id", F.col("g.url.value").alias("url"), F.length("g.html.value").alias("n_html"))


def conversation_streams(spark, sf_dir):
    """The turns of a conversation as one framed text, cut again by the five framings: they all give the same turns."""
    turns = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", F.to_json(F.struct("turn", "role")).alias("j")))).alias("t"))
    texts = turns.select("conv_id", F.col("t.j").alias("j"))
    mark = {"whitespace": "", "newline": "\n", "comma": ","}
    framed = texts.select(
        "conv_id",
        *(F.array_join("j", m).alias(n) for n, m in mark.items()),
        F.array_join(F.transform("j", lambda x: F.concat(F.lit("\x1e"), x, F.lit("\n"))), "").alias("sequence"),
        F.concat(F.lit(" [ "), F.array_join("j", " , "), F.lit(" ] ")).alias("comma_array"),
    )

    framings = ("whitespace", "newline", "sequence", "comma", "comma_array")

    @F.pandas_udf(", ".join(f"{n} array<string>" for n in framings))
    def cut(texts: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({n: [[piece for _, piece, _ in split(t, n)] for t in texts[n]] for n in framings})

    out = framed.select("conv_id", cut(F.struct(*framings)).alias("cut")).select("conv_id", "cut.*")
    same = F.lit(True)
    for n in ("newline", "sequence", "comma", "comma_array"):
        same = same & (F.col(n) == F.col("whitespace"))
    return out.select("conv_id", F.size("whitespace").cast("bigint").alias("n"), same.alias("same"), F.from_json(F.element_at("whitespace", -1), "turn bigint")["turn"].alias("last"))


def _framed(spark, sf_dir, framing: str) -> DataFrame:
    """Documents written to files in one framing and read again from them."""
    docs = table(spark, sf_dir, "customer").select(F.to_json(F.struct("c_custkey", "c_name", "c_acctbal")).alias("json"))
    path = scratch(spark, framing)
    if framing == "newline":
        D.write_documents(docs, path)
        return D.read_documents(spark, path, framing, mode="skip")
    parts = docs.repartition(4).select(F.spark_partition_id().alias("part"), "json").groupBy("part").agg(F.collect_list("json").alias("j"))
    text = {"whitespace": F.array_join("j", "\n\n  "), "comma_array": F.concat(F.lit("["), F.array_join("j", ","), F.lit("]"))}[framing]
    parts.select(text.alias("value")).repartition(4, "value").write.option("lineSep", " ").text(path)
    return D.read_documents(spark, f"{path}/part-*", framing, mode="skip")


def _customers(docs: DataFrame) -> DataFrame:
    read = F.from_json("json", "c_custkey bigint, c_name string, c_acctbal double")
    return docs.select(read.alias("r"), "error").select("r.c_custkey", "r.c_name", "r.c_acctbal", "error")


def files_newline(spark, sf_dir):
    return _customers(_framed(spark, sf_dir, "newline"))


def files_whitespace(spark, sf_dir):
    return _customers(_framed(spark, sf_dir, "whitespace"))


def files_by_range(spark, sf_dir):
    """One large file by byte ranges, through the data source."""
    docs = table(spark, sf_dir, "customer").select(F.to_json(F.struct("c_custkey", "c_name", "c_acctbal")).alias("json"))
    path = scratch(spark, "ranges")
    D.write_documents(docs, path)
    D.register(spark)
    return _customers(spark.read.format("tessera_json").option("path", path.removeprefix("file://") if path.startswith("file:///") else path).option("framing", "newline").option("blockBytes", 4096).load())


def _streamed(spark, chunks: DataFrame) -> DataFrame:
    """Chunks arrive as files; the stream runs until it has seen them all."""
    into, out = scratch(spark, "chunks"), scratch(spark, "turns")
    chunks.repartition(4, "source").write.parquet(into)
    stream = spark.readStream.schema(chunks.schema).parquet(into)
    S.chunks(stream).writeStream.format("parquet").outputMode("append").option("checkpointLocation", scratch(spark, "state")).trigger(availableNow=True).start(out).awaitTermination()
    return spark.read.schema("source string, doc_id bigint, json string, error string").parquet(out)


def chunked_turns(spark, sf_dir):
    """Conversations as bytes cut anywhere, put together again by the stateful operator."""
    turns = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", F.to_json(F.struct("turn", "role", F.length("text").alias("n"))).alias("j")))).alias("t"))
    data = F.encode(F.concat(F.array_join("t.j", " "), F.lit(" ")), "UTF-8")
    cut = turns.select(F.col("conv_id").cast("string").alias("source"), data.alias("d")).select("source", "d", F.explode(F.sequence(F.lit(0), F.floor(F.octet_length("d") / 17).cast("int"))).alias("seq"))
    chunks = cut.select("source", F.col("seq").cast("bigint").alias("seq"), F.substring("d", F.col("seq") * 17 + 1, F.lit(17)).alias("data"))
    docs = _streamed(spark, chunks)
    read = F.from_json("json", "turn bigint, role string, n int")
    return docs.select(F.col("source").cast("bigint").alias("conv_id"), read.alias("r"), "error").select("conv_id", "r.turn", "r.role", "r.n", "error")


def number_struct(spark, sf_dir):
    """The dynamic number of a mixed member."""
    v = F.when(F.col("p_partkey") % 3 == 0, F.col("p_size").cast("string")).when(F.col("p_partkey") % 3 == 1, F.col("p_retailprice").cast("string")).otherwise("18446744073709551615")
    docs = spread(table(spark, sf_dir, "part")).select("p_partkey", F.concat(F.lit('{"v":'), v, F.lit("}")).alias("json"))
    n = api.json_number("json", "/v")
    return docs.select("p_partkey", n.alias("n")).select("p_partkey", "n.kind", "n.i64", F.col("n.u64").cast("string").alias("u64"), "n.f64")


def kind_tests(spark, sf_dir):
    """Type tests of each member of a document."""
    docs = customer_documents(spark, sf_dir)
    tests = {
        "object": ("object", "/user"), "scalar": ("scalar", "/user"), "string": ("string", "/text"), "nothing": ("null", "/in_reply_to"), "number": ("number", "/retweets"), "integer": ("integer", "/user/id"),
        "negative": ("negative", "/retweets"),
    }
    rows = docs.select("c_custkey", api.json_are("json", tests).alias("g"))
    return rows.select("c_custkey", *(F.col(f"g.{name}.value").alias(name) for name in tests))


def raw_texts(spark, sf_dir):
    """Members as they are written, by pointer and by path, in both dialects."""
    docs = customer_documents(spark, sf_dir)
    return docs.select("c_custkey", api.json_raw("json", pointer="/user")["value"].alias("object"), api.json_raw("json", path="$.text")["value"].alias("text"), api.json_raw("json", pointer="/in_reply_to", dialect="ondemand")["value"].alias("reply"), api.json_touch("json", "/user/id")["value"].alias("id"))


def typed_getters(spark, sf_dir):
    """Getters of the rarer kinds, of values that fit and of values that don't."""
    key = F.col("p_partkey")
    more = F.concat(F.lit('{"f":'), F.col("p_retailprice").cast("string"), F.lit(',"b":'), (F.col("p_size") > 25).cast("string"), F.lit(',"n":'), F.when(key % 4 == 0, -key).otherwise(key).cast("string"), F.lit(',"big":1234567890123456789012'), key.cast("string"), F.lit("}"))
    some = F.concat(F.lit("["), F.when(key % 2 == 0, "1").otherwise(""), F.lit("]"))
    rows = spread(table(spark, sf_dir, "part")).select("p_partkey", more.alias("json"), F.concat(F.lit("["), F.col("p_size").cast("string"), F.lit(","), key.cast("string"), F.lit("]")).alias("pair"), some.alias("some"))
    got = api.json_get_many("json", {"f": ("float", "/f"), "b": ("bool", "/b"), "n": ("uint32", "/n"), "u": ("uint64", "/n"), "big": ("bigint", "/big"), "wrong": ("bool", "/f")}, big=True)
    rows = rows.select("p_partkey", got.alias("g"), api.json_at("pair", 1)["value"].alias("second"), api.json_at("pair", 2)["error"].alias("third"), (api.json_size("some")["value"] == 0).alias("empty"))
    return rows.select(
        "p_partkey", F.col("g.f.value").cast("double").alias("float"), F.col("g.b.value").alias("bool"), F.col("g.n.value").alias("uint32"), F.col("g.n.error").alias("uint32_error"), F.col("g.u.error").alias("uint64_error"),
        F.col("g.big.value").alias("bigint"), F.col("g.wrong.error").alias("wrong"), "second", "third", "empty",
    )


def document_ends(spark, sf_dir):
    """Marks before a document, text behind it, documents that stop early, and where a document goes wrong."""
    key = F.col("n_nationkey")
    json = F.concat(F.lit('{"k":'), key.cast("string"), F.lit(',"n":"'), F.col("n_name"), F.lit('"}'))
    rows = table(spark, sf_dir, "nation").select("n_nationkey", json.alias("json"))
    tail = F.when(key % 2 == 1, " {}").otherwise("  ")
    bad = api.json_error_at(F.concat(F.lit("["), key.cast("string"), F.lit(",]")))
    return rows.select(
        "n_nationkey", (api.strip_bom(F.concat(F.lit("\ufeff"), F.col("json"))) == F.col("json")).alias("bare"), api.has_trailing(F.concat("json", tail))["value"].alias("trailing"),
        api.json_error(F.concat("json", tail)).alias("error"), bad["code"].alias("code"), bad["at"].alias("at"), api.json_error(F.substring("json", 1, 8)).alias("cut"),
        api.json_error(F.concat(F.lit("["), "json", F.lit("]")), max_depth=1).alias("depth"),
    )


def _nation_files(spark, sf_dir, joined) -> str:
    """One file a nation with its customers' documents, in the order of their keys."""
    doc = F.to_json(F.struct(F.col("c_custkey").alias("k"), F.col("c_name").alias("n")))
    rows = table(spark, sf_dir, "customer").groupBy(F.col("c_nationkey").alias("nation")).agg(F.transform(F.array_sort(F.collect_list(F.struct("c_custkey", doc.alias("j")))), lambda x: x["j"]).alias("j"))
    path = scratch(spark, "nations")
    rows.select("nation", joined(F.col("j"), F.col("nation")).alias("value")).repartition("nation").write.partitionBy("nation").option("lineSep", " ").text(path)
    return f"{path}/nation=*/part-*"


def stream_errors(spark, sf_dir):
    """A stream ends with the first bad document: how many came, where it stood, and its code; the other mode goes on."""
    broken = lambda j, nation: F.array_join(F.transform(j, lambda x, i: F.when(i == nation, F.lit("[nul]")).otherwise(x)), " ")
    path = _nation_files(spark, sf_dir, broken)
    of = lambda mode: D.read_documents(spark, path, "whitespace", mode=mode).withColumn("nation", F.regexp_extract("source", "nation=([0-9]+)", 1).cast("bigint"))
    stop = of("stop").groupBy("nation").agg(F.count("*").alias("n"), F.max("byte_offset").alias("last"), F.max("error").alias("error"))
    return stop.join(of("skip").groupBy("nation").agg(F.count("*").alias("all"), F.count("error").alias("bad")), "nation")


def stream_truncated(spark, sf_dir):
    """Files that end inside a document: how many documents are whole, and how many bytes belong to none."""
    path = _nation_files(spark, sf_dir, lambda j, nation: F.expr("left(array_join(j, ' '), length(array_join(j, ' ')) - 5)"))
    return D.slices(spark, path).select(F.regexp_extract("source", "nation=([0-9]+)", 1).cast("bigint").alias("nation"), "documents", F.col("truncated_bytes").alias("truncated"))


# --- tables of cases ----------------------------------------------------------------------------------------------------

#: Documents and the code of what is wrong with them.
BAD = (
    ("", "EMPTY"), (" \t\n", "EMPTY"), ("{", "TAPE_ERROR"), ("[1 2]", "TAPE_ERROR"), ("[1,]", "TAPE_ERROR"), ('{"a":1,}', "TAPE_ERROR"), ('{"a" 1}', "TAPE_ERROR"), ("{1:2}", "TAPE_ERROR"),
    ("[tru]", "T_ATOM_ERROR"), ("[falsy]", "F_ATOM_ERROR"), ("nul", "N_ATOM_ERROR"), ("[1] x", "TAPE_ERROR"), ("01", "NUMBER_ERROR"), ("+1", "TAPE_ERROR"), (".5", "TAPE_ERROR"), ("1.", "NUMBER_ERROR"),
    ("1e", "NUMBER_ERROR"), ("12a", "NUMBER_ERROR"), ("-", "NUMBER_ERROR"), ("1e400", "NUMBER_ERROR"), ("NaN", "TAPE_ERROR"), ("18446744073709551616", "BIGINT_ERROR"), ('"abc', "UNCLOSED_STRING"),
    ('"\\x"', "STRING_ERROR"), ('"\\ud800"', "STRING_ERROR"), ('"a\tb"', "UNESCAPED_CHARS"), ("'a'", "TAPE_ERROR"), ("[" * 1024 + "1" + "]" * 1024, "DEPTH_ERROR"),
)
GOOD = ("1", "-0", '"x"', "[]", "{}", " [1, 2.5e3, null, true] ", '{"a":1,"a":2}', "[" * 1023 + "1" + "]" * 1023, '"\\ud83d\\ude00"', "18446744073709551615", "-9223372036854775808")


def bad_documents(spark, sf_dir):
    ship(spark)
    rows = [*BAD, *((t, None) for t in GOOD)]
    cases = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(rows)], "case_id int, json string")
    return cases.select("case_id", api.json_error("json").alias("error"))


#: Pointers into a document, and the text or the code that they give.
POINTED = '{"foo":["bar","baz"],"":0,"a/b":1,"m~n":8," ":7,"k\\"l":6,"o":{"s":{"x":1.5}}}'
POINTERS = (
    ("/foo/0", '"bar"', None), ("/foo", '["bar","baz"]', None), ("/", "0", None), ("/a~1b", "1", None), ("/m~0n", "8", None), ("/ ", "7", None), ('/k"l', "6", None), ("/o/s/x", "1.5", None),
    ("/o/s/y", None, "NO_SUCH_FIELD"), ("/o/s/x/z", None, "NO_SUCH_FIELD"), ("/foo/2", None, "INDEX_OUT_OF_BOUNDS"), ("/foo/-", None, "INDEX_OUT_OF_BOUNDS"), ("/foo/01", None, "INVALID_JSON_POINTER"),
    ("/foo/x", None, "INCORRECT_TYPE"), ("/foo/", None, "INVALID_JSON_POINTER"), ("foo", None, "INVALID_JSON_POINTER"), ("/o/~4", None, "INVALID_JSON_POINTER"),
)


def pointer_cases(spark, sf_dir):
    ship(spark)
    docs = spark.createDataFrame([(POINTED,)], "json string")
    rows = docs.select(F.posexplode(api.json_pointers("json", [p for p, _, _ in POINTERS])).alias("case_id", "f"))
    return rows.select("case_id", F.col("f.value").alias("value"), F.col("f.error").alias("error"))


#: Paths and the pointers that they stand for.
PATHS = (("$.a.b[0]", "/a/b/0"), (".a", "/a"), ("[1].x", "/1/x"), ("$['k']", "/'k'"), ("$.a~b", "/a~0b"), ("$[a/b]", "/a~1b"), ("$", None), ("1", None), ("$a", None), ("$.a[", None))


def path_cases(spark, sf_dir):
    rows = []
    for i, (path, _) in enumerate(PATHS):
        try:
            rows.append((i, path_to_pointer(path)))
        except ValueError:
            rows.append((i, None))
    return spark.createDataFrame(rows, "case_id int, pointer string")


#: Numbers, their kinds, and what the getters say: int64, uint64, int32, double.
NUMBERS = (
    ("0", "int64", "0", "0", "0"), ("-1", "int64", "-1", "NUMBER_OUT_OF_RANGE", "-1"), ("2147483648", "int64", "2147483648", "2147483648", "NUMBER_OUT_OF_RANGE"),
    ("9223372036854775807", "int64", "9223372036854775807", "9223372036854775807", "NUMBER_OUT_OF_RANGE"), ("9223372036854775808", "uint64", "NUMBER_OUT_OF_RANGE", "9223372036854775808", "NUMBER_OUT_OF_RANGE"),
    ("18446744073709551615", "uint64", "NUMBER_OUT_OF_RANGE", "18446744073709551615", "NUMBER_OUT_OF_RANGE"), ("18446744073709551616", "bigint", "INCORRECT_TYPE", "INCORRECT_TYPE", "INCORRECT_TYPE"),
    ("1.0", "double", "INCORRECT_TYPE", "INCORRECT_TYPE", "INCORRECT_TYPE"), ("1e1", "double", "INCORRECT_TYPE", "INCORRECT_TYPE", "INCORRECT_TYPE"), ("true", "bool", "INCORRECT_TYPE", "INCORRECT_TYPE", "INCORRECT_TYPE"),
)


def number_cases(spark, sf_dir):
    ship(spark)
    docs = spark.createDataFrame([(i, t) for i, (t, *_) in enumerate(NUMBERS)], "case_id int, json string")
    said = lambda kind: F.coalesce((g := api.json_get("json", kind, pointer="", big=True))["value"].cast("string"), g["error"])
    return docs.select("case_id", api.json_type("json", big=True)["value"].alias("kind"), said("int64").alias("i64"), said("uint64").alias("u64"), said("int32").alias("i32"))


#: Wildcard paths, how many values they have in the "dom" dialect, and the code of the "ondemand" one.
WILD = '{"a":[{"b":1},{"c":2},3],"d":{"e":{"b":4},"f":{"b":5}},"g":7}'
WILDCARDS = (("$.a[*].b", 1, "NO_SUCH_FIELD"), ("$.d.*.b", 2, None), ("$.*", 3, None), ("$.a[*]", 3, None), ("$.g.*", 0, "INCORRECT_TYPE"), ("$", None, "INVALID_JSON_POINTER"), ("$.zz[*]", 0, "NO_SUCH_FIELD"))


def wildcard_cases(spark, sf_dir):
    ship(spark)
    docs, out = spark.createDataFrame([(WILD,)], "json string"), None
    for i, (path, _, _) in enumerate(WILDCARDS):
        dom, lazy = api.json_wildcard("json", path), api.json_wildcard("json", path, dialect="ondemand")
        row = docs.select(F.lit(i).alias("case_id"), F.when(dom["value"].isNotNull(), F.size(dom["value"])).alias("n"), lazy["error"].alias("error"))
        out = row if out is None else out.unionByName(row)
    return out


#: Raw strings and their content, strictly and with half surrogates replaced.
ESCAPES = (("a\\u00e9b", "aéb", "aéb"), ("\\n\\t\\/", "\n\t/", "\n\t/"), ("\\ud83d\\ude00", "😀", "😀"), ("\\ud800x", None, "�x"), ("\\u0041\\\\", "A\\", "A\\"), ("\\q", None, None))


def unescape_cases(spark, sf_dir):
    ship(spark)
    docs = spark.createDataFrame([(i, t) for i, (t, _, _) in enumerate(ESCAPES)], "case_id int, raw string")
    return docs.select("case_id", api.json_unescape("raw")["value"].alias("strict"), api.json_unescape("raw", "replace")["value"].alias("replaced"))


#: Texts, their kind by the first character, whether the first pass or a pointer to "a" finds fault, and whether the whole does.
TOUCHED = (
    ('{"a":1,"b":01}', "object", "1", None, "NUMBER_ERROR"), ('{"a":[1,2],"b":[tru]}', "object", "[1,2]", None, "T_ATOM_ERROR"), ('{"b":2}', "object", None, "NO_SUCH_FIELD", None), ("[1]", "array", None, "INCORRECT_TYPE", None),
    ("12", "number", None, "NO_SUCH_FIELD", None), ('{"a":1', "object", None, "INCOMPLETE_ARRAY_OR_OBJECT", "TAPE_ERROR"), ('"x', "string", None, "UNCLOSED_STRING", "UNCLOSED_STRING"),
)


def touched_cases(spark, sf_dir):
    ship(spark)
    docs = spark.createDataFrame([(i, t) for i, (t, *_) in enumerate(TOUCHED)], "case_id int, json string")
    got = api.json_touch("json", "/a")
    return docs.select("case_id", api.json_type_coarse("json").alias("coarse"), got["value"].alias("value"), got["error"].alias("error"), api.json_error("json").alias("whole"))
