"""Streams of documents.

Line and record framings are Spark's text stream. Chunks of bytes whose edges fall anywhere are put together again by a
stateful operator: the state of a source is the text of the document that its last chunk left open.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions.api import json_error
from ..functions.tree import error
from ..shipping import ship
from ..sources.framing import split

_OUT = "source string, doc_id bigint, json string, error string"


def read_stream(spark: SparkSession, path: str, framing: str = "newline", check: bool = True) -> DataFrame:
    """source, json and error of each document of the files that arrive in a folder."""
    if framing not in ("newline", "sequence"):
        raise ValueError("files stream by newline or sequence; others go through chunks()")
    ship(spark)
    rows = spark.readStream.option("lineSep", "\n" if framing == "newline" else "\x1e").text(path)
    rows = rows.select(F.input_file_name().alias("source"), F.trim("value", F.lit(" \t\n\r")).alias("json")).where("json <> ''")
    return rows.withColumn("error", json_error("json") if check else F.lit(None).cast("string"))


def _cut(held: bytes, framing: str) -> tuple[list[str], bytes]:
    """Whole documents of some bytes, and the bytes that may belong to one that isn't whole yet."""
    edge = len(held)
    while edge and edge > len(held) - 4:  # a character that is cut off waits
        try:
            text = held[:edge].decode("utf-8")
            break
        except UnicodeDecodeError as e:
            if e.reason != "unexpected end of data":
                text = held[:edge].decode("utf-8", "replace")
                break
            edge = e.start
    else:
        text = held[:edge].decode("utf-8", "replace")
    rest = held[edge:]
    pieces = list(split(text, framing))
    if not pieces:
        return [], text.encode() + rest
    # A scalar, or a piece that no mark ends, could go on in the next chunk.
    offset, last, complete = pieces[-1]
    closed = complete and (last[-1] in "}]" if framing == "whitespace" else text[offset + len(last) :].lstrip(" \t\r")[:1] in ("\n", "\x1e", ","))
    if closed:
        return [p[1] for p in pieces], text[offset + len(last) + (framing != "whitespace") :].encode() + rest
    return [p[1] for p in pieces[:-1]], text[offset:].encode() + rest


def chunks(stream: DataFrame, framing: str = "whitespace", order: str = "seq") -> DataFrame:
    """Documents of a stream of source, `order` and data (bytes), whatever the chunks' edges.

    Chunks of a source must come in order over the batches; within a batch they are sorted.
    """
    ship(stream.sparkSession)

    def step(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        number, held = state.get if state.exists else (0, b"")
        got = pd.concat(list(parts)).sort_values(order)
        docs, held = _cut(bytes(held) + b"".join(bytes(d) for d in got["data"]), framing)
        state.update((number + len(docs), held))
        yield pd.DataFrame({"source": [key[0]] * len(docs), "doc_id": range(number, number + len(docs)), "json": docs, "error": [error(d)[0] for d in docs]})

    return stream.groupBy("source").applyInPandasWithState(step, _OUT, "number bigint, held binary", "append", GroupStateTimeout.NoTimeout)
