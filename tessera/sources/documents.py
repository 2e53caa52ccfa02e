"""Files of many documents as a table: source, doc_id, byte_offset, json, error.

Newline and sequence framings are read by Spark's own text reader, which splits large files. The others need the bytes in
order: `read_documents` takes each file whole (and many files in parallel), and `JsonDataSource` cuts one large file into
byte ranges whose edges move to the next line.

An error ends its stream: mode "stop" gives the documents before the first bad one and that one's code, as a reader that
gives up would; mode "skip" gives all, each with its own code.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..functions.errors import JsonError
from ..functions.tree import decode, error
from ..shipping import ship
from .framing import DEFAULT_BATCH, FORMATS, LEAST_BATCH, split

SCHEMA = "source string, doc_id bigint, byte_offset bigint, json string, error string"


def documents_of(data: bytes, framing: str, mode: str = "stop", max_doc_bytes: int | None = None, check: bool = True) -> tuple[list[tuple[int, str, str | None]], int]:
    """(byte offset, document, code) of each document of some bytes, and how many bytes at the end belong to none.

    A document that is cut off at the end is no error: its bytes are the truncated ones.
    """
    text, good = decode(data)
    shift = 3 if data[:3] == b"\xef\xbb\xbf" else 0
    out: list[tuple[int, str, str | None]] = []
    at_chars = at_bytes = 0
    try:
        for offset, piece, complete in split(text, framing):
            at_bytes += len(text[at_chars:offset].encode("utf-8", "surrogatepass"))
            at_chars = offset
            if not complete:
                return out, len(data) - at_bytes - shift
            code = None
            if max_doc_bytes is not None and len(piece.encode("utf-8", "surrogatepass")) > max_doc_bytes:
                code = "CAPACITY"
            elif not good and "\ufffd" in piece:
                code = "UTF8_ERROR"
            elif check:
                code = error(piece)[0]
            out.append((at_bytes + shift, piece, code))
            if code and mode == "stop":
                break
    except JsonError as e:
        out.append((0, text, e.code))
    return out, 0


def _limits(framing: str, mode: str, max_doc_bytes: int | None) -> int | None:
    if framing not in FORMATS:
        raise ValueError(f"framings are {FORMATS}")
    if mode not in ("stop", "skip"):
        raise ValueError("modes are stop and skip")
    return None if max_doc_bytes is None else max(LEAST_BATCH, max_doc_bytes)


def read_documents(spark: SparkSession, path: str, framing: str = "whitespace", mode: str = "stop", max_doc_bytes: int | None = None, check: bool = True) -> DataFrame:
    """All documents of some files. A path that isn't there is Spark's own error (IO_ERROR)."""
    limit = _limits(framing, mode, max_doc_bytes)
    ship(spark)
    if framing in ("newline", "sequence") and mode == "skip":
        return _lines(spark, path, framing, limit, check)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for source, content in zip(batch.column(0), batch.column(1), strict=True):
                found, _ = documents_of(content.as_py() or b"", framing, mode, limit, check)
                n = len(found)
                yield pa.record_batch(
                    [pa.array([source.as_py()] * n, pa.string()), pa.array(range(n), pa.int64()), pa.array([f[0] for f in found], pa.int64()), pa.array([f[1] for f in found], pa.string()), pa.array([f[2] for f in found], pa.string())],
                    ["source", "doc_id", "byte_offset", "json", "error"],
                )

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(run, SCHEMA)


def _lines(spark: SparkSession, path: str, framing: str, limit: int | None, check: bool) -> DataFrame:
    """One record a document: Spark splits the files. doc_id is a rising number, not a dense one; offsets aren't known."""
    from ..functions.api import json_error

    rows = spark.read.option("lineSep", "\n" if framing == "newline" else "\x1e").text(path).select(F.input_file_name().alias("source"), F.trim(F.regexp_replace("value", "^\\uFEFF", ""), F.lit(" \t\n\r")).alias("json"))
    rows = rows.where("json <> ''").withColumn("doc_id", F.monotonically_increasing_id())
    code = json_error(F.col("json")) if check else F.lit(None).cast("string")
    if limit is not None:
        code = F.when(F.octet_length("json") > limit, "CAPACITY").otherwise(code)
    return rows.select("source", "doc_id", F.lit(None).cast("bigint").alias("byte_offset"), "json", code.alias("error"))


def stop_at_error(docs: DataFrame, source: str = "source", order: str = "doc_id") -> DataFrame:
    """Of each source, the documents up to and with the first bad one. The first bad one is found by a sum that combines early."""
    first = docs.where("error is not null").groupBy(F.col(source).alias("_source")).agg(F.min(order).alias("_first"))
    kept = docs.join(first, F.col(source).eqNullSafe(F.col("_source")), "left")
    return kept.where(F.col("_first").isNull() | (F.col(order) <= F.col("_first"))).drop("_source", "_first")


def slices(spark: SparkSession, path: str, framing: str = "whitespace") -> DataFrame:
    """source, size_in_bytes, documents and truncated_bytes of each file."""
    _limits(framing, "skip", None)
    ship(spark)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(s.as_py(), len(c.as_py()), *documents_of(c.as_py(), framing, "skip", check=False)) for s, c in zip(batch.column(0), batch.column(1), strict=True)]
            yield pa.record_batch(
                [pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.int64()), pa.array([len(r[2]) for r in rows], pa.int64()), pa.array([r[3] for r in rows], pa.int64())],
                ["source", "size_in_bytes", "documents", "truncated_bytes"],
            )

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(run, "source string, size_in_bytes bigint, documents bigint, truncated_bytes bigint")


def write_documents(docs: DataFrame, path: str, text: str = "json") -> None:
    """One line a document. Line ends inside a document can only be white space, and go."""
    docs.select(F.regexp_replace(text, r"[\r\n]+", " ").alias("value")).write.text(path)


class _Range(InputPartition):
    def __init__(self, path: str, begin: int, end: int):
        self.path, self.begin, self.end = path, begin, end


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.framing, self.mode = options["path"], options.get("framing", "newline"), options.get("mode", "skip")
        self.block = int(options.get("blockBytes", 64 << 20))
        self.limit = _limits(self.framing, self.mode, int(options["maxDocBytes"]) if "maxDocBytes" in options else None)

    def _open(self, path: str):
        from pyarrow import fs

        where, inner = fs.FileSystem.from_uri(path if re.match(r"\w+://", path) else f"file://{path}")
        return where, inner

    def partitions(self):
        from pyarrow import fs

        where, inner = self._open(self.path)
        info = where.get_file_info(inner)
        files = [info] if info.type == fs.FileType.File else [f for f in where.get_file_info(fs.FileSelector(inner, recursive=True)) if f.type == fs.FileType.File and not f.base_name.startswith(("_", "."))]
        # Only where a document is a line, or ends at one, can a file be cut.
        block = self.block if self.framing in ("newline", "sequence") else 1 << 62
        return [_Range(f.path, b, min(f.size, b + block)) for f in files for b in range(0, max(1, f.size), block)]

    def read(self, partition):
        where, _ = self._open(self.path)
        mark = b"\x1e" if self.framing == "sequence" else b"\n"
        with where.open_input_file(partition.path) as f:
            size = f.size()
            begin, end = _snap(f, partition.begin, size, mark), _snap(f, partition.end, size, mark)
            data = f.read_at(end - begin, begin) if end > begin else b""
        for n, (offset, text, code) in enumerate(documents_of(bytes(data), self.framing, self.mode, self.limit)[0]):
            yield partition.path, begin + n, begin + offset, text, code


def _snap(f, at: int, size: int, mark: bytes, step: int = 1 << 16) -> int:
    """The place behind the next mark, for an edge inside a file."""
    if at <= 0 or at >= size:
        return max(0, min(at, size))
    at -= 1
    while at < size:
        data = bytes(f.read_at(min(step, size - at), at))
        if (found := data.find(mark)) >= 0:
            return at + found + 1
        at += len(data)
    return size


class JsonDataSource(DataSource):
    """spark.read.format("tessera_json").option("path", ...).option("framing", ...): large files by byte ranges."""

    @classmethod
    def name(cls) -> str:
        return "tessera_json"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _Reader(dict(self.options))


def register(spark: SparkSession) -> None:
    ship(spark)
    spark.dataSource.register(JsonDataSource)


def first_of_each(docs: DataFrame) -> DataFrame:
    """Each source's first document, by an aggregate that combines before it is shuffled."""
    return docs.groupBy(F.col("source").alias("_of")).agg(F.min_by(F.struct("*"), "doc_id").alias("_first")).select("_first.*")


__all__ = ["DEFAULT_BATCH", "JsonDataSource", "documents_of", "first_of_each", "read_documents", "register", "slices", "stop_at_error", "write_documents"]
