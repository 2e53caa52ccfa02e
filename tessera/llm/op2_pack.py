"""Token ids in a fixed-width bit-packed format.

Every text is encoded, an end id follows, and ids are stored in the fewest bits that the vocabulary needs. The written
table has one row a block: a run of whole documents in ascending doc_id order with its place in the stream, the width,
the documents' ids and offsets, and the packed ids. A block is unpacked by numpy at once, and a document is found by the
blocks' doc_id ranges, which the file's statistics hold, without reading others. Spark's own writer commits the blocks,
so a lost executor or a repeated task leaves neither gaps nor doubles. Places in the stream count from the start of a
block's part; `starts` has what all parts before hold, one row a part.

A doc_id, or none, that a large part of all rows has is dealt to as many parts as it fills, which follow each other.

Defined results. Null and empty texts give the end id alone; very long texts are encoded whole, and a block holds whole documents.
Rows with the same doc_id stand next to each other, in no promised order; so do rows without one, which come first (a block
says how many of its documents have none, and they are read back as null). An empty table gives no blocks. Other columns are ignored.
"""

from __future__ import annotations

import json
import os
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import bound_arrow, partitions

#: Ids that a block holds at least before it ends (one document's ids are never split).
BLOCK_IDS = 1 << 16
#: Words whose ids a worker remembers, and the longest such word.
CACHE_WORDS, CACHE_CHARS = 1_400_000, 48
#: Words that are encoded as one text, with blanks between them.
JOINED_WORDS = 200
#: Letters whose small letter is one character that no normal form changes, and marks that no cut divides.
LETTERS = "".join(c for c in map(chr, range(0x130)) if c.isalpha())
MARKS = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"
#: Fixed value: the pattern by which the tokenizer cuts whose pieces can be encoded one by one.
WORD_CUTS = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: Cuts between parts that are looked at in one step.
STRIDE = 64


def width(vocabulary: int) -> int:
    """Bits for ids from 0 to vocabulary - 1."""
    return max(1, int(vocabulary - 1).bit_length())


def pack(ids: np.ndarray, bits: int) -> bytes:
    """Ids of `bits` bits each, least significant bit first, to whole bytes."""
    if len(ids) and int(ids.max()) >> bits:
        raise ValueError(f"an id needs more than {bits} bits")
    if bits in (8, 16, 32):
        return ids.astype(f"<u{bits // 8}").tobytes()
    split = (ids.astype(np.uint32)[:, None] >> np.arange(bits, dtype=np.uint32)) & 1
    return np.packbits(split.astype(np.uint8).ravel(), bitorder="little").tobytes()


def unpack(data: bytes, n: int, bits: int, first: int = 0) -> np.ndarray:
    """n ids from the id numbered `first` on, as unsigned 32-bit integers."""
    if bits in (8, 16, 32):
        return np.frombuffer(data, f"<u{bits // 8}", n, first * bits // 8).astype(np.uint32)
    low = first * bits
    raw = np.frombuffer(data, np.uint8)[low // 8 : -(-(low + n * bits) // 8)]
    flat = np.unpackbits(raw, bitorder="little")[low % 8 : low % 8 + n * bits].reshape(n, bits)
    return (flat.astype(np.uint32) << np.arange(bits, dtype=np.uint32)).sum(1, dtype=np.uint32)


def _cuts_words(model: dict) -> bool:
    """Whether a tokenizer's file says that it joins white space, lower-cases and cuts by WORD_CUTS, and does nothing else before."""
    normal = [p["type"] for p in (model.get("normalizer") or {}).get("normalizers", [])]
    cuts = (model.get("pre_tokenizer") or {}).get("pretokenizers", [])
    return normal == ["NFC", "Replace", "Lowercase"] and [p["type"] for p in cuts] == ["Split", "ByteLevel"] and cuts[0]["pattern"] == {"Regex": WORD_CUTS} and cuts[0]["invert"]


class WordEncoder:
    """Ids of texts as little-endian unsigned integers of `unit` bytes.

    Where the tokenizer lower-cases and cuts at white space and between letters and marks, a text's ids are those of its pieces
    between blanks and line ends in a row, and a word's are those of its small letters, then of the marks behind. A batch's distinct
    pieces are taken apart at once; the ids of words, marks and other pieces are kept. Texts of any other tokenizer are encoded whole.
    """

    def __init__(self, model: str, unit: int = 4):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer, self.unit, self.code = Tokenizer.from_str(model), unit, {1: "B", 2: "H", 4: "I"}[unit]
        self.known: dict[str, bytes] = {"": b""}
        said = json.loads(model)
        self.by_words = _cuts_words(said)
        suffix, vocabulary = said["model"].get("end_of_word_suffix"), self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)  # ids that end a word, if the tokenizer marks them
        self.ends[[i for t, i in vocabulary.items() if suffix and t.endswith(suffix)]] = True

    def _bytes(self, ids: list[int]) -> bytes:
        return struct.pack(f"<{len(ids)}{self.code}", *ids)

    def _encode(self, pieces: list[str]) -> None:
        for piece, got in zip(pieces, self.tokenizer.encode_batch_fast(pieces, add_special_tokens=False), strict=True):
            self.known[piece] = self._bytes(got.ids)

    def _encode_words(self, words: list[str]) -> None:
        """Words of LETTERS: many make one text, whose ids are cut behind those that end a word. Where these aren't as many as the words, each is encoded alone."""
        for at in range(0, len(words), JOINED_WORDS):
            run = words[at : at + JOINED_WORDS]
            ids = self.tokenizer.encode_batch_fast([" ".join(run)], add_special_tokens=False)[0].ids
            ends = ((np.flatnonzero(self.ends[ids]) + 1) * self.unit).tolist()
            if len(ends) == len(run):
                data = self._bytes(ids)
                self.known.update(zip(run, [data[i:j] for i, j in zip([0, *ends], ends)], strict=True))
            else:
                self._encode(run)

    def _ids(self, pieces: pa.Array) -> pa.Array:
        """The ids of distinct pieces."""
        bare, tail, size = pc.utf8_rtrim(pieces, MARKS), pc.utf8_ltrim(pieces, LETTERS), pc.binary_length
        split = pc.equal(pc.add(size(bare), size(tail)), size(pieces))  # letters alone, then marks alone
        heads = pc.if_else(split, pc.utf8_lower(bare), pieces).dictionary_encode()
        tails = pc.if_else(split, tail, pa.scalar("", pieces.type)).dictionary_encode()
        names, marks, other = (x.to_numpy(zero_copy_only=False).tolist() for x in (heads.dictionary, tails.dictionary, pieces.filter(pc.invert(split))))
        if len(self.known) > CACHE_WORDS:
            self.known = {"": b""}
        known, whole = self.known, set(other)
        new = [n for n in names if n not in known]
        self._encode_words([n for n in new if n not in whole])
        self._encode([n for n in new if n in whole] + [m for m in marks if m not in known])
        first, last = (pa.array([known[x] for x in xs], pa.large_binary()) for xs in (names, marks))
        for x in (*new, *marks):
            if len(x) > CACHE_CHARS:
                known.pop(x, None)
        return pc.binary_join_element_wise(first.take(heads.indices), last.take(tails.indices), pa.scalar(b"", pa.large_binary()))

    def batch(self, texts: pa.Array) -> list[bytes]:
        """The ids of each text; null is empty."""
        texts = texts.fill_null("")
        if not self.by_words:
            return [self._bytes(got.ids) for got in (self.tokenizer.encode(t, add_special_tokens=False) for t in texts.to_pylist())]
        rows = pc.split_pattern(pc.replace_substring(texts, "\n", " "), " ")
        pieces = rows.flatten().dictionary_encode()
        _, ends, data = self._ids(pieces.dictionary).take(pieces.indices).buffers()
        at = np.frombuffer(ends, np.int64)[rows.offsets.to_numpy()].tolist()
        data = memoryview(data or b"")
        return [bytes(data[i:j]) for i, j in zip(at, at[1:])]

    def __call__(self, text: str) -> bytes:
        return self.batch(pa.array([text], pa.string()))[0]


_encoders: dict[tuple[int, int], WordEncoder] = {}


def encoder(model: str, unit: int) -> WordEncoder:
    """The worker process's one encoder of a model: what it has learned serves the next tasks too."""
    key = zlib.crc32(model.encode()), unit
    if key not in _encoders:
        _encoders.clear()
        _encoders[key] = WordEncoder(model, unit)
    return _encoders[key]


def _unit(bits: int) -> int:
    """Bytes of an id on its way to a block: its width, if that is whole bytes."""
    return bits // 8 if bits in (8, 16, 32) else 4


_TOKENS = "doc_id long, part int, n_tokens long, ids binary"
_BLOCKS = "part int, block int, first_id long, n_ids long, bits int, first_doc long, last_doc long, n_null long, doc_ids binary, doc_tokens binary, ids binary"


def tokenize(docs: DataFrame, model: str, end_id: int, bits: int) -> DataFrame:
    """doc_id, part, n_tokens and the ids of each row; the tokenizer's file, of fixed size, goes to each worker once."""
    bound_arrow(docs.sparkSession)
    sent, unit = docs.sparkSession.sparkContext.broadcast(model), _unit(bits)
    end = end_id.to_bytes(unit, "little")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(sent.value, unit)
        for batch in batches:
            ids = [data + end for data in encode.batch(batch.column("text"))]
            yield pa.record_batch([batch.column("doc_id"), batch.column("part"), pa.array([len(i) // unit for i in ids], pa.int64()), pa.array(ids, pa.binary())], ["doc_id", "part", "n_tokens", "ids"])

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "part", "text").mapInArrow(run, _TOKENS)


def _rank(cuts: list[int], test) -> Column:
    """How many of the sorted cuts pass a test that the first ones pass: by every STRIDE-th, then inside one stride."""
    if not cuts:
        return F.lit(0)
    every, coarse = F.lit(cuts), F.lit(cuts[STRIDE - 1 :: STRIDE] or [cuts[-1]])
    whole = F.size(F.filter(coarse, test)) if len(cuts) >= STRIDE else F.lit(0)
    return F.get(F.transform(F.array(whole * STRIDE), lambda at: at + F.size(F.filter(F.slice(every, at + 1, F.lit(STRIDE)), test))), F.lit(0))


def _blocks(bits: int, block_ids: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, number, part = 0, 0, 0
        docs: list[int] = []
        counts: list[int] = []
        ids: list[bytes] = []
        kind = f"<u{_unit(bits)}"

        def block() -> pa.RecordBatch:
            flat = np.frombuffer(b"".join(ids), kind)
            row = {
                "part": part, "block": number, "first_id": first, "n_ids": len(flat), "bits": bits, "first_doc": next((d for d in docs if d is not None), None), "last_doc": docs[-1],
                "n_null": docs.count(None), "doc_ids": pa.array(docs, pa.int64()).fill_null(0).to_numpy().astype("<i8").tobytes(), "doc_tokens": np.asarray(counts, "<i8").tobytes(), "ids": pack(flat, bits),
            }
            kinds = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary()]
            return pa.record_batch([pa.array([v], k) for v, k in zip(row.values(), kinds, strict=True)], list(row))

        held = 0
        for batch in batches:
            for doc, n, data, at in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "n_tokens", "ids", "part")), strict=True):
                part = at
                docs.append(doc)
                counts.append(n)
                ids.append(data)
                held += n
                if held >= block_ids:
                    yield block()
                    first, number, held, docs, counts, ids = first + held, number + 1, 0, [], [], []
        if docs:
            yield block()

    return run


def write(docs: DataFrame, path: str, model: str, vocabulary: int, end_id: int, parts: int | None = None, block_ids: int = BLOCK_IDS) -> None:
    """Write the texts' ids below `path`, in ascending doc_id order: part after part, block after block."""
    spark, bits = docs.sparkSession, width(vocabulary)
    parts = parts or partitions(spark)
    said = docs.agg(F.count("*").alias("n"), F.count("doc_id").alias("named"), F.percentile_approx("doc_id", [i / parts for i in range(1, parts)] or [0.5], max(10_000, 20 * parts)).alias("cuts")).first()
    cuts = sorted(said.cuts or [])[: parts - 1]
    bare = -(-(said.n - said.named) * parts // max(said.n, 1))  # parts for rows without a doc_id
    doc, salt = F.col("doc_id").cast("bigint"), F.monotonically_increasing_id()
    below = _rank(cuts, lambda c: c < doc)
    named = bare + below
    if len(set(cuts)) < len(cuts):  # a doc_id that several cuts fall on fills the parts between them; its rows are dealt to these
        upto = _rank(cuts, lambda c: c <= doc)
        named = named + F.when(upto - below > 1, F.pmod(F.xxhash64(salt), upto - below)).otherwise(0)
    part = F.when(doc.isNull(), F.pmod(F.xxhash64(salt), F.lit(max(bare, 1)))).otherwise(named)
    tokens = tokenize(docs.select("doc_id", "text", part.cast("int").alias("part")), model, end_id, bits)
    dealt = tokens.repartitionById(bare + len(cuts) + 1, F.col("part")).sortWithinPartitions("doc_id", "n_tokens", "ids")
    dealt.mapInArrow(_blocks(bits, block_ids), _BLOCKS).write.option("compression", "zstd").parquet(path)


def starts(spark: SparkSession, path: str) -> DataFrame:
    """part and before: the ids of all parts before. One row a part."""
    sums = spark.read.parquet(path).groupBy("part").agg(F.sum("n_ids").alias("n"))
    return sums.select("part", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in batch.to_pylist():
            docs, counts = np.frombuffer(row["doc_ids"], "<i8"), np.frombuffer(row["doc_tokens"], "<i8")
            data = memoryview(unpack(row["ids"], row["n_ids"], row["bits"]).astype("<u4", copy=False).tobytes())
            ends = np.cumsum(counts)
            crcs = [zlib.crc32(data[4 * (e - n) : 4 * e]) for e, n in zip(ends.tolist(), counts.tolist(), strict=True)]
            yield pa.record_batch(
                [pa.array(docs, mask=np.arange(len(docs)) < row["n_null"]), pa.array(np.full(len(docs), row["part"], np.int32)), pa.array(row["first_id"] + ends - counts), pa.array(counts), pa.array(crcs, pa.int64())],
                ["doc_id", "part", "first", "n_tokens", "ids_crc32"],
            )


def read_digest(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of each document, from the files."""
    bound_arrow(spark)
    rows = spark.read.parquet(path).select("part", "first_id", "n_ids", "bits", "n_null", "doc_ids", "doc_tokens", "ids")
    docs = rows.mapInArrow(_digest, "doc_id long, part int, first long, n_tokens long, ids_crc32 long")
    return docs.join(starts(spark, path), "part").select("doc_id", (F.col("first") + F.col("before")).alias("start"), "n_tokens", "ids_crc32")


def fetch(spark: SparkSession, path: str, doc_id: int) -> list[list[int]]:
    """Random access: the ids of the documents with this doc_id. Only blocks whose range has it are read."""
    rows = spark.read.parquet(path).where((F.col("first_doc") <= doc_id) & (F.col("last_doc") >= doc_id)).collect()
    out = []
    for row in rows:
        docs, counts = np.frombuffer(row.doc_ids, "<i8"), np.frombuffer(row.doc_tokens, "<i8")
        ends = np.cumsum(counts)
        out += [unpack(bytes(row.ids), int(counts[i]), row.bits, int(ends[i] - counts[i])).tolist() for i in np.flatnonzero(docs == doc_id) if i >= row.n_null]
    return out
