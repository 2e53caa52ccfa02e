"""Suffix-array dedup: byte runs that an earlier document has too, by a column-wise multi-string Burrows-Wheeler transform.

A byte goes if a string of `size` bytes that covers it also starts in a document with a smaller doc_id. The collection's
strings are not whole documents, whose rounds would be as many as the longest has bytes, but the neighbourhoods in which
such strings can lie. Every string of `size` bytes picks its anchor, the least hash among its grams of GRAM bytes, so equal
strings pick equal anchors at equal places. Anchors that only one document has can't be in a repeated string and end there.
Around each other anchor stands a context of less than twice `size` bytes that holds all strings that picked it. Contexts
are dealt to buckets by anchor, equal ones become one string with its least doc_id, and each bucket builds the transform
and the common prefixes of its strings column by column: a round inserts one symbol of every string at the place that the
last round's order gives (`ColumnBwt`). Strings stand with their anchors in one column, so equal ones begin in the same
column, and the positional form of the transform, which orders each column's suffixes among themselves, finds them all:
suffixes whose common prefix reaches `size` bytes form an interval, whose least doc_id decides each of its strings.

Between the steps the state lies in tables written in sequence to the shared folder: the texts by chunk, each chunk's
contexts, the replies. What returns to a chunk is bits and ranges. A chunk counts its places of an anchor before it tells them,
so an anchor is a few bytes a chunk to its bucket, whatever its places. One that more than MOST_OF_ANCHOR places share is
dealt by its strings rather than as a whole, so a passage that a third of all documents hold fills no task: the copies
become one string in the mapper, and different neighbourhoods of it go to different buckets.

Contexts are compared by 64-bit hashes and, inside a transform, by their bytes.

Defined results. Null and empty texts have no bytes and no spans. Texts shorter than `size` lose nothing. Rows that share a
doc_id take nothing from each other. Ties don't occur: a byte goes or stays by its document's id alone. A null doc_id counts as larger than all others. An empty table gives an empty result.
Other columns are ignored. Long texts are worked through in pieces; a chunk holds whole texts.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Written, bound_arrow, free, partitions, utf8
from .texthash import BYTE, mix, sliding_min, spans, windows

SIZE, GRAM = 50, 24
CHUNK_BYTES, PIECE = 2 << 20, 1 << 19
BUCKET_BYTES = 64 << 20
#: Places of one anchor beyond which it is dealt by string, and strings of one transform (whole anchors).
MOST_OF_ANCHOR, STRINGS = 50_000, 50_000
NO_ID = np.iinfo(np.int64).max
_HIGH, _LOW = np.uint64(0xFFFFFFFF00000000), np.uint64(0xFFFFFFFF)
HOT = 128


def _pack(x: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(x.tobytes())


def _open(data: bytes, kind: str) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(data), kind)


def _dealt(key: np.ndarray, buckets: int) -> np.ndarray:
    return (((key >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)).astype(np.int64)


class ColumnBwt:
    """The positional Burrows-Wheeler transform of aligned byte strings, built column by column from the right.

    A string's first byte stands in column `shift`. A round takes in one symbol of every string that has one in its column:
    the suffixes that begin there are those of the column before, in the order of the new symbols and, where these are equal,
    in their order so far, so one stable sort by symbol updates the order, and the symbols in that order are the column's
    part of the transform. `prefix[i]` is what suffixes i - 1 and i share: with equal symbols one more than the least
    between the two suffixes that they extend, else nothing. Strings that end in a column come first, as an end is smaller
    than any symbol. Equal strings of one column are neighbours; equal strings in different columns are not compared.
    """

    def __init__(self, data: np.ndarray, begin: np.ndarray, length: np.ndarray, shift: np.ndarray):
        self.data, self.at, self.shift, self.stop = data, begin - shift, shift, shift + length
        self.order, self.prefix = np.zeros(0, np.int64), np.zeros(0, np.uint8)
        self.column = int(self.stop.max(initial=0))
        by_stop = np.argsort(self.stop, kind="stable")
        cut = np.searchsorted(self.stop[by_stop], np.arange(self.column + 2))
        self.ending = [by_stop[cut[c] : cut[c + 1]] for c in range(self.column + 1)]

    def step(self) -> bool:
        """Take in the next column to the left; False if there is none."""
        if not self.column:
            return False
        ends = self.ending[self.column]
        self.column -= 1
        # Strings that end here come in front; those that began in the column before are done.
        every = np.concatenate([ends, self.order])
        shared = np.concatenate([np.zeros(len(ends), np.uint8), self.prefix])
        if len(self.prefix):
            shared[len(ends)] = 0
        live = np.flatnonzero(self.shift[every] <= self.column)
        symbol = self.data[self.at[every[live]] + self.column]
        by = np.argsort(symbol, kind="stable")
        place, symbol = live[by], symbol[by]
        grown = np.zeros(len(place), np.uint8)
        same = np.flatnonzero(symbol[1:] == symbol[:-1]) + 1
        grown[same] = np.minimum(_least(shared, place[same - 1] + 1, place[same]), 254) + 1
        self.order, self.prefix = every[place], grown
        return True

    def intervals(self, least: int) -> tuple[np.ndarray, np.ndarray]:
        """The strings whose suffix from this column on has `least` bytes or more, and where intervals that share so many begin."""
        long = np.flatnonzero(self.stop[self.order] - self.column >= least)
        if not len(long):
            return long, long
        number = np.cumsum(self.prefix < least)[long]
        return self.order[long], np.flatnonzero(np.concatenate([[True], number[1:] != number[:-1]]))


def _least(values: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """The least value in each range of places, ends included, by a table of ranges of powers of two."""
    out = np.zeros(len(first), np.uint8)
    level = np.frexp((last - first + 1).astype(float))[1] - 1
    table, size = values, 1
    for k in range(int(level.max(initial=-1)) + 1):
        if k:
            table = np.minimum(table[:-size], table[size:])
            size *= 2
        here = np.flatnonzero(level == k)
        out[here] = np.minimum(table[first[here]], table[last[here] - size + 1])
    return out


def _anchors(raw: np.ndarray, at: np.ndarray, size: int, contents: bool):
    """Of all strings' anchors: place, first and last string that picked it, the gram's hash, and the context's hash."""
    edge = np.zeros(len(raw) + 1, np.int8)
    long = np.flatnonzero(np.diff(at) >= size)
    edge[at[long]] += 1
    edge[at[long + 1] - size + 1] -= 1
    whole = np.cumsum(edge[:-1], dtype=np.int8).astype(bool)  # strings that begin here and stay in their document
    out: list[tuple[np.ndarray, ...]] = [(np.zeros(0, np.int64),) * 3 + (np.zeros(0, np.uint64),) * 2]
    for s in range(0, len(raw) - size + 1, PIECE):
        part = raw[s : s + PIECE + size - 1]
        gram = windows(part, GRAM)
        least = sliding_min((gram & _HIGH) | np.arange(len(gram), dtype=np.uint64), size - GRAM + 1)
        p = np.flatnonzero(whole[s : s + len(least)])
        if not len(p):
            continue
        picked = (least[p] & _LOW).astype(np.int64)
        turn = np.flatnonzero(np.concatenate([[True], (picked[1:] != picked[:-1]) | (p[1:] != p[:-1] + 1)]))
        a, first, last = picked[turn], p[turn], p[np.append(turn[1:] - 1, len(p) - 1)]
        held = spans(BYTE[part], first, last + size) if contents else gram[:0]
        out.append((a + s, first + s, last + s, gram[a], held))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True)) if contents else (*(np.concatenate(x) for x in list(zip(*out, strict=True))[:4]), None)


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    part, number = TaskContext.get().partitionId(), 0
    ids: list[np.ndarray] = []
    sizes: list[np.ndarray] = []
    data: list[np.ndarray] = []

    def chunk() -> pa.RecordBatch:
        row = [(part << 32) + number, np.concatenate(ids).tobytes(), np.concatenate(sizes).tobytes(), _pack(np.concatenate(data))]
        return pa.record_batch([pa.array([v], k) for v, k in zip(row, [pa.int64(), *[pa.binary()] * 3], strict=True)], ["chunk", "ids", "sizes", "data"])

    held = 0
    for batch in batches:
        raw, at = utf8(batch.column("text"))
        doc = batch.column("doc_id").fill_null(NO_ID).to_numpy().astype("<i8")
        i = 0
        while i < len(doc):
            j = max(i + 1, int(np.searchsorted(at, at[i] + CHUNK_BYTES - held, "right")) - 1)
            ids.append(doc[i:j])
            sizes.append(np.diff(at[i : j + 1]).astype("<i8"))
            data.append(raw[at[i] : at[j]].copy())
            held += int(at[j] - at[i])
            if held >= CHUNK_BYTES or j < len(doc) or sum(map(len, ids)) >= 60_000:
                yield chunk()
                number, held, ids, sizes, data = number + 1, 0, [], [], []
            i = j
    if ids:
        yield chunk()


def _text(row: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    ids, sizes = np.frombuffer(row["ids"], "<i8"), np.frombuffer(row["sizes"], "<i8")
    return _open(row["data"], np.uint8), np.concatenate([[0], np.cumsum(sizes)]), ids


def _batch(schema: list[tuple[str, pa.DataType]], *columns: list) -> pa.RecordBatch:
    return pa.record_batch([pa.array(c, k) for c, (_, k) in zip(columns, schema, strict=True)], [n for n, _ in schema])


_SEEN = [("bucket", pa.int32()), ("chunk", pa.int64()), ("hash", pa.binary()), ("held", pa.binary())]
#: The bit of `held` that says that several documents of the chunk have the anchor; the others count its places there.
SEVERAL = np.uint32(1 << 31)
_FLAGS = [("chunk", pa.int64()), ("bucket", pa.int32()), ("shared", pa.binary()), ("hot", pa.binary())]
_CONTEXT = [("kind", pa.int32()), ("bucket", pa.int32()), ("chunk", pa.int64()), ("a", pa.binary()), ("b", pa.binary()), ("c", pa.binary()), ("d", pa.binary())]
_REPLY = [("chunk", pa.int64()), ("bucket", pa.int32()), ("index", pa.binary()), ("first", pa.binary()), ("last", pa.binary()), ("least", pa.binary())]


def _by_bucket(key: np.ndarray, buckets: int):
    """Buckets that have something, and the places of each one's entries in their order."""
    bucket = _dealt(key, buckets)
    order = np.argsort(bucket, kind="stable")
    cut = np.searchsorted(bucket[order], np.arange(buckets + 1))
    return [(int(b), order[cut[b] : cut[b + 1]]) for b in np.flatnonzero(np.diff(cut))]


def _announce(size: int, buckets: int):
    """Each chunk tells the buckets its distinct anchors, with the number of places and whether several of its documents have them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                raw, at, _ = _text(row)
                _, first, _, gram, _ = _anchors(raw, at, size, False)
                key, index, number = np.unique(mix(gram), return_inverse=True, return_counts=True)
                doc = np.searchsorted(at, first, "right") - 1
                low, high = np.full(len(key), len(at)), np.full(len(key), -1)
                np.minimum.at(low, index, doc)
                np.maximum.at(high, index, doc)
                held = number.astype("<u4") | np.where(low < high, SEVERAL, np.uint32(0))
                cuts = _by_bucket(key, buckets)
                yield _batch(_SEEN, [b for b, _ in cuts], [row["chunk"]] * len(cuts), [key[p].astype("<u4").tobytes() for _, p in cuts], [_pack(held[p]) for _, p in cuts])

    return run


def _compare(most: int):
    """A bucket tells each chunk which of its anchors another document has too, and which very many places have.

    An anchor is one entry a chunk, however many places have it.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bucket, chunks, keys, counts = 0, [], [], []
        for batch in batches:
            for row in batch.to_pylist():
                bucket = row["bucket"]
                keys.append(np.frombuffer(row["hash"], "<u4"))
                counts.append(_open(row["held"], "<u4"))
                chunks.append(row["chunk"])
        if not chunks:
            return
        ends = np.cumsum([len(k) for k in keys])
        if ends[-1] >> 32:
            raise ValueError("a bucket has more than 2**32 anchors: BUCKET_BYTES is too large")
        entry = (np.concatenate(keys).astype(np.uint64) << np.uint64(32)) | np.arange(ends[-1], dtype=np.uint64)
        held = np.concatenate(counts)
        keys, counts = [], []
        entry.sort()
        place = (entry & _LOW).astype(np.int64)
        begin = np.flatnonzero(np.concatenate([[True], (entry[1:] >> np.uint64(32)) != (entry[:-1] >> np.uint64(32))]))
        number = np.diff(np.append(begin, len(entry)))
        shared = (number > 1) | (np.maximum.reduceat(held[place], begin) >= SEVERAL)
        places = np.add.reduceat((held[place] & ~SEVERAL).astype(np.int64), begin)
        flag, hot = np.zeros(len(entry), bool), np.zeros(len(entry), bool)
        flag[place] = np.repeat(shared, number)
        hot[place] = np.repeat(shared & (places > most), number)
        for chunk, end, begin_ in zip(chunks, ends, np.concatenate([[0], ends[:-1]]), strict=True):
            if flag[begin_:end].any():
                yield _batch(_FLAGS, [chunk], [bucket], [np.packbits(flag[begin_:end]).tobytes()], [np.packbits(hot[begin_:end]).tobytes() if hot[begin_:end].any() else b""])

    return run


def _gather(size: int, buckets: int):
    """Each chunk sends the contexts of its shared anchors to the buckets (kind 1), equal ones once, and keeps where they are (kind 0)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                raw, at, ids = _text(row)
                anchor, first, last, gram, held = _anchors(raw, at, size, True)
                distinct, index = np.unique(mix(gram), return_inverse=True)
                flag, hot = np.zeros(len(distinct), bool), np.zeros(len(distinct), bool)
                told = {f["bucket"]: f for f in row["flags"]}
                for b, p in _by_bucket(distinct, buckets):
                    if b in told:
                        flag[p] = np.unpackbits(np.frombuffer(told[b]["shared"], np.uint8), count=len(p)).astype(bool)
                        if told[b]["hot"]:
                            hot[p] = np.unpackbits(np.frombuffer(told[b]["hot"], np.uint8), count=len(p)).astype(bool)
                flag, hot = flag[index], hot[index]
                plain = np.flatnonzero(flag & ~hot)
                first_, last_, key = first[plain], last[plain], mix(gram[plain])
                offset, content = (anchor[plain] - first_).astype(np.uint8), held[plain]
                if hot.any():
                    # Each string of such an anchor stands alone, dealt by what it holds.
                    h = np.flatnonzero(hot)
                    n = last[h] - first[h] + 1
                    p = np.repeat(first[h] - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
                    own = np.concatenate([spans(BYTE[raw[q[0] : q[-1] + size]], q - q[0], q - q[0] + size) for q in np.array_split(p, max(1, len(p) // PIECE))])
                    first_, last_, key = np.concatenate([first_, p]), np.concatenate([last_, p]), np.concatenate([key, mix(own)])
                    offset, content = np.concatenate([offset, np.full(len(p), HOT, np.uint8)]), np.concatenate([content, own])
                if not len(first_):
                    continue
                doc = ids[np.searchsorted(at, first_, "right") - 1]
                same = mix(content ^ mix(offset.astype(np.uint64)))
                order = np.lexsort((doc, same))
                new = np.concatenate([[True], same[order[1:]] != same[order[:-1]]])
                one = np.empty(len(order), np.int64)
                one[order] = np.cumsum(new) - 1
                rep = order[new]  # the place of each context in its smallest document
                bucket_of, index_of = np.empty(len(rep), "<i4"), np.empty(len(rep), "<i4")
                for b, p in _by_bucket(key[rep], buckets):
                    bucket_of[p], index_of[p] = b, np.arange(len(p))
                    r = rep[p]
                    n = last_[r] - first_[r] + size
                    where = np.repeat(first_[r] - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
                    yield _batch(_CONTEXT, [1], [b], [row["chunk"]], [offset[r].tobytes()], [n.astype(np.uint8).tobytes()], [doc[r].astype("<i8").tobytes()], [_pack(raw[where])])
                yield _batch(_CONTEXT, [0], [0], [row["chunk"]], [_pack(bucket_of[one])], [_pack(index_of[one])], [_pack(first_.astype("<i8"))], [_pack((last_ - first_).astype(np.uint8))])

    return run


def _decide(size: int):
    """A bucket builds the transforms of its contexts and replies with the strings that a smaller document has."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bucket, chunks, offsets, lengths, docs, texts = 0, [], [], [], [], []
        for batch in batches:
            for row in batch.to_pylist():
                bucket = row["bucket"]
                chunks.append(row["chunk"])
                offsets.append(np.frombuffer(row["a"], np.uint8))
                lengths.append(np.frombuffer(row["b"], np.uint8))
                docs.append(np.frombuffer(row["c"], "<i8"))
                texts.append(_open(row["d"], np.uint8))
        if not chunks:
            return
        ends = np.cumsum([len(o) for o in offsets])
        offset, length, doc, data = (np.concatenate(x) for x in (offsets, lengths, docs, texts))
        offsets, lengths, docs, texts = [], [], [], []
        length = length.astype(np.int64)
        begin = np.concatenate([[0], np.cumsum(length)[:-1]])
        content, gram = np.empty(len(offset), np.uint64), np.empty(len(offset), np.uint64)
        for i in range(0, len(offset), 10_000):  # hashes of a slice at a time
            j = min(len(offset), i + 10_000)
            value, b = BYTE[data[begin[i] : begin[j - 1] + length[j - 1]]], begin[i:j] - begin[i]
            content[i:j] = spans(value, b, b + length[i:j])
            at = b + np.where(offset[i:j] < HOT, offset[i:j], 0)
            gram[i:j] = spans(value, at, at + GRAM)
        gram = np.where(offset < HOT, gram, content)
        same = mix(content ^ mix(offset.astype(np.uint64)))
        order = np.lexsort((doc, same, gram))
        new = np.concatenate([[True], (same[order[1:]] != same[order[:-1]]) | (gram[order[1:]] != gram[order[:-1]])])
        one = np.empty(len(order), np.int64)
        one[order] = np.cumsum(new) - 1
        rep = order[new]  # distinct strings, those of an anchor in a row
        least, count = doc[rep], length[rep] - size + 1
        at = np.concatenate([[0], np.cumsum(count)])  # the place of each string's windows
        decided = np.repeat(least, count)
        group = np.flatnonzero(np.concatenate([[True], gram[rep[1:]] != gram[rep[:-1]]]))
        ends_ = np.append(group[1:], len(rep))
        several = np.flatnonzero(ends_ - group > 1)
        i = 0
        while i < len(several):  # as many anchors as make a transform of STRINGS strings
            held = np.cumsum(ends_[several[i:]] - group[several[i:]])
            j = i + max(1, int(np.searchsorted(held, STRINGS, "right")))
            rows = np.concatenate([np.arange(group[g], ends_[g]) for g in several[i:j]])
            own = rep[rows]
            bwt = ColumnBwt(data, begin[own], length[own], size - offset[own].astype(np.int64))
            while bwt.step():
                string, turn = bwt.intervals(size)
                if len(string):
                    low = np.minimum.reduceat(least[rows[string]], turn)
                    where = at[rows[string]] + bwt.column - bwt.shift[string]
                    decided[where] = np.repeat(low, np.diff(np.append(turn, len(string))))
            i = j
        for chunk, first, end in zip(chunks, np.concatenate([[0], ends[:-1]]), ends, strict=True):
            o, own = one[first:end], doc[first:end]
            n = count[o]
            index = np.repeat(np.arange(len(o)), n)
            window = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            value = decided[at[o][index] + window]
            less = np.flatnonzero(value < own[index])
            if not len(less):
                continue
            index, window, value = index[less], window[less], value[less]
            turn = np.flatnonzero(np.concatenate([[True], (index[1:] != index[:-1]) | (value[1:] != value[:-1]) | (window[1:] != window[:-1] + 1)]))
            stop = np.append(turn[1:] - 1, len(index) - 1)
            yield _batch(_REPLY, [chunk], [bucket], [_pack(index[turn].astype("<i4"))], [_pack(window[turn].astype(np.uint8))], [_pack(window[stop].astype(np.uint8))], [_pack(value[turn].astype("<i8"))])

    return run


def _finish(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                raw, at, ids = _text(row)
                edge = np.zeros(len(raw) + 1, np.int32)
                if row["b"] is not None:
                    key = (_open(row["a"], "<i4").astype(np.int64) << 32) | _open(row["b"], "<i4")
                    first = _open(row["c"], "<i8")
                    last = first + _open(row["d"], np.uint8)
                    doc = ids[np.searchsorted(at, first, "right") - 1]
                    order = np.lexsort((doc, key))
                    new = np.concatenate([[True], key[order[1:]] != key[order[:-1]]])
                    own = np.empty(len(key), np.int64)
                    own[order] = doc[order][new][np.cumsum(new) - 1]  # the smallest document of the chunk that has the context
                    later = doc > own
                    np.add.at(edge, first[later], 1)
                    np.add.at(edge, last[later] + size, -1)
                    if row["replies"]:
                        index, a, b, least = (
                            np.concatenate(x)
                            for x in zip(*(((np.int64(r["bucket"]) << 32) | _open(r["index"], "<i4").astype(np.int64), _open(r["first"], np.uint8), _open(r["last"], np.uint8), _open(r["least"], "<i8")) for r in row["replies"]), strict=True)
                        )
                        by = np.argsort(index, kind="stable")
                        index, a, b, least = index[by], a[by], b[by], least[by]
                        low, high = np.searchsorted(index, key), np.searchsorted(index, key, "right")
                        n = high - low
                        which = np.repeat(np.arange(len(key)), n)
                        reply = np.repeat(low - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
                        sure = np.flatnonzero(least[reply] < doc[which])
                        which, reply = which[sure], reply[sure]
                        np.add.at(edge, first[which] + a[reply], 1)
                        np.add.at(edge, first[which] + b[reply] + size, -1)
                gone = np.cumsum(edge[:-1]) > 0
                kept = [raw[s:e][~gone[s:e]].tobytes() for s, e in zip(at[:-1], at[1:], strict=True)]
                start = gone.copy()
                start[1:] &= ~gone[:-1]
                inner = at[:-1][at[:-1] < at[1:]]
                start[inner] = gone[inner]
                sums = lambda x: np.diff(np.concatenate([[0], np.cumsum(x)])[at])
                yield pa.record_batch(
                    [pa.array(ids, mask=ids == NO_ID), pa.array(np.diff(at)), pa.array(sums(gone)), pa.array(sums(start)), pa.array([hashlib.sha256(k).hexdigest() for k in kept]), pa.array(kept, pa.binary())],
                    ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"],
                )

    return run


def _ddl(schema: list[tuple[str, pa.DataType]]) -> str:
    return ", ".join(f"{n} {'binary' if k == pa.binary() else 'int' if k == pa.int32() else 'long'}" for n, k in schema)


def dedup(docs: DataFrame, size: int = SIZE, most_of_anchor: int = MOST_OF_ANCHOR) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 and kept (the bytes that stay) of each row."""
    if not GRAM < size <= HOT - 2:
        raise ValueError(f"strings have {GRAM + 1} to {HOT - 2} bytes")
    spark = docs.sparkSession
    bound_arrow(spark)
    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    chunks = Written(texts.mapInArrow(_chunks, "chunk long, ids binary, sizes binary, data binary"), "bwt-chunks")
    volume = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = max(partitions(spark), -(-volume // BUCKET_BYTES))

    seen = chunks.df.mapInArrow(_announce(size, buckets), _ddl(_SEEN)).repartitionById(buckets, F.col("bucket"))
    told = seen.mapInArrow(_compare(most_of_anchor), _ddl(_FLAGS)).groupBy("chunk").agg(F.collect_list(F.struct("bucket", "shared", "hot")).alias("flags"))
    found = Written(chunks.df.join(told, "chunk").mapInArrow(_gather(size, buckets), _ddl(_CONTEXT)), "bwt-contexts")
    del seen, told
    free(spark)
    strings = found.df.where("kind = 1").drop("kind").repartitionById(buckets, F.col("bucket"))
    replies = Written(strings.mapInArrow(_decide(size), _ddl(_REPLY)), "bwt-replies")
    del strings
    free(spark)
    back = replies.df.groupBy("chunk").agg(F.collect_list(F.struct("bucket", "index", "first", "last", "least")).alias("replies"))
    places = found.df.where("kind = 0").select("chunk", "a", "b", "c", "d")
    ready = chunks.df.join(places.join(back, "chunk", "left"), "chunk", "left")
    return ready.mapInArrow(_finish(size), "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")
