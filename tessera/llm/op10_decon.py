"""Benchmark decontamination by template canonicalisation.

A text becomes a sequence of tokens: words stripped of outer marks and lower-cased, with numbers, names (capitalised inside
a sentence; marks and line breaks end one) and units replaced by typed placeholders whose words are kept as slot values. Windows
of WINDOW tokens are hash-joined with those of the benchmark's items. Matches of an item that lie on one line (the same distance
between the places) are checked for their slots: a value of the item must stand for one value throughout, and no two values for
the same one. A document is contaminated by an item if LEAST windows on such a line agree. Equal slots make it verbatim,
others re-parameterised. Items with fewer than LEAST windows of LITERAL plain words or more (short ones, and those of little but
numbers, names and units) say too little as templates: they are joined on their words, numbers and all, and match where all
of them follow each other.

The benchmark goes to the workers in blocks of items with at most BLOCK_TOKENS tokens, about 40 bytes each, whatever its size. A
larger benchmark means more passes over the documents, one after the other, not a larger broadcast: the rows are written with
a number first, and what a block finds is put together by that number. Block sizes change no result.

Defined results. Null and empty texts, of documents or items, match nothing, as do items with fewer than SHORTEST tokens. Items
with equal texts are reported each, and so are rows that repeat or have no doc_id. Very long texts are read whole. Of an item's
lines in a document the one with the most windows is reported, of ties the verbatim one. Empty tables give an empty result.
Other columns are ignored, whatever they are called.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Written, bound_arrow
from .texthash import mix, spans

WINDOW, LEAST, SHORTEST = 8, 3, 3
#: Tokens of a window that must not be placeholders.
LITERAL = 4
BLOCK_TOKENS = 1 << 21
CACHE_WORDS = 400_000

#: Unit words and signs that become the placeholder for units.
UNITS = frozenset(
    """mm cm m km in ft yd mi mg g kg lb lbs oz ml l s ms min mins h hr hrs day days week weeks month months year years
    second seconds minute minutes hour hours metre metres meter meters kilometre kilometres kilometer kilometers centimetre centimetres
    mile miles inch inches foot feet yard yards gram grams kilogram kilograms pound pounds ounce ounces litre litres liter liters
    dollar dollars cent cents euro euros usd eur gbp mph kmh percent degrees celsius fahrenheit % $ € £ °c °f""".split()
)
_NUMBER = re.compile(r"[+-]?[$€£]?(?:\d+(?:[.,:/]\d+)*|\.\d+)(?:st|nd|rd|th|%|°)?")
_WORDS = frozenset("zero one two three four five six seven eight nine ten eleven twelve twenty thirty forty fifty sixty seventy eighty ninety hundred thousand million billion".split())
_OUTER = re.compile(r"^[^\w$€£%+.-]+|[^\w%]+$")
_CLOSE = re.compile(r"[.!?:][^\w]*$")

DROP, ENDS, NAME, NUMBER, UNIT, VALUE = 1, 2, 4, 8, 16, 0xFFFFFFFFFFFFFFE0


def _hash(word: str) -> int:
    raw = word.encode("utf-8", "surrogatepass")
    return ((zlib.crc32(raw) << 32) | zlib.crc32(raw[::-1] + b"\x01")) & VALUE


def clean(word: str) -> str:
    """A word without outer marks."""
    return _OUTER.sub("", word)


def code(word: str) -> int:
    """A word's hash in the upper 59 bits, and what it is in the lower 5."""
    bare = clean(word)
    low = bare.lower()
    flags = ENDS if _CLOSE.search(word) else 0
    if not any(c.isalnum() for c in bare) and low not in UNITS:
        return flags | DROP
    if _NUMBER.fullmatch(low) or low in _WORDS:
        return flags | NUMBER | _hash("\x00number")
    if low in UNITS:
        return flags | UNIT | _hash("\x00unit")
    if bare[0].isupper() and len(bare) > 1 and bare[1:].islower():
        flags |= NAME
    return flags | _hash(low)


_NAMED = np.uint64(_hash("\x00name"))


class Canonical:
    """Token hashes, slot kinds and words of a text; the codes of words that were seen are kept."""

    def __init__(self):
        self.known: dict[str, int] = {}
        self.bare: dict[str, int] = {}

    def __call__(self, text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[str]]:
        words, breaks = [], [0]
        for line in text.split("\n"):
            words += line.split()
            breaks.append(len(words))
        known = self.known
        if len(known) > CACHE_WORDS:
            known.clear()
        try:
            got = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
        except KeyError:
            known.update((w, code(w)) for w in set(words).difference(known))
            got = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
        starts = np.zeros(len(got) + 1, bool)
        starts[1:] = (got & np.uint64(ENDS)) > 0
        starts[breaks] = True
        name = ((got & np.uint64(NAME)) > 0) & ~starts[:-1]
        token = np.where(name, _NAMED, got & np.uint64(VALUE))
        slot = name | ((got & np.uint64(NUMBER | UNIT)) > 0)
        keep = np.flatnonzero((got & np.uint64(DROP)) == 0)
        return token[keep], slot[keep], keep, words

    def plain(self, words: list[str], keep: np.ndarray) -> np.ndarray:
        """The hashes of the kept words as they stand, placeholders or not."""
        bare = self.bare
        if len(bare) > CACHE_WORDS:
            bare.clear()
        for w in set(words).difference(bare):
            bare[w] = _hash(clean(w).lower())
        return np.fromiter((bare[words[i]] for i in keep.tolist()), np.uint64, len(keep))


def window_hashes(token: np.ndarray, slot: np.ndarray | None, size: int) -> np.ndarray:
    """The hash of each window; with `slot`, 0 where too few of its tokens are words."""
    n = len(token) - size + 1
    if n < 1:
        return np.zeros(0, np.uint64)
    begin = np.arange(n)
    out = spans(mix(token), begin, begin + size) | np.uint64(1)
    if slot is None:
        return out
    held = np.concatenate([[0], np.cumsum(~slot)])
    return np.where(held[size:] - held[:-size] >= LITERAL, out, np.uint64(0))


class Table:
    """Window hashes in order, and for each the items and places that have it."""

    def __init__(self, rows: list[tuple[int, np.ndarray]]):
        number = np.repeat([n for n, _ in rows], [len(h) for _, h in rows]) if rows else np.zeros(0, int)
        place = np.concatenate([np.arange(len(h)) for _, h in rows]) if rows else np.zeros(0, int)
        value = np.concatenate([h for _, h in rows]) if rows else np.zeros(0, np.uint64)
        some = np.flatnonzero(value)
        order = some[np.argsort(value[some], kind="stable")]
        self.keys, begin = np.unique(value[order], return_index=True)
        self.begin = np.append(begin, len(order)).astype(np.int64)
        self.number, self.place = number[order].astype(np.int32), place[order].astype(np.int32)

    def meet(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Item numbers, distances and places of the windows that items have."""
        at = np.minimum(np.searchsorted(self.keys, h), len(self.keys) - 1)
        here = np.flatnonzero(self.keys[at] == h) if len(self.keys) and len(h) else np.zeros(0, np.int64)
        low, n = self.begin[at[here]], self.begin[at[here] + 1] - self.begin[at[here]]
        entry = np.repeat(low - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum()) if len(here) else here
        where = np.repeat(here, n)
        return self.number[entry], where - self.place[entry], where


class Items:
    """A block of benchmark items: their words, and the tables of their windows."""

    def __init__(self, rows: list[tuple[int, str]], size: int):
        canonical, self.size = Canonical(), size
        self.ids, self.words, self.slots, templates, plain = [], [], [], [], {}
        for item, text in rows:
            token, slot, keep, words = canonical(text or "")
            if len(token) < SHORTEST:
                continue
            number = len(self.ids)
            self.ids.append(item)
            self.words.append([clean(words[i]).lower() for i in keep])
            self.slots.append(slot)
            h = window_hashes(token, slot, size)
            if np.count_nonzero(h) >= LEAST:
                templates.append((number, h))
            else:
                own = min(size, len(token))
                plain.setdefault(own, []).append((number, window_hashes(canonical.plain(words, keep)[:own], None, own)))
        self.templates = Table(templates)
        self.plain = {n: Table(held) for n, held in sorted(plain.items())}

    def agree(self, item: int, shift: int, places: list[int], slot: np.ndarray, words: list[str]) -> str | None:
        """Whether the slots under these windows are consistent: "verbatim", "reparameterised" or None."""
        there, back, equal = {}, {}, True
        for p in sorted({p + i for p in places for i in range(self.size)}):
            if not slot[p]:
                continue
            theirs, ours = self.words[item][p - shift], words[p]
            if there.setdefault(theirs, ours) != ours or back.setdefault(ours, theirs) != theirs:
                return None
            equal &= theirs == ours
        return "verbatim" if equal else "reparameterised"

    def judge(self, canonical: Canonical, text: str) -> list[tuple[int, int, str]]:
        """(item_id, windows, how) of the items that contaminate a text."""
        token, slot, keep, words = canonical(text)
        own, best = None, {}
        item, shift, place = self.templates.meet(window_hashes(token, slot, self.size))
        if len(item):
            order = np.lexsort((place, shift, item))
            item, shift, place = item[order], shift[order], place[order]
            cut = np.flatnonzero(np.concatenate([[True], (item[1:] != item[:-1]) | (shift[1:] != shift[:-1])]))
            end = np.append(cut[1:], len(item))
            for a, b in zip(cut.tolist(), end.tolist(), strict=True):
                if b - a >= LEAST:
                    own = own or [clean(words[i]).lower() for i in keep]
                    if how := self.agree(int(item[a]), int(shift[a]), place[a:b].tolist(), slot, own):
                        best[int(item[a])] = max(best.get(int(item[a]), (0, "")), (b - a, how))
        if self.plain:
            bare = canonical.plain(words, keep)
            for size, table in self.plain.items():
                for number, at in {(int(n), int(p)) for n, _, p in zip(*table.meet(window_hashes(bare, None, size)), strict=True)}:
                    own = own or [clean(words[i]).lower() for i in keep]
                    if own[at : at + len(self.words[number])] == self.words[number]:
                        best[number] = (1, "verbatim")
        return sorted((self.ids[i], n, how) for i, (n, how) in best.items())


def _blocks(items: DataFrame, most: int) -> Iterator[list[tuple[int, str]]]:
    """Items, so many at a time that their words are at most `most` (or one item's). The driver holds one block."""
    held, words = [], 0
    for row in items.select(F.col("item_id").cast("bigint"), "text").where("text is not null").toLocalIterator():
        n = len(row[1].split())
        if held and words + n > most:
            yield held
            held, words = [], 0
        held.append((row[0], row[1]))
        words += n
    if held:
        yield held


_HITS = "row long, doc_id long, item_id long, windows long, how string"
_FOUND = "doc_id long, item_ids array<long>, n_windows long, kind string"


def _check(sent):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items, canonical = sent.value, Canonical()
        for batch in batches:
            rows = [(row.as_py(), doc.as_py(), *hit) for row, doc, text in zip(*map(batch.column, ("row", "doc_id", "text")), strict=True) for hit in items.judge(canonical, text.as_py() or "")]
            if rows:
                kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string())
                yield pa.record_batch([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], ["row", "doc_id", "item_id", "windows", "how"])

    return run


def contaminated(docs: DataFrame, benchmark: DataFrame, size: int = WINDOW, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """doc_id, item_ids, n_windows and kind of each row that holds benchmark items."""
    spark = docs.sparkSession
    bound_arrow(spark)
    texts, found, written = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("bigint").alias("doc_id"), "text"), None, False
    blocks = _blocks(benchmark, block_tokens)
    block = next(blocks, None)
    while block is not None:
        sent, block = spark.sparkContext.broadcast(Items(block, size)), next(blocks, None)
        if block is not None and not written:  # numbers must be the same in all passes; a single one needs no copy
            texts, written = Written(texts, "decon-texts").df, True
        hits = Written(texts.mapInArrow(_check(sent), _HITS), "decon-hits").df
        sent.destroy()
        found = hits if found is None else found.unionByName(hits)
    if found is None:
        return spark.createDataFrame([], _FOUND)
    how = F.max("how").alias("kind")  # of the two, "verbatim" is the larger word
    of_row = found.groupBy("row").agg(F.first("doc_id").alias("doc_id"), F.array_sort(F.collect_list("item_id")).alias("item_ids"), F.sum("windows").alias("n_windows"), how)
    return of_row.drop("row")


def _clean(sent):
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        items, canonical = sent.value, Canonical()
        for texts in batches:
            yield pd.Series([not items.judge(canonical, t or "") for t in texts], dtype=bool)

    return run


def without(docs: DataFrame, benchmark: DataFrame, size: int = WINDOW, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """The rows that no item contaminates, with all columns. Texts are neither shuffled nor joined."""
    bound_arrow(docs.sparkSession)
    sent = None
    for block in _blocks(benchmark, block_tokens):
        if sent is not None:
            docs = Written(docs, "decon-clean").df  # the block before is done with
            sent.destroy()
        sent = docs.sparkSession.sparkContext.broadcast(Items(block, size))
        docs = docs.where(F.pandas_udf(_clean(sent), "boolean")(F.col("text")))
    return docs


def summary(found: DataFrame) -> DataFrame:
    """How many documents each item is in."""
    return found.select(F.explode("item_ids").alias("item_id")).groupBy("item_id").agg(F.count("*").alias("n_docs"))
