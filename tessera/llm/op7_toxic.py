"""Toxicity by a weighted lexicon.

Texts are folded first: letters that look alike and digits that stand for letters become plain letters, marks inside a word
go. The lexicon has folded words and beginnings of words, with weights from labelled documents: how much more often toxic
texts use them, as the lower end of an interval, so that rare coincidences weigh nothing. An Aho-Corasick automaton finds the terms of a whole folded text
at once. A term inside an exception phrase (a pair of words that labelled clean documents use it in) doesn't count. The sum
of weights, as such and by the text's length, goes through a logistic curve that is fitted to the same documents.

What is fitted is bounded, and documented here: at most TRAIN_ROWS labelled documents, chosen by a hash of doc_id, which are
broadcast by id and written to the shared folder; CANDIDATES terms, those most frequent in toxic documents; TERMS terms of
the lexicon and as many exceptions. Scoring covers every row and text. No label, language, source or id enters a score.

Defined results. Null and empty texts have no hits and get the score of none. Without labelled documents of both kinds the
lexicon is empty and all scores are 0. Label rows without doc_id or toxic are left out; where rows of a doc_id disagree, it
is toxic, and where a labelled doc_id has several texts, one of them is learned from. A null doc_id is never held out and never
labelled. Rows that repeat are scored each; very long texts are scored whole. Terms with equal weights are taken in their own
order. An empty table gives an empty result. Other columns are ignored, whatever they are called.
"""

from __future__ import annotations

import unicodedata
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Written, bound_arrow

TRAIN_ROWS, CANDIDATES, TERMS = 40_000, 40_000, 8_000
THRESHOLD = 0.7
#: Beginnings of words that can be terms have 4 to 7 letters; whole words up to LONGEST.
STEMS, LONGEST = (4, 5, 6, 7, 8), 24
SUPPORT, LEAST_WEIGHT, Z = 6, 1.3, 1.96
#: Uses of a term that count in one document when learning, and those of a word when scoring.
MOST_USES, MOST_REPEATS = 10, 2
CACHE_WORDS = 400_000

#: Characters that stand for a Latin letter.
LOOKALIKE = {
    "0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "|": "i", "€": "e",
    "а": "a", "в": "b", "е": "e", "к": "k", "м": "m", "н": "h", "о": "o", "р": "p", "с": "c", "т": "t", "у": "y", "х": "x", "і": "i", "ј": "j", "ѕ": "s", "ԁ": "d", "ӏ": "l",
    "α": "a", "β": "b", "ε": "e", "η": "n", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x", "ı": "i", "ł": "l", "ø": "o",
}
_SWAP = str.maketrans(LOOKALIKE)


def fold(word: str) -> str:
    """A word's plain letters; empty if it has none of its own."""
    if word.isascii() and word.isalpha():
        return word.lower()
    if not any(c.isalpha() for c in word):
        return ""
    # Marks at a word's ends are punctuation, not letters in disguise.
    word = word.strip("!|.,;:?\"'()[]{}*#&%_-")
    plain = unicodedata.normalize("NFKD", word.lower()).translate(_SWAP)
    return "".join(c for c in plain if c.isalpha())


class Folder(dict):
    """Folded words, kept as they are met."""

    def __missing__(self, word: str) -> str:
        if len(self) > CACHE_WORDS:
            self.clear()
        out = fold(word)
        if len(word) <= 64:
            self[word] = out
        return out

    def text(self, text: str) -> list[str]:
        return [w for w in map(self.__getitem__, text.split()) if w]


def terms(words: list[str]) -> Counter[str]:
    """What a text offers the lexicon, with its uses: beginnings of words, and whole words with a blank at the end."""
    out: Counter[str] = Counter()
    for w, n in Counter(words).items():
        if 2 < len(w) <= LONGEST:
            out[w + " "] += n
        for size in STEMS:
            if len(w) >= size:
                out[w[:size]] += n
    return out


def weight(toxic: np.ndarray, clean: np.ndarray, toxic_docs: np.ndarray, clean_docs: np.ndarray, ratio: float) -> np.ndarray:
    """The lower end of the logarithm of how much more often toxic texts use a term; `ratio`: clean words by toxic ones.

    Uses in one document depend on each other, so the interval is that of the numbers of documents.
    """
    mid = np.log((toxic + 0.5) / (clean + 0.5) * ratio)
    return mid - Z * np.sqrt(1 / (toxic_docs + 0.5) + 1 / (clean_docs + 0.5))


@dataclass
class Model:
    """Terms with weights, exception phrases, and the curve."""

    weights: dict[str, float] = field(default_factory=dict)
    exceptions: frozenset[tuple[str, str]] = frozenset()
    curve: tuple[float, ...] = ()

    def automaton(self):
        import ahocorasick

        out = ahocorasick.Automaton()
        for term, value in self.weights.items():
            out.add_word(" " + term, (len(term) + 1, value))
        out.make_automaton()
        return out


def hits(words: list[str], automaton, exceptions: frozenset[tuple[str, str]]) -> list[tuple[int, float]]:
    """The hit words' numbers in the text, with the largest weight of the terms that each matches."""
    if not words or not len(automaton):
        return []
    text = " " + " ".join(words) + " "
    best: dict[int, float] = {}
    for end, (size, value) in automaton.iter(text):
        start = end - size + 1
        best[start] = max(best.get(start, 0.0), value)
    if not best:
        return []
    out, number, at = [], 0, 0
    for start, value in sorted(best.items()):
        number, at = number + text.count(" ", at, start), start
        pairs = [words[i : i + 2] for i in (number - 1, number) if 0 <= i < len(words) - 1]
        if not any(tuple(p) in exceptions for p in pairs):
            out.append((number, value))
    return out


def features(found: list[tuple[int, float]], words: list[str]) -> tuple[float, float, float]:
    """The sum of weights, as such and by the text's length, and the largest. A word counts MOST_REPEATS times at most."""
    uses: Counter[str] = Counter()
    total = 0.0
    for number, value in found:
        uses[words[number]] += 1
        if uses[words[number]] <= MOST_REPEATS:
            total += value
    return (float(np.log1p(total)), float(np.log1p(100 * total / max(len(words), 20))), max((v for _, v in found), default=0.0))


def fit(x: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> tuple[float, ...]:
    """Logistic regression by Newton's steps; the constant is free of the penalty."""
    x = np.column_stack([np.ones(len(x)), x])
    keep, beta = np.diag([1e-6] + [ridge] * (x.shape[1] - 1)), np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p) + 1e-9)[:, None]).T @ x + keep, x.T @ (y - p) - keep @ beta)
        beta = beta + np.clip(step, -4, 4)
        if np.abs(step).max() < 1e-8:
            break
    return tuple(float(b) for b in beta)


def curve(beta: tuple[float, ...], x: tuple[float, float, float]) -> float:
    if not beta:
        return 0.0
    return float(1 / (1 + np.exp(-np.clip(beta[0] + sum(b * v for b, v in zip(beta[1:], x, strict=True)), -30, 30))))


def held_out(doc_id: Column) -> Column:
    """Whether a document is kept from learning."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


_USES = "term string, uses long, docs long"


def _uses(held: dict[str, list[int]], words: int) -> pa.RecordBatch:
    """Terms with their uses and documents; the empty term has all words."""
    held[""] = [words, 0]
    return pa.record_batch([pa.array(list(held)), pa.array([v[0] for v in held.values()], pa.int64()), pa.array([v[1] for v in held.values()], pa.int64())], ["term", "uses", "docs"])


def _count(asked):
    """Uses of the asked terms, or of all if there is no list; counts leave the worker whenever there are many."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        only, folder, held, total = asked and asked.value, Folder(), {}, 0
        for batch in batches:
            for text in batch.column("text").to_pylist():
                words = folder.text(text or "")
                total += len(words)
                for term, n in terms(words).items():
                    if only is None or term in only:
                        entry = held.setdefault(term, [0, 0])
                        entry[0] += min(n, MOST_USES)
                        entry[1] += 1
                if len(held) > 300_000:
                    yield _uses(held, total)
                    held, total = {}, 0
        yield _uses(held, total)

    return run


def _counted(rows: DataFrame, asked=None) -> DataFrame:
    return rows.select("text").mapInArrow(_count(asked), _USES).groupBy("term").agg(F.sum("uses").alias("uses"), F.sum("docs").alias("docs"))


def _phrases(sent):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton, folder, held = sent.value.automaton(), Folder(), Counter()
        for batch in batches:
            for text, toxic in zip(batch.column("text").to_pylist(), batch.column("toxic").to_pylist(), strict=True):
                words = folder.text(text or "")
                pairs = {tuple(words[i : i + 2]) for n, _ in hits(words, automaton, frozenset()) for i in (n - 1, n) if 0 <= i < len(words) - 1}
                held.update((a, b, toxic) for a, b in pairs)
        a, b, t = zip(*held, strict=True) if held else ((), (), ())
        yield pa.record_batch([pa.array(a, pa.string()), pa.array(b, pa.string()), pa.array(t, pa.int32()), pa.array(list(held.values()), pa.int64())], ["a", "b", "toxic", "n"])

    return run


def _features(sent):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, folder = sent.value, Folder()
        automaton = model.automaton()
        for batch in batches:
            words = [folder.text(t or "") for t in batch.column("text").to_pylist()]
            x = np.array([features(hits(w, automaton, model.exceptions), w) for w in words]).reshape(-1, 3)
            yield pa.record_batch([batch.column("toxic"), *(pa.array(x[:, i]) for i in range(3))], ["toxic", "x0", "x1", "x2"])

    return run


def learn(docs: DataFrame, labels: DataFrame, train_rows: int = TRAIN_ROWS) -> Model:
    """A model from the labelled documents that are not held out."""
    spark = docs.sparkSession
    bound_arrow(spark)
    told = labels.where("doc_id is not null and toxic is not null").groupBy(F.col("doc_id").cast("bigint").alias("doc_id")).agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    told = told.where(~held_out(F.col("doc_id"))).orderBy(F.xxhash64("doc_id"), "doc_id").limit(train_rows)
    # One text of each labelled id, that with the least hash, so what is fitted is bounded by rows too.
    named = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").join(F.broadcast(told), "doc_id")
    train = Written(named.groupBy("doc_id").agg(F.min_by("text", F.xxhash64("text")).alias("text"), F.max("toxic").alias("toxic")).select("text", "toxic"), "toxic-train")
    n = {r.toxic: r["count"] for r in train.df.groupBy("toxic").count().collect()}
    n_toxic, n_clean = n.get(1, 0), n.get(0, 0)
    if not n_toxic or not n_clean:
        return Model()
    send = spark.sparkContext.broadcast
    support = max(SUPPORT, n_toxic // 1000)
    toxic_uses = Written(_counted(train.df.where("toxic = 1")), "toxic-uses")
    toxic = {r.term: r for r in toxic_uses.df.where((F.col("docs") >= support) & (F.col("term") != "")).orderBy(F.desc("docs"), "term").limit(CANDIDATES).collect()}
    toxic_words = toxic_uses.df.where("term = ''").first().uses
    clean = {r.term: r for r in _counted(train.df.where("toxic = 0"), send(frozenset(toxic))).collect()}
    toxic_uses.drop()
    names, ratio = sorted(toxic), (clean[""].uses + 1) / (toxic_words + 1)
    of = lambda rows, field_: np.array([rows[t][field_] if t in rows else 0 for t in names], float)
    w = weight(of(toxic, "uses"), of(clean, "uses"), of(toxic, "docs"), of(clean, "docs"), ratio)
    model = Model({names[i]: float(w[i]) for i in np.argsort(-w, kind="stable")[:TERMS] if w[i] >= LEAST_WEIGHT})
    pairs = train.df.mapInArrow(_phrases(send(model)), "a string, b string, toxic int, n long").groupBy("a", "b")
    pairs = pairs.agg(F.sum(F.when(F.col("toxic") == 1, F.col("n")).otherwise(0)).alias("t"), F.sum(F.when(F.col("toxic") == 0, F.col("n")).otherwise(0)).alias("c"))
    rows = pairs.where(F.col("c") >= SUPPORT).orderBy(F.desc("c"), "a", "b").limit(TERMS).collect()
    safe = lambda r: weight(*(np.array([n], float) for n in (r.c, r.t, r.c, r.t)), n_toxic / n_clean)[0] > 0
    model.exceptions = frozenset((r.a, r.b) for r in rows if safe(r))
    x = train.df.mapInArrow(_features(send(model)), "toxic int, x0 double, x1 double, x2 double").toPandas().to_numpy(float)
    x = x[np.lexsort(x.T[::-1])]  # sums of floats in one order, so reruns agree
    model.curve = fit(x[:, 1:], x[:, 0])
    train.drop()
    return model


def scorer(spark: SparkSession, model: Model):
    """A function of a text column that gives its score; no other column of a table is touched."""
    bound_arrow(spark)
    sent = spark.sparkContext.broadcast(model)

    def scored(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        held, folder = sent.value, Folder()
        automaton = held.automaton()
        for texts in batches:
            words = [folder.text(t or "") for t in texts]
            yield pd.Series([curve(held.curve, features(hits(w, automaton, held.exceptions), w)) for w in words], dtype=float)

    return F.pandas_udf(scored, "double")


def classify(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score and predicted of each row."""
    model = learn(docs, labels)
    rows = docs.select("doc_id", scorer(docs.sparkSession, model)(F.col("text")).alias("score"))
    return rows.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def without(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows whose score is below the threshold, with all columns."""
    return docs.where(scorer(docs.sparkSession, learn(docs, labels))(F.col("text")) < threshold)
