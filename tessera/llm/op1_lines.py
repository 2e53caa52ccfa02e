"""Line dedup by distributed prefix doubling over line-ID sequences.

A run of lines is repeated if it has `least` lines or more, or `words` words or more in fewer lines. A round joins the ranks of
two neighbouring runs of k lines to the rank of the run of 2 k lines that they make: distinct pairs are counted, sorted over
the cluster and numbered in that order, which sorts all suffixes by their first 2 k lines. Pairs that occur once are settled and
leave, so rounds shrink to what repeats. Doubling stops at `least` lines: places with equal ranks are then an interval of suffixes
whose longest common prefix is `least` lines or more, and longer repeated runs are the unions of such places that overlap, so the
rounds that would tell how much longer need not be made. In each interval the first place, by doc_id and line, keeps its lines;
the lines of all others go, and overlapping runs join. What decides is thus the equality of ranks, not their order; the order is
kept, as it is that of a suffix array of depth `least`. Runs are judged on the input and don't cross documents.

Every count combines before it is shuffled, and only distinct pairs are sorted, so a line that a third of all documents hold
is one row there; the join that hands ranks back is split by Spark where one key is large. Documents' texts are read
twice and shuffled once, with what goes. A round writes two tables, its ranks and the next round's runs, which also say what
goes by this round; the last writes none. Where Spark's local file system starts a process for each file that it makes, fewer
tables mean fewer moments at which that process is counted with the whole memory of the JVM.

Defined results. Lines end at line feeds and are compared whole, however long; lines are told by 128 bits of hash. Null and empty
texts are one empty line. Rows with the same doc_id and text are one document and get the same result each; rows that share a
doc_id but not the text count as different documents, in the order of a hash. Null doc_ids are the smallest. An empty table gives
an empty result. Other columns are ignored.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Written
from .op4_mix import word_count

#: Lines of the shortest run that counts, and words of the shortest that counts with fewer lines.
LEAST, WORDS = 3, 50


def _repeated(rows: DataFrame) -> DataFrame:
    """The pairs (a, b) that occur more than once, with their first place."""
    return rows.groupBy("a", "b").agg(F.count("*").alias("held"), F.min(F.struct("doc_id", "h", "i")).alias("first")).where("held > 1").drop("held")


def _ranked(rows: DataFrame, name: str) -> Written:
    """The pairs (a, b) that occur more than once, with their rank and first place, sorted over the cluster."""
    dealt = _repeated(rows).repartitionByRange("a", "b").sortWithinPartitions("a", "b")
    return Written(dealt.select("a", "b", "first", F.monotonically_increasing_id().alias("rank")), name)


def _ahead(column: str, lines: int) -> Column:
    """What the run that begins so many lines further on in the document has, if it repeats."""
    return F.max(column).over(Window.partitionBy("doc_id", "h").orderBy("i").rangeBetween(lines, lines))


def removed_lines(docs: DataFrame, least: int = LEAST, words: int = WORDS) -> DataFrame:
    """doc_id, h and `gone`, the sorted numbers of lines that go, for each document (doc_id, h, text) that loses any."""
    if least < 1:
        raise ValueError("a run has a line at least")
    lines = docs.select("doc_id", "h", F.posexplode(F.split("text", "\n", -1)).alias("i", "line"))
    # A pair (a, b) names a run: of one line by two hashes, of more by the ranks of its two halves; w are its words.
    runs = Written(lines.select("doc_id", "h", "i", F.xxhash64("line").alias("a"), F.xxhash64("line", F.lit(1)).alias("b"), word_count(F.col("line")).alias("w")), "lines-1")
    length, gone = 1, []
    later = ~F.struct("doc_id", "h", "i").eqNullSafe(F.col("first"))
    span = lambda rows, n: rows.select("doc_id", "h", F.explode(F.sequence(F.col("i"), F.col("i") + (n - 1))).alias("line"))
    while length < least:
        every = runs.df.where("b is not null")
        alive = every.join(_ranked(every, f"ranks-{length}").df, ["a", "b"])
        step = min(length, least - length)  # doubles, or reaches `least` with two runs that overlap
        longer = alive.select("doc_id", "h", "i", F.col("rank").alias("a"), _ahead("rank", step).alias("b"), (F.col("w") + _ahead("w", step)).alias("w"), (later & (F.col("w") >= words)).alias("goes"))
        old, runs = runs, Written(longer.where("b is not null or goes"), f"lines-{length + step}")
        gone.append(span(runs.df.where("goes"), length))
        if length == 1:  # the other tables are read again for what goes
            old.drop()
        length += step
    every = runs.df.where("b is not null")
    gone.append(span(every.join(_repeated(every), ["a", "b"]).where(later), length))
    gone = reduce(DataFrame.unionByName, gone)
    return gone.groupBy("doc_id", "h").agg(F.array_sort(F.collect_set("line")).alias("gone"))


def dedup(docs: DataFrame, least: int = LEAST, words: int = WORDS) -> DataFrame:
    """doc_id, n_lines, n_removed, n_runs (maximal removed runs) and `kept`, the text that stays, of each row."""
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("h", F.xxhash64("text"))
    gone = removed_lines(texts, least, words)
    none = F.expr("cast(array() as array<int>)")
    told = texts.join(gone.withColumnsRenamed({"doc_id": "d", "h": "g"}), F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("h") == F.col("g")), "left")
    told = told.select("doc_id", F.split("text", "\n", -1).alias("lines"), F.coalesce("gone", none).alias("gone"), "text")
    left = F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), "gone")
    kept = F.when(F.size("gone") == 0, F.col("text")).otherwise(F.array_join(F.transform(left, lambda i: F.get("lines", i)), "\n"))
    runs = F.size(F.array_except("gone", F.transform("gone", lambda i: i + 1)))
    return told.select("doc_id", F.size("lines").cast("bigint").alias("n_lines"), F.size("gone").cast("bigint").alias("n_removed"), runs.cast("bigint").alias("n_runs"), kept.alias("kept"))
