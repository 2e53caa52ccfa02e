"""Connected components of a graph of 64-bit nodes by alternating large and small stars. No task or driver holds a component."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Written, few

#: Rounds after which something must be wrong: the number grows with the square of the logarithm of the longest path.
MOST_ROUNDS = 200
#: Edges of a file. A round has no more edges than twice those of the round before it, so these say how many files it writes.
FILE_EDGES = 100_000


def _least(edges: DataFrame) -> DataFrame:
    """node and least: the smallest neighbour. A sum that combines before the shuffle, so a node of any degree is a row a task."""
    return edges.groupBy("u").agg(F.min("v").alias("least"))


def _large(edges: DataFrame) -> DataFrame:
    """Each larger neighbour of u is tied to u's smallest neighbour, or to u."""
    both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    return both.where("v > u").join(_least(both), "u").select(F.col("v").alias("u"), F.least("u", "least").alias("v")).where("u <> v").distinct()


def _small(edges: DataFrame) -> DataFrame:
    """Each smaller neighbour of u, and u, are tied to the smallest one. Edges come with u > v."""
    tied = edges.join(_least(edges), "u")
    return tied.select(F.col("v").alias("u"), F.col("least").alias("v")).union(tied.select("u", F.col("least").alias("v"))).where("u <> v").distinct()


def components(edges: DataFrame, name: str) -> Written:
    """node and label (the smallest node of its component) for each node of the edges (a, b), labels themselves included."""
    pair = edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    files = few(edges.sparkSession)
    now, before = Written(pair, f"{name}-0", files), None
    for turn in range(MOST_ROUNDS):
        then = Written(_small(_large(now.df)), f"{name}-{turn + 1}", files)
        said = then.df.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        now.drop()
        now = then
        if said == before:
            break
        before, files = said, 1 + said[0] // FILE_EDGES
    else:
        raise RuntimeError("components did not settle")
    out = Written(now.df.select(F.col("u").alias("node"), F.col("v").alias("label")).union(now.df.select(F.col("v").alias("node"), F.col("v").alias("label")).distinct()), f"{name}-labels", files)
    now.drop()
    return out
