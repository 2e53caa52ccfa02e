"""Mixing sources to target weights by pivotal dependent rounding.

Every document of a source asks for target / size copies of itself, a fraction. The whole part is granted. The rest is
decided pair by pair: of two undecided documents one gains and the other loses words, at random but with the same
expectation, until one of them has a whole copy or none. A pair's words don't change, so a source's words stay at its
target up to the one document that is left at the end. Blocks of a source are rounded on their own and pass on the one
document that they could not decide; a tree of such reductions ends at one per source, so no task sees a whole source.
Rows that are equal in doc_id, source and size are counted first and dealt one by one, so many of them don't fill a block.
Targets are set by windows over a table with one row a source, however many there are.

Defined results. Null and empty texts have size 0 and take 0 words; of very long texts only the size counts. A null source is a
source of its own, the last. Rows that repeat are documents of their own. An empty table gives an empty result. Blocks, their
order and the random numbers depend on doc_id, size and the seed alone, so reruns agree, and ties (documents of one size) are
broken by doc_id. Other columns are ignored, whatever they are called.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Written, bound_arrow

#: Rows of a block, and residual documents that one node of the tree combines.
BLOCK_ROWS, FAN_IN = 2_000, 2_000
#: Equal rows that one task deals at once.
PIECE = 1_000
NEAR = 1e-9

_LEFT = T.StructType().add("source", "string").add("block", "long").add("doc_id", "long").add("size", "long").add("whole", "long").add("part", "double")


def word_count(text: Column) -> Column:
    """Runs of anything but ASCII white space."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("bigint")


def targets(sizes: DataFrame, weights: list[float], share: float = 1.0, most: float = 3.0) -> DataFrame:
    """The rows of `sizes` (source, words) with `target`: `share` of all words by weight, none above `most` times its size.

    The excess is shared again until none is above, which is a level: a source takes its weight times the level, or its limit
    if that is less. In the order of limit by weight the limited sources come first, and running sums tell where they end.
    """
    everything, turn = Window.partitionBy(), Window.orderBy(F.col("source").asc_nulls_last())
    listed = F.lit([float(w) for w in weights])
    limit = sizes.withColumn("weight", F.get(listed, (F.row_number().over(turn) - 1) % len(weights))).withColumn("limit", F.lit(float(most)) * F.col("words"))
    limit = limit.withColumn("reach", F.col("limit") / F.col("weight")).withColumn("all", F.lit(float(share)) * F.sum("words").over(everything))
    before = Window.orderBy("reach", F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    gone = lambda c: F.coalesce(F.sum(c).over(before), F.lit(0.0))
    level = limit.withColumn("level", (F.col("all") - gone("limit")) / (F.sum("weight").over(everything) - gone("weight")))
    # The first source that stays below its limit has the level of all that do.
    free = F.min(F.when(F.col("level") <= F.col("reach"), F.struct("reach", F.col("source").isNull().alias("last"), "source", "level"))).over(everything)
    told = level.withColumn("target", F.when(free.isNull(), F.col("limit")).otherwise(F.least("limit", F.col("weight") * free["level"])))
    return told.drop("weight", "limit", "reach", "all", "level")


def pivot(size: np.ndarray, part: np.ndarray, draw: np.random.Generator) -> np.ndarray:
    """Round the fractions to 0 or 1, all but one at most; the sum of size * part stays."""
    part = part.copy()
    coin = draw.random(len(part))
    held = -1
    for i in range(len(part)):
        if not NEAR < part[i] < 1 - NEAR:
            part[i] = round(part[i])
            continue
        if held < 0:
            held = i
            continue
        a, b, p, q = float(size[held]), float(size[i]), part[held], part[i]
        up, down = min((1 - p) * a, q * b), min(p * a, (1 - q) * b)  # words that the held one can gain or lose
        move = up if coin[i] * (up + down) < down else -down
        part[held], part[i] = p + move / a, q - move / b
        for j in (held, i):
            if part[j] < NEAR or part[j] > 1 - NEAR:
                part[j] = round(part[j])
        open_ = [j for j in (held, i) if 0 < part[j] < 1]
        held = open_[0] if open_ else -1
    return part


def _round(seed: int, level: int, last: bool):
    def node(key: tuple, rows: pa.Table) -> pa.Table:
        rows = rows.sort_by([("doc_id", "ascending"), ("size", "ascending"), ("block", "ascending")])
        source = key[0].as_py()
        tag = 0 if source is None else zlib.crc32(source.encode()) + 1
        draw = np.random.default_rng([seed, level, tag, key[1].as_py()])
        part = pivot(rows["size"].to_numpy(), rows["part"].to_numpy(), draw)
        if last:
            part = np.where((part > 0) & (part < 1), draw.random(len(part)) < part, part).astype(float)
        return rows.set_column(rows.schema.get_field_index("part"), "part", pa.array(part))

    return node


def mix(docs: DataFrame, weights: list[float] = (5, 2, 1), share: float = 1.0, most: int = 3, seed: int = 17, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """doc_id, source, size, source_size, target, copies and taken (size * copies) of each row."""
    spark = docs.sparkSession
    bound_arrow(spark)
    said = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("source").cast("string").alias("source"), word_count(F.col("text")).alias("size"))
    sized = Written(said.groupBy("source", "doc_id", "size").agg(F.count("*").alias("rows")), "sizes")
    sums = sized.df.groupBy("source").agg(F.sum(F.col("size") * F.col("rows")).alias("words"), F.sum("rows").alias("rows"))
    rate = F.when(F.col("words") > 0, F.col("target") / F.col("words")).otherwise(0.0)
    plan = targets(sums, list(weights), share, most).select(
        F.col("source").alias("of"), F.col("words").alias("source_size"), "target", rate.alias("rate"), F.greatest(F.ceil(F.col("rows") / block_rows), F.lit(1)).alias("blocks")
    )
    plan = Written(plan, "mix-plan")
    most_blocks = plan.df.agg(F.max("blocks")).first()[0] or 1
    plan = plan.df
    # Equal rows are dealt in pieces, each piece by a task, and get a turn each.
    pieces = sized.df.withColumn("piece", F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor((F.col("rows") - 1) / PIECE))))
    pieces = pieces.repartition("source", "doc_id", "size", "piece") if sized.df.where(F.col("rows") > PIECE).limit(1).count() else pieces
    held = F.least(F.col("rows") - F.col("piece") * PIECE, F.lit(PIECE))
    each = pieces.select("source", "doc_id", "size", F.explode(F.sequence(F.col("piece") * PIECE, F.col("piece") * PIECE + held - 1)).alias("turn"))
    each = each.join(plan, F.col("source").eqNullSafe(F.col("of")))
    block = F.pmod(F.xxhash64("doc_id", "size", "turn", F.lit(seed)), F.col("blocks")).alias("block")
    whole = F.least(F.floor(F.col("rate") + NEAR), F.lit(most)).cast("bigint")
    part = F.when(F.col("size") > 0, F.greatest(F.col("rate") - whole, F.lit(0.0))).otherwise(0.0)
    start = each.select("source", block, "doc_id", "size", whole.alias("whole"), part.alias("part"))

    level, decided = 0, []
    while True:
        last = most_blocks <= 1
        out = Written(start.groupBy("source", "block").applyInArrow(_round(seed, level, last), _LEFT), f"mix{level}")
        undecided = (F.col("part") > 0) & (F.col("part") < 1)
        decided.append(out.df if last else out.df.where(~undecided))
        if last:
            break
        start = out.df.where(undecided).withColumn("block", F.floor(F.col("block") / FAN_IN).cast("bigint"))
        most_blocks, level = -(-most_blocks // FAN_IN), level + 1
    every = decided[0]
    for more in decided[1:]:
        every = every.unionByName(more)
    copies = (F.col("whole") + F.col("part")).cast("bigint")
    return every.join(plan, F.col("source").eqNullSafe(F.col("of"))).select(
        "doc_id", "source", "size", "source_size", "target", copies.alias("copies"), (F.col("size") * copies).cast("bigint").alias("taken")
    )
