"""Sharding: jump consistent hashing maps stable keys to shards without a ring table. Native: DataFrame functions only.

A shard is a pure function of the key and the shard count, so a lost executor, a rerun or another partitioning of the
input changes nothing. Slots number the rows of a shard without one task seeing the whole shard: what is to be dealt is written
once with the block that each row stands in, a run of BLOCK_ROWS rows of the input; rows are counted by (shard, block), the
counts of a shard's blocks are added up, and each block numbers its own rows. So neither a hot shard nor a key on a third of
all rows fills a task.

Defined results. Keys are hashed as text, so a key's type doesn't matter. A null key is a key of its own, so all null keys share
a shard. Null and empty texts have 0 bytes, so size 8 and the crc32 of no bytes (0); the longest texts are only measured. Rows
that repeat a key get the same shard and slots of their own, in no promised order among themselves: slots follow the input's order, and ties with it. An empty table gives an
empty result; other columns of the input are ignored, so names can't clash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Written

#: Rows of the input that are numbered in one task at most.
BLOCK_ROWS = 32_768
#: Steps that every key takes; 24 shards need 16 of them with a chance of about one in a million.
SHORT = 16


def jump_hash(key: Column, shards: int) -> Column:
    """The shard (int, 0 to shards - 1) of a key.

    Step i of a key jumps from bucket b to floor((b + 1) / r) with r in (0, 1] drawn from the key and i, until that leaves
    the range. Buckets grow strictly, so `shards` steps are enough for certain, and about ln(shards) of them do something:
    SHORT steps are taken for every key, and the rest for those few that are still in range.
    """
    if shards < 1:
        raise ValueError("there must be a shard")
    named = F.coalesce(key.cast("string"), F.lit(""))
    start = F.struct(F.lit(0).cast("bigint").alias("b"), F.lit(0).cast("bigint").alias("j"))

    def step(state: Column, i: Column) -> Column:
        bits = F.shiftrightunsigned(F.xxhash64(named, i), 33)  # 31 bits, as in the published algorithm
        ahead = F.floor((state["j"] + 1) * F.lit(2147483648.0) / (bits + 1)).cast("bigint")
        on = state["j"] < shards
        return F.struct(F.when(on, state["j"]).otherwise(state["b"]).alias("b"), F.when(on, ahead).otherwise(state["j"]).alias("j"))

    short = min(shards, SHORT)
    walked = F.aggregate(F.sequence(F.lit(0), F.lit(short)), start, step)
    if short < shards:
        long = lambda state: F.aggregate(F.sequence(F.lit(short + 1), F.lit(shards)), state, step)
        walked = F.get(F.transform(F.array(walked), lambda state: F.when(state["j"] < shards, long(state)).otherwise(state)), F.lit(0))
    return walked["b"].cast("int")


def shard(docs: DataFrame, shards: int = 24, key: str = "doc_id", text: str = "text", block_rows: int = BLOCK_ROWS, carry: bool = False) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot and grown_shard (with one shard more) of each row; with `carry` also `document`, the row itself."""
    body = F.encode(F.coalesce(F.col(text), F.lit("")), "UTF-8")
    own = [F.struct("*").alias("document")] if carry else []
    rows = docs.select(F.col(key).alias("doc_id"), (F.octet_length(body) + 8).cast("bigint").alias("size"), F.crc32(body).alias("text_crc32"), *own)
    where = [jump_hash(F.col("doc_id"), shards).alias("shard"), jump_hash(F.col("doc_id"), shards + 1).alias("grown_shard"), F.monotonically_increasing_id().alias("nth")]
    rows = Written(rows.select("*", *where), "shard-rows").df.withColumn("block", F.floor(F.col("nth") / block_rows))
    before = Window.partitionBy("shard").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    held = rows.groupBy("shard", "block").agg(F.count("*").alias("held"))
    first = held.select("shard", "block", F.coalesce(F.sum("held").over(before), F.lit(0)).alias("first"))
    within = F.row_number().over(Window.partitionBy("shard", "block").orderBy("nth")) - 1
    numbered = rows.withColumn("within", within).join(first, ["shard", "block"])
    return numbered.select(
        "doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", (F.col("first") + F.col("within")).cast("bigint").alias("slot"), "grown_shard", *(["document"] if carry else [])
    )
