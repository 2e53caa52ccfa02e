"""The corpus pipeline: five stages over `documents`, each written as Parquet and read again as the next one's input.

Documents that the toxicity lexicon rejects go; of each group of near duplicates (shingles of five words, a Jaccard
similarity of 0.8 or more) the smallest doc_id stays; documents that hold benchmark items go; sources are mixed to their
target weights, so a row appears as often as the mix takes it; rows are dealt to shards.

All stages take rows with any columns besides doc_id, text and source, whatever they are called, and all but the last give the
same columns back. An empty table gives an empty one. No stage cuts a text, and none brings rows of one key or text to one task
without combining them first.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import op4_mix, op5_shard, op7_toxic, op9_jaccard, op10_decon
from tessera.llm.common import Written, table
from tessera.shared import scratch

THRESHOLD, SHINGLE, PERCENT, SHARDS = 0.7, 5, 80, 24
#: Copies of a row that are written by one task.
COPIES = 1_000


def _row(docs: DataFrame) -> Column:
    """The row with the least hash, whole, so that which row stands for others doesn't depend on their order. Maps have no hash."""
    names = ["`" + f.name.replace("`", "``") + "`" for f in docs.schema.fields if "map<" not in f.dataType.simpleString()]
    return F.min_by(F.struct("*"), F.xxhash64(*names))


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that the lexicon rejects go. Null and empty texts have no hits and stay, as do rows without a doc_id that aren't toxic;
    repeated rows are judged each."""
    return op7_toxic.without(docs, table(spark, sf_dir, "labels"), THRESHOLD)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose doc_id isn't the smallest of their component go, judged by their own text where a doc_id has several; of rows
    equal in doc_id and text the one with the least hash stays. Null and empty texts are linked with nothing; rows without a doc_id
    go only if they repeat."""
    found = op9_jaccard.join(docs, SHINGLE, PERCENT)
    gone = found.where("component_id <> doc_id").select(F.col("doc_id").alias("id"), "tag").distinct()
    once = docs.groupBy(F.col("doc_id").alias("id"), F.xxhash64("text").alias("tag")).agg(_row(docs).alias("row"))
    return once.join(gone, ["id", "tag"], "left_anti").select("row.*")


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose text holds a benchmark item go. Null and empty texts hold none; repeated rows are judged each."""
    return op10_decon.without(docs, table(spark, sf_dir, "benchmark"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each row as often as the mix takes it. Rows equal in doc_id, source and text share their copies, and the one with the least
    hash stands for them. Rows without words take nothing, and stay where their source's words are taken once or more; a null source
    is one of its own, the last."""
    name = F.xxhash64("doc_id", "source", "text")
    mixed = op4_mix.mix(docs.select(name.alias("doc_id"), "text", "source")).groupBy(F.col("doc_id").alias("name")).agg(F.sum("copies").alias("copies"))
    once = docs.groupBy(name.alias("name")).agg(_row(docs).alias("row"))
    told = Written(once.join(mixed.where("copies > 0"), "name").select("row", "copies"), "mixed").df
    each = lambda rows: rows.select(F.explode(F.sequence(F.lit(1).cast("bigint"), "copies")), "row").select("row.*")
    # Rows that are taken very often are cut into pieces first, which many tasks write.
    piece = F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor((F.col("copies") - 1) / COPIES))).alias("piece")
    many = told.where(F.col("copies") > COPIES).select("row", "copies", piece).select("row", "piece", F.least(F.col("copies") - F.col("piece") * COPIES, F.lit(COPIES)).alias("copies"))
    return each(told.where(F.col("copies") <= COPIES)).unionByName(each(many.repartition(F.xxhash64("row.doc_id", "row.text"), "piece")))


def sharding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every row with its shard and slot: doc_id, size, text_crc32, law, shard, slot, grown_shard, and `document`, the row with all
    its columns. Rows without a doc_id share a shard; repeated rows have slots of their own."""
    return op5_shard.shard(docs, SHARDS, carry=True)


STAGES = [("toxicity", toxicity), ("near_duplicates", near_duplicates), ("decontamination", decontamination), ("mixing", mixing), ("sharding", sharding)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows. Tables between stages are in the shared folder."""
    docs, base = table(spark, sf_dir, "documents"), scratch(spark, "pipeline")
    for number, (name, stage) in enumerate(STAGES):
        path = f"{base}/{number}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs


#: Learned scores, verified set similarities and seeded random rounding have no SQL form.
ORACLE_SQL = None
