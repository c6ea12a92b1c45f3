"""A training-data pipeline: five stages, each of which is one operator of tijolo.llm.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which run() writes as Parquet to the
shared folder and reads again as the next stage's docs. All but the last return the columns of docs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window
from pyspark.sql import functions as F

from tijolo.llm import decontamination, language, mixing, near_duplicates, sharding
from tijolo.llm.common import table, written

SHARDS = 8
#: Rows that repeat a document whole are numbered in so many slices.
SLICES = 64


def _packed(docs: DataFrame) -> DataFrame:
    """The text, and all other columns in one, so that no name of theirs meets a name that an operator adds."""
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != "text"]).alias("doc"), "text")


def _unpacked(packed: DataFrame, docs: DataFrame) -> DataFrame:
    return packed.select(*[F.col("text") if c == "text" else F.col("doc")[c].alias(c) for c in docs.columns])


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that language identification rejects: no letters, or far from every learned language."""
    model = language.fit(docs)
    return _unpacked(language.identify(_packed(docs), model).where(~F.col("rejected")), docs)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, the one with the smallest id; of rows that repeat an id and a text, one."""
    kept = near_duplicates.near_duplicates(docs).where("kept").select(F.col("doc_id").alias("kept")).distinct()
    rows = _packed(docs)
    found = rows.join(kept, F.col("doc.doc_id").eqNullSafe(F.col("kept")), "left_semi")
    found = found.withColumns({"id": F.col("doc.doc_id"), "hash": F.xxhash64("text"), "missing": F.col("text").isNull()})
    return _unpacked(found.dropDuplicates(["id", "hash", "missing"]), docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that hold a window of a benchmark item."""
    return _unpacked(decontamination.decontaminate(_packed(docs), table(spark, sf_dir, "benchmark")), docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it: not at all, once or twice. Rows that repeat id, source and text share
    what the mix takes of them, as evenly as whole copies can."""
    key = ["id", "no_id", "source", "no_source", "tie"]

    def keys(doc_id: Column, source: Column, tie: Column) -> list[Column]:
        """Without nulls, so that rows are dealt by their keys once."""
        return [
            F.coalesce(doc_id.cast("string"), F.lit("")).alias("id"), doc_id.isNull().alias("no_id"),
            F.coalesce(source.cast("string"), F.lit("")).alias("source"), source.isNull().alias("no_source"), tie.alias("tie"),
        ]

    taken = mixing.mix(docs).select(*keys(F.col("doc_id"), F.col("source"), F.col("tie")), "copies")
    taken = written(taken.groupBy(key).agg(F.sum("copies").alias("copies"), F.count(F.lit(1)).alias("n")).where("copies > 0"), "mix-taken")
    rows = _packed(docs)
    rows = rows.select("doc", "text", *keys(F.col("doc.doc_id"), F.col("doc.source"), F.xxhash64("doc.doc_id", "text")))
    found = rows.join(taken.where("n = 1"), key).select("doc", "text", F.col("copies").alias("times"))
    if not taken.where("n > 1").isEmpty():
        # rows of one key are numbered slice by slice, as one key may hold a third of all rows
        again = rows.join(taken.where("n > 1"), key).withColumn("slice", F.pmod(F.monotonically_increasing_id(), F.lit(SLICES)))
        again = written(again, "mix-repeated")
        before = Window.partitionBy(key).orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
        slices = again.groupBy(*key, "slice").agg(F.count(F.lit(1)).alias("in_slice"))
        slices = slices.select(*key, "slice", F.coalesce(F.sum("in_slice").over(before), F.lit(0)).alias("offset"))
        nth = F.row_number().over(Window.partitionBy(*key, "slice").orderBy(F.lit(0)))
        again = again.withColumn("nth", nth).join(slices, [*key, "slice"])
        more = F.when(F.col("offset") + F.col("nth") <= F.col("copies") % F.col("n"), 1).otherwise(0)
        found = found.unionByName(again.select("doc", "text", (F.floor(F.col("copies") / F.col("n")) + more).alias("times")))
    found = found.withColumn("copy", F.explode(F.array_repeat(F.lit(True), F.col("times").cast("int"))))
    return _unpacked(found, docs)


def deal_shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Shard and slot of each remaining document."""
    return sharding.shard(docs, SHARDS)


STAGES = [
    ("language", identify_language),
    ("near_dedup", drop_near_duplicates),
    ("decontamination", decontaminate),
    ("mixing", mix_sources),
    ("sharding", deal_shards),
]

#: The first two stages, and the tilts of the fourth, have no SQL; tests/llm compares run() with brute force, but for what the fitted
#: language model rejects, which it takes from the operator.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
