"""Operator 4: jump consistent hashing, in DataFrame functions only.

A stable key starts a pseudo-random sequence; each draw says at which later
shard count the key would next move. The last position below the shard count
is the key's shard, so no ring table is kept, and one more shard takes about
1/(n+1) of the keys and moves no other key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from tijolo.llm.common import size_in_bytes, table

#: Rows of a shard are numbered in this many slices at once.
SLICES = 256
_UNIT = float(2**53)


def jump_hash(key: Column, shards: int) -> Column:
    """Shard of `key` among `shards` (at least 1). A null key counts as a key of its own.

    The draw before position b is a 53-bit fraction of xxhash64(key, b); the next position is
    floor((b + 1) / (1 - fraction)). Positions only grow, so at most `shards` steps are folded.
    """
    if shards < 1:
        raise ValueError("at least one shard is needed")

    def step(state: Column, _: Column) -> Column:
        draw = F.shiftrightunsigned(F.xxhash64(state["key"], state["next"]), 11).cast("double") / F.lit(_UNIT)
        further = F.least(F.floor((state["next"] + 1) / (1 - draw)), F.lit(shards).cast("long"))
        return F.when(state["next"] >= shards, state).otherwise(
            F.struct(state["key"].alias("key"), state["next"].alias("at"), further.alias("next"))
        )

    start = F.struct(F.xxhash64(key).alias("key"), F.lit(0).cast("long").alias("at"), F.lit(0).cast("long").alias("next"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(shards)), start, step, lambda s: s["at"].cast("int"))


def shard(docs: DataFrame, shards: int, key: str = "doc_id", text: str = "text", slices: int = SLICES) -> DataFrame:
    """Adds size, text_crc32, law, shard, slot and grown_shard to the key; other columns are dropped.

    size is the text's UTF-8 bytes plus 1; slots number a shard's rows from 0 without gaps.
    Null or empty text has size 1 and the checksum of no bytes, 0. Repeated rows each get a slot;
    equal keys share a shard. An empty table gives an empty result. Rows are numbered inside
    (shard, slice) windows, so that a shard never meets in one task; only shards * slices counts
    are then summed and broadcast. Rows of one key, size and checksum are alike and share a slice;
    a window only streams over them.
    """
    rows = docs.select(
        F.col(key).alias("doc_id"),
        (size_in_bytes(F.col(text)) + 1).alias("size"),
        F.crc32(F.coalesce(F.col(text), F.lit("")).cast("binary")).cast("long").alias("text_crc32"),
        F.lit("key").alias("law"),
        jump_hash(F.col(key), shards).alias("shard"),
        jump_hash(F.col(key), shards + 1).alias("grown_shard"),
    ).withColumn("slice", F.pmod(F.xxhash64("doc_id", "size", "text_crc32"), F.lit(slices)).cast("int"))
    counts = rows.groupBy("shard", "slice").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("shard").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("shard", "slice", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    inside = Window.partitionBy("shard", "slice").orderBy("doc_id", "size", "text_crc32")
    return (
        rows.withColumn("nth", F.row_number().over(inside) - 1)
        .join(F.broadcast(offsets), ["shard", "slice"])  # shards * slices rows of three numbers
        .select("doc_id", "size", "text_crc32", "law", "shard", (F.col("offset") + F.col("nth")).cast("long").alias("slot"), "grown_shard")
    )


def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard(table(spark, sf_dir, "documents"), 8)
