"""Small helpers that the operators of this folder share."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share; a temporary one where none is named and all run on one machine (tests)."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not folder:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir names no folder, and a cluster's machines share no other")
        folder = tempfile.mkdtemp(prefix="tijolo-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage: write df as Parquet to the shared folder and read it again.
    A lost executor then costs a re-read, not a recomputation."""
    path = fresh_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def size_in_bytes(text: Column) -> Column:
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long")


def partitions(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


#: Rows and bytes of an Arrow batch where rows are whole texts, unless the session says otherwise: Python workers hold a batch at a time.
_ARROW = "spark.sql.execution.arrow."
BATCHES = {f"{_ARROW}maxRecordsPerBatch": ("10000", "1000"), f"{_ARROW}maxBytesPerBatch": ("67108864b", "16m")}  # Spark's default, ours


def small_batches(spark: SparkSession) -> None:
    for key, (default, ours) in BATCHES.items():
        if spark.conf.get(key) == default:
            spark.conf.set(key, ours)


def numbered(df: DataFrame, by: list[str], order: list[str], name: str) -> DataFrame:
    """df with `nth`, its place from 0 among the rows of equal `by` (null is a value) in ascending `order`, nulls first, and
    `of`, the number of those rows. Rows that are equal in `by` and `order` get places in any order, fixed by then.

    Rows are sorted over ranges of (by, order), so that a group is cut wherever it is large, and written; of each range
    only its number of rows in each group is added up. A group's sums meet in one task: one row for each range that it is in.
    """
    spark, n = df.sparkSession, partitions(df.sparkSession)
    keys = [F.col(c).asc_nulls_first() for c in (*by, *order)]
    rows = df.repartitionByRange(n, *keys).sortWithinPartitions(*keys).withColumn("_at", F.monotonically_increasing_id())
    rows = written(rows, name).withColumn("_range", F.shiftright("_at", 33))
    # one window a group; all rows are one group where `by` names none
    ranges = rows.groupBy(*by, "_range").agg(F.count(F.lit(1)).alias("_n"), F.min("_at").alias("_first"))
    group = Window.partitionBy(*[F.col(c) for c in by]) if by else Window.partitionBy(F.lit(0))
    before = group.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    ranges = ranges.select(
        *[F.col(c).alias(f"_by{i}") for i, c in enumerate(by)], F.col("_range").alias("_in"), "_first",
        F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"), F.sum("_n").over(group).alias("of"))
    same = [F.col(c).eqNullSafe(F.col(f"_by{i}")) for i, c in enumerate(by)]
    found = rows.join(ranges, [*same, F.col("_range") == F.col("_in")])
    return found.select(*df.columns, (F.col("_at") - F.col("_first") + F.col("_before")).alias("nth"), F.col("of").cast("long"))


def bucketed(df: DataFrame, key: str, name: str) -> DataFrame:
    """df written to the shared folder in buckets of `key`, so that rows of equal keys meet those of another table without being
    shuffled again. The catalogue only lends its name while the plan is resolved; the files stay in the shared folder."""
    spark, table_name = df.sparkSession, f"{name.replace('-', '_')}_{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").bucketBy(partitions(spark), key).option("path", fresh_path(spark, name)).saveAsTable(table_name)
    found = spark.table(table_name)
    spark.sql(f"DROP TABLE {table_name}")
    return found
