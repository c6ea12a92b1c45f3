"""Which pages were collected, which are missing and which come next."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tijolo.functions.text import is_missing


def page_coverage(rows: DataFrame, by: list[str], page: str) -> DataFrame:
    """First and last page, number of pages and whether they run from 1 without a gap."""
    out = rows.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.min(page).alias("first_page"), F.max(page).alias("last_page"), F.countDistinct(page).alias("pages"))
    return out.withColumn("status", F.when((F.col("first_page") == 1) & (F.col("last_page") == F.col("pages")), "contiguous").otherwise("with gaps"))


def gap_pages(rows: DataFrame, by: list[str], page: str) -> DataFrame:
    """Pages from 1 to the last one seen that are not there."""
    due = rows.groupBy(*by).agg(F.max(page).alias("_last")).select(*by, F.explode(F.sequence(F.lit(1), F.col("_last"))).alias(page))
    return due.join(rows.select(*by, page).distinct(), [*by, page], "left_anti")


def frontier(grid: DataFrame, progress: DataFrame, empty: DataFrame, pages: int = 400) -> DataFrame:
    """(segment, page, url) still to be collected: all pages of the grid but those collected and those behind a segment's first empty one."""
    first_empty = empty.groupBy("segment").agg(F.min("page").alias("end"))
    due = grid.select("segment", "slug", F.explode(F.sequence(F.lit(1), F.lit(pages))).alias("page"))
    open_ = due.join(first_empty, "segment", "left").where(F.col("end").isNull() | (F.col("page") < F.col("end")))
    return open_.join(progress, ["segment", "page"], "left_anti").select("segment", "page", F.format_string("https://listings.example/%s?page=%d", "slug", "page").alias("url"))


def fill_rate(rows: DataFrame, by: str, columns: list[str]) -> DataFrame:
    return rows.groupBy(by).agg(*[F.round(F.lit(100.0).cast("double") * F.count_if(~is_missing(F.col(c))) / F.count(F.lit(1)), 2).alias(f"{c}_filled") for c in columns])


def missing_counts(rows: DataFrame, columns: list[str]) -> DataFrame:
    return rows.agg(F.count(F.lit(1)).alias("n"), *[F.count_if(is_missing(F.col(c))).alias(f"{c}_missing") for c in columns])


#: Logarithm of a sketch's registers. The relative standard error is 1.04 / sqrt(2 ** LG_K), 0.8 %.
LG_K = 14


def distinct_sketches(rows: DataFrame, by: list[str], key: Column, lg_k: int = LG_K) -> DataFrame:
    """by, n and sketch: rows, and a sketch of the different keys, of each group. To be stored: later groups are merged with it, and
    rows are not read again. Null keys are not counted."""
    return rows.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.hll_sketch_agg(key, lg_k).alias("sketch"))


def merge_sketches(sketches: DataFrame, by: list[str] = ()) -> DataFrame:
    """by, n, different and repeated: estimates out of the merged sketches of each group, or of all."""
    merged = sketches.groupBy(*by).agg(F.sum("n").alias("n"), F.hll_sketch_estimate(F.hll_union_agg("sketch")).alias("different"))
    return merged.withColumn("repeated", F.greatest(F.col("n") - F.col("different"), F.lit(0)))
