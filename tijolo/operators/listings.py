"""Raw listings into typed, deduplicated, valid rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from tijolo.functions import text as T

KEY = ["address", "price", "area"]


def typed(raw: DataFrame) -> DataFrame:
    return raw.select(
        "id", "address", T.clean_price(F.col("price_text")).alias("price"), T.extract_number(F.col("area_text")).alias("area"),
        *[T.extract_number(F.col(f"{c}_text")).cast("int").alias(c) for c in ("rooms", "baths", "parking")],
    )


def dedup_first(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    """One row for each key, nulls being equal: the first by `order`, which is unique in a key. Aggregates on the map side, by hash
    as long as `order` and the other columns are numbers."""
    rest = [c for c in df.columns if c not in (*keys, order)]
    return df.groupBy(*keys).agg(F.min(order).alias(order), *[F.min_by(c, order).alias(c) for c in rest]).select(*keys, order, *rest)


def clean(raw: DataFrame) -> DataFrame:
    """Valid rows, once each. Validity and kind depend on the key alone: rows are tested before they are dealt out, and kinds are
    found for the rows that stay. inline() keeps the optimizer from evaluating the texts again for the test."""
    rows = typed(raw)
    once = rows.select(F.inline(F.array(F.struct(*rows.columns))))
    valid = once.where(F.col("price").isNotNull() & (F.col("area") > 0))
    out = dedup_first(valid, KEY, "id")
    return out.select(*out.columns, T.classify_kind(F.col("address")).alias("kind"), F.bround(F.col("price") / F.col("area"), 2).alias("unit_price"))


def audit(raw: DataFrame) -> DataFrame:
    """Rows read, repeated, invalid and kept, in one pass over the keys."""
    keys = typed(raw).groupBy(*KEY).agg(F.count(F.lit(1)).alias("n"))
    valid = F.col("price").isNotNull() & F.coalesce(F.col("area") > 0, F.lit(False))
    return keys.agg(
        F.sum("n").alias("rows_read"), F.sum(F.col("n") - 1).alias("rows_repeated"), F.count_if(~valid).alias("rows_invalid"), F.count_if(valid).alias("rows_kept"),
    )


def clean_and_count(raw: DataFrame, path: str) -> tuple[DataFrame, DataFrame]:
    """(clean rows, counts as of `audit`): writes the clean rows and counts what is read, repeated, invalid and kept on the way,
    so that the raw rows are read once. Counting what is invalid once needs invalid rows to be deduplicated too."""
    read, once = Observation(), Observation()
    first = dedup_first(typed(raw).observe(read, F.count(F.lit(1)).alias("n")), KEY, "id")
    valid = F.col("price").isNotNull() & F.coalesce(F.col("area") > 0, F.lit(False))
    out = first.observe(once, F.count(F.lit(1)).alias("n"), F.count_if(valid).alias("kept")).where(valid)
    out = out.select(*out.columns, T.classify_kind(F.col("address")).alias("kind"), F.bround(F.col("price") / F.col("area"), 2).alias("unit_price"))
    out.write.parquet(path)
    n, unique, kept = read.get["n"], once.get["n"], once.get["kept"]
    counts = raw.sparkSession.createDataFrame([(n, n - unique, unique - kept, kept)], "rows_read bigint, rows_repeated bigint, rows_invalid bigint, rows_kept bigint")
    return raw.sparkSession.read.schema(out.schema).parquet(path), counts
