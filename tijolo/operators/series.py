"""Series tables: resampling, keyed updates, catalogue attributes and fallbacks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KEY = ["source", "code", "date"]


def monthly(df: DataFrame, keys: list[str], date: str, value: str, method: str = "last", seq: str = "seq") -> DataFrame:
    """One value a month: mean, sum, or the last by date and sequence (any other method)."""
    agg = {"mean": F.avg(value), "sum": F.sum(value)}.get(method, F.max_by(value, F.struct(date, seq)))
    return df.groupBy(*keys, F.trunc(F.col(date).cast("date"), "month").alias("month")).agg(agg.alias("value"))


def ingest(rows: DataFrame, catalogue: DataFrame, seq: str = "seq") -> DataFrame:
    """source, code, name, month (ISO text), value, unit, frequency: monthly values of all active series of the catalogue, each
    resampled by its own method. A series that has no rows under its code takes those of its first fallback code that has
    some, and is listed under the code that was used; months are of the frequency M, other attributes those of the catalogue."""
    active = catalogue.where(F.coalesce("active", F.lit(True)))
    tried = active.select("source", "code", F.concat(F.array("code"), F.coalesce("fallbacks", F.expr("cast(array() as array<string>)"))).alias("codes"))
    used = first_found(tried, ["source", "code"], rows.groupBy("source", F.col("code").alias("found")).agg(F.count(F.lit(1)).alias("n")), "source")
    months = rows.groupBy("source", F.col("code").alias("found"), F.trunc(F.col("date").cast("date"), "month").alias("month")).agg(
        F.avg("value").alias("mean"), F.sum("value").alias("sum"), F.max_by("value", F.struct("date", seq)).alias("last"))
    value = F.when(F.col("method") == "mean", F.col("mean")).when(F.col("method") == "sum", F.col("sum")).otherwise(F.col("last"))
    named = months.join(used, ["source", "found"]).join(active.select("source", "code", "name", "method", "unit"), ["source", "code"])
    return named.select("source", F.col("found").alias("code"), "name", F.col("month").cast("string").alias("month"), value.alias("value"), "unit", F.lit("M").alias("frequency"))


def first_found(candidates: DataFrame, keys: list[str], counts: DataFrame, *shared: str) -> DataFrame:
    """keys, rank, found and n: the first of each key's `codes` that counts (found, n, and the shared columns) has."""
    ranked = candidates.select(*keys, F.posexplode("codes").alias("rank", "found"))
    hits = ranked.join(counts, [*shared, "found"])
    return hits.groupBy(*keys).agg(F.min_by(F.struct("rank", "found", "n"), "rank").alias("h")).select(*keys, "h.*")


def dedup_last(df: DataFrame, keys: list[str], value: str, seq: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.max_by(value, seq).alias(value))


def upsert(stored: DataFrame, batch: DataFrame, seq: str = "seq") -> DataFrame:
    """stored with the batch merged in by KEY: the last row of the batch by `seq` gives the values, and the stored row, else the
    key's first row, the time it was first seen. The caller writes the result beside the old table and swaps paths."""
    both = stored.withColumn(seq, F.lit(-1).cast("long")).unionByName(batch)
    values = [c for c in stored.columns if c not in (*KEY, "seen")]
    return both.groupBy(*KEY).agg(F.max_by(F.struct(*values), seq).alias("_v"), F.min_by("seen", seq).alias("seen")).select(*KEY, *[F.col(f"_v.{c}").alias(c) for c in values], "seen")


def insert_if_absent(stored: DataFrame, batch: DataFrame, keys: list[str]) -> DataFrame:
    return stored.unionByName(batch.dropDuplicates(keys).join(stored, keys, "left_anti"))


def with_catalogue(rows: DataFrame, catalogue: DataFrame) -> DataFrame:
    """rows with the attributes of their active series. A catalogue is a short list by nature; the join is left to the planner."""
    return rows.join(catalogue.where(F.coalesce("active", F.lit(True))).drop("active"), "code")


def fallback(candidates: DataFrame, rows: DataFrame) -> DataFrame:
    """Rows of the first candidate of each series that has any; candidates: series and codes in order of preference.
    Candidates meet the number of rows of each code; the rows themselves are joined to the chosen codes only."""
    counts = rows.groupBy(F.col("code").alias("found")).agg(F.count(F.lit(1)).alias("n"))
    best = first_found(candidates, ["series"], counts).drop("n")
    return rows.join(best.withColumnRenamed("found", "code"), "code")


def fallback_counts(candidates: DataFrame, rows: DataFrame) -> DataFrame:
    """series, rank, code and number of rows of the first candidate of each series that has any."""
    counts = rows.groupBy(F.col("code").alias("found")).agg(F.count(F.lit(1)).alias("n"))
    return first_found(candidates, ["series"], counts).withColumnRenamed("found", "code")


def pivot_mean(df: DataFrame, names: list[str]) -> DataFrame:
    return df.where(F.col("series").isNotNull()).groupBy("month").pivot("series", names).agg(F.avg("value"))


def names_found(df: DataFrame) -> list[str]:
    """Names of the series that have a value, in order; they become columns, so they are few."""
    return sorted(r["series"] for r in df.where(F.col("series").isNotNull() & F.col("value").isNotNull()).select("series").distinct().collect())


def pivot_found(df: DataFrame, require_rows: bool = False) -> DataFrame:
    """Means by month and series, a column for each series that has a value. With `require_rows`, no such series is an error."""
    names = names_found(df)
    if require_rows and not names:
        raise ValueError("no series has a value")
    return pivot_mean(df, names) if names else df.select("month").distinct()


def join_months(left: DataFrame, right: DataFrame, require_rows: bool = False) -> DataFrame:
    """Two wide tables by month. With `require_rows`, months that have nothing in common are an error."""
    both = left.join(right, "month")
    if require_rows and both.isEmpty():
        raise ValueError("the tables have no month in common")
    return both


def latest(df: DataFrame, key: str, order: list[str]) -> DataFrame:
    """The last row of each key by the order columns, and beside it the greatest value of the first of them over all keys."""
    last = df.groupBy(key).agg(F.max(F.struct(*order)).alias("last"))
    overall = df.agg(F.max(order[0]).alias(f"overall_{order[0]}"))  # one row
    return last.select(key, *[F.col(f"last.{c}").alias(f"last_{c}") for c in order]).crossJoin(F.broadcast(overall))


def coverage(df: DataFrame, by: list[str], date: str) -> DataFrame:
    return df.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.min(date).alias("first"), F.max(date).alias("last"))


