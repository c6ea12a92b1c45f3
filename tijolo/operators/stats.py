"""Descriptive statistics and the numbers behind charts."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from tijolo.sources import scratch

#: Label of all rows, which no class may have.
ALL = "Todos"


def describe_by_kind(df: DataFrame, kind: str, measures: dict[str, str]) -> DataFrame:
    """kind, field, unit, n, mean, median, stddev: over all rows and over each kind; measures: column to unit.

    Rows without a kind count in all rows only, as do rows of a kind that is named like all rows. Medians are exact. A table
    without rows has no kinds, and all rows with n 0 and no values.
    """
    spark = df.sparkSession
    label = F.when(F.col(kind).isNull() | (F.col(kind) == ALL), F.array(F.lit(ALL))).otherwise(F.array(F.lit(ALL), F.col(kind)))
    field = F.array(*[F.struct(F.lit(m).alias("field"), F.col(m).cast("double").alias("v")) for m in measures])
    long = df.select(F.explode(label).alias("kind"), field.alias("fields")).select("kind", F.inline("fields"))
    known = long.groupBy("kind", "field").agg(F.count("v").alias("n"), F.bround(F.avg("v"), 2).alias("mean"), F.bround(F.stddev_samp("v"), 2).alias("stddev"))
    medians = quantiles(long, "v", [0.5], ["kind", "field"]).select("kind", "field", F.bround("q0", 2).alias("median"))
    # all rows have their line even if there are none; measures are a few names
    always = spark.createDataFrame([(ALL, m, u) for m, u in measures.items()], "kind string, field string, unit string")
    units = always.select("field", "unit")
    kinds = known.where(F.col("kind") != ALL).join(units, "field")
    both = always.join(known.where(F.col("kind") == ALL), ["kind", "field"], "left").withColumn("n", F.coalesce("n", F.lit(0).cast("long")))
    out = both.select("kind", "field", "unit", "n", "mean", "stddev").unionByName(kinds.select("kind", "field", "unit", "n", "mean", "stddev"))
    return out.join(medians, ["kind", "field"], "left").select("kind", "field", "unit", "n", "mean", "median", "stddev")


def bars(described: DataFrame, fields: list[str]) -> DataFrame:
    """Means of the fields by kind, by ascending mean of the first field."""
    return described.where(F.col("field").isin(fields)).groupBy("kind").pivot("field", fields).agg(F.first("mean")).orderBy(F.col(fields[0]).asc_nulls_last(), "kind")


def share(df: DataFrame, kind: str) -> DataFrame:
    """Rows of each kind and their percentage of all rows that have one, largest first."""
    counts = df.where(F.col(kind).isNotNull()).groupBy(F.col(kind).alias("kind")).agg(F.count(F.lit(1)).alias("n"))
    total = counts.agg(F.sum("n").alias("total"))
    return counts.crossJoin(F.broadcast(total)).select("kind", "n", F.round(F.lit(100.0).cast("double") * F.col("n") / F.col("total"), 1).alias("percent")).orderBy(F.desc("n"), "kind")


#: A sketch's rank is off by one in so many at most; values that one task puts in order.
ACCURACY, LIMIT = 10_000, 1_000_000


def quantiles(df: DataFrame, value: str, qs: list[float], by: list[str] = (), accuracy: int = ACCURACY, limit: int = LIMIT) -> DataFrame:
    """by, and q0, q1, ...: exact quantiles of the non-null values of each group, interpolated between neighbours.

    A sketch of each group, merged from those of its parts, gives a narrow range around every quantile. Rows are then
    counted: those below a range as one, those inside by value. The counts say whether a range holds the ranks that are
    wanted; if a sketch was off, ranges are widened to everything. So few values are left that they are put in order, group by
    group or, where a range holds more than `limit` different values, over all tasks. No outlier or gap moves rows into one task.
    A group without values has no row.
    """
    keys = [f"_k{i}" for i in range(len(by))] or ["_k0"]  # all rows are one group where `by` names none
    rows = df.where(F.col(value).isNotNull()).select(*[x.alias(k) for x, k in zip(map(F.col, by) if by else [F.lit(0)], keys)], F.col(value).cast("double").alias("_v"))
    near = 2.0 / accuracy
    ends = F.percentile_approx("_v", [x for q in qs for x in (max(0.0, q - near), min(1.0, q + near))], accuracy)
    sketched = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_of"), ends.alias("_ends")).where("_of > 0")
    span = lambda i: F.struct(F.lit(i).alias("_i"), F.lit(float(qs[i])).alias("_q"), F.col("_ends")[2 * i].alias("_lo"), F.col("_ends")[2 * i + 1].alias("_hi"))
    ranges = scratch.written(sketched.select(*keys, "_of", F.inline(F.array(*[span(i) for i in range(len(qs))]))), "ranges")
    cells = scratch.written(_counted(rows, ranges, keys), "cells")
    below, inside = F.sum(F.when(F.col("_v").isNull(), F.col("_n"))), F.sum(F.when(F.col("_v").isNotNull(), F.col("_n")))
    first, last = F.floor(F.col("_q") * (F.col("_of") - 1)), F.ceil(F.col("_q") * (F.col("_of") - 1))
    groups = cells.groupBy(*keys, "_i", "_q", "_of").agg(F.coalesce(below, F.lit(0)).alias("_below"), F.coalesce(inside, F.lit(0)).alias("_inside"), F.count("_v").alias("_values"))
    held = (F.col("_below") <= first) & (last < F.col("_below") + F.col("_inside"))
    seen = groups.agg(F.count_if(held).alias("held"), F.max("_values").alias("values")).first()
    most = seen["values"]
    if seen["held"] < ranges.count():
        everything = ranges.withColumns({"_lo": F.lit(float("-inf")), "_hi": F.lit(float("nan"))})  # NaN is above all values
        cells = scratch.written(_counted(rows, everything, keys), "cells")
        most = cells.groupBy(*keys, "_i").agg(F.count("_v").alias("n")).agg(F.max("n")).first()[0]
    summed = _summed(cells, [*keys, "_i"], (most or 0) > limit)
    at = F.col("_q") * (F.col("_of") - 1)
    value_of = lambda rank: F.min(F.when((F.col("_before") <= rank) & (rank < F.col("_before") + F.col("_n")), F.col("_v")))
    found = summed.groupBy(*keys, "_i", "_q", "_of").agg(value_of(first).alias("_low"), value_of(last).alias("_high"))
    exact = F.when(F.col("_low") == F.col("_high"), F.col("_low")).otherwise(F.col("_low") + (at - F.floor(at)) * (F.col("_high") - F.col("_low")))
    wide = found.groupBy(*keys).agg(*[F.max(F.when(F.col("_i") == i, exact)).alias(f"q{i}") for i in range(len(qs))])
    return wide.select(*[F.col(k).alias(c) for c, k in zip(by, keys)], *[f"q{i}" for i in range(len(qs))])


def _counted(rows: DataFrame, ranges: DataFrame, keys: list[str]) -> DataFrame:
    """Numbers of rows inside each range by value, and of those below it, whose value is null; others are left out."""
    same = F.lit(True)
    named = ranges
    for k in keys:
        named = named.withColumnRenamed(k, f"{k}r")
        same = same & F.col(k).eqNullSafe(F.col(f"{k}r"))
    # a few rows, one for each group and quantile: the planner broadcasts them by their size, which is known as they are written
    met = rows.join(named, same)
    kept = met.where(F.col("_v") <= F.col("_hi")).withColumn("_v", F.when(F.col("_v") >= F.col("_lo"), F.col("_v")))
    return kept.groupBy(*keys, "_i", "_q", "_of", "_v").agg(F.count(F.lit(1)).alias("_n"))


def _summed(cells: DataFrame, keys: list[str], large: bool) -> DataFrame:
    """cells with `_before`, the number of rows before each in its group, nulls first."""
    group = Window.partitionBy(*keys).orderBy("_v")
    if not large:
        return cells.withColumn("_before", F.sum("_n").over(group) - F.col("_n"))
    # sorted over all tasks: within a range of the sort, and over the sums of the ranges
    n = int(cells.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    part = cells.repartitionByRange(n, *keys, "_v").withColumn("_part", F.spark_partition_id())
    part = scratch.written(part, "sorted")
    inside = Window.partitionBy(*keys, "_part").orderBy("_v")
    sums = part.groupBy(*keys, "_part").agg(F.sum("_n").alias("_s"))
    earlier = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(*[F.col(k).alias(f"{k}s") for k in keys], F.col("_part").alias("_parts"), F.coalesce(F.sum("_s").over(earlier), F.lit(0)).alias("_earlier"))
    placed = part.withColumn("_before", F.sum("_n").over(inside) - F.col("_n"))
    same = F.col("_part") == F.col("_parts")
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"{k}s"))
    return placed.join(sums, same).withColumn("_before", F.col("_before") + F.col("_earlier"))


def below_quantile(df: DataFrame, columns: list[str], q: float = 0.95) -> DataFrame:
    """Rows strictly below the q quantile of every column; quantiles are of all rows. A column without values keeps no row.

    All columns are measured in one go, and their few quantiles become literals, which reach the scan as filters.
    """
    long = df.select(F.inline(F.array(*[F.struct(F.lit(i).alias("_c"), F.col(c).cast("double").alias("_value")) for i, c in enumerate(columns)])))
    ends = {r["_c"]: r["q0"] for r in quantiles(long, "_value", [q], ["_c"]).collect()}  # one row a column
    kept = df
    for i, c in enumerate(columns):
        kept = kept.where(F.col(c) < F.lit(ends.get(i)).cast("double"))
    return kept


def _fenced(df: DataFrame, kind: str, value: str) -> DataFrame:
    """df's rows with q0, q1, q2 of their kind and the ends of 1.5 interquartile ranges around."""
    q = quantiles(df.where(F.col(kind).isNotNull()), value, [0.25, 0.5, 0.75], [kind])
    reach = 1.5 * (F.col("q2") - F.col("q0"))
    return df.join(q, kind).withColumns({"_low": F.col("q0") - reach, "_high": F.col("q2") + reach})


def box(df: DataFrame, kind: str, value: str) -> DataFrame:
    """Quartiles, whiskers at 1.5 interquartile ranges and number of outliers, by kind and ascending median."""
    inside = F.col(value).between(F.col("_low"), F.col("_high"))
    return _fenced(df, kind, value).groupBy(F.col(kind).alias("kind")).agg(
        *[F.round(F.first(c), 6).alias(n) for c, n in (("q0", "q1"), ("q1", "median"), ("q2", "q3"))],
        F.min(F.when(inside, F.col(value))).alias("low"), F.max(F.when(inside, F.col(value))).alias("high"), F.count_if(~inside).alias("outliers")).orderBy("median", "kind")


def outliers(df: DataFrame, kind: str, value: str) -> DataFrame:
    """df's rows outside the whiskers of their kind."""
    return _fenced(df, kind, value).where(~F.col(value).between(F.col("_low"), F.col("_high"))).select(df.columns)


def histogram(df: DataFrame, value: str, bins: int = 30) -> DataFrame:
    """Rows in each of the equal-width bins, empty ones included and the last one closed; a constant column is in the first."""
    ends = df.agg(F.min(value).alias("lo"), F.max(value).alias("hi"))
    width = F.when(F.col("hi") > F.col("lo"), (F.col("hi") - F.col("lo")) / bins).otherwise(1.0)
    placed = df.where(F.col(value).isNotNull()).crossJoin(F.broadcast(ends)).select(F.least(F.floor((F.col(value) - F.col("lo")) / width), F.lit(bins - 1)).cast("long").alias("bin"))
    counts = placed.groupBy("bin").agg(F.count(F.lit(1)).alias("n"))
    every = df.sparkSession.range(bins).withColumnRenamed("id", "bin")
    return every.join(F.broadcast(counts), "bin", "left").select("bin", F.coalesce("n", F.lit(0)).alias("n")).orderBy("bin")  # counts: one row a bin


#: Series that a block holds, about.
BLOCK = 128


def correlation(left: DataFrame, right: DataFrame, sides: tuple[str, str] = ("left", "right"), block: int = BLOCK) -> DataFrame:
    """series_a, series_b, r: Pearson coefficients of all pairs of series, from long rows (month, series, value) of two tables, over the
    months that both tables have; pairs without a coefficient are null, as are those whose variance is rounding (1e-13 of the square).

    A name that both tables have is two series, named after their sides. Values of a month are averaged first. Series are dealt
    into blocks, and a task gets two blocks, each with all months of its series; months are few by nature. No task or
    message holds more series than that, and the result is never more than its pairs.
    """
    both = left.select("month", "series", "value", F.lit(1).alias("side")).unionByName(right.select("month", "series", "value", F.lit(2).alias("side")))
    means = scratch.written(both.where(F.col("month").isNotNull()).groupBy("month", "side", "series").agg(F.avg("value").alias("v")), "means")
    shared = means.groupBy("month").agg(F.bit_or("side").alias("sides")).where("sides = 3").select("month")
    known = means.where(F.col("v").isNotNull() & F.col("series").isNotNull()).join(shared, "month", "left_semi")
    twice = known.groupBy("series").agg(F.bit_or("side").alias("sides")).where("sides = 3").select("series", F.lit(True).alias("twice"))
    label = F.when(F.col("twice"), F.concat(F.element_at(F.array(*map(F.lit, sides)), F.col("side")), F.lit(": "), F.col("series"))).otherwise(F.col("series"))
    cells = known.join(twice, "series", "left").select("month", label.alias("series"), "v")
    blocks = max(1, -(-cells.select("series").distinct().count() // block))
    packs = cells.groupBy(F.pmod(F.xxhash64("series"), F.lit(blocks)).alias("b")).agg(F.collect_list(F.struct("series", F.col("month").cast("string").alias("month"), "v")).alias("cells"))
    firsts = packs.select(F.col("b").alias("a"), F.explode(F.sequence("b", F.lit(blocks - 1).cast("long"))).alias("b"), F.col("cells").alias("x"))
    seconds = packs.select(F.explode(F.sequence(F.lit(0).cast("long"), "b")).alias("a"), "b", F.col("cells").alias("y"))
    pairs = firsts.join(seconds, ["a", "b"]).select("a", "b", "x", "y").mapInPandas(_pairs_of_blocks, "series_a string, series_b string, r double")
    return pairs.select("series_a", "series_b", F.round("r", 6).alias("r"))


def _matrix(cells, months: dict) -> tuple[list[str], np.ndarray]:
    names: dict[str, int] = {}
    rows = [(names.setdefault(c["series"], len(names)), months[c["month"]], c["v"]) for c in cells]
    out = np.full((len(names), len(months)), np.nan)
    at = np.array([(i, m) for i, m, _ in rows])
    out[at[:, 0], at[:, 1]] = [v for _, _, v in rows]
    return list(names), out


def _pairs_of_blocks(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Coefficients of each series of one block with each of another, in both orders."""
    for pdf in batches:
        for a, b, x, y in zip(pdf["a"], pdf["b"], pdf["x"], pdf["y"]):
            months = {m: i for i, m in enumerate(dict.fromkeys(c["month"] for c in [*x, *y]))}
            (na, va), (nb, vb) = _matrix(x, months), _matrix(y, months)
            r = _coefficients(va, vb)
            yield pd.DataFrame({"series_a": np.repeat(na, len(nb)), "series_b": np.tile(nb, len(na)), "r": r.reshape(-1)})
            if a != b:
                yield pd.DataFrame({"series_a": np.repeat(nb, len(na)), "series_b": np.tile(na, len(nb)), "r": r.T.reshape(-1)})


def _coefficients(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Of the rows of x with those of y over the columns that both have, from co-moments about each row's first value."""
    def about(v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        there = ~np.isnan(v)
        first = np.take_along_axis(v, there.argmax(axis=1)[:, None], axis=1)
        return np.where(there, v - first, 0.0), there.astype(float)

    (x, mx), (y, my) = about(x), about(y)
    with np.errstate(divide="ignore", invalid="ignore"):
        n = mx @ my.T
        ex, ey, exx, eyy = (x @ my.T) / n, (mx @ y.T) / n, (x**2 @ my.T) / n, (mx @ (y**2).T) / n
        vx, vy = exx - ex**2, eyy - ey**2
        r = ((x @ y.T) / n - ex * ey) / np.sqrt(vx * vy)
        return np.where((vx > 1e-13 * exx) & (vy > 1e-13 * eyy), np.clip(r, -1, 1), np.nan)
