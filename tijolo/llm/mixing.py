"""Operator 8: entropy balancing of sources to token targets, in DataFrame functions only.

Among all document rates between 0 and `most`, take those nearest to 1 in relative entropy whose
tokens sum to each source's target. The solution tilts documents exponentially in their token
count, rate = min(most, exp(tilt * tokens / mean tokens)), and the dual, one tilt a source, is
solved by Newton steps whose gradient and curvature are sums over the documents. As the rate
depends on nothing but source and token count, those sums run over the (source, size) histogram,
which is exact and much smaller than the table. Rates are then rounded into whole copies, cell by
cell of the histogram, so that each source's tokens land within a small document of its target.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from tijolo.llm.common import table, written

#: The mix of the query: source weights in turn, share of all tokens, most copies of a document.
WEIGHTS, SHARE, MOST = (5.0, 2.0, 1.0), 1.5, 2
#: Newton steps at most; they end as soon as every gradient is below TOLERANCE of its target.
STEPS, TOLERANCE = 40, 1e-9
#: Largest exponent of a tilt, and slices in which the rows of a cell are numbered.
HIGHEST, SLICES = 700.0, 64


def count_words(text: Column) -> Column:
    """Number of [^\\x20\\x09-\\x0D]+ in a text; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit("[^\\x20\\x09-\\x0D]+")), F.lit(0)).cast("long")


def targets(sources: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """Adds `target` to (source, source_size): weights are dealt in turn to the sources by code point, null last.

    A target stops at `most` times its source and the excess is shared again by weight. At the end
    every target is min(most * size, c * weight) for one c, found by sorting sources by size / weight.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    everything = Window.partitionBy()
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod(F.row_number().over(by_name) - 1, F.lit(len(weights))) + 1).cast("int"))
    ranked = sources.withColumn("weight", weight).withColumns({
        "most": F.col("source_size") * F.lit(float(most)), "all": F.sum("source_size").over(everything) * F.lit(float(share))
    })
    order = Window.orderBy((F.col("most") / F.col("weight")).asc(), F.col("source").asc_nulls_last())
    done = order.rowsBetween(Window.unboundedPreceding, -1)
    left = order.rowsBetween(0, Window.unboundedFollowing)
    levels = ranked.withColumn("level", (F.col("all") - F.coalesce(F.sum("most").over(done), F.lit(0.0))) / F.sum("weight").over(left))
    level = F.max(F.when(F.col("level") * F.col("weight") <= F.col("most"), F.col("level"))).over(everything)
    return levels.withColumn("c", level).select(
        "source", "source_size", F.when(F.col("c").isNull(), F.col("most")).otherwise(F.least("most", F.col("c") * F.col("weight"))).alias("target")
    )


def balance(cells: DataFrame, goals: DataFrame, most: int = MOST) -> DataFrame:
    """(source, target, mean, tilt) from the histogram (source, size, n). Each step is one aggregate over the
    cells; what comes to the driver is one number, the worst gradient. Steps that leave the bracket known to
    hold the root are replaced by its middle. A target at the cap has tilt HIGHEST, one of 0 has -HIGHEST."""
    means = cells.groupBy("source").agg((F.sum(F.col("size") * F.col("n")) / F.sum("n")).alias("mean"))
    means = means.withColumn("mean", F.when(F.col("mean") > 0, F.col("mean")).otherwise(1.0))
    state = goals.join(means, goals["source"].eqNullSafe(means["source"])).select(
        goals["source"], "source_size", "target", "mean", F.lit(0.0).alias("tilt"), F.lit(-HIGHEST).alias("low"), F.lit(HIGHEST).alias("high"),
    )
    state = written(state.withColumn("tilt", F.when(F.col("target") >= most * F.col("source_size"), HIGHEST).when(F.col("target") <= 0, -HIGHEST).otherwise(F.col("tilt"))), "mix-state")
    for _ in range(STEPS):
        tokens = F.col("size") * F.col("n")
        power = F.col("tilt") * F.col("size") / F.col("mean")
        rate = F.when(power >= F.lit(float(most)).cast("double"), F.lit(float(most))).otherwise(F.least(F.lit(float(most)), F.exp(power)))
        sums = (
            cells.join(state.select(F.col("source").alias("of"), "tilt", "mean"), F.col("source").eqNullSafe(F.col("of")))
            .groupBy("source")
            .agg(
                F.sum(tokens * rate).alias("reached"),
                F.sum(F.when(rate < most, tokens * rate * F.col("size") / F.col("mean")).otherwise(0.0)).alias("slope"),
            )
            .withColumnRenamed("source", "of")
        )
        gap = F.col("reached") - F.col("target")
        settled = (F.abs(gap) <= TOLERANCE * F.greatest(F.col("target"), F.lit(1.0))) | (F.abs("tilt") >= HIGHEST)
        moved = state.join(sums, F.col("source").eqNullSafe(F.col("of"))).withColumns({
            "low": F.when(gap < 0, F.greatest("low", "tilt")).otherwise(F.col("low")), "high": F.when(gap > 0, F.least("high", "tilt")).otherwise(F.col("high"))
        }).withColumn("newton", F.when(F.col("slope") > 0, F.col("tilt") - gap / F.col("slope")))
        inside = (F.col("newton") > F.col("low")) & (F.col("newton") < F.col("high"))
        moved = moved.select(
            "source", "source_size", "target", "mean",
            F.when(settled, F.col("tilt")).when(inside, F.col("newton")).otherwise((F.col("low") + F.col("high")) / 2).alias("tilt"),
            "low", "high", (~settled).alias("open"),
        )
        step = written(moved, "mix-state")
        state = step.drop("open")
        if step.where("open").isEmpty():
            break
    return state


def _copies(cells: DataFrame, state: DataFrame, most: int) -> DataFrame:
    """Copies that each (source, size) cell hands out: `base` to all its rows and one more to `extra` of them.

    Inside a source, cells from long to short get floor(running sum of fractions) extras, which never
    passes the target; one fold over the cells then adds the copies that still fit below what is left.
    The fold's list has one entry a distinct size, however many rows there are.
    """
    power = F.col("tilt") * F.col("size") / F.col("mean")
    rate = F.when(power >= float(most), F.lit(float(most))).otherwise(F.least(F.lit(float(most)), F.exp(power)))
    long_first = Window.partitionBy("source").orderBy(F.desc("size"))
    run = F.sum(F.col("fraction") * F.col("n")).over(long_first.rowsBetween(Window.unboundedPreceding, 0))
    shared = (
        cells.join(state.select(F.col("source").alias("of"), "target", "tilt", "mean"), F.col("source").eqNullSafe(F.col("of"))).drop("of")
        .withColumn("rate", F.when(F.col("size") == 0, 1.0).otherwise(rate))
        .withColumn("base", F.floor("rate").cast("long"))
        .withColumn("fraction", F.col("rate") - F.col("base"))
        .withColumn("run", F.floor(run + 1e-9))
        .withColumn("extra", (F.col("run") - F.coalesce(F.lag("run").over(long_first), F.lit(0))).cast("long"))
        .withColumn("extra", F.least("n", "extra"))
    )
    lists = shared.groupBy("source", "target").agg(
        F.sum(F.col("size") * (F.col("base") * F.col("n") + F.col("extra"))).alias("reached"),
        F.reverse(F.array_sort(F.collect_list(F.struct("size", (F.col("n") * (most - F.col("base")) - F.col("extra")).alias("spare"))))).alias("spares"),
    )

    def add(state: Column, cell: Column) -> Column:
        fits = F.when((cell["size"] > 0) & (cell["spare"] > 0), F.least(cell["spare"], F.floor(state["left"] / cell["size"]).cast("long"))).otherwise(F.lit(0).cast("long"))
        return F.when(fits <= 0, state).otherwise(F.struct(
            (state["left"] - fits * cell["size"]).alias("left"),
            F.concat(state["picks"], F.array(F.struct(cell["size"].alias("size"), fits.alias("more")))).alias("picks"),
        ))

    start = F.struct((F.col("target") - F.col("reached")).alias("left"), F.expr("cast(array() as array<struct<size:bigint,more:bigint>>)").alias("picks"))
    more = lists.select(F.col("source").alias("of"), F.explode(F.aggregate("spares", start, add)["picks"]).alias("p")).select("of", F.col("p.size").alias("at"), F.col("p.more").alias("more"))
    return shared.join(more, F.col("source").eqNullSafe(F.col("of")) & (F.col("size") == F.col("at")), "left").select(
        "source", "size", "n", "rate", (F.col("base") * F.col("n") + F.col("extra") + F.coalesce("more", F.lit(0))).alias("copies"),
    )


def mix(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, most: int = MOST, key: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """doc_id, size, source, source_size, target, rate, copies, taken of each row.

    Null sources are one source, the last; null or empty text has size 0 and stays once. Targets of 0
    give no copies. Ties inside a cell are broken by a hash of key and text, then by row, so that rows
    repeated whole may differ in copies but a rerun gives the same rows. An empty table gives an empty result.
    """
    rows = docs.select(F.col(key).alias("doc_id"), F.col(source).alias("source"), count_words(F.col(text)).alias("size"), F.xxhash64(F.col(key), F.col(text)).alias("tie"))
    rows = written(rows, "mix-sizes")  # 30 bytes a row, so that texts are read once
    cells = written(rows.groupBy("source", "size").agg(F.count(F.lit(1)).alias("n")), "mix-cells")
    goals = targets(cells.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size")), weights, share, most)
    state = balance(cells, goals, most)
    dealt = written(_copies(cells, state, most), "mix-copies")
    # Rows of a cell are numbered slice by slice, as a cell may hold a third of all rows.
    rows = rows.withColumn("slice", F.pmod(F.col("tie"), F.lit(SLICES)).cast("int"))
    slices = rows.groupBy("source", "size", "slice").agg(F.count(F.lit(1)).alias("in_slice"))
    before = Window.partitionBy("source", "size").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    slices = slices.withColumn("offset", F.coalesce(F.sum("in_slice").over(before), F.lit(0)))
    plan = (
        slices.alias("s").join(dealt.alias("d"), F.col("s.source").eqNullSafe(F.col("d.source")) & (F.col("s.size") == F.col("d.size")))
        .join(state.alias("t"), F.col("s.source").eqNullSafe(F.col("t.source")))
        .select(F.col("s.source").alias("of"), F.col("s.size").alias("at"), F.col("s.slice").alias("part"), "offset", "n", "copies", "rate", F.col("t.source_size").alias("source_size"), F.col("t.target").alias("target"))
    )
    nth = F.row_number().over(Window.partitionBy("source", "size", "slice").orderBy("tie", "doc_id"))
    numbered = rows.withColumn("nth", nth).join(plan, F.col("source").eqNullSafe(F.col("of")) & (F.col("size") == F.col("at")) & (F.col("slice") == F.col("part")))
    copies = F.floor(F.col("copies") / F.col("n")) + F.when(F.col("offset") + F.col("nth") <= F.pmod(F.col("copies"), F.col("n")), 1).otherwise(0)
    return numbered.select("doc_id", "source", "size", "source_size", "target", "rate", "tie", copies.cast("long").alias("copies")).withColumn("taken", F.col("copies") * F.col("size"))


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "source", "rate", "copies")
