"""Tables on storage: appends, guarded and atomic replacement, CSV, contracts."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

#: Tables and their columns.
SCHEMAS = {
    "listings": "id bigint, segment string, min_price bigint, page int, address string, price_text string, area_text string, rooms_text string, baths_text string, parking_text string",
    "clean_listings": "address string, price double, area double, id bigint, rooms int, baths int, parking int, kind string, unit_price double",
    "progress": "segment int, page int",
    "series": "source string, code string, date date, name string, value double, unit string, frequency string, seen date",
    "price_index": "date date, price_m2 double, rent_m2 double, monthly_sale double, monthly_rent double, yearly_sale double, yearly_rent double, rent_yield double",
    "statistics": "kind string, field string, unit string, n bigint, mean double, median double, stddev double",
}
#: Table to (columns that must not be null, columns that are unique together).
CONTRACTS = {
    "listings": (["id"], ["id"]), "clean_listings": (["address", "price", "area"], ["address", "price", "area"]), "progress": (["segment", "page"], ["segment", "page"]),
    "series": (["source", "code", "date"], ["source", "code", "date"]), "price_index": (["date"], ["date"]), "statistics": (["kind", "field"], ["kind", "field"]),
}


def conform(df: DataFrame, name: str) -> DataFrame:
    """df in the columns, types and order of a table's schema; a column that is not there is an error."""
    fields = [x.rsplit(" ", 1) for x in SCHEMAS[name].split(", ")]
    return df.select(*[F.col(c).cast(t).alias(c) for c, t in fields])


#: The time that a table notes when a row is written, and values that stand for a missing one.
WRITTEN_AT = {"listings": "collected_at", "clean_listings": "processed_at", "series": "collected_at", "price_index": "processed_at", "statistics": "computed_at"}
DEFAULTS = {"series": {"frequency": "M"}}


def stamped(df: DataFrame, name: str, now: Column | None = None) -> DataFrame:
    """df as a table stores it: in its schema, with its defaults for missing columns and nulls, and the time of writing. A row that
    has a time already keeps it, as rows do that are written again. `now` is one time for all rows of a query."""
    defaults, at = DEFAULTS.get(name, {}), WRITTEN_AT.get(name)
    for c, value in defaults.items():
        df = df.withColumn(c, F.coalesce(F.col(c), F.lit(value)) if c in df.columns else F.lit(value))
    if not at:
        return conform(df, name)
    now = F.current_timestamp() if now is None else now
    known = F.coalesce(F.col(at).cast("timestamp"), now) if at in df.columns else now
    fields = [x.rsplit(" ", 1) for x in SCHEMAS[name].split(", ")]
    return df.select(*[F.col(c).cast(t).alias(c) for c, t in fields], known.alias(at))


def append(df: DataFrame, path: str, partition: str | None = None) -> None:
    writer = df.write.mode("append")
    (writer.partitionBy(partition) if partition else writer).parquet(path)


# --- tables whose content is what a list names
#
# Rows are written to a folder of their own first, and count once the list has an entry for it. The list grows by one
# committed file at a time, so readers see the state before or after, and what a job that died has left counts never.
# Folders are named relative to the table, so that it can be moved. One writer at a time.


def _list(spark: SparkSession, path: str, name: str, schema: str) -> DataFrame:
    """The entries of a list, none if there is no list yet."""
    if not _exists(spark, f"{path}/{name}"):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(f"{path}/{name}")


def _exists(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at)


def _commit(entries: DataFrame, path: str, name: str) -> None:
    entries.coalesce(1).write.mode("append").parquet(f"{path}/{name}")


_VERSIONS = "number bigint, rows string"


def replace(df: DataFrame, path: str) -> None:
    """New content; an empty df keeps the old content. The rows are written once and looked at there."""
    spark, rows = df.sparkSession, f"rows/{uuid.uuid4().hex}"
    df.write.parquet(f"{path}/{rows}")
    if not spark.read.schema(df.schema).parquet(f"{path}/{rows}").isEmpty():
        number = (_list(spark, path, "versions", _VERSIONS).agg(F.max("number")).first()[0] or 0) + 1
        _commit(spark.range(1).select(F.lit(number).cast("long").alias("number"), F.lit(rows).alias("rows")), path, "versions")


def current(spark: SparkSession, path: str, order: list[str] = ()) -> DataFrame:
    """The content that counts, ordered where an order is asked for. Reading creates nothing."""
    last = _list(spark, path, "versions", _VERSIONS).agg(F.max_by("rows", F.struct("number", "rows"))).first()[0]
    if last is None:
        raise ValueError(f"{path} has no content")
    df = spark.read.parquet(f"{path}/{last}")
    return df.orderBy(*order) if order else df


def vacuum(spark: SparkSession, path: str, name: str = "versions") -> int:
    """Delete the folders of rows that no longer count, and return how many. No job may be reading or writing the table."""
    schema = {"versions": _VERSIONS, "parts": _PARTS}[name]
    listed = _list(spark, path, name, schema)
    last = listed.groupBy(*([] if name == "versions" else ["part"])).agg(F.max_by("rows", F.struct("number", "rows")).alias("rows"))
    kept = {r["rows"].split("/")[1] for r in last.collect() if r["rows"]}  # a list entry each: folders, not rows
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(f"{path}/rows")
    fs = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    old = [f.getPath() for f in (fs.listStatus(at) if fs.exists(at) else []) if f.getPath().getName() not in kept]
    for folder in old:
        fs.delete(folder, True)
    return len(old)


# --- tables in parts, of which a batch changes only those that it touches

_PARTS = "number bigint, part string, rows string"


def merge(batch: DataFrame, path: str, schema: str, part: Column, combine) -> None:
    """Merge a batch into a table of parts: combine(stored rows, batch) gives the new rows of the parts that the batch touches;
    files of other parts stay. part: of a row, as text, the same for a row of the table and of the batch that have equal keys,
    such as its month; a batch has few. The batch is read twice; the table's parts are read once. An empty batch changes nothing."""
    spark, rows = batch.sparkSession, f"rows/{uuid.uuid4().hex}"
    touched = [r["part"] for r in batch.select(part.alias("part")).distinct().collect()]
    if not touched:
        return
    stored = parts(spark, path, schema, touched)
    done = combine(stored, batch).withColumn("_part", part)
    done.repartition(F.col("_part"), F.pmod(F.xxhash64(*done.columns), F.lit(8))).write.partitionBy("_part").parquet(f"{path}/{rows}")
    number = (_list(spark, path, "parts", _PARTS).agg(F.max("number")).first()[0] or 0) + 1
    written = spark.createDataFrame([(number, p, f"{rows}/_part={p}") for p in touched], _PARTS)
    _commit(written, path, "parts")


def parts(spark: SparkSession, path: str, schema: str, wanted: list[str] | None = None) -> DataFrame:
    """The rows of a table of parts, or of the wanted parts only."""
    listed = _list(spark, path, "parts", _PARTS)
    if wanted is not None:
        listed = listed.where(F.col("part").isin(wanted))
    last = listed.groupBy("part").agg(F.max_by("rows", "number").alias("rows")).collect()  # one folder a part
    if not last:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(*[f"{path}/{r['rows']}" for r in last])


# --- rows and the marks of their pages, published together

_RUNS = "run string"


def record(rows: DataFrame, pages: DataFrame, path: str, keys: list[str], run: str) -> None:
    """Append the rows of pages and mark these, unless they are marked: rows of a marked page, or of none of `pages`, add nothing.

    Rows and marks of a run are written to folders of their own and published by one entry that names the run. A run that was
    published adds nothing if it comes again; one that died before starts over. Null keys are keys like others.
    """
    spark = rows.sparkSession
    if not published(spark, path).where(F.col("run") == run).isEmpty():
        return
    same = lambda a, b: [F.col(f"{a}.{k}").eqNullSafe(F.col(f"{b}.{k}")) for k in keys]
    marked = marks(spark, path, pages.select(*keys).schema.simpleString()[7:-1].replace(":", " "))
    fresh = pages.select(*keys).dropDuplicates(keys).alias("p").join(marked.alias("m"), same("p", "m"), "left_anti")
    to = f"{path}/marks/run={run}"
    fresh.write.mode("overwrite").parquet(to)
    fresh = spark.read.schema(fresh.schema).parquet(to)
    rows.alias("r").join(fresh.alias("p"), same("r", "p"), "left_semi").write.mode("overwrite").parquet(f"{path}/rows/run={run}")
    _commit(spark.range(1).select(F.lit(run).alias("run")), path, "runs")


def published(spark: SparkSession, path: str) -> DataFrame:
    return _list(spark, path, "runs", _RUNS).distinct()


def marks(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return _of_runs(spark, path, "marks", schema)


def recorded(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The rows of all published runs."""
    return _of_runs(spark, path, "rows", schema)


def _of_runs(spark: SparkSession, path: str, name: str, schema: str) -> DataFrame:
    if not _exists(spark, f"{path}/{name}"):
        return spark.createDataFrame([], schema)
    # the runs prune the folders that are read
    every = spark.read.schema(f"{schema}, run string").parquet(f"{path}/{name}")
    return every.join(published(spark, path), "run", "left_semi").drop("run")


# --- rows that break a contract


def checked(df: DataFrame, path: str, needed: list[str], unique: list[str], order: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(rows, quarantine, counts): writes df's rows that keep a contract, and the others beside them, in one job.

    A row with a null where none may be goes to quarantine; of rows with equal keys the first by `order` counts and the others go
    there: one row for each key and reason, with `n`, how many it stands for. counts are observed while
    writing: table rows, rows with nulls, repeats. They cost no scan; df is read once. An empty df gives empty tables and zeros.
    """
    spark, watched = df.sparkSession, Observation()
    null = F.concat_ws(", ", *[F.when(F.col(c).isNull(), F.lit(c)) for c in needed])
    rest = [c for c in df.columns if c not in unique]
    flagged = df.withColumn("_why", F.when(null != "", F.concat(F.lit("null in "), null)))
    firsts = flagged.groupBy(*unique, "_why").agg(F.count(F.lit(1)).alias("_n"), F.min_by(F.struct(*rest), F.struct(F.col(order), F.struct(*rest))).alias("_rest"))
    split = F.when(F.col("_why").isNotNull(), F.array(F.struct(F.col("_why").alias("reason"), F.col("_n").alias("n")))).otherwise(
        F.filter(F.array(F.struct(F.lit("").alias("reason"), F.lit(1).cast("long").alias("n")), F.struct(F.lit("repeated").alias("reason"), (F.col("_n") - 1).alias("n"))), lambda x: x["n"] > 0))
    out = firsts.select(*unique, "_rest.*", F.inline(split)).select(*df.columns, "reason", "n")
    total = lambda when: F.coalesce(F.sum(F.when(when, F.col("n"))), F.lit(0))
    good, repeated = F.col("reason") == "", F.col("reason") == "repeated"
    seen = out.observe(watched, total(good).alias("n"), total(~good & ~repeated).alias("nulls"), total(repeated).alias("repeats"))
    seen.withColumn("kept", good).write.partitionBy("kept").parquet(path)
    counts = spark.createDataFrame([tuple(watched.get[k] for k in ("n", "nulls", "repeats"))], "n bigint, nulls bigint, repeats bigint")
    stored = spark.read.schema(out.withColumn("kept", good).schema).parquet(path)
    return stored.where("kept").select(df.columns), stored.where("NOT kept").drop("kept"), counts


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def read_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.option("header", True).schema(schema).csv(path)


def violations(df: DataFrame, name: str, needed: list[str], unique: list[str]) -> DataFrame:
    """Rows with a null where none may be, and rows beyond the first of a key."""
    keys = df.groupBy(*unique).agg(F.count(F.lit(1)).alias("n"), *[F.count_if(F.col(c).isNull()).alias(f"_{i}") for i, c in enumerate(needed)])
    nulls = sum((F.col(f"_{i}") for i in range(1, len(needed))), F.col("_0"))
    return keys.agg(F.lit(name).alias("table_name"), F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.coalesce(F.sum(nulls), F.lit(0)).alias("nulls"), F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("repeats"))
