"""Landed responses on disk, one file each, in folders that name the request: root/path=<request>/<any name>."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tijolo.functions import text as T
from tijolo.sources import landed_json, scratch


def read(spark: SparkSession, root: str) -> DataFrame:
    """path, file, landed (time) and body of every response below root. A file is read whole; it is one API response."""
    files = spark.read.schema("value string, path string").text(root, wholetext=True)
    return files.select("path", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_modification_time").alias("landed"), F.col("value").alias("body"))


def land(bodies: DataFrame, root: str) -> None:
    """Write responses (path, body) the way `read` expects them; a body without line breaks stays as it is."""
    land_lines(bodies.select("path", "body").repartition("path"), root)


def land_lines(lines: DataFrame, root: str) -> None:
    """Write lines (path, body) of responses; those of a path, which is never null, stand in one task, in order and with no other's between."""
    lines.write.partitionBy("path").text(root)


def load(responses: DataFrame, outcomes, by: list[str]) -> tuple[DataFrame, DataFrame]:
    """(rows, rejects) of responses by one of the sources' `outcomes`; bodies are read and parsed once for both."""
    done = scratch.written(outcomes(responses, "body"), "outcomes")
    return landed_json.accepted(done), landed_json.rejects(done, by)


def series_by_catalogue(responses: DataFrame, catalogue: DataFrame) -> DataFrame:
    """source, code, name, month (ISO text), value, unit, frequency, path: source B's series as a catalogue describes them.

    catalogue: source, code, name, unit, active, frequency, value_key and candidates, in order of preference: (path, keywords,
    period_key) of a request whose response may hold the series. A row counts if all keywords stand in its names; its period
    is under period_key, or found. The first candidate that gives any row is the series; a response that is broken or
    not there gives none. Null active counts as true, null value_key as V, null frequency is told by the code, null or empty
    keywords take all rows. A response that several series name is parsed once.
    """
    objects = landed_json.entries(responses.select("path", "body"), "body")
    named = objects.select("path", "m", landed_json.once(landed_json.names(F.col("m"))).alias("_names"))
    active = catalogue.where(F.coalesce("active", F.lit(True)))
    tried = active.select("source", "code", "frequency", "value_key", F.posexplode("candidates").alias("rank", "c"))
    words = F.transform(F.coalesce("c.keywords", F.expr("CAST(array() AS array<string>)")), T.fold_accents)
    tried = tried.select("source", "code", F.col("frequency").alias("_forced"), "value_key", "rank", F.col("c.path").alias("path"), words.alias("_words"), F.col("c.period_key").alias("_key"))
    met = named.join(tried, "path").where(F.forall("_words", lambda w: F.col("_names").contains(w)))
    kept = ["source", "code", "rank", "path", "_forced"]
    value = F.try_element_at("m", F.coalesce("value_key", F.lit("V")))
    typed = landed_json._typed_b(met, kept, landed_json.period_code(F.col("m"), F.col("_key")), value)
    rows = scratch.written(typed.where(F.col("date").isNotNull() & F.col("value").isNotNull()), "series")
    best = rows.groupBy("source", "code").agg(F.min("rank").alias("rank"))
    chosen = rows.join(best, ["source", "code", "rank"]).join(active.select("source", "code", "name", "unit"), ["source", "code"])
    return chosen.select("source", "code", "name", F.trunc("date", "month").cast("string").alias("month"), "value", "unit", F.coalesce("_forced", "frequency").alias("frequency"), "path")
