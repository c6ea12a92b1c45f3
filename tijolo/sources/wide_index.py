"""Wide price-index files: four heading records, a column for each measure, month labels and pt-BR numbers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tijolo.functions import text as T
from tijolo.sources import scratch

HEADINGS, WIDTH = 4, 56
#: What a heading holds to count for a rule, and the outputs of the first and second column with such a heading.
#: U+FFFD is a letter lost in a wrong encoding.
HEADED = [
    (("r$/m", "preco medio", "pre\ufffdo m\ufffddio", "preco m\ufffddio"), ("price_m2", "rent_m2")),  # price of a square metre
    (("var. mensal", "var mensal"), ("monthly_sale", "monthly_rent")),  # change in a month
    (("var. em 12 meses", "var em 12 meses"), ("yearly_sale", "yearly_rent")),  # change in twelve months
    (("rentabilidade do aluguel", "rental yield"), ("rent_yield",)),  # yield of letting
]
#: (output, rule, which of the rule's columns), by rule.
RULES = [(name, patterns[0], nth + 1) for patterns, names in HEADED for nth, name in enumerate(names)]


def cells(lines: DataFrame, width: int = WIDTH) -> DataFrame:
    """(file, record, column, text) from (file, record, line)."""
    parsed = F.from_csv("line", F.lit(", ".join(f"c{i} string" for i in range(width))))
    row = lines.select("file", "record", parsed.alias("r"))
    return row.select("file", "record", F.posexplode(F.array(*[F.col(f"r.c{i}") for i in range(width)])).alias("column", "text"))


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """One file is one row of text until it is split, so that records have numbers; files are monthly tables of some hundred lines."""
    whole = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), "value")
    return whole.select("file", F.posexplode(F.split("value", r"\r?\n")).alias("record", "line"))


def headings(cell: DataFrame) -> DataFrame:
    """(file, column, heading): the non-blank parts of the heading records, lower case, accents folded."""
    parts = cell.where((F.col("record") < HEADINGS) & (F.trim("text") != "")).groupBy("file", "column").agg(F.array_sort(F.collect_list(F.struct("record", "text"))).alias("p"))
    return parts.select("file", "column", T.fold_accents(F.array_join(F.col("p.text"), " ")).alias("heading"))


def columns(heading: DataFrame) -> DataFrame:
    """(file, column, output): the date column and those that the rules name; the first rule that a heading meets counts.

    The date is the first column headed `data`, else the first whose heading holds it, else the second column. Without a
    price column, the first other column with a heading that lacks `total` is it, else the last one.
    """
    dated = heading.groupBy("file").agg(F.coalesce(F.min(_dating())["column"], F.lit(1)).alias("date"))
    text, rule = F.col("heading"), _rule()
    others = heading.join(dated, "file").where("column <> date").select("file", "column", "heading", rule.alias("rule"))
    lists = others.where(F.col("rule").isNotNull()).groupBy("file", "rule").agg(F.array_sort(F.collect_list("column")).alias("at"))  # a file has few columns
    out = F.lit(None).cast("string")
    numbered = lists.select("file", "rule", F.posexplode("at").alias("nth", "column"))
    for name, pattern, nth in RULES:
        out = F.when((F.col("rule") == pattern) & (F.col("nth") == nth - 1), name).otherwise(out)
    named = numbered.select("file", "column", out.alias("output")).where(F.col("output").isNotNull())
    price, _, _ = RULES[0]
    priced = F.coalesce(F.bool_or(F.col("rule") == RULES[0][1]), F.lit(False))
    spare = others.groupBy("file").agg(priced.alias("priced"), F.coalesce(F.min(F.when(~text.contains("total"), F.col("column"))), F.max("column")).alias("column"))
    spare = spare.where("NOT priced").select("file", "column", F.lit(price).alias("output"))
    return dated.select("file", F.col("date").alias("column"), F.lit("date").alias("output")).unionByName(named).unionByName(spare)


def _dating() -> Column:
    """(rank, column) of a heading that may be the date's: 0 if it is headed so, 1 if it holds the word."""
    text = F.col("heading")
    word = (text == "data") | text.endswith(" data") | text.startswith("data ")
    rank = F.when(word, 0).when(text.contains("data"), 1)
    return F.when(rank.isNotNull(), F.struct(rank.alias("rank"), "column"))


def _rule() -> Column:
    """The first rule that a heading meets, by its first pattern."""
    out = F.lit(None).cast("string")
    for patterns, _ in reversed(HEADED):
        hit = F.lit(False)
        for p in patterns:
            hit = hit | F.col("heading").contains(p)
        out = F.when(hit, patterns[0]).otherwise(out)
    return out


def report(cell: DataFrame) -> DataFrame:
    """file, date_rule and price_rule: how each file's date and price columns were found. `headed` is a column named so; others are
    guesses: for the date `holds the word` or `second column`, for the price `first without total` or `last`; `none` is a file without any heading for it."""
    named = headings(cell)
    dated = named.groupBy("file").agg(F.min(_dating()).alias("d"))
    rules = named.join(dated, "file").where(F.col("d").isNull() | (F.col("column") != F.col("d.column"))).where(F.col("d").isNotNull() | (F.col("column") != 1))
    priced = rules.groupBy("file").agg(F.coalesce(F.bool_or(_rule() == RULES[0][1]), F.lit(False)).alias("named"), F.bool_or(~F.col("heading").contains("total")).alias("spare"))
    date_rule = F.when(F.col("d.rank") == 0, "headed").when(F.col("d.rank") == 1, "holds the word").when(F.col("heads"), "second column").otherwise("none")
    price_rule = F.when(F.col("named"), "headed").when(F.col("spare"), "first without total").when(F.col("spare").isNotNull(), "last").otherwise("none")
    files = cell.select("file").distinct().join(named.select("file", F.lit(True).alias("heads")).distinct(), "file", "left")
    return files.join(dated, "file", "left").join(priced, "file", "left").select("file", date_rule.alias("date_rule"), price_rule.alias("price_rule"))


def load_with_report(lines: DataFrame, width: int = WIDTH) -> tuple[DataFrame, DataFrame]:
    """(typed months of all files, the files whose date or price column is a guess or not there)."""
    guessed = report(cells(lines, width)).where("date_rule <> 'headed' OR price_rule <> 'headed'")
    return load(lines, width), guessed


def load(lines: DataFrame, width: int = WIDTH) -> DataFrame:
    """Typed months of all files. Records without a month label or a sale price, notes among them, fall away."""
    cell = cells(lines, width)
    chosen = scratch.written(columns(headings(cell)), "columns")  # used once for each file's headings, and small
    names = ["date", *[r[0] for r in RULES]]
    data = cell.where(F.col("record") >= HEADINGS).join(chosen, ["file", "column"])
    wide = data.groupBy("file", "record").pivot("output", names).agg(F.first("text"))
    typed = wide.select(T.ptbr_month(F.col("date")).alias("date"), *[T.ptbr_number(F.col(n)).alias(n) for n in names[1:]])
    return typed.dropna(subset=["date", "price_m2"])
