"""Series out of landed JSON responses, one text cell a response.

Each source has `outcomes`: a row for everything that a response holds, with the `reason` why it gives no value, null for the
rows that count. `accepted` takes these, `rejects` counts the others. A response that is no JSON or holds no list is one row.

A body is read once, as a list of its elements, and each element is typed by itself, so that no value but the body and the list
grows with a response; a VARIANT of a whole body may have 128 MB at most. Elements of sources A and C are read as VARIANT. Source B
needs the order of an object's keys, which VARIANT sorts, so its elements are read as maps.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tijolo.functions import text as T


def once(value: Column) -> Column:
    """A generator of the value alone. An expression that stands in several columns is evaluated for each; a generated one is not."""
    return F.explode(F.array(value))


def accepted(outcomes: DataFrame) -> DataFrame:
    return outcomes.where(F.col("reason").isNull()).drop("reason")


def rejects(outcomes: DataFrame, by: list[str]) -> DataFrame:
    """by, reason and n of what gives no value."""
    return outcomes.where(F.col("reason").isNotNull()).groupBy(*by, "reason").agg(F.count(F.lit(1)).alias("n"))


def _elements(df: DataFrame, body: str, elements: Column, kind: str) -> DataFrame:
    """df without the body, `_e` for each element of its list, and `_broken`, why there is none: then one row without an element."""
    kept = [c for c in df.columns if c != body]
    listed = df.select(*kept, body, once(elements).alias("_list"))
    broken = F.when(F.col("_list").isNull(), F.when(F.try_parse_json(F.col(body)).isNull(), "not json").otherwise("no list"))
    nothing = F.array(F.lit(None).cast(kind))
    return listed.withColumn("_broken", broken).select(*kept, "_broken", F.explode(F.coalesce("_list", nothing)).alias("_e"))


def _fields(df: DataFrame, kept: list[str], **fields: Column) -> DataFrame:
    """kept and the fields, each evaluated once a row however often it is used later."""
    return df.select(*kept, once(F.struct(*[c.alias(n) for n, c in fields.items()])).alias("_f")).select(*kept, "_f.*")


def _text(name: str, kind: str = "string") -> Column:
    return F.expr(f"try_variant_get(_e, '$.{name}', '{kind}')")


def outcomes_a(df: DataFrame, body: str) -> DataFrame:
    """Arrays of {data: dd/MM/yyyy, valor: text or number}."""
    kept = [*(c for c in df.columns if c != body), "_broken"]
    texts = _fields(_elements(df, body, F.from_json(body, "array<variant>"), "variant"), kept, _date=_text("data"), _value=_text("valor"))
    typed = _fields(texts, kept, date=T.brazilian_date(F.col("_date")), value=T.parse_number(F.col("_value")))
    return typed.withColumn("reason", F.coalesce("_broken", F.when(F.col("date").isNull(), "no date").when(F.col("value").isNull(), "no value"))).drop("_broken")


def source_a(df: DataFrame, body: str) -> DataFrame:
    return accepted(outcomes_a(df, body))


def entries(df: DataFrame, body: str) -> DataFrame:
    """Arrays of objects with keys of their own, one row an object, as a map in the order of the text. Elements that are no objects are left out."""
    return _maps(df, body).where(F.col("m").isNotNull()).drop("_broken")


def _maps(df: DataFrame, body: str) -> DataFrame:
    """df without the body, `m` for each element of its list, null where it is no object, and `_broken` as above."""
    kept = [*(c for c in df.columns if c != body), "_broken"]
    rows = _elements(df, body, F.from_json(body, "array<string>"), "string")
    return rows.select(*kept, once(F.from_json("_e", "map<string,string>")).alias("m"))


def period_code(m: Column, key: str | Column | None = None) -> Column:
    """Value of the forced key, else of the first key D<n>C whose value has 4, 5, 6 or 8 digits, the first four a year of 1990-2035; without outer blanks."""
    if isinstance(key, str):
        return F.trim(F.try_element_at(m, F.lit(key)))
    numbered = F.filter(F.map_entries(m), lambda e: e["key"].startswith("D") & e["key"].rlike(r"^D\d+C$"))
    digits = F.transform(numbered, lambda e: F.struct(e["value"].alias("value"), F.regexp_replace(e["value"], "[^0-9]", "").alias("digits")))
    # years of four digits are in the order of their texts
    fits = F.filter(digits, lambda e: F.length(e["digits"]).isin(4, 5, 6, 8) & F.substring(e["digits"], 1, 4).between("1990", "2035"))
    found = F.trim(F.get(fits, F.lit(0))["value"])
    return found if key is None else F.when(key.isNull(), found).otherwise(F.trim(F.try_element_at(m, key)))


def names(m: Column) -> Column:
    """The values of the keys ending in N, joined, accents folded."""
    return T.fold_accents(F.array_join(F.map_values(F.map_filter(m, lambda k, v: k.endswith("N"))), " "))


def has_keywords(m: Column, words: list[str]) -> Column:
    """All words, accents folded, stand in the names."""
    out = F.lit(True)
    for w in words:
        out = out & names(m).contains(T.fold_accents(F.lit(w)))
    return out


def _typed_b(rows: DataFrame, kept: list[str], code: Column, value: Column) -> DataFrame:
    coded = _fields(rows, kept, period=code, _value=value)
    digits = _fields(coded, [*kept, "period", "_value"], _digits=T.digits(F.col("period")))
    d = F.col("_digits")
    return _fields(digits, [*kept, "period"], date=T.date_of_digits(d), frequency=T.frequency_of_digits(d), value=T.parse_number(F.col("_value")))


def outcomes_b(df: DataFrame, body: str, value_key: str = "V", key: str | None = None, words: list[str] = ()) -> DataFrame:
    """Arrays of objects with keys of their own. Rows of other names than `words` are left out, and are no rejects."""
    rows = _maps(df, body)
    if words:
        rows = rows.where(F.col("m").isNull() | has_keywords(F.col("m"), list(words)))
    rows = rows.withColumn("_broken", F.coalesce("_broken", F.when(F.col("m").isNull(), "no object")))
    kept = [*(c for c in df.columns if c != body), "_broken"]
    typed = _typed_b(rows, kept, period_code(F.col("m"), key), F.try_element_at("m", F.lit(value_key)))
    reason = F.coalesce("_broken", F.when(F.col("period").isNull(), "no period").when(F.col("date").isNull(), "no date").when(F.col("value").isNull(), "no value"))
    return typed.withColumn("reason", reason).drop("_broken")


def source_b(df: DataFrame, body: str, value_key: str = "V", key: str | None = None, words: list[str] = ()) -> DataFrame:
    return accepted(outcomes_b(df, body, value_key, key, words))


def outcomes_c(df: DataFrame, body: str) -> DataFrame:
    """Objects {value: [{SERCODIGO, VALDATA, VALVALOR: number or text}]}."""
    kept = [*(c for c in df.columns if c != body), "_broken"]
    rows = _elements(df, body, F.from_json(body, "struct<value array<variant>>")["value"], "variant")
    texts = _fields(rows, [*kept, "_e"], code=_text("SERCODIGO"), _date=_text("VALDATA"), _value=_text("VALVALOR"))
    plain = F.nullif(_text("VALVALOR", "double"), F.lit(float("nan")))
    typed = _fields(texts, [*kept, "code"], date=T.iso_date(F.col("_date")), value=F.coalesce(T.parse_number(F.col("_value")), plain))
    return typed.withColumn("reason", F.coalesce("_broken", F.when(F.col("date").isNull(), "no date").when(F.col("value").isNull(), "no value"))).drop("_broken")


def source_c(df: DataFrame, body: str) -> DataFrame:
    return accepted(outcomes_c(df, body))
