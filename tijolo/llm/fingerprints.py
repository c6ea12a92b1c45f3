"""Operator 3: one-permutation MinHash fingerprints, in DataFrame functions only.

Each shingle of five words is hashed once. The hash's top byte is its bin, and each of the 256 bins keeps
its least hash. An empty bin borrows from the first non-empty one in its own fixed sequence of bins
(optimal densification), so equal sets borrow alike. Of each bin's value, mixed with the bin's number so that
bins that share a donor agree by chance independently, the BITS low-order bits are kept and packed as a
hexadecimal digit; the likeness of two fingerprints is corrected for bins that agree by chance.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from tijolo.llm.common import partitions, table

WORDS, BINS, BITS = 5, 256, 4
#: Bins tried for an empty one before the choice falls to the least hash of (bin, donor), which has the same law.
TRIES = 24
_LOW = (1 << 56) - 1


def _mixed(a: int, b: int) -> int:
    """A fixed hash of two small numbers to 0..255."""
    x = (a * 0x9E3779B97F4A7C15 + b * 0xC2B2AE3D27D4EB4F + 0x165667B19E3779F9) & (2**64 - 1)
    x = (x ^ x >> 29) * 0xBF58476D1CE4E5B9 & (2**64 - 1)
    return (x ^ x >> 32) * 0x94D049BB133111EB >> 40 & 0xFF


def _numbers(values: list[int], kind: str) -> Column:
    return F.expr(f"array({','.join(f'{v}{kind}' for v in values)})")


def with_fingerprint(df: DataFrame, text: str, name: str, words: int = WORDS) -> DataFrame:
    """df with `name`: the packed digits, 256 of them; null for a text without words."""
    def t(x: str) -> str:
        return f"{name}_{x}"

    word_list = F.filter(F.split(F.lower(F.coalesce(F.col(text), F.lit(""))), "[\\x20\\x09-\\x0D]+"), lambda w: w != "")
    df = df.withColumn(t("w"), F.transform(word_list, lambda x: F.xxhash64(x)))
    count = F.greatest(F.size(t("w")) - (words - 1), F.least(F.size(t("w")), F.lit(1)))
    # the hash of a word and those after it; behind the last word there are nulls, which a hash passes over
    every = F.transform(t("w"), lambda x, i: F.xxhash64(x, *[F.get(F.col(t("w")), i + k) for k in range(1, words)]))
    df = df.withColumn(t("h"), F.slice(every, 1, count))
    # One entry more a bin, greater than any hash in it, makes every bin present; the first entry of a bin is its least hash.
    ends = _numbers([(b - BINS // 2) * 2**56 + _LOW for b in range(BINS)], "L")
    df = df.withColumn(t("s"), F.sort_array(F.concat(t("h"), ends)))
    first = F.filter(t("s"), lambda x, i: (i == 0) | (F.shiftright(x, 56) != F.shiftright(F.get(F.col(t("s")), i - 1), 56)))
    df = df.withColumn(t("b"), F.transform(first, lambda x: F.when(x.bitwiseAND(_LOW) != _LOW, x)))
    full = F.filter(F.transform(t("b"), lambda x, i: F.when(x.isNotNull(), i)), lambda i: i.isNotNull())
    df = df.withColumn(t("f"), full)
    bins, tries = F.col(t("b")), [_numbers([_mixed(j, k + 1) for j in range(BINS)], "") for k in range(TRIES)]

    def filled(x: Column, j: Column) -> Column:
        rare = F.get(bins, F.array_min(F.transform(t("f"), lambda d: F.struct(F.xxhash64(j, d).alias("o"), d.alias("d"))))["d"])
        return F.coalesce(x, *[F.get(bins, F.get(k, j)) for k in tries], rare)

    df = df.withColumn(t("d"), F.transform(t("b"), filled))
    digits = F.transform(t("d"), lambda x, i: F.substring(F.lit("0123456789abcdef"), (F.xxhash64(x, i).bitwiseAND(2**BITS - 1) + 1).cast("int"), F.lit(1)))
    return df.withColumn(name, F.when(F.size(t("f")) > 0, F.array_join(digits, ""))).drop(*[t(x) for x in "whsbfd"])


def likeness(a: Column, b: Column) -> Column:
    """Estimated similarity, 0 to 1: two texts without words are alike, one without words is like no other."""
    # taken apart once each; the i-th character of a string is found by walking to it
    same = F.size(F.filter(F.zip_with(F.split(a, ""), F.split(b, ""), lambda x, y: x == y), lambda x: x)) / F.lit(float(BINS))
    chance = 2.0**-BITS
    return F.when(a.isNull() & b.isNull(), 1.0).when(a.isNull() | b.isNull(), 0.0).otherwise(F.greatest(F.lit(0.0), (same - chance) / (1 - chance)))


def with_next(df: DataFrame, key: str, columns: list[str], parts: int) -> DataFrame:
    """df with next_<column>: the values of the next row by descending key, of the first row after the last one.

    Keys are cut into `parts` ranges, each a window of its own; the head of every range is also given to the range
    before it, so that no window holds more than its range and one row. Nulls come last; rows of one key are ordered
    by a hash of their values, and are alike if that is equal. One row is its own successor. The key is a number; rows of
    one key, or with a null one, are one range, so that a table where many rows share a key is not for this function.
    """
    tie = F.xxhash64(*columns)
    bounds = df.where(F.col(key).isNotNull()).agg(F.percentile_approx(key, [i / parts for i in range(1, parts)] or [0.5], 10000).alias("b")).first().b or []
    edges = F.array(*[F.lit(x) for x in sorted(set(bounds))]) if bounds else F.expr("cast(array() as array<bigint>)")
    # 0 is the range of the greatest keys; nulls are in the last
    last = len(set(bounds))
    part = F.when(F.col(key).isNull(), F.lit(last)).otherwise(F.size(F.filter(edges, lambda x: x >= F.col(key))))
    dealt = df.withColumns({"_part": part.cast("int"), "_tie": tie})
    order = F.struct(F.col(key).isNull().alias("n"), (-F.col(key)).alias("k"), F.col("_tie").alias("t"))
    heads = dealt.groupBy("_part").agg(F.min(order).alias("head"))  # at most `parts` rows of three numbers
    above = Window.orderBy("_part")
    heads = heads.select("_part", "head", F.coalesce(F.lag("_part").over(above), F.max("_part").over(Window.partitionBy())).alias("_before"))
    both = dealt.join(F.broadcast(heads), "_part").withColumn(
        "_copy", F.explode(F.when(order == F.col("head"), F.array(F.lit(False), F.lit(True))).otherwise(F.array(F.lit(False))))
    )
    both = both.withColumn("_in", F.when(F.col("_copy"), F.col("_before")).otherwise(F.col("_part"))).drop("head", "_before", "_part")
    w = Window.partitionBy("_in").orderBy("_copy", F.col(key).desc_nulls_last(), "_tie")
    both = both.withColumns({f"next_{c}": F.lead(c).over(w) for c in columns})
    return both.where(~F.col("_copy")).drop("_copy", "_in", "_tie")


def fingerprint(docs: DataFrame, key: str = "doc_id", text: str = "text", words: int = WORDS) -> DataFrame:
    """docs with `fingerprint` added. Null text counts as empty; a text without words has the fingerprint ''."""
    return with_fingerprint(docs, text, "fingerprint", words).withColumn("fingerprint", F.coalesce("fingerprint", F.lit("")))


def op3_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    own = with_fingerprint(docs, "text", "own")
    pairs = with_next(own, "doc_id", ["text", "own"], 4 * partitions(spark))
    n = F.char_length("text")
    half = F.floor(n / 2).cast("int")
    pairs = pairs.withColumn("n_chars", n.cast("long")).withColumn("edited_text", F.concat(F.substring(F.col("text"), F.lit(1), n - half), F.substring(F.col("next_text"), F.lit(1), half)))
    edited = with_fingerprint(pairs.drop("text", "next_text"), "edited_text", "edited")
    return edited.select(
        "doc_id", "n_chars", F.sha2("edited_text", 256).alias("edited_sha256"),
        F.coalesce("own", F.lit("")).alias("fingerprint"), F.coalesce("edited", F.lit("")).alias("edited_fingerprint"),
        likeness(F.col("own"), F.col("edited")).alias("near_edited"), likeness(F.col("own"), F.col("next_own")).alias("near_next"),
    )
