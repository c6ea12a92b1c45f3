"""Operator 12: phrase collocations of two and three words by stripes.

Each pair of words that follow each other keys a stripe, a counter of the words that come next, with a slot for those that end
the piece or are too rare to be part of a phrase. Chunks of documents make stripes of their own, and equal stripes are merged
element by element. A merged stripe gives all at once: its elements count the phrases of three words, its total the pair
itself, as the slot holds the rest, and its largest element the longer phrase that covers the pair most.

A phrase is at least as rare as each of its words, so words are counted first and only those that are frequent enough get a number;
numbers are exact, not hashes. Stripes are dealt by pair; a pair of two words that are both very frequent has its stripe
cut by the next word, and the cuts' totals are added up afterwards.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tijolo.llm.common import LOWER, UPPER, bucketed, numbered, partitions, small_batches, table, written
from tijolo.llm.language_model import pack, pack_keys, unpack, unpack_keys
from tijolo.llm.near_duplicates import _grouped

#: Occurrences of a candidate; percentage of them that a longer one must have to cover it; phrases of a language's report.
LEAST, COVER, TOP = 10, 50, 2000
#: Tokens of a chunk; tokens whose stripes one slot of the merge may get; occurrences of a word for each cut of its stripes.
CHUNK, SLOT, HOT = 1_500_000, 2_000_000, 5_000_000
NO_LANGUAGE = "und"

_BREAKS = b".,;:!?\n\x0b\x0c\r"
#: A-Z become a-z, breaks become a full stop, which is in no word, and a tab a blank.
_MAP = bytes(b + 32 if 0x41 <= b <= 0x5A else 0x2E if b in _BREAKS else 0x20 if b == 9 else b for b in range(256))
_ODD = np.uint64(0x9E3779B97F4A7C15)


def tokens(text: str | None) -> list[bytes]:
    """Words, and a full stop for each break."""
    return (text or "").encode("utf-8", "surrogatepass").translate(_MAP).replace(b".", b" . ").split()


class _Words(dict):
    """A word to its number in a chunk; 0 is a break."""

    def __init__(self):
        super().__init__({b".": 0})

    def __missing__(self, word: bytes) -> int:
        value = self[word] = len(self)
        return value


def _chunks(docs: DataFrame, chunk: int) -> DataFrame:
    """chunk, lang, words (distinct), counts (of each) and tokens (packed numbers, from 1, and 0 for a break), a row a language."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        first, number, size = TaskContext.get().partitionId() << 32, 0, 0
        held: dict[str, tuple[_Words, list[np.ndarray]]] = {}

        def close() -> Iterator[pd.DataFrame]:
            nonlocal number
            for lang, (words, seqs) in held.items():
                all_ = np.concatenate(seqs)
                names = [w.decode("utf-8", "surrogatepass") for w in words][1:]
                counts = np.bincount(all_, minlength=len(words))[1:]
                yield pd.DataFrame({"chunk": [first + number], "lang": [lang], "words": [names], "counts": [counts], "tokens": [pack(all_)]})
                number += 1

        for pdf in batches:
            for lang, text in zip(pdf["lang"], pdf["text"]):
                words, seqs = held.setdefault(lang, (_Words(), []))
                found = tokens(text)
                found.append(b".")
                seqs.append(np.fromiter(map(words.__getitem__, found), np.int32, len(found)))
                size += len(found)
                if size >= chunk:
                    yield from close()
                    held, size = {}, 0
        if held:
            yield from close()

    return docs.mapInPandas(run, "chunk bigint, lang string, words array<string>, counts array<bigint>, tokens binary")


def _distinct(p: np.ndarray, q: np.ndarray, z: np.ndarray, v: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct triples of numbers below v, and how often each is there."""
    if v < 1 << 21:
        code, counts = np.unique((p * v + q) * v + z, return_counts=True)
        pair, z = np.divmod(code, v)
        return *np.divmod(pair, v), z, counts
    pairs, at = np.unique(p * v + q, return_inverse=True)
    code, counts = np.unique(at * v + z, return_counts=True)
    at, z = np.divmod(code, v)
    return *np.divmod(pairs[at], v), z, counts


def stripes(chunks: DataFrame, slots: int, hot: int) -> DataFrame:
    """slot, cut, pairs, nexts and counts: stripes of each chunk, packed. Words are numbered from 1 in nexts, where 0 is the rest."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for packed, pos, ids, often in zip(pdf["tokens"], pdf["pos"], pdf["id"], pdf["f"]):
                all_ = unpack(packed, np.int32)
                local = np.zeros(int(all_.max()) + 1, np.int64)
                local[pos + 1] = np.arange(1, len(pos) + 1)
                ids, often = np.append(np.int64(-1), ids).astype(np.int64), np.append(np.int64(0), often).astype(np.int64)
                t = np.append(local[all_], 0)  # a chunk ends with a break
                both = np.flatnonzero((t[:-1] > 0) & (t[1:] > 0))
                p, q, z, counts = _distinct(t[both], t[both + 1], t[both + 2], len(ids))
                pairs, nexts = (ids[p] << 32 | ids[q]).view(np.uint64), ids[z] + 1
                cuts = 1 + np.minimum(often[p], often[q]) // hot
                with np.errstate(over="ignore"):
                    cut = (nexts.view(np.uint64) * _ODD >> np.uint64(33)) % cuts.view(np.uint64)
                    mixed = (pairs ^ pairs >> np.uint64(29)) * _ODD + cut * np.uint64(0xD6E8FEB86659FD93)
                    mixed = (mixed ^ mixed >> np.uint64(32)) * np.uint64(0xBF58476D1CE4E5B9)
                    slot = ((mixed >> np.uint64(32)) * np.uint64(slots) >> np.uint64(32)).astype(np.int64)
                where = slot * 2 + (cuts > 1)
                order = np.lexsort((nexts, pairs, where))
                where, pairs, nexts, counts = where[order], pairs[order], nexts[order], counts[order]
                edges = np.flatnonzero(np.concatenate([[True], where[1:] != where[:-1], [True]])) if len(where) else np.zeros(1, np.int64)
                yield pd.DataFrame(
                    [(w >> 1, bool(w & 1), pack_keys(pairs[a:b]), pack(nexts[a:b]), pack(counts[a:b])) for a, b in zip(edges[:-1], edges[1:]) for w in (int(where[a]),)],
                    columns=["slot", "cut", "pairs", "nexts", "counts"])

    return chunks.mapInPandas(run, "slot bigint, cut boolean, pairs binary, nexts binary, counts binary")


def _merge(least: int):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        """first, second, third, n, longest: phrases of three words, and pairs, which have no third. Pairs of cut stripes are given in part."""
        out = []
        for _, rows in pdf.groupby("slot", sort=False):
            parts = [unpack_keys(k) for k in rows["pairs"]]
            pairs, nexts, counts = np.concatenate(parts), *(np.concatenate([unpack(x, np.int64) for x in rows[c]]) for c in ("nexts", "counts"))
            cut = np.repeat(rows["cut"].to_numpy(), [len(k) for k in parts])
            order = np.lexsort((nexts, pairs))
            pairs, nexts, cut = pairs[order], nexts[order], cut[order]
            at = np.flatnonzero(np.concatenate([[True], (pairs[1:] != pairs[:-1]) | (nexts[1:] != nexts[:-1])]))
            n, pairs, nexts, cut = np.add.reduceat(counts[order], at), pairs[at], nexts[at], cut[at]
            long = np.where((nexts > 0) & (n >= least), n, 0)
            at = np.flatnonzero(np.concatenate([[True], pairs[1:] != pairs[:-1]]))
            total, longest = np.add.reduceat(n, at), np.maximum.reduceat(long, at)
            kept = (total >= least) | cut[at]
            phrases = long > 0
            key = np.concatenate([pairs[at][kept], pairs[phrases]])
            out.append(pd.DataFrame({
                "first": (key >> np.uint64(32)).astype(np.int64), "second": (key & np.uint64(0xFFFFFFFF)).astype(np.int64),
                "third": np.concatenate([np.full(int(kept.sum()), -1), nexts[phrases] - 1]),
                "n": np.concatenate([total[kept], n[phrases]]), "longest": np.concatenate([longest[kept], np.zeros(int(phrases.sum()), np.int64)])}))
        return pd.concat(out)

    return run


def collocations(
    docs: DataFrame, least: int = LEAST, cover: int = COVER, top: int = TOP, lang: str = "lang", text: str = "text", chunk: int = CHUNK, slot: int = SLOT, hot: int = HOT,
) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: the `top` phrases of each language, by score, occurrences and phrase.

    A null language is `und`; a null, empty or blank text has no words. Repeated rows count as often as they are there. Words
    are whatever stands between blanks, tabs and breaks; phrases don't reach over breaks or from one text into another. An empty
    table, or one without a frequent phrase, gives an empty result. Other columns are dropped. Counts are exact up to
    3e15 occurrences of a phrase and 2^32 different frequent words; beyond, the job fails.
    """
    spark = docs.sparkSession
    small_batches(spark)
    rows = docs.select(F.coalesce(F.col(lang).cast("string"), F.lit(NO_LANGUAGE)).alias("lang"), F.col(text).alias("text"))
    chunks = bucketed(_chunks(rows, chunk), "chunk", "phrase-chunks")
    asks = chunks.select("chunk", "lang", F.posexplode(F.arrays_zip("words", "counts")).alias("pos", "w")).select("chunk", "lang", "pos", F.col("w.words").alias("word"), F.col("w.counts").alias("n"))
    frequent = asks.groupBy("lang", "word").agg(F.sum("n").alias("f")).where(F.col("f") >= least)
    dictionary = written(numbered(written(frequent, "words"), [], ["lang", "word"], "words").select("lang", "word", "f", F.col("nth").alias("id")), "dictionary")
    totals = chunks.select("lang", F.aggregate("counts", F.lit(0).cast("long"), lambda s, x: s + x).alias("n")).groupBy("lang").agg(F.sum("n").alias("n"))
    sizes = dictionary.agg(F.max("id").alias("id")).first(), totals.agg(F.sum("n").alias("n")).first()
    if (sizes[0].id or 0) >= 2**32 - 1:
        raise ValueError("more frequent words than numbers")
    answers = asks.join(dictionary, ["lang", "word"]).groupBy("chunk").agg(F.collect_list(F.struct("pos", "id", "f")).alias("known"))
    asked = chunks.select("chunk", "tokens").join(answers.hint("shuffle_merge"), "chunk").select("tokens", "known.pos", "known.id", "known.f")
    slots = max(partitions(spark), -(-(sizes[1].n or 0) // slot))
    merged = written(_grouped(stripes(asked, slots, hot), "slot", _merge(least), "first bigint, second bigint, third bigint, n bigint, longest bigint"), "stripes")
    return _report(merged, dictionary, totals, least, cover, top)


def _report(merged: DataFrame, dictionary: DataFrame, totals: DataFrame, least: int, cover: int, top: int) -> DataFrame:
    threes = merged.where("third >= 0").select("first", "second", "third", F.col("n").alias("a"))
    twos = written(merged.where("third < 0").groupBy("first", "second").agg(F.sum("n").alias("a"), F.max("longest").alias("longest")).where(F.col("a") >= least), "pairs")
    # the longer phrases that a pair ends; those that it begins are in its stripe
    ends = threes.groupBy(F.col("second").alias("first"), F.col("third").alias("second")).agg(F.max("a").alias("other"))
    alone = twos.join(ends, ["first", "second"], "left").where(100 * F.greatest("longest", F.coalesce("other", F.lit(0))) < cover * F.col("a"))
    none = F.lit(None).cast("long")
    heads = twos.select("first", "second", F.col("a").alias("head"))
    tails = twos.select(F.col("first").alias("second"), F.col("second").alias("third"), F.col("a").alias("tail"))
    phrases = alone.select("first", "second", none.alias("third"), "a", none.alias("head"), none.alias("tail")).unionByName(threes.join(heads, ["first", "second"]).join(tails, ["second", "third"]))
    for i, c in enumerate(("first", "second", "third")):
        word = dictionary.select(F.col("id").alias(c), F.col("word").alias(f"w{i}"), F.col("f").alias(f"f{i}"), *(["lang"] if i == 0 else []))
        phrases = phrases.join(word, c, "left" if c == "third" else "inner")
    part = lambda left, right: F.struct(left.alias("l"), right.alias("r"))
    cuts = F.when(F.col("third").isNull(), F.array(part(F.col("f0"), F.col("f1")))).otherwise(F.array(part(F.col("f0"), F.col("tail")), part(F.col("head"), F.col("f2"))))
    big = lambda c: f"CAST({c} AS DECIMAL(19, 0))"
    scored = F.expr(f"transform(cuts, (c, k) -> struct({big('a')} * {big('a')} * 1000000 div ({big('c.l')} * {big('c.r')}) AS score, k, c.l AS l, c.r AS r))")
    best = phrases.withColumn("cuts", cuts).select("lang", F.concat_ws(" ", "w0", "w1", "w2").alias("phrase"), "a", F.array_min(scored).alias("c")).select("lang", "phrase", "a", "c.l", "c.r", "c.score")
    best = written(best.withColumns({"_score": -F.col("score"), "_a": -F.col("a")}), "phrases")
    ranked = numbered(best, ["lang"], ["_score", "_a", "phrase"], "ranked").where(F.col("nth") < top)
    return ranked.join(totals, "lang").select("lang", (F.col("nth") + 1).alias("rank"), "phrase", "a", "l", "r", "n", "score")


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(table(spark, sf_dir, "documents"))


OP12_SQL = f"""
WITH d AS (SELECT coalesce(lang, '{NO_LANGUAGE}') AS lang, unnest(string_split_regex(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[.,;:!?\\x0A-\\x0D]')) AS piece FROM documents),
p AS (SELECT lang, regexp_extract_all(piece, '[^\\x20\\x09]+') AS w FROM d),
g AS (SELECT lang, k, w[i:i + k - 1] AS g FROM p, (VALUES (1), (2), (3)) t(k), LATERAL (SELECT unnest(range(1, len(w) - k + 2)) AS i)),
f AS MATERIALIZED (SELECT lang, k, g, count(*) AS f FROM g GROUP BY ALL),
n AS (SELECT lang, sum(f)::BIGINT AS n FROM f WHERE k = 1 GROUP BY lang),
c AS (SELECT * FROM f WHERE k > 1 AND f >= {LEAST}),
s AS (SELECT c.lang, c.g, c.k, c.f AS a, x.f AS l, y.f AS r, len(x.g) AS cut, 1000000::HUGEINT * c.f * c.f // (x.f::HUGEINT * y.f) AS score
  FROM c, (VALUES (1), (2)) t(cut) JOIN f x ON x.lang = c.lang AND x.g = c.g[1:t.cut] JOIN f y ON y.lang = c.lang AND y.g = c.g[t.cut + 1:] WHERE t.cut < c.k),
b AS (SELECT lang, g, k, a, arg_min(l, (score, cut)) AS l, arg_min(r, (score, cut)) AS r, min(score) AS score FROM s GROUP BY lang, g, k, a),
o AS (SELECT lang, g[1:2] AS g, f FROM c WHERE k = 3 UNION ALL SELECT lang, g[2:3], f FROM c WHERE k = 3),
m AS (SELECT lang, g, max(f) AS f FROM o GROUP BY ALL),
z AS (SELECT b.*, array_to_string(b.g, ' ') AS phrase FROM b LEFT JOIN m ON b.k = 2 AND m.lang = b.lang AND m.g = b.g WHERE m.f IS NULL OR 100 * m.f < {COVER} * b.a)
SELECT lang, rank, phrase, a, l, r, n, CAST(score AS BIGINT) AS score FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM z)
  JOIN n USING (lang) WHERE rank <= {TOP}
"""
