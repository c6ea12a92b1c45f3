"""Operator 1: benchmark decontamination with a broadcast set of normalised n-grams.

Benchmark items become windows of word ids. Every document's words are mapped to the same ids, a
rolling hash of each window length is looked up in the sorted benchmark hashes, and each hit is
verified word by word before it marks the document's words. Items are cut into pieces that overlap by a
window, and the set is built in blocks of at most BLOCK_BYTES and one piece, by measured sizes; a benchmark
of more blocks is scanned block after block, each block against all documents, so that no broadcast grows with
the benchmark.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window

from tijolo.llm.common import LOWER, UPPER, small_batches, table, written

WINDOW = 10
BLOCK_BYTES = 8 << 20
#: Bytes that are no word byte become a blank, A-Z become a-z; bytes of 0x80 and more are word bytes.
_MAP = bytes(
    b + 32 if 0x41 <= b <= 0x5A else b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else 0x20
    for b in range(256)
)
_BASE = 0x9E3779B97F4A7C15 | 1
_SLICE = 2_000_000
#: Words that a piece of a long item starts with windows of. A piece is broadcast whole, however long its words are.
PIECE = 50_000
ADDED = {"_n_words": pa.int64(), "_spans": pa.list_(pa.list_(pa.int64())), "_items": pa.list_(pa.string())}


def words(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").translate(_MAP).split()


class Grams:
    """The windows of a bounded set of items."""

    def __init__(self, items: list[tuple[object, str | None]], n: int):
        self.ids: dict[bytes, int] = {}
        self.windows: dict[bytes, set] = {}
        for item, text in items:
            ids = [self.ids.setdefault(w, len(self.ids) + 1) for w in words(text)]
            for i in range(max(1, len(ids) - n + 1) if ids else 0):
                self.windows.setdefault(np.array(ids[i : i + n], np.int32).tobytes(), set()).add(item)
        self.hashes = {}
        for m in {len(w) // 4 for w in self.windows}:
            keys = np.array([np.frombuffer(w, np.int32) for w in self.windows if len(w) == 4 * m])
            self.hashes[m] = np.unique(np.concatenate([_rolling(k, m) for k in keys]))

    def hits(self, ids: np.ndarray) -> Iterator[tuple[int, int, set]]:
        """(first word, word after the last, items) of each verified window."""
        for m, known in self.hashes.items():
            if len(ids) < m:
                continue
            h = _rolling(ids, m)
            at = np.searchsorted(known, h)
            at[at == len(known)] = 0
            for i in np.flatnonzero(known[at] == h):
                if items := self.windows.get(ids[i : i + m].tobytes()):
                    yield int(i), int(i) + m, items


def _rolling(ids: np.ndarray, m: int) -> np.ndarray:
    """Polynomial hash of every m consecutive ids, from powers of two of the length."""
    with np.errstate(over="ignore"):
        h, width, base = ids.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93), 1, _BASE
        out, done = None, 0
        while m:
            if m & 1:
                part = h if not done else h[done:]
                size = len(ids) - done - width + 1
                out = part[:size] if out is None else out[:size] * np.uint64(base) + part[:size]
                done += width
            m >>= 1
            if m:
                h, width, base = h[:-width] * np.uint64(base) + h[width:], 2 * width, base * base & (2**64 - 1)
        return out


def scan(docs: DataFrame, items: list[tuple[object, str]], n: int, text: str = "text", first: bool = True) -> DataFrame:
    """Adds, or extends, n_words, spans (word ranges hit, merged) and items (ids as strings) of one block."""
    shared = docs.sparkSession.sparkContext.broadcast(items)  # at most BLOCK_BYTES of text and one piece
    rest = docs.drop(*ADDED)
    kept = rest.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams = Grams(shared.value, n)
        get = grams.ids.get
        for batch in batches:
            out = {name: [] for name in ADDED}
            texts = batch.column(text).to_pylist()
            before = [([], [])] * len(texts) if first else zip(batch.column("_spans").to_pylist(), batch.column("_items").to_pylist())
            for t, (spans, found) in zip(texts, before):
                w, spans, found = words(t), [tuple(s) for s in spans], set(found)
                for lo in range(0, len(w), _SLICE):  # a very long text in slices that overlap by a window
                    part = w[lo : lo + _SLICE + n - 1]
                    ids = np.fromiter((get(x, 0) for x in part), np.int32, len(part))
                    for a, b, items_hit in grams.hits(ids):
                        spans.append((lo + a, lo + b))
                        found.update(str(i) for i in items_hit if i is not None)
                merged: list[list[int]] = []
                for a, b in sorted(spans):
                    if merged and a <= merged[-1][1]:
                        merged[-1][1] = max(b, merged[-1][1])
                    else:
                        merged.append([a, b])
                out["_n_words"].append(len(w)), out["_spans"].append(merged), out["_items"].append(sorted(found))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), *(pa.array(out[c], ADDED[c]) for c in ADDED)], names=[*kept, *ADDED])

    added = T.StructType.fromDDL("_n_words bigint, _spans array<array<bigint>>, _items array<string>")
    return docs.mapInArrow(run, T.StructType([*rest.schema.fields, *added.fields]))  # Arrow keeps other columns as they are


def find(docs: DataFrame, benchmark: DataFrame, n: int = WINDOW, text: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """docs with _n_words, _spans and _items added.

    A window is n consecutive item words; an item of fewer words, but not none, is one window. Words are runs
    of lower-cased ASCII letters, digits and anything beyond ASCII. Null or empty text has no words; an item with
    a null id marks words but is not listed; repeated items count once; an empty benchmark hits nothing. Columns
    of docs that are named like those added are an error.
    """
    small_batches(docs.sparkSession)
    clash = {"_n_words", "_spans", "_items"} & set(docs.columns)
    if clash:
        raise ValueError(f"docs has columns of the result: {sorted(clash)}")
    pieces = benchmark.select(F.col(item_id).alias("i"), F.col(item_text).alias("t")).distinct().mapInPandas(_pieces(n), f"i {benchmark.schema[item_id].dataType.simpleString()}, t string, size bigint")
    pieces = written(pieces.distinct(), "benchmark-pieces")
    size = pieces.agg(F.sum("size")).first()[0] or 0
    if size <= BLOCK_BYTES:
        return scan(docs, [(r.i, r.t) for r in pieces.toLocalIterator()], n, text)
    # a block has the pieces that start in BLOCK_BYTES of a group's running size; a group has about 16 blocks
    tie = F.xxhash64("i", "t")
    running = F.sum("size").over(Window.partitionBy("g").orderBy(tie, "i", "t").rowsBetween(Window.unboundedPreceding, 0))
    dealt = pieces.withColumn("g", F.pmod(tie, F.lit(-(-size // (16 * BLOCK_BYTES))))).withColumn("b", F.floor((running - F.col("size")) / BLOCK_BYTES))
    dealt = written(dealt, "benchmark-blocks")
    for k, (g, b) in enumerate(sorted((r.g, r.b) for r in dealt.select("g", "b").distinct().collect())):  # two numbers a scan
        block = dealt.where((F.col("g") == g) & (F.col("b") == b))
        docs = written(scan(docs, [(r.i, r.t) for r in block.toLocalIterator()], n, text, first=k == 0), "decontaminated")
    return docs


def _pieces(n: int):
    """Items cut so that each window is in one piece; an item of one piece stays as it is."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for i, t in zip(pdf["i"].astype(object), pdf["t"]):
                w = words(t)
                for k in range(0, len(w) - n + 1, PIECE) if len(w) > PIECE + n else [0]:
                    piece = b" ".join(w[k : k + PIECE + n - 1])
                    rows.append((None if pd.isna(i) else i, piece.decode("utf-8", "surrogatepass"), len(piece)))
            yield pd.DataFrame({"i": pd.Series([r[0] for r in rows], dtype=object), "t": [r[1] for r in rows], "size": [r[2] for r in rows]})

    return run


def decontaminate(docs: DataFrame, benchmark: DataFrame, n: int = WINDOW, most: float = 0.0) -> DataFrame:
    """docs without the documents of which more than the share `most` of words is hit."""
    hit = F.aggregate("_spans", F.lit(0).cast("long"), lambda a, s: a + s[1] - s[0])
    return find(docs, benchmark, n).where(hit <= F.col("_n_words") * F.lit(most)).drop("_n_words", "_spans", "_items")


def remove_spans(docs: DataFrame, benchmark: DataFrame, n: int = WINDOW, text: str = "text") -> DataFrame:
    """docs with the hit words, and what stands between them, cut out of the text, until no window is left."""
    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pdf.drop(columns=["_n_words", "_spans", "_items"]).assign(**{text: [_without(t, s) for t, s in zip(pdf[text], pdf["_spans"])]})

    while True:
        found = written(find(docs, benchmark, n, text), "spans")
        if found.where(F.size("_spans") > 0).isEmpty():
            return found.drop("_n_words", "_spans", "_items")
        docs = written(found.mapInPandas(cut, docs.schema), "spans-cut")


def _without(text: str | None, spans) -> str | None:
    if text is None or not len(spans):
        return text
    raw = text.encode("utf-8", "surrogatepass")
    mask = np.frombuffer(raw.translate(_MAP), np.uint8) != 0x20
    edge = np.flatnonzero(np.diff(np.concatenate([[0], mask.view(np.int8), [0]])))
    starts, ends = edge[::2], edge[1::2]
    keep, at = [], 0
    for a, b in spans:
        keep.append(raw[at : starts[int(a)]])
        at = ends[int(b) - 1]
    return b"".join([*keep, raw[at:]]).decode("utf-8", "surrogatepass")


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = find(docs, table(spark, sf_dir, "benchmark"))
    n_hit = F.aggregate("_spans", F.lit(0).cast("long"), lambda a, s: a + s[1] - s[0])
    return found.select(
        "doc_id", F.col("_n_words").alias("n_words"), n_hit.alias("n_hit"), F.size("_items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", "_items"), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"),
    )


OP1_SQL = f"""
WITH d AS (SELECT doc_id, row_number() OVER () AS r,
    regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM benchmark),
g AS (SELECT DISTINCT item_id, least(len(w), {WINDOW}) AS m,
    array_to_string(w[i:i + least(len(w), {WINDOW}) - 1], ' ') AS gram
    FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - {WINDOW} + 1, 1) + 1)) AS i FROM b WHERE len(w) > 0)),
m AS (SELECT DISTINCT m FROM g),
p AS (SELECT r, m, i, array_to_string(w[i:i + m - 1], ' ') AS gram
    FROM (SELECT r, w, m.m, unnest(range(1, len(w) - m.m + 2)) AS i FROM d, m WHERE len(w) >= m.m)),
h AS (SELECT p.r, p.i, p.m, g.item_id FROM p JOIN g ON p.gram = g.gram AND p.m = g.m),
n AS (SELECT r, count(DISTINCT k) AS n_hit FROM (SELECT r, unnest(range(i, i + m)) AS k FROM h) GROUP BY r),
t AS (SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
    FROM (SELECT DISTINCT r, CAST(item_id AS VARCHAR) AS item FROM h WHERE item_id IS NOT NULL) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
    CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN n USING (r) LEFT JOIN t USING (r)
"""
