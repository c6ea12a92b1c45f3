"""Operator 2: a Katz backoff model of n-grams, counted and evaluated over chunks of documents.

Documents are packed into chunks of bounded size: the chunk's distinct words and its token sequence. A chunk
asks, once for each of its distinct n-grams of every order, for the corpus counts; requests are dealt by ranges of
64-bit hashes, so the most frequent n-gram is asked for once a chunk and no key is hot. Counts, and for each history
its backoff weight, are kept in tables partitioned by order and hash range, and are sent back in the order asked.

P(w | h) = d(c) c(hw) / C(h) if the n-gram hw was seen, else backoff(h) P(w | h'), where h' is h without its first word, and so on down
to P(w) = d(c) c(w) / N, or the mass that discounting leaves if w was not seen; a history that was not seen has P(w | h) = P(w | h'). d
is the Good-Turing discount of counts up to GT, of each order from its own counts of counts. backoff(h) = (1 - sum of P(w | h) of seen
n-grams) / (1 - sum of P(w | h') of their words) makes each history sum to 1 exactly: the sums are kept as whole
numbers, as h' of a seen history was seen with the same words. Where discounting leaves nothing, one is added to C(h) or N. A text is scored
from start marks to an end, which is a token like others.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tijolo.llm.common import bucketed, fresh_path, partitions, small_batches, table, written
from tijolo.llm.near_duplicates import _grouped

#: Counts up to GT are discounted; tokens a chunk holds before it is closed.
GT, CHUNK = 5, 1_500_000
#: Longest n-gram; tokens of the corpus for each hash range.
ORDER, RANGE = 2, 4_000_000
FOLDS, HELD_OUT = 10, 0

_MAP = bytes(b + 32 if 0x41 <= b <= 0x5A else b for b in range(256))
# A word has no line feed, so these stand for no word.
_END, _START = (np.uint64(xxhash.xxh3_64_intdigest(x)) for x in (b"\nend", b"\nstart"))


class _Ids(dict):
    def __missing__(self, word: bytes) -> int:
        value = self[word] = len(self)
        return value


# --- packed arrays


def pack(a: np.ndarray) -> bytes:
    """Bytes of equal significance side by side, compressed."""
    a = np.ascontiguousarray(a)
    return zstandard.compress(np.ascontiguousarray(a.view(np.uint8).reshape(len(a), -1).T).tobytes(), 1) if len(a) else b""


def unpack(b: bytes, kind: type) -> np.ndarray:
    if not b:
        return np.zeros(0, kind)
    raw = np.frombuffer(zstandard.decompress(b), np.uint8)
    return np.ascontiguousarray(raw.reshape(np.dtype(kind).itemsize, -1).T).reshape(-1).view(kind)


def pack_keys(keys: np.ndarray) -> bytes:
    return pack(np.diff(keys, prepend=np.uint64(0)))


def unpack_keys(b: bytes) -> np.ndarray:
    return np.cumsum(unpack(b, np.uint64), dtype=np.uint64)


def _parts(keys: np.ndarray, n: int) -> np.ndarray:
    """Bounds of the n hash ranges in sorted keys."""
    return np.searchsorted((keys >> np.uint64(32)) * np.uint64(n) >> np.uint64(32), np.arange(n + 1))


# --- chunks


def _chunks(docs: DataFrame, chunk_tokens: int) -> DataFrame:
    """chunk, docs, held, lengths (tokens with the end), vocab (sorted hashes) and tokens (places in vocab)."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        first, count = TaskContext.get().partitionId() << 32, 0
        ids, seqs, names, held, size = _Ids(), [], [], [], 0

        def close() -> pd.DataFrame:
            hashes = np.append(np.fromiter(map(xxhash.xxh3_64_intdigest, ids), np.uint64, len(ids)), [_END, _START])
            vocab, place = np.unique(hashes, return_inverse=True)
            place = place.astype(np.int32)
            tokens = np.concatenate([x for s in seqs for x in (place[s], place[-2:-1])])
            return pd.DataFrame({"chunk": [first + count], "docs": [names], "held": [held], "lengths": [[len(s) + 1 for s in seqs]], "vocab": [pack_keys(vocab)], "tokens": [pack(tokens)]})

        for pdf in batches:
            for name, h, text in zip(pdf["doc_id"].astype(object), pdf["held"], pdf["text"]):
                words = (text or "").encode("utf-8", "surrogatepass").translate(_MAP).split()
                seqs.append(np.fromiter(map(ids.__getitem__, words), np.int32, len(words)))
                names.append(None if pd.isna(name) else name), held.append(bool(h))
                size += len(words) + 1
                if size >= chunk_tokens:
                    yield close()
                    count += 1
                    ids, seqs, names, held, size = _Ids(), [], [], [], 0
        if seqs:
            yield close()

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.mapInPandas(run, f"chunk bigint, docs array<{kind}>, held array<boolean>, lengths array<int>, vocab binary, tokens binary")


def _mixed(history: np.ndarray, word: np.ndarray) -> np.ndarray:
    """Key of a history's key and a word's hash."""
    with np.errstate(over="ignore"):
        keys = history * np.uint64(0x9E3779B97F4A7C15) + (word ^ word >> np.uint64(29)) * np.uint64(0xD6E8FEB86659FD93)
        keys = (keys ^ keys >> np.uint64(32)) * np.uint64(0xBF58476D1CE4E5B9)
        return keys ^ keys >> np.uint64(31)


class _Chunk:
    """A chunk's n-grams of each order up to `order`, sorted by key.

    For order n: keys[n]; at[n], the n-gram that ends at each token; for n of 2 or more h[n], the histories' places in
    histories[n], which has the n-grams of the order below and, at its end, start marks alone; low[n], the places of
    the n-grams without their first word in keys[n - 1].
    """

    def __init__(self, row: pd.Series, order: int):
        vocab, tokens = unpack_keys(row["vocab"]), unpack(row["tokens"], np.int32).astype(np.int64)
        lengths = np.asarray(row["lengths"], np.int64)
        self.starts = np.concatenate([[0], np.cumsum(lengths)[:-1]])
        self.train = np.repeat(~np.asarray(row["held"], bool), lengths)
        self.keys, self.at, self.h, self.low, self.histories = {1: vocab}, {1: tokens}, {}, {}, {}
        pad = np.array([_START])
        for n in range(2, order + 1):
            self.histories[n] = np.append(self.keys[n - 1], pad)
            before = np.empty_like(tokens)
            before[1:] = self.at[n - 1][:-1]
            before[self.starts] = len(self.keys[n - 1])
            code, first, at = np.unique(before * len(vocab) + tokens, return_index=True, return_inverse=True)
            h, w = np.divmod(code, len(vocab))
            keys = _mixed(self.histories[n][h], vocab[w])
            order_ = np.argsort(keys)
            place = np.empty(len(order_), np.int64)
            place[order_] = np.arange(len(order_))
            self.keys[n], self.h[n], self.low[n], self.at[n] = keys[order_], h[order_], self.at[n - 1][first][order_], place[at]
            pad = _mixed(pad, np.array([_START]))

    def counts(self) -> dict[int, tuple[np.ndarray, np.ndarray]]:
        return {n: (k, np.bincount(self.at[n][self.train], minlength=len(k)).astype(np.uint64)) for n, k in self.keys.items()}


def _ask(chunks: DataFrame, n: int, order: int) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for _, row in pdf.iterrows():
                out = []
                for kind, (keys, counts) in _Chunk(row, order).counts().items():
                    cut = _parts(keys, n)
                    out += [(kind * n + p, row["chunk"], pack_keys(keys[a:b]), pack(counts[a:b])) for p, (a, b) in enumerate(zip(cut[:-1], cut[1:])) if b > a]
                yield pd.DataFrame(out, columns=["bucket", "chunk", "keys", "counts"])

    return chunks.select("chunk", "held", "lengths", "vocab", "tokens").mapInPandas(run, "bucket bigint, chunk bigint, keys binary, counts binary")


def _count(pdf: pd.DataFrame) -> pd.DataFrame:
    """Corpus counts of one hash range: an answer for each chunk, with a mark where the chunk is the first to have
    seen the key in training, and the range's table with its counts of counts 1 to GT + 1, total and distinct keys."""
    out = []
    for bucket, rows in pdf.groupby("bucket", sort=False):
        keys = [unpack_keys(k) for k in rows["keys"]]
        names, at = np.unique(np.concatenate(keys), return_inverse=True)
        counts = np.concatenate([unpack(c, np.uint64) for c in rows["counts"]]).astype(np.int64)
        totals = np.zeros(len(names), np.int64)
        np.add.at(totals, at, counts)  # whole numbers, as a sum of doubles is exact up to 2^53 only
        seen = np.flatnonzero(counts)
        owner = np.zeros(len(at), bool)
        first = np.full(len(names), -1)
        first[at[seen][::-1]] = seen[::-1]
        owner[first[first >= 0]] = True
        edges = np.concatenate([[0], np.cumsum([len(k) for k in keys])])
        for chunk, a, b in zip(rows["chunk"], edges[:-1], edges[1:]):
            out.append((bucket, chunk, None, pack(totals[at[a:b]].astype(np.uint64)), pack(np.packbits(owner[a:b])), None))
        some = totals > 0
        stats = [*np.bincount(np.minimum(totals, GT + 2), minlength=GT + 3)[1 : GT + 2].tolist(), int(totals.sum()), int(some.sum())]
        out.append((bucket, -1, pack_keys(names[some]), pack(totals[some].astype(np.uint64)), None, stats))
    return pd.DataFrame(out, columns=["bucket", "chunk", "keys", "counts", "owner", "stats"])


def good_turing(counts_of_counts: list[int]) -> tuple[np.ndarray, str]:
    """Discounts of counts 0 to GT + 1 (1 from there on), and how they were found.

    `katz k`: Katz's form for counts up to k, the largest k of GT or less at which all discounts are between 0 and 1; counts
    above k are reliable and not discounted. If there is none, `smoothed`: the Good-Turing discounts of a line fitted to
    the logarithms of the counts of counts, (1 + 1 / r) to the power of its slope + 1. If its slope is not below -1, or two
    counts of counts are 0 so that there is no line, the counts tell nothing and 1 - 1 / (2 r) is taken: `fixed`.
    """
    n = [0, *counts_of_counts]
    for k in range(min(GT, len(n) - 2), 1, -1):
        if all(n[1 : k + 2]) and (cut := (k + 1) * n[k + 1] / n[1]) != 1:
            out = np.ones(GT + 2)
            out[1 : k + 1] = [((r + 1) * n[r + 1] / (r * n[r]) - cut) / (1 - cut) for r in range(1, k + 1)]
            if all(0 < d < 1 for d in out[1 : k + 1]):
                return out, f"katz {k}"
    out, r = np.ones(GT + 2), np.arange(1, GT + 1)
    some = [i for i in range(1, len(n)) if n[i]]
    if len(some) > 1 and (slope := np.polyfit(np.log(some), np.log([n[i] for i in some]), 1)[0]) < -1:
        out[1 : GT + 1] = (1 + 1 / r) ** (slope + 1)
        return out, "smoothed"
    out[1 : GT + 1] = 1 - 0.5 / r
    return out, "fixed"


class Model:
    """Discounts of each order (d) and how they were found (how), and totals: a few numbers; the counts stay in the tables."""

    def __init__(self, stats: dict[int, list[int]], order: int = 2):
        of = {n: stats.get(n) or [0] * (GT + 3) for n in range(1, order + 1)}
        found = {n: good_turing(x[: GT + 1]) for n, x in of.items()}
        self.d, self.how = {n: d for n, (d, _) in found.items()}, {n: how for n, (_, how) in found.items()}
        one = of[1]
        self.tokens, self.types = one[GT + 1], one[GT + 2]
        lost = sum((1 - self.d[1][r]) * r * one[r - 1] for r in range(1, GT + 1))
        self.n1 = self.tokens + (lost < 1e-9)
        self.unknown = 1 - (self.tokens - lost) / self.n1 if self.tokens else 1.0

    def word(self, c: np.ndarray) -> np.ndarray:
        """P of words with these counts; those not seen are one class."""
        return np.where(c > 0, self.d[1][np.minimum(c, GT + 1)] * c / max(1, self.n1), self.unknown)

    def history(self, n: int, c: np.ndarray, small: np.ndarray, words: np.ndarray, rare: np.ndarray, below: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(denominator, backoff weight) of histories of n-grams, seen c times, of whose n-grams small[:, r-1] were seen r times. These n-grams without
        their first word were seen `words` times in all and rare[:, r-1] of them r times, of `below`, the lower order's denominator."""
        r = np.arange(1, GT + 1)
        lost = small @ ((1 - self.d[n][1 : GT + 1]) * r)
        total = c + (lost < 1e-9)
        left = 1 - (c - lost) / np.maximum(1, total)
        lower = (words - rare @ ((1 - self.d[n - 1][1 : GT + 1]) * r)) / np.maximum(1, below)
        return np.where(c > 0, total, 0), np.where(c > 0, left / np.maximum(1 - lower, 1e-300), 1.0)


def _answers(column_rows, kind: int, n: int, name: str, of: type) -> np.ndarray:
    mine = sorted((r["bucket"], r[name]) for r in column_rows if r["bucket"] // n == kind)
    return np.concatenate([unpack(b, of) for _, b in mine]) if mine else np.zeros(0, of)


def _owners(column_rows, counts: list[int]) -> np.ndarray:
    out = [np.unpackbits(unpack(b, np.uint8))[:k].astype(bool) for b, k in zip(column_rows, counts)]
    return np.concatenate(out) if out else np.zeros(0, bool)


def _told(row: pd.Series, c: _Chunk, order: int, n: int) -> tuple[dict[int, np.ndarray], dict[int, np.ndarray]]:
    """(denominators, backoff weights) of the chunk's histories, of the orders up to `order`, in their places."""
    totals, weights = {}, {}
    for k in range(2, order + 1):
        back = np.argsort(np.argsort(c.histories[k], kind="stable"), kind="stable")
        totals[k] = _answers(row[f"histories{k}"], 0, n, "totals", np.uint64).astype(np.int64)[back]
        weights[k] = _answers(row[f"histories{k}"], 0, n, "weights", np.float64)[back]
    return totals, weights


def _sum_histories(chunks: DataFrame, n: int, order: int, model: Model) -> DataFrame:
    """Asks for every history of the n-grams of an order, and gives what the chunk's own n-grams (those it saw first) add to it,
    and the lower order's denominator."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for _, row in pdf.iterrows():
                c, got = _Chunk(row, order), row["got"]
                seen, lower = (_answers(got, k, n, "counts", np.uint64).astype(np.int64) for k in (order, order - 1))
                mine = sorted((r["bucket"], r["owner"], len(unpack(r["counts"], np.uint64))) for r in got if r["bucket"] // n == order)
                own = np.flatnonzero(_owners([m[1] for m in mine], [m[2] for m in mine]))
                h, v, below = c.h[order][own], len(c.histories[order]), lower[c.low[order][own]]
                sums = np.zeros((v, 3 + 2 * GT), np.int64)
                np.add.at(sums[:, 0], h, seen[own])
                np.add.at(sums[:, 1], h, below)
                for r in range(1, GT + 1):
                    sums[:, 1 + r] = np.bincount(h[seen[own] == r], minlength=v)
                    sums[:, 1 + GT + r] = np.bincount(h[below == r], minlength=v)
                if order == 2:
                    sums[:, -1] = model.n1
                else:
                    totals, _ = _told(row, c, order - 1, n)
                    sums[:, -1] = totals[order - 1][np.append(c.low[order - 1], len(c.histories[order - 1]) - 1)]
                at = np.argsort(c.histories[order], kind="stable")
                keys, sums = c.histories[order][at], sums[at]
                cut = _parts(keys, n)
                yield pd.DataFrame([(p, row["chunk"], pack_keys(keys[a:b]), pack(sums[a:b].T.reshape(-1))) for p, (a, b) in enumerate(zip(cut[:-1], cut[1:])) if b > a], columns=["bucket", "chunk", "keys", "sums"])

    return chunks.mapInPandas(run, "bucket bigint, chunk bigint, keys binary, sums binary")


def _weigh(model: Model, order: int):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        out = []
        for bucket, rows in pdf.groupby("bucket", sort=False):
            keys = [unpack_keys(k) for k in rows["keys"]]
            names, at = np.unique(np.concatenate(keys), return_inverse=True)
            sums = np.concatenate([unpack(s, np.int64).reshape(3 + 2 * GT, -1) for s in rows["sums"]], axis=1)
            total = np.zeros((len(names), 2 + 2 * GT), np.int64)
            for i in range(2 + 2 * GT):
                np.add.at(total[:, i], at, sums[i])
            below = np.zeros(len(names), np.int64)
            np.maximum.at(below, at, sums[-1])
            c, weight = model.history(order, total[:, 0], total[:, 2 : 2 + GT], total[:, 1], total[:, 2 + GT :], below)
            edges = np.concatenate([[0], np.cumsum([len(k) for k in keys])])
            for chunk, a, b in zip(rows["chunk"], edges[:-1], edges[1:]):
                out.append((bucket, chunk, None, pack(c[at[a:b]].astype(np.uint64)), pack(weight[at[a:b]])))
            some = c > 0
            out.append((bucket, -1, pack_keys(names[some]), pack(c[some].astype(np.uint64)), pack(weight[some])))
        return pd.DataFrame(out, columns=["bucket", "chunk", "keys", "totals", "weights"])

    return run


def _evaluate(chunks: DataFrame, model: Model, n: int, order: int, kind: str) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for _, row in pdf.iterrows():
                c = _Chunk(row, order)
                totals, weights = _told(row, c, order, n)
                one = _answers(row["got"], 1, n, "counts", np.uint64).astype(np.int64)
                p = model.word(one)
                for k in range(2, order + 1):
                    seen, h = _answers(row["got"], k, n, "counts", np.uint64).astype(np.int64), c.h[k]
                    p = np.where(seen > 0, model.d[k][np.minimum(seen, GT + 1)] * seen / np.maximum(1, totals[k][h]), weights[k][h] * p[c.low[k]])
                logs = np.log10(np.maximum(p, 1e-300))
                base = np.log10((one + 0.1) / (model.tokens + 0.1 * (model.types + 1)))
                tokens = c.at[1]
                per = lambda x: np.add.reduceat(x, c.starts)
                yield pd.DataFrame({
                    "doc_id": pd.Series(list(row["docs"]), dtype=object), "held_out": list(row["held"]), "n_tokens": list(row["lengths"]), "n_known": per((one[tokens] > 0).astype(np.int64)),
                    "train_tokens": model.tokens, "base_score": per(base[tokens]), "score": per(logs[c.at[order]]),
                })

    return chunks.mapInPandas(run, f"doc_id {kind}, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double")


def held_out(key: Column) -> Column:
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % FOLDS == HELD_OUT, F.lit(False))


def score_corpus(
    docs: DataFrame, key: str = "doc_id", text: str = "text", order: int = ORDER, chunk_tokens: int = CHUNK, range_tokens: int = RANGE,
) -> tuple[DataFrame, DataFrame, list[DataFrame], Model]:
    """(scores, counts, histories, model): scores of all rows by a model of n-grams up to `order`, 2 or more, learned from the rows whose key is
    not held out, and the model's tables, partitioned by kind or hash range: packed keys, counts, and for each order from 2 on its histories'
    denominators and backoff weights; the discounts are in the model.

    Null or empty text is one token, the end. A row with a null key is learned from. Repeated rows count as often as
    they are there. Without a training row every word is unknown and has probability 1. Other columns are dropped. Counts are 64-bit.
    """
    if order < 2:
        raise ValueError("the order is 2 or more")
    spark = docs.sparkSession
    small_batches(spark)
    rows = docs.select(F.col(key).alias("doc_id"), held_out(F.col(key)).alias("held"), F.col(text).alias("text"))
    # bucketed by chunk, so that answers come to the chunks and the chunks need not be shuffled again
    chunks = bucketed(_chunks(rows, chunk_tokens), "chunk", "lm-chunks")
    tokens = chunks.select(F.aggregate("lengths", F.lit(0).cast("long"), lambda s, x: s + x).alias("n")).agg(F.sum("n")).first()[0] or 0
    n = max(partitions(spark), -(-tokens // range_tokens))
    schema = "bucket bigint, chunk bigint, keys binary, counts binary, owner binary, stats array<bigint>"
    path = fresh_path(spark, "lm-counts")
    asked = _grouped(_ask(chunks, n, order), "bucket", _count, schema)
    order_of = F.floor(F.col("bucket") / n).cast("int")
    asked.withColumn("kind", F.when(F.col("chunk") >= 0, 0).otherwise(order_of)).write.partitionBy("kind").parquet(path)
    counted = spark.read.schema(f"{schema}, kind int").parquet(path)
    tables = counted.where("kind > 0")
    of = lambda i: F.sum(F.col("stats")[i]).alias(f"s{i}")
    stats = {r["kind"]: [r[f"s{i}"] for i in range(GT + 3)] for r in tables.groupBy("kind").agg(*[of(i) for i in range(GT + 3)]).collect()}
    model = Model(stats, order)
    answers = counted.where("kind = 0")
    got = answers.groupBy("chunk").agg(F.collect_list(F.struct("bucket", "counts", "owner")).alias("got"))
    sent, histories = [], []

    def told(rows: DataFrame, answers: DataFrame) -> DataFrame:
        for x in (answers, *sent):
            rows = rows.join(x.hint("shuffle_merge"), "chunk")
        return rows

    needed = chunks.select("chunk", "held", "lengths", "vocab", "tokens")
    for k in range(2, order + 1):
        summed = _sum_histories(told(needed, got), n, k, model)
        weighed = _grouped(summed, "bucket", _weigh(model, k), "bucket bigint, chunk bigint, keys binary, totals binary, weights binary")
        weighed = written(weighed, "lm-histories")
        sent.append(weighed.where("chunk >= 0").groupBy("chunk").agg(F.collect_list(F.struct("bucket", "totals", "weights")).alias(f"histories{k}")))
        histories.append(weighed.where("chunk < 0"))
    light = answers.groupBy("chunk").agg(F.collect_list(F.struct("bucket", "counts")).alias("got"))
    return _evaluate(told(chunks, light), model, n, order, rows.schema["doc_id"].dataType.simpleString()), tables, histories, model


def op2_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_corpus(table(spark, sf_dir, "documents"))[0]
