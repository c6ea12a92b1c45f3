"""Operator 9: language identification by the nearest of several centroids per language.

A text becomes counts of hashed byte 2- to 4-grams of its lower-cased letters, weighted by TF-IDF and
normalised to length 1. Each learned language has a few centroids, found by spherical k-means over a
bounded sample of its labelled texts. A text gets the language of the centroid with the highest cosine;
it is rejected if that cosine is below what most of the centroid's own texts reach at its length, less a margin.
What they reach is measured on pieces of the sample's texts, each without its own text's share in the centroid.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tijolo.llm.common import small_batches, table, written

#: Labelled texts a language, at most, that the classifier is fitted on, those with the least hash of the key.
SAMPLE = 1000
DIM, CENTROIDS, ROUNDS = 4096, 4, 8
#: Bytes of the pieces that limits are measured on; between them, limits go by the logarithm of the length.
SIZES = [2**k for k in range(2, 14)]
#: A text is rejected if 1 - cosine is over the quantile NEAR of such pieces plus the share SLACK of what is left up to 1.
NEAR, SLACK = 0.9, 0.35
#: Documents of the query that it learns from.
FOLDS, HELD_OUT = 4, 2

_STEP = 1 << 20
ADDED = ("lang_pred", "score", "rejected")


def letters(text: str | None) -> bytes:
    """Lower-cased letters, each other run a blank; empty if there are no letters."""
    if not text:
        return b""
    raw = text.lower().encode("utf-8", "replace").translate(_LETTERS)
    if not any(c.isalpha() for c in text):
        return b""
    return b" " + raw + b" "


_LETTERS = bytes(b if 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256))


def stream(text: str | None) -> np.ndarray:
    """Bytes of the distinct words of letters, in the order in which they first come, a blank around each. Repeats tell nothing of
    the language, and would make a text of a few repeated words look like no other of its length."""
    words = dict.fromkeys(letters(text).split())
    return np.frombuffer(b" " + b" ".join(words) + b" " if words else b"", np.uint8)


def gram_counts(text: str | None) -> np.ndarray | None:
    """Counts of hashed 2-, 3- and 4-grams of bytes; whole text, in steps of bounded memory."""
    a = stream(text)
    return stream_counts(a) if len(a) else None


def stream_counts(a: np.ndarray) -> np.ndarray:
    out = np.zeros(DIM, np.int64)
    for lo in range(0, len(a), _STEP):
        x = a[lo : lo + _STEP + 3].astype(np.uint32)
        two = x[:-1] << 8 | x[1:]
        three = (two[:-1] << 8 | x[2:]) if len(x) > 2 else two[:0]
        four = (three[:-1] << 8 | x[3:]) if len(x) > 3 else two[:0]
        for k, g in ((1, two), (2, three), (3, four)):
            h = (g[:_STEP] * np.uint32(0x9E3779B1) + np.uint32(k * 0x85EBCA6B & 0xFFFFFFFF)) >> np.uint32(20)
            out += np.bincount(h, minlength=DIM)
    return out


def pieces(a: np.ndarray, seed: int) -> list[bytes]:
    """One piece of each of SIZES that the stream is long enough for, from the start of a word if one is near."""
    out = []
    for n in SIZES:
        if len(a) < n:
            break
        at = seed % (len(a) - n + 1)
        blanks = np.flatnonzero(a[at : min(at + 64, len(a) - n + 1)] == 32)
        at += int(blanks[0]) if len(blanks) else 0
        out.append(a[at : at + n].tobytes())
    return out


def vectors(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    x = np.log1p(counts).astype(np.float32) * idf
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)


def fit(train: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", sample: int = SAMPLE) -> dict:
    """Model from rows with non-null lang: at most `sample` texts a language, chosen by
    a hash, then k-means language by language on the executors. What comes to the driver is the model:
    DIM weights, and CENTROIDS vectors a language. A language without a text of letters is not learned."""
    limit = train.where(F.col(lang).isNotNull()).groupBy(F.col(lang).alias("lang")).agg(F.count(F.lit(1)).alias("n"))
    # The threshold on a uniform hash lets about 1.2 * sample rows a language through; a window then trims them to `sample`.
    share = (F.lit(1.2 * sample + 100) / F.col("n")) * F.lit(2.0**63)
    chosen = train.where(F.col(lang).isNotNull()).withColumn("h", F.xxhash64(F.col(key), F.col(text)).bitwiseAND(F.lit(2**63 - 1)))
    chosen = chosen.select(F.col(lang).alias("lang"), F.col(text).alias("text"), "h").join(F.broadcast(limit), "lang").where(F.col("h").cast("double") <= share).drop("n")

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            got = [(g, h, stream_counts(a).astype(np.float32).tobytes(), b"".join(pieces(a, h))) for g, h, a in zip(pdf["lang"], pdf["h"], map(stream, pdf["text"])) if len(a)]
            yield pd.DataFrame(got, columns=["lang", "h", "counts", "pieces"])

    counted = chosen.mapInPandas(count, "lang string, h bigint, counts binary, pieces binary")
    nth = F.row_number().over(Window.partitionBy("lang").orderBy("h", "counts"))
    counted = written(counted.withColumn("nth", nth).where(F.col("nth") <= sample).drop("nth", "h"), "lang-sample")

    def df(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        n, seen = 0, np.zeros(DIM, np.int64)
        for pdf in batches:
            for c in pdf["counts"]:
                n, seen = n + 1, seen + (np.frombuffer(c, np.float32) > 0)
        yield pd.DataFrame({"n": [n], "seen": [seen.tolist()]})

    parts = counted.select("counts").mapInPandas(df, "n bigint, seen array<bigint>").collect()  # one row a partition of the bounded sample
    n, seen = sum(p.n for p in parts), np.sum([p.seen for p in parts] or [np.zeros(DIM)], axis=0)
    idf = (np.log((1 + n) / (1 + seen)) + 1).astype(np.float32)

    def cluster(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["counts", "pieces"])
        x = vectors(np.array([np.frombuffer(c, np.float32) for c in pdf["counts"]]), idf)
        c = seeds(x)
        for _ in range(ROUNDS):
            c /= np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-12)
            own = (x @ c.T).argmax(axis=1)
            c = np.array([x[own == k].mean(axis=0) if (own == k).any() else c[k] for k in range(len(c))])
        found = reach(x, own, c, pdf["pieces"].tolist(), idf)
        c /= np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-12)
        return pd.DataFrame({"lang": pdf["lang"].iat[0], "centroid": [v.astype(np.float32).tobytes() for v in c], "reach": found.tolist()})

    found = sorted(counted.groupBy("lang").applyInPandas(cluster, "lang string, centroid binary, reach array<double>").collect(), key=lambda r: (r.lang, r.centroid))
    near = np.array([r.reach for r in found]).reshape(-1, len(SIZES))
    return {
        "idf": idf, "langs": [r.lang for r in found],
        "centroids": np.array([np.frombuffer(r.centroid, np.float32) for r in found]).reshape(-1, DIM),
        "limits": near + SLACK * (1 - near),
    }


def seeds(x: np.ndarray) -> np.ndarray:
    """Start of the centroids: the mean of all, then the mean of a twentieth of the texts about one that is farther
    than nine of ten from those before. A single outlier is none."""
    out = [x.mean(axis=0)]
    while len(out) < min(CENTROIDS, len(x)):
        c = np.array(out)
        c /= np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-12)
        far = np.argsort(-(x @ c.T).max(axis=1), kind="stable")[int(0.9 * (len(x) - 1))]
        about = np.argsort(-(x @ x[far]), kind="stable")[: max(1, len(x) // 20)]
        out.append(x[about].mean(axis=0))
    return np.array(out)


def reach(x: np.ndarray, own: np.ndarray, means: np.ndarray, cut: list[bytes], idf: np.ndarray) -> np.ndarray:
    """Quantile NEAR of 1 - cosine of pieces to their nearest centroid, a row a centroid and a column a size. A piece meets
    the centroid of its text without that text. No centroid reaches farther than its language's pieces do, so that one
    of a few odd texts is no way in; where no piece is of a size, the next smaller size counts."""
    n = np.bincount(own, minlength=len(means))
    unit = means / np.maximum(np.linalg.norm(means, axis=1, keepdims=True), 1e-12)
    out, at = np.ones((len(means), len(SIZES))), 0
    for j, size in enumerate(SIZES):
        rows = [i for i, p in enumerate(cut) if len(p) >= at + size]
        if not rows:
            out[:, j] = out[:, j - 1] if j else 1.0
            continue
        v = vectors(np.array([stream_counts(np.frombuffer(cut[i], np.uint8, size, at)) for i in rows]), idf)
        near, k = v @ unit.T, own[rows]
        rest = n[k][:, None] * means[k] - x[rows]
        rest /= np.maximum(np.linalg.norm(rest, axis=1, keepdims=True), 1e-12)
        near[np.arange(len(rows)), k] = np.where(n[k] > 1, (v * rest).sum(axis=1), 0)
        best, far = near.argmax(axis=1), 1 - near.max(axis=1)
        whole = np.quantile(far, NEAR)
        out[:, j] = [min(whole, np.quantile(far[best == c], NEAR)) if (best == c).sum() >= 20 else whole for c in range(len(means))]
        at += size
    return out.clip(0, 1)


def limit(limits: np.ndarray, length: int) -> float:
    return float(np.interp(np.log2(max(1, length)), np.log2(SIZES), limits))


def identify(docs: DataFrame, model: dict, text: str = "text") -> DataFrame:
    """docs with lang_pred, score (cosine, 0 to 1), distance and rejected added.

    Null, empty or letterless text is `und` with score 0 and is rejected, as is every text if nothing was learned.
    Other texts carry the nearest language even if rejected for their distance. Ties go to the first language. Columns of
    docs named lang_pred, score or rejected are replaced.
    """
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # bounded by languages * CENTROIDS * DIM

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            streams = [stream(t) for t in batch.column(text).to_pylist()]
            lengths, counts = [len(a) for a in streams], [stream_counts(a) if len(a) else None for a in streams]
            some = [i for i, c in enumerate(counts) if c is not None and len(m["langs"])]
            pred, score, far = ["und"] * len(streams), [0.0] * len(streams), [True] * len(streams)
            for lo in range(0, len(some), 256):
                rows = some[lo : lo + 256]
                near = vectors(np.array([counts[i] for i in rows]), m["idf"]) @ m["centroids"].T
                best = near.argmax(axis=1)
                for i, b, s in zip(rows, best, near[np.arange(len(rows)), best]):
                    pred[i], score[i], far[i] = m["langs"][b], float(min(1.0, max(0.0, s))), bool(1 - s > limit(m["limits"][b], lengths[i]))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(pred, pa.string()), pa.array(score, pa.float64()), pa.array(far, pa.bool_())], names=[*batch.schema.names, *ADDED]
            )

    rest = docs.drop(*ADDED)
    added = T.StructType.fromDDL("lang_pred string, score double, rejected boolean")
    return rest.mapInArrow(run, T.StructType([*rest.schema.fields, *added.fields]))  # Arrow keeps other columns as they are, large integers beside nulls too


def held_out(key: str = "doc_id"):
    return F.coalesce(F.crc32(F.col(key).cast("string").cast("binary")) % FOLDS == HELD_OUT, F.lit(False))


def op9_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = fit(docs.where(~held_out()))
    found = identify(docs.select("doc_id", held_out().alias("held_out"), "text"), model)
    return found.select("doc_id", "held_out", "lang_pred", "score", "rejected")
