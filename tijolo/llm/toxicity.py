"""Operator 10: classifier chains over toxicity categories.

Categories are predicted in order by linear models; the probabilities of earlier categories are inputs of
later ones. When a later model is fitted, those inputs are out-of-fold predictions, as the earlier model
would otherwise seem better than it is. Inputs are the presence of words, of word beginnings and of
classes of the text's shape; the few thousand that tell a category apart best are kept.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tijolo.llm.common import small_batches, table, written

#: Labelled documents that the chain is fitted on, at most: those with the least hash of the key.
SAMPLE = 6000
#: Features kept a category, least documents of a feature, folds, gradient steps, penalty.
KEPT, LEAST, FOLDS, STEPS, PENALTY = 800, 3, 4, 600, 1e-4
STEMS = (3, 4, 5, 6)
#: The share of documents without a category that may be taken for ones with it. The probability from which on a document has the category is
#: the least that keeps to this among out-of-fold predictions of the fitted sample, so no label decides about itself.
FALSE_ALARMS = 0.01

_WORD = re.compile(r"[^\W\d_]+")
_CACHE = 300_000


def word_features(word: str) -> list[int]:
    return [xxhash.xxh3_64_intdigest(f"{n}:{word[:n]}") >> 1 for n in STEMS if len(word) > n] + [xxhash.xxh3_64_intdigest(f"w:{word}") >> 1]


def shape_features(text: str, words: list[str], distinct: int) -> list[int]:
    n = max(1, len(text))
    letters = sum(map(len, words))
    upper = sum(map(str.isupper, words)) / max(1, len(words))
    classes = (("letters", int(10 * letters / n)), ("upper", int(5 * upper)), ("repeats", int(10 * distinct / max(1, len(words)))), ("length", n.bit_length()))
    return [xxhash.xxh3_64_intdigest(f"s:{k}:{v}") >> 1 for k, v in classes]


def features(text: str | None, of_word=word_features) -> set[int]:
    words = _WORD.findall(text or "")
    distinct = {w.lower() for w in set(words)}
    out = set(shape_features(text or "", words, len(distinct)))
    for w in distinct:
        out.update(of_word(w))
    return out


def _logistic(x: np.ndarray, y: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Weights of several models, a column each, the last one the intercept, by accelerated gradient steps. rows: a column
    each, which rows of x a model is fitted on; all models advance together, as reading x is what a step takes."""
    x = np.hstack([x, np.ones((len(x), 1), np.float32)])
    rows = rows.astype(np.float32)
    n = np.maximum(1, rows.sum(axis=0))
    rate = (1 / (0.25 * ((x * x).sum(axis=1) @ rows) / n + PENALTY)).astype(np.float32)
    w = last = np.zeros((x.shape[1], rows.shape[1]), np.float32)
    penalty = np.full((x.shape[1], 1), PENALTY, np.float32)
    penalty[-1] = 0
    for t in range(STEPS):
        ahead = w + np.float32(t / (t + 3)) * (w - last)
        off = (1 / (1 + np.exp(-np.clip(x @ ahead, -30, 30))) - y[:, None]) * rows
        last, w = w, (ahead - rate * (x.T @ off / n + penalty * ahead)).astype(np.float32)
    return w


def _predict(x: np.ndarray, w: np.ndarray) -> np.ndarray:
    return (1 / (1 + np.exp(-np.clip(x @ w[:-1] + w[-1], -30, 30)))).astype(np.float32)


def fit_chain(x: np.ndarray, y: np.ndarray, fold: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """(a weight vector for each column of y, out-of-fold predictions of each): the k-th model's inputs are x and the out-of-fold
    predictions of the k columns before. A fold without rows, or with all of them, has 0."""
    models, inputs = [], x
    held = [fold == f for f in range(FOLDS)]
    held = [h for h in held if h.any() and not h.all()]
    for k in range(y.shape[1]):
        fitted = _logistic(inputs, y[:, k], np.stack([np.ones(len(x), bool), *(~h for h in held)], axis=1))
        models.append(fitted[:, 0])
        out = np.zeros(len(x), np.float32)
        for i, h in enumerate(held):
            out[h] = _predict(inputs[h], fitted[:, i + 1])
        inputs = np.hstack([inputs, out[:, None]])
    return models, inputs[:, x.shape[1] :]


def threshold(p: np.ndarray, y: np.ndarray, false_alarms: float) -> float:
    """The least probability from which on at most so many of the rows with y 0 are taken, and 0.5 at most; 0.5 if there are none."""
    without = np.sort(p[y == 0])[::-1]
    if not len(without):
        return 0.5
    return float(min(0.5, np.nextafter(without[int(false_alarms * len(without))], np.float32(1))))


def fit(labelled: DataFrame, categories: list[str], key: str = "doc_id", text: str = "text", sample: int = SAMPLE, false_alarms: float = FALSE_ALARMS) -> dict:
    """Chain, and the probability from which on a document has each category, from rows with a 0/1 column for each category, at most `sample` of them. Rows with a null category are
    left out; without rows every probability is 0.5. Counting and choosing features is Spark's work; what comes to
    the driver is at most KEPT features a category and the sample's rows over those."""
    rows = labelled.select(F.col(key).alias("k"), F.col(text).alias("text"), *[F.col(c).cast("int").alias(f"y{i}") for i, c in enumerate(categories)]).dropna(subset=[f"y{i}" for i in range(len(categories))])
    ys = [f"y{i}" for i in range(len(categories))]

    def extract(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pdf.drop(columns="text").assign(found=[list(features(t)) for t in pdf["text"]])

    found = rows.mapInPandas(extract, f"k {rows.schema['k'].dataType.simpleString()}, {', '.join(f'{c} int' for c in ys)}, found array<bigint>")
    found = written(found, "tox-sample")
    total = found.agg(F.count(F.lit(1)).alias("n"), *[F.sum(c).alias(c) for c in ys]).first()
    if not total.n:
        return {"index": {}, "models": None, "categories": categories, "thresholds": [0.5] * len(ys)}
    seen = found.select(*ys, F.explode("found").alias("f")).groupBy("f").agg(F.count(F.lit(1)).alias("n"), *[F.sum(c).alias(c) for c in ys]).where(F.col("n") >= LEAST)
    index: dict[int, int] = {}
    for c in ys:
        with_, without = F.col(c) + 0.5, F.col("n") - F.col(c) + 0.5
        odds = F.log(with_ / (total[c] - F.col(c) + 1.0)) - F.log(without / (total.n - total[c] - F.col("n") + F.col(c) + 1.0))
        for r in seen.orderBy(F.desc(F.abs(odds) / F.sqrt(1 / with_ + 1 / without)), "f").limit(KEPT).collect():
            index.setdefault(r.f, len(index))
    chosen = found.select("k", *ys, F.array_intersect("found", F.array(*[F.lit(f) for f in index])).alias("found")).orderBy("k").limit(sample).collect()
    x = np.zeros((len(chosen), len(index)), np.float32)
    for i, r in enumerate(chosen):
        x[i, [index[f] for f in r.found]] = 1
    y = np.array([[r[c] for c in ys] for r in chosen], np.float32)
    fold = np.array([xxhash.xxh3_64_intdigest(f"fold:{r.k}") % FOLDS for r in chosen])
    models, held = fit_chain(x, y, fold)
    return {"index": index, "models": models, "categories": categories, "thresholds": [threshold(held[:, k], y[:, k], false_alarms) for k in range(len(ys))]}


def probabilities(at: list[list[int]], models: list[np.ndarray], width: int) -> np.ndarray:
    """Of each category, for documents with the features `at`, all of them at once."""
    sizes = np.array([len(a) for a in at], np.int64)
    doc, flat = np.repeat(np.arange(len(at)), sizes), np.fromiter((i for a in at for i in a), np.int64, int(sizes.sum()))
    p = np.zeros((len(at), len(models)))
    for k, w in enumerate(models):
        z = np.bincount(doc, w[flat], len(at)) + p[:, :k] @ w[width : width + k] + w[-1]
        p[:, k] = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
    return p


def score(docs: DataFrame, model: dict, text: str = "text") -> DataFrame:
    """docs with a column p_<category> each; columns of docs with such names are replaced. Null or empty text has the shape features of an empty text only."""
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # KEPT weights a category
    names = [f"p_{c}" for c in model["categories"]]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m, cache = shared.value, {}
        index = m["index"]

        def of_word(w: str) -> list[int]:
            got = cache.get(w)
            if got is None:
                if len(cache) >= _CACHE:
                    cache.clear()
                got = cache[w] = [f for f in word_features(w) if f in index]
            return got

        for pdf in batches:
            if m["models"] is None:
                yield pdf.assign(**{c: 0.5 for c in names})
                continue
            at = [[index[f] for f in features(t, of_word) if f in index] for t in pdf[text]]
            p = probabilities(at, m["models"], len(index))
            yield pdf.assign(**{c: p[:, k] for k, c in enumerate(names)})

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields if f.name not in names)
    return docs.drop(*names).mapInPandas(run, f"{fields}, {', '.join(f'{c} double' for c in names)}")


def labelled_sample(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, key: str = "doc_id") -> DataFrame:
    """docs joined to at most `sample` labels, those with the least hash of the key; so few are broadcast. Where a key has several
    labels the greatest of each category counts, so that a rerun gives the same rows."""
    once = labels.groupBy(key).agg(*[F.max(c).alias(c) for c in labels.columns if c != key])
    few = once.orderBy(F.xxhash64(key), key).limit(sample)
    return docs.join(F.broadcast(few), key)


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = table(spark, sf_dir, "labels").select("doc_id", (1 - F.col("quality")).alias("low_quality"), "toxic")
    model = fit(labelled_sample(docs, labels), ["low_quality", "toxic"])
    return score(docs, model).select("doc_id", "p_low_quality", "p_toxic", (F.col("p_toxic") >= model["thresholds"][1]).alias("toxic"))
