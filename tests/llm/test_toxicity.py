"""The share of upper-case words is of all words of a text, however long it is."""

import numpy as np
import xxhash

from tijolo.llm import toxicity


def upper(words):
    got = toxicity.shape_features(" ".join(words), words, len(set(words)))
    return [v for v in range(12) if xxhash.xxh3_64_intdigest(f"s:upper:{v}") >> 1 in got]


def test_upper_share_of_long_texts():
    assert upper(["AB", "cd"] * 50) == upper(["AB", "cd"] * 450) == upper(["cd", "AB"] * 2000) == [2]
    assert upper(["ab"] * 900 + ["CD"] * 100) == [0] and upper(["AB"] * 999) == [5]


def test_chain_equals_a_plain_one():
    """Inputs of later models are out-of-fold predictions of earlier ones; thresholds keep false alarms to the share asked for."""
    rng = np.random.default_rng(4)
    x = (rng.random((120, 6)) < 0.4).astype(np.float32)
    y = np.stack([x[:, 0] + rng.random(120) > 0.8, x[:, 1] * x[:, 0] + rng.random(120) > 0.9], axis=1).astype(np.float32)
    fold = rng.integers(0, toxicity.FOLDS, 120)
    models, held = toxicity.fit_chain(x, y, fold)

    def plain(inputs, target, rows, of):  # full gradient descent, to the same optimum
        a = np.hstack([inputs, np.ones((len(inputs), 1))])
        w = np.zeros(a.shape[1])
        for _ in range(20_000):
            p = 1 / (1 + np.exp(-a[rows] @ w))
            w -= 0.5 * (a[rows].T @ (p - target[rows]) / len(rows) + toxicity.PENALTY * np.append(w[:-1], 0))
        return w, 1 / (1 + np.exp(-a[of] @ w))

    every, inputs = np.arange(120), x.astype(float)
    for k in range(2):
        w, p = plain(inputs, y[:, k], every, every)
        assert np.allclose(toxicity._predict(inputs, models[k]), p, atol=0.02)
        out = np.zeros(120)
        for f in range(toxicity.FOLDS):
            of = np.flatnonzero(fold == f)
            out[of] = plain(inputs, y[:, k], np.flatnonzero(fold != f), of)[1]
        assert np.allclose(held[:, k], out, atol=0.03)
        inputs = np.hstack([inputs, held[:, k : k + 1]])
    at = [np.flatnonzero(r).tolist() for r in x[:10]] + [[]]
    got = toxicity.probabilities(at, models, 6)
    for i, a in enumerate(at):
        p = []
        for w in models:
            p.append(1 / (1 + np.exp(-(sum(w[j] for j in a) + sum(w[6 + j] * q for j, q in enumerate(p)) + w[-1]))))
        assert np.allclose(got[i], p)


def test_threshold_keeps_false_alarms():
    p = np.arange(1, 101, dtype=np.float32) / 250
    y = (np.arange(100) % 2).astype(np.float32)
    for share in (0.0, 0.01, 0.1):
        t = toxicity.threshold(p, y, share)
        assert (p[y == 0] >= t).sum() == int(share * 50)
    assert toxicity.threshold(p[:0], y[:0], 0.01) == toxicity.threshold(np.ones(5, np.float32), np.zeros(5), 0.01) == 0.5


def test_a_very_long_text_and_nothing(spark):
    docs = spark.createDataFrame([(i, ("bad " if i % 2 else "good ") * 30 + str(i), i % 2) for i in range(60)], "doc_id long, text string, toxic int")
    long = spark.createDataFrame([(1, "bad word " * 400_000), (2, ""), (3, None)], "doc_id long, text string")
    got = {r.doc_id: r.p_toxic for r in toxicity.score(long, toxicity.fit(docs, ["toxic"])).collect()}
    assert got[1] > 0.5 and got[2] == got[3]
