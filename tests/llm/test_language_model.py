"""Operator 2 at other orders than its query's, and its counts beyond 32 bits."""

import re
import zlib
from collections import Counter

import numpy as np
import pandas as pd
import pytest

from tests.conftest import DATA
from tijolo.llm import language_model as L

LOWER = {i: i + 32 for i in range(65, 91)}
START, END = 1, 0


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER)) + [END]


class Brute:
    """Katz backoff of any order, written as the recursion it is, with the model's discounts."""

    def __init__(self, texts, order, d):
        self.d, self.count = d, {n: Counter() for n in range(1, order + 1)}
        for w in texts:
            for n, c in self.count.items():
                padded = [START] * (n - 1) + w
                c.update(tuple(padded[i : i + n]) for i in range(len(w)))
        one = self.count[1]
        self.n = sum(one.values())
        kept = sum(self.discount(1, c) * c for c in one.values())
        self.unknown = 1 - kept / self.n
        self.total, self.kept, self.below, self.known = {}, {}, {}, {}
        for n in range(2, order + 1):
            total, kept, below = Counter(), Counter(), Counter()
            for g, c in self.count[n].items():
                total[g[:-1]] += c
                kept[g[:-1]] += self.discount(n, c) * c
            self.total[n] = {h: t + (t - kept[h] < 1e-9) for h, t in total.items()}
            self.kept[n] = kept
            for g in self.count[n]:
                below[g[:-1]] += self.p(g[1:])
            self.below[n] = below

    def discount(self, n, c):
        return self.d[n][min(c, L.GT + 1)]

    def p(self, g):
        n, c = len(g), self.count[len(g)][g]
        if n == 1:
            return self.discount(1, c) * c / self.n if c else self.unknown
        if g not in self.known:
            h = g[:-1]
            if c:
                self.known[g] = self.discount(n, c) * c / self.total[n][h]
            elif h in self.total[n]:
                self.known[g] = (1 - self.kept[n][h] / self.total[n][h]) / (1 - self.below[n][h]) * self.p(g[1:])
            else:
                self.known[g] = self.p(g[1:])
        return self.known[g]


@pytest.mark.parametrize(("order", "chunk", "span"), [(3, 5000, 300), (4, 10**6, 10**6)])
def test_scores_equal_brute_force(spark, order, chunk, span):
    docs = {r.doc_id: words(r.text) for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}
    scored, tables, histories, model = L.score_corpus(spark.read.parquet(f"{DATA}/documents.parquet"), order=order, chunk_tokens=chunk, range_tokens=span)
    train = [w for i, w in docs.items() if zlib.crc32(str(i).encode()) % 10]
    brute = Brute(train, order, model.d)
    for n, c in brute.count.items():
        got = tables.where(f"kind = {n}").select("stats").collect()
        assert sum(r.stats[L.GT + 1] for r in got) == sum(c.values()) and sum(r.stats[L.GT + 2] for r in got) == len(c)
    assert len(histories) == order - 1
    rows = scored.collect()
    assert len(rows) == len(docs)
    for r in rows:
        w = [START] * (order - 1) + docs[r.doc_id]
        want = sum(np.log10(brute.p(tuple(w[i : i + order]))) for i in range(len(docs[r.doc_id])))
        assert abs(r.score - want) < 1e-6 * max(1, r.n_tokens)


def test_every_history_sums_to_one():
    texts = [[w for w in "a b a c a b b a d".split()] + [END], ["a", "b", "c", END], ["d", "d", END]]
    flat = np.array([0, 0.6, 0.7, 0.8, 0.9, 0.95, 1.0])
    brute = Brute(texts, 3, {n: flat for n in (1, 2, 3)})
    vocabulary = {g[0] for g in brute.count[1]}
    for n in (2, 3):
        for h in brute.total[n]:
            # words that were not seen are one class at the lowest order
            left = brute.unknown
            for k in range(2, n + 1):
                s = h[-(k - 1) :]
                if s in brute.total[k]:
                    left *= (1 - brute.kept[k][s] / brute.total[k][s]) / (1 - brute.below[k][s])
            assert abs(sum(brute.p((*h, w)) for w in vocabulary) + left - 1) < 1e-9


def test_counts_beyond_32_bits():
    """Two chunks with 3e9 of one word: 6e9 in the table, in the answers and in the total."""
    key, many = np.array([7], np.uint64), np.array([3 * 10**9], np.uint64)
    asked = pd.DataFrame({"bucket": [5, 5], "chunk": [0, 1], "keys": [L.pack_keys(key)] * 2, "counts": [L.pack(many)] * 2})
    for _, r in L._count(asked).iterrows():
        assert L.unpack(r["counts"], np.uint64).tolist() == [6 * 10**9]
        assert r["stats"] is None or r["stats"][L.GT + 1] == 6 * 10**9
    exact = pd.DataFrame({"bucket": [5, 5], "chunk": [0, 1], "keys": [L.pack_keys(key)] * 2, "counts": [L.pack(np.array([2**60 + 1], np.uint64)), L.pack(np.array([1], np.uint64))]})
    assert {L.unpack(c, np.uint64)[0] for c in L._count(exact)["counts"]} == {2**60 + 2}
