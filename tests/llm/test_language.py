"""Rejection by distance: noise goes at every length, clean texts stay."""

import base64
import random
import re

import numpy as np

from tests.conftest import DATA
from tijolo.llm import language


def test_noise_is_rejected_and_clean_text_stays(spark):
    rng = random.Random(2)
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    word = lambda lo, hi: "".join(chr(rng.randint(lo, hi)) for _ in range(rng.randint(2, 10)))
    noise = {
        "letters": lambda: word(0x61, 0x7A), "base64": lambda: base64.b64encode(rng.randbytes(6)).decode(),
        "cyrillic": lambda: word(0x430, 0x44F), "cjk": lambda: word(0x4E00, 0x9FFF),
    }
    rows = [(kind, " ".join(make() for _ in range(n))) for kind, make in noise.items() for n in (5, 50, 300) for _ in range(20)]
    # texts that do not repeat a few words, as the table's junk does
    clean = [w for w in (r.text.split() for r in docs.where(language.held_out()).collect()) if len(w) > 300 and len(set(w)) > 0.3 * len(w)]
    rows += [("clean", " ".join(w[at : at + n])) for w in clean for n in (5, 50, 300) for at in [rng.randint(0, len(w) - n)]]
    found = language.identify(spark.createDataFrame(rows, "kind string, text string"), language.fit(docs.where(~language.held_out()))).collect()
    share = {k: sum(r.rejected for r in found if r.kind == k) / sum(r.kind == k for r in found) for k in [*noise, "clean"]}
    assert all(share[k] >= 0.95 for k in noise) and share["clean"] <= 0.05, share


def test_repeats_and_licence_lines_are_not_rejected(spark):
    """Nearly all of the table is kept: of the language that it says, repeats of a few words among it."""
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    model = language.fit(docs.where(~language.held_out()))
    found = language.identify(docs.select("lang", "text"), model).where("lang_pred <> 'und'").collect()
    assert sum(r.rejected for r in found) < 0.01 * len(found) and sum(r.lang == r.lang_pred for r in found) > 0.99 * len(found)
    words = docs.where("lang = 'en'").first().text.split()[:8]
    again = spark.createDataFrame([(" ".join(words * n),) for n in (1, 3, 50, 5000)], "text string")
    assert {r.rejected for r in language.identify(again, model).collect()} == {False}
    assert language.stream("A b, a B c c-c").tobytes() == b" a b c " and len(language.stream("12 !")) == 0 and language.stream("é").tobytes() == " é ".encode()


def test_predictions_equal_plain_cosines(spark):
    """The nearest centroid by cosine of plain TF-IDF vectors, and the limit of its length."""
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    m = language.fit(docs.where(~language.held_out()))
    for r in language.identify(docs.where(language.held_out()).select("text"), m).limit(40).collect():
        words = list(dict.fromkeys(re.findall(rb"[a-z\x80-\xff]+", r.text.lower().encode())))
        text, v = b" " + b" ".join(words) + b" ", np.zeros(language.DIM)
        for k in (2, 3, 4):
            for i in range(len(text) - k + 1):
                h = int.from_bytes(text[i : i + k], "big") * 0x9E3779B1 + (k - 1) * 0x85EBCA6B & 0xFFFFFFFF
                v[h >> 20] += 1
        v = np.log1p(v) * m["idf"]
        near = m["centroids"] @ v / np.linalg.norm(v)
        best = int(near.argmax())
        assert r.lang_pred == m["langs"][best] and abs(r.score - near[best]) < 1e-4
        assert r.rejected == (1 - near[best] > np.interp(np.log2(len(text)), np.log2(language.SIZES), m["limits"][best]))
