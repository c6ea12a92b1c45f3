"""Operator 12 against plain counting and against its SQL: stripes of any size, cut stripes, odd rows."""

import re
from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.conftest import DATA
from tijolo.llm import collocations as C

LOWER = {i: i + 32 for i in range(65, 91)}


def brute(rows, least, cover, top):
    grams, n, out = {}, Counter(), []
    for lang, text in rows:
        for piece in re.split("[.,;:!?\n\x0b\x0c\r]", (text or "").translate(LOWER)):
            words = [w for w in re.split("[ \t]", piece) if w]
            for k in (1, 2, 3):
                grams.setdefault(lang or "und", Counter()).update(tuple(words[i : i + k]) for i in range(len(words) - k + 1))
            n[lang or "und"] += len(words)
    for lang, f in grams.items():
        candidates = [(g, a) for g, a in f.items() if len(g) > 1 and a >= least]
        covering = Counter()
        for g, a in candidates:
            if len(g) == 3:
                for part in (g[:2], g[1:]):
                    covering[part] = max(covering[part], a)
        rated = []
        for g, a in candidates:
            if len(g) == 2 and g in covering and 100 * covering[g] >= cover * a:
                continue
            score, _, left, right = min((10**6 * a * a // (f[g[:k]] * f[g[k:]]), k, f[g[:k]], f[g[k:]]) for k in range(1, len(g)))
            rated.append((-score, -a, " ".join(g).encode(), left, right))
        for i, (score, a, phrase, left, right) in enumerate(sorted(rated)[:top]):
            out.append((lang, i + 1, phrase.decode(), -a, left, right, n[lang], -score))
    return sorted(out)


def rows_of(df):
    return sorted(map(tuple, df.collect()))


def test_whole_table_equals_brute_force_and_sql(spark):
    got = rows_of(C.op12_collocations(spark, DATA))
    docs = spark.read.parquet(f"{DATA}/documents.parquet").select("lang", "text").collect()
    assert got == brute(docs, C.LEAST, C.COVER, C.TOP) and got
    con = duckdb.connect()
    con.sql(f"create view documents as select * from '{DATA}/documents.parquet'")
    assert sorted(con.sql(C.OP12_SQL).fetchall()) == got


@pytest.mark.parametrize("sizes", [{}, {"chunk": 7, "slot": 3, "hot": 1}, {"chunk": 50, "slot": 10, "hot": 3}])
def test_stripes_of_any_size_and_odd_rows(spark, sizes):
    rng = np.random.default_rng(5)
    words = ["the", "THE", "of", "a.b", "é", "x\x1cy", "漢字", "of\tthe", "and,", "New York", "\x0b", "'s"]
    rows = [(rng.choice(["en", "de", None]), " ".join(rng.choice(words, rng.integers(0, 40)))) for _ in range(60)]
    rows = [(None if a is None else str(a), t) for a, t in rows] + [("en", None), ("fr", ""), ("en", " \t\n. "), *[("en", "to be or not to be to be")] * 6, ("und", "of the of the of the"), ("es", "la la la " * 30_000)]
    docs = spark.createDataFrame(rows, "lang string, text string").withColumns({c: F.lit(1) for c in ("n", "word", "phrase", "rank", "first")})
    for least, cover, top in ((2, 50, 2000), (5, 80, 7)):
        assert rows_of(C.collocations(docs, least, cover, top, **sizes)) == brute(rows, least, cover, top)
    assert C.collocations(docs.limit(0)).collect() == [] and C.collocations(docs, least=10**6).collect() == []


def test_scores_beyond_64_bits(spark):
    """Counts of 2e12, whose squares times a million pass 64 bits, from stripes that are merged already."""
    a = 2 * 10**12
    merged = spark.createDataFrame([(0, 1, -1, a, 0), (1, 0, -1, 50, 0)], "first bigint, second bigint, third bigint, n bigint, longest bigint")
    words = spark.createDataFrame([("en", "x", a + 1, 0), ("en", "y", a + 7, 1)], "lang string, word string, f bigint, id bigint")
    totals = spark.createDataFrame([("en", 3 * a)], "lang string, n bigint")
    got = {r.phrase: r.score for r in C._report(merged, words, totals, 10, 50, 10).collect()}
    assert got == {"x y": 10**6 * a * a // ((a + 1) * (a + 7)), "y x": 10**6 * 2500 // ((a + 1) * (a + 7))}


def test_triples_of_large_vocabularies():
    p, q, z = (np.array(x, np.int64) for x in ([5, 5, 3 * 10**6], [1, 1, 2], [0, 0, 3 * 10**6]))
    for v in (1 << 20, 1 << 22):
        keep = slice(0, 2 if v < 3 * 10**6 else 3)
        got = [x.tolist() for x in C._distinct(p[keep], q[keep], z[keep], v)]
        assert list(zip(*got))[0] == (5, 1, 0, 2) and len(got[0]) == (1 if v < 3 * 10**6 else 2)
