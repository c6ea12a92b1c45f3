import math
import re
from collections import Counter, defaultdict

import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from tests.conftest import DATA
from tests.llm.test_operators import brute_components, low
from tijolo.llm import language, mixing


def brute_contaminated(texts, items, n=10):
    words = {i: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low(t)) for i, t in texts.items()}
    windows = set()
    for t in items:
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low(t))
        windows |= {tuple(w[k : k + n]) for k in range(max(1, len(w) - n + 1))} if w else set()
    lengths = {len(w) for w in windows}
    return {i for i, w in words.items() if any(tuple(w[k : k + m]) in windows for m in lengths for k in range(len(w) - m + 1))}


def brute_cells(rows):
    """Copies of each (source, size), by bisection of each source's tilt; rows: (source, size)."""
    cells = defaultdict(Counter)
    for source, size in rows:
        cells[source][size] += 1
    names = sorted(cells, key=lambda s: (s is None, s or ""))
    total = {s: sum(k * n for k, n in cells[s].items()) for s in names}
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    target, free = {}, list(names)
    while free:
        left = 1.5 * sum(total.values()) - sum(2 * total[s] for s in names if s not in free)
        shares = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        over = [s for s in free if shares[s] > 2 * total[s]]
        target |= {s: 2 * total[s] for s in over} if over else shares
        free = [s for s in free if s not in over] if over else []
    out = {}
    for s in names:
        mean = total[s] / sum(cells[s].values()) or 1.0
        rate = lambda tilt, size: 1.0 if size == 0 else min(2.0, math.exp(min(1.0, tilt * size / mean)))
        low_, high = -700.0, 700.0
        for _ in range(200):
            tilt = (low_ + high) / 2
            low_, high = (tilt, high) if sum(k * n * rate(tilt, k) for k, n in cells[s].items()) < target[s] else (low_, tilt)
        run, before, left, spare = 0.0, 0, target[s], {}
        for size in sorted(cells[s], reverse=True):
            n, base = cells[s][size], math.floor(rate(tilt, size) + 1e-9)
            run += (rate(tilt, size) - base) * n
            extra = min(n, math.floor(run + 1e-7) - before)
            before = math.floor(run + 1e-7)
            out[s, size] = base * n + extra
            spare[size] = (2 - base) * n - extra
            left -= size * out[s, size]
        for size in sorted(spare, reverse=True):
            fits = min(spare[size], math.floor(left / size)) if size and spare[size] > 0 else 0
            if fits > 0:
                out[s, size] += fits
                left -= fits * size
    return out


def brute_shard(key, shards):
    def chain(*longs):
        h = 42
        for x in longs:
            h = xxhash.xxh64((x % 2**64).to_bytes(8, "little"), seed=h).intdigest()
        return h

    state, at, following = chain(key), 0, 0
    while following < shards:
        at = following
        following = math.floor((at + 1) / (1 - (chain(state, at) >> 11) / 2**53))
    return at


def test_run_equals_brute_force(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    items = [r.text for r in spark.read.parquet(f"{DATA}/benchmark.parquet").collect()]
    # what the fitted model rejects is taken from the operator
    rows = {r.doc_id: r for r in language.identify(docs, language.fit(docs)).where("not rejected").collect()}
    assert 0.9 * docs.count() < len(rows)
    component = brute_components({i: r.text for i, r in rows.items()}, 5)
    kept = {i: r for i, r in rows.items() if component[i] == i}
    hit = brute_contaminated({i: r.text for i, r in kept.items()}, items)
    assert len(kept) < len(rows) and hit
    clean = {i: r for i, r in kept.items() if i not in hit}
    cell = {i: (r.source, len(re.findall(r"[^\x20\x09-\x0D]+", r.text or ""))) for i, r in clean.items()}
    want, rows_of = brute_cells(cell.values()), Counter(cell.values())

    got = corpus_pipeline.run(spark, DATA).collect()
    copies = Counter(r.doc_id for r in got)
    assert set(copies) <= set(clean)
    reached = Counter()
    for i, n in copies.items():
        reached[cell[i]] += n
    assert reached == Counter({c: n for c, n in want.items() if n})
    for i, c in cell.items():
        assert copies[i] - want[c] // rows_of[c] in (0, 1), i
    for r in got:
        assert (r.shard, r.grown_shard) == (brute_shard(r.doc_id, 8), brute_shard(r.doc_id, 9))
        assert r.size == len((clean[r.doc_id].text or "").encode()) + 1
    for s in range(8):
        assert sorted(r.slot for r in got if r.shard == s) == list(range(sum(r.shard == s for r in got)))


def test_mixing_of_repeated_rows(spark):
    rows = [(None, "one two three four", None)] * 301 + [(7, "one two", "a")] * 5 + [(i, "word " * i, "ab"[i % 2]) for i in range(30)]
    docs = spark.createDataFrame([(*r, k) for k, r in enumerate(rows)], "doc_id bigint, text string, source string, k int").repartition(5)
    want = mixing.mix(docs).groupBy("doc_id", "source", "size").agg(F.sum("copies").alias("n")).where("n > 0").collect()
    got = corpus_pipeline.mix_sources(spark, docs, DATA).collect()
    assert Counter((r.doc_id, r.source, mixing_size(r.text)) for r in got) == {(r.doc_id, r.source, r.size): r.n for r in want}
    times = Counter(r.k for r in got if r.doc_id is None)
    assert max(times.values()) - min(times[k] for k in range(301)) <= 1


def mixing_size(text):
    return len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))


SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, copies int, rejected boolean, shard int, doc string, `a.b` int, kept int, _n_words int"
OTHER = (1, True, 2, "x", 2**31 - 1, 3, 4)
ODD = [
    (1, None, None, None, None), (2, "", "en", "a", 0), (None, "the cat sat on the mat and looked at the dog", "en", None, 2**53 + 1), (3, "the cat sat on the mat and looked at the dog", "en", "a", 44),
    (3, "the cat sat on the mat and looked at the dog", "en", "a", 44), (4, "a dog ran over the hill to find the old red house", "en", "b", 49), (5, "12 34 !", None, "b", 7),
]


def test_stages_of_odd_rows(spark):
    docs = spark.createDataFrame([(*r, *OTHER) for r in ODD], SCHEMA)
    given = set(docs.collect())
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, docs, DATA)
        assert after.columns == docs.columns and set(after.collect()) <= given, name
        assert stage(spark, docs.limit(0), DATA).count() == 0, name
    kept = corpus_pipeline.drop_near_duplicates(spark, docs, DATA).collect()
    assert sorted(str(r.doc_id) for r in kept) == ["1", "2", "3", "4", "5", "None"]
    assert corpus_pipeline.identify_language(spark, docs, DATA).where("doc_id in (1, 2, 5)").isEmpty()
    assert set(corpus_pipeline.decontaminate(spark, docs, DATA).collect()) == given
    assert corpus_pipeline.deal_shards(spark, docs, DATA).count() == len(ODD)
