"""Operator 5: suffix-array removal of byte strings that repeat anywhere.

A byte goes if a LENGTH-byte string that covers it also starts elsewhere; bytes covered by shorter strings of SHORT
bytes that do (passages of about forty words and more) are reported, not removed. Every SHORT-byte window is classed by its
anchor, the 48-byte string inside it with the least hash; equal windows have equal anchors, so a window whose
anchor occurs once is unique. Windows that follow one another with one anchor form a context, which reaches as far
as LENGTH bytes from its last window; contexts that are equal as a whole are repeats and fold into one. Of the
remaining contexts of a class, those go on that agree with another one, left and right of the anchor, in SHORT
bytes or more. Their suffixes are sorted in two stages: those smaller than their successor directly, the others
induced by a scan of the buckets; windows are repeats where the common prefix with a neighbour is long enough.

A class of more than CLASS different contexts is first cut into shorter runs of windows and classed by all
the bytes that those share, at last into single windows, so that no task holds an unbounded class.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tijolo.llm.common import small_batches, table, written
from tijolo.llm.near_duplicates import _grouped

LENGTH, GRAM = 400, 48
SHORT = 3 * LENGTH // 5
#: Different contexts of a class that one task compares, at most; runs of windows that larger classes are cut into.
CLASS, STEPS = 512, (64, 16, 4, 1)
#: Bytes whose suffixes are sorted at once (a class always together) and of a text that are looked at at once.
BLOCK, SLICE = 1 << 20, 1 << 22

_TABLE = np.array([xxhash.xxh3_64_intdigest(bytes([b])) for b in range(256)], np.uint64)
_POS = np.uint64(24)


def _gram_hashes(a: np.ndarray, m: int) -> np.ndarray:
    """Mixed polynomial hashes of every m bytes, from powers of two of the length."""
    h, width, base, done, out = _TABLE[a], 1, 0x9E3779B97F4A7C15, 0, None
    while m:
        if m & 1:
            size = len(a) - done - width + 1
            out = h[done:][:size] if out is None else out[:size] * np.uint64(base) + h[done:][:size]
            done += width
        m >>= 1
        if m:
            h, width, base = h[:-width] * np.uint64(base) + h[width:], 2 * width, base * base & (2**64 - 1)
    out = (out ^ out >> np.uint64(32)) * np.uint64(0xD6E8FEB86659FD93)
    return out ^ out >> np.uint64(29)


def contexts(raw: bytes, length: int = LENGTH, short: int = SHORT) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of each run of `short`-byte windows with one anchor: first and last window, anchor hash, and hash of the bytes up to
    `length` from the last window, or to the end of the text. Runs cover all windows."""
    starts, stops, anchors, digests = [], [], [], []
    gram, view = min(GRAM, short // 2), memoryview(raw)
    for lo in range(0, max(0, len(raw) - short + 1), SLICE):
        a = np.frombuffer(raw, np.uint8, min(len(raw) - lo, SLICE + short - 1), lo)
        out = _gram_hashes(a, gram)
        # leftmost least hash in each window: hash above, place below
        least = (out >> _POS << _POS) | np.arange(len(out), dtype=np.uint64)
        span, w = short - gram + 1, 1
        while 2 * w <= span:
            least, w = np.minimum(least[:-w], least[w:]), 2 * w
        if w < span:
            least = np.minimum(least[: len(least) - (span - w)], least[span - w :])
        at = (least & np.uint64((1 << 24) - 1)).astype(np.int64)
        first = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
        last = np.append(first[1:], len(at)) - 1
        starts.append(first + lo)
        stops.append(last + lo)
        anchors.append(out[at[first]].view(np.int64))
        digests.append(np.fromiter((xxhash.xxh3_64_intdigest(view[i : j + length]) for i, j in zip((first + lo).tolist(), (last + lo).tolist())), np.uint64, len(first)).view(np.int64))
    if not starts:
        return tuple(np.zeros(0, np.int64) for _ in range(4))
    return tuple(map(np.concatenate, (starts, stops, anchors, digests)))


# --- two-stage suffix sorting


def suffix_array(raw: bytes, depth: int = LENGTH, wanted: np.ndarray | None = None) -> np.ndarray:
    """Suffixes in order of their first `depth` bytes at least. Where only some are `wanted` (a mask), they and those
    that induce them are sorted: of each wanted one that is larger than its successor, the next ones up to a smaller one."""
    t = np.frombuffer(raw, np.uint8).astype(np.int16)
    n = len(t)
    if n == 0:
        return np.zeros(0, np.int64)
    # smaller[i]: suffix i is smaller than its successor; equal bytes take after the next unequal ones
    step = np.diff(t)
    at = np.where(step != 0, np.arange(n - 1), n)
    at = np.minimum.accumulate(at[::-1])[::-1]
    smaller = np.append(np.where(at < n, np.append(step, -1)[np.minimum(at, n - 1)] > 0, False), False)
    if wanted is None:
        wanted = np.ones(n, bool)
    else:
        nearest = np.minimum.accumulate(np.where(smaller, np.arange(n), n - 1)[::-1])[::-1]
        ends = np.flatnonzero(wanted & ~np.append(wanted[1:], False))
        change = np.zeros(n + 1, np.int32)
        np.add.at(change, ends, 1)
        np.add.at(change, nearest[ends] + 1, -1)
        wanted = wanted | (np.cumsum(change[:-1]) > 0)
    direct = np.array(sorted(np.flatnonzero(smaller & wanted).tolist(), key=lambda i: raw[i : i + depth]), np.int64)
    ends = np.searchsorted(t[direct], np.arange(257))
    induced: list[list[np.ndarray]] = [[] for _ in range(256)]
    if wanted[-1]:
        induced[t[-1]].append(np.array([n - 1]))  # after the empty suffix
    order = []
    for c in range(256):
        own = direct[ends[c] : ends[c + 1]]
        if not len(own) and not induced[c]:
            continue
        wave = np.concatenate(induced[c]) if induced[c] else own[:0]
        while len(wave):  # runs of the byte induce inside their bucket
            order.append(wave)
            before = wave[wave > 0] - 1
            before = before[wanted[before]]
            following = before[t[before] == c]
            larger = before[t[before] > c]
            _deal(induced, larger, t)
            wave = following
        order.append(own)
        before = own[own > 0] - 1
        _deal(induced, before[wanted[before] & (t[before] > c)], t)
    return np.concatenate([*order, np.zeros(0, np.int64)])


def _deal(induced: list[list[np.ndarray]], suffixes: np.ndarray, t: np.ndarray) -> None:
    if not len(suffixes):
        return
    by = suffixes[np.argsort(t[suffixes], kind="stable")]
    cuts = np.flatnonzero(np.diff(t[by])) + 1
    for part in np.split(by, cuts):
        induced[t[part[0]]].append(part)


def common_prefixes(raw: bytes, suffixes: np.ndarray, most: int) -> np.ndarray:
    """Bytes, up to `most`, that each suffix has in common with the one before it; counted in steps of 8 below `most`."""
    padded = np.frombuffer(raw + bytes(most + 8), np.uint8)
    words = np.lib.stride_tricks.as_strided(padded, (len(raw) + most, 8), (1, 1))
    out = np.zeros(len(suffixes), np.int64)
    p, q, alive = suffixes[:-1], suffixes[1:], np.arange(len(suffixes) - 1)
    for k in range(0, most, 8):
        size = min(8, most - k)
        a, b = words[p[alive] + k, :size], words[q[alive] + k, :size]
        alive = alive[(a == b).all(axis=1)]
        if not len(alive):
            break
        out[alive + 1] = k + size
    return out


def _runs(mask: np.ndarray) -> list[tuple[int, int]]:
    edge = np.flatnonzero(np.diff(np.concatenate([[0], mask.astype(np.int8), [0]])))
    return list(zip(edge[::2].tolist(), edge[1::2].tolist()))


def repeated_windows(parts: list[bytes], windows: list[int] | None = None, length: int = LENGTH, short: int = SHORT) -> list[tuple[list, list]]:
    """Of each part, runs (from, to) of its first `windows` windows (all by default) that equal another such window of any
    part: those of `length` bytes and those of `short` bytes."""
    raw = b"".join(parts)
    at = np.concatenate([[0], np.cumsum([len(p) for p in parts])])
    windows = [len(p) for p in parts] if windows is None else windows
    starts = {size: np.zeros(len(raw), bool) for size in (short, length)}
    for size, whole in starts.items():
        for a, b, n in zip(at[:-1].tolist(), at[1:].tolist(), windows):
            whole[a : max(a, min(a + n, b - size + 1))] = True
    sa, hits = suffix_array(raw, max(length, short), starts[min(starts)]), []
    for size, whole in ((short, starts[short]), (length, starts[length])):
        mine = sa[whole[sa]]
        same = common_prefixes(raw, mine, size) >= size
        hit = np.zeros(len(raw), bool)
        hit[mine[same]] = True
        hit[mine[:-1][same[1:]]] = True
        hits.append(hit)
        if length >= short:  # only these can agree in more bytes
            sa = mine[hit[mine]]
    return [(_runs(hits[1][a:b]), _runs(hits[0][a:b])) for a, b in zip(at[:-1], at[1:])]


# --- contexts that can hold a repeat


def _common(x: bytes, y: bytes) -> int:
    n = min(len(x), len(y))
    if x[:n] == y[:n]:
        return n
    lo, hi = 0, n
    while hi - lo > 1:
        mid = (lo + hi) // 2
        if x[lo:mid] == y[lo:mid]:
            lo = mid
        else:
            hi = mid
    return lo


def _longest(sides: list[bytes]) -> list[int]:
    """Most bytes that each has in common, from its start, with another one."""
    order = sorted(range(len(sides)), key=sides.__getitem__)
    near = [_common(sides[i], sides[j]) for i, j in zip(order, order[1:])]
    out = [0] * len(sides)
    for k, i in enumerate(order):
        out[i] = max(near[k - 1] if k else 0, near[k] if k < len(near) else 0)
    return out


def can_repeat(parts: list[bytes], at: list[int], short: int = SHORT) -> list[bool]:
    """Whether a part may share a window with another part; all hold one anchor, at these places, and so do their windows.
    Parts whose longest agreements on the two sides add up to less than a window can not."""
    left = _longest([b[:i][::-1] for b, i in zip(parts, at)])
    right = _longest([b[i:] for b, i in zip(parts, at)])
    return [x + y >= short for x, y in zip(left, right)]


# --- Spark

_PART = "a bigint, c bigint, off int, n int, cls bigint, sub bigint, done boolean, at int, b binary"
_HIT = "a bigint, c bigint, off int, n int, long boolean"


def _sorted_hits(length: int, short: int):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        # a row of the input that is repeated whole gives its contexts again
        pdf = pdf.drop_duplicates(["a", "c", "off"])
        rows, cls = [], pdf["cls"].to_numpy()
        columns = [pdf[x].tolist() for x in ("a", "c", "off", "n", "at", "b", "done")]
        edges = np.flatnonzero(np.concatenate([[True], cls[1:] != cls[:-1], [True]])).tolist()
        block, size = [], 0

        def sort() -> None:
            for (a, c, off, _, _, _, done), found in zip(block, repeated_windows([r[5] for r in block], [r[3] for r in block], length, short)):
                rows.extend((a, c, off + x, y - x, k == 0) for k, runs in enumerate(found) for x, y in runs if not done)
            block.clear()

        for lo, hi in zip(edges[:-1], edges[1:]):
            if hi - lo < 2:
                continue
            of = [x[lo:hi] for x in columns]
            kept = [r for r, may in zip(zip(*of), can_repeat(of[5], of[4], short)) if may]
            more = sum(len(r[5]) for r in kept)
            if block and size + more > BLOCK:
                sort()
                size = 0
            block.extend(kept)
            size += more
        if block:
            sort()
        return pd.DataFrame(rows, columns=["a", "c", "off", "n", "long"])

    return run


def _cut(step: int, size: int):
    """Parts of at most `step` windows of `size` bytes, classed by the bytes that all windows of a place have in common. Places
    are counted from the anchor, so that equal windows have equal places."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for a, c, off, n, cls, done, at, b in zip(*(pdf[x] for x in ("a", "c", "off", "n", "cls", "done", "at", "b"))):
                i = 0
                while i < n:
                    place = (i - at) // step
                    j = min(n, (place + 1) * step + at)
                    core, part = b[(place + 1) * step - 1 + at : max(0, place * step + at + size)], b[i : j - 1 + size]
                    rows.append((a, c, off + i, j - i, xxhash.xxh3_64_intdigest(b"%d %d " % (cls, place) + core) - 2**63, xxhash.xxh3_64_intdigest(part) - 2**63, done, at - i, part))
                    i = j
            yield pd.DataFrame(rows, columns=["a", "c", "off", "n", "cls", "sub", "done", "at", "b"])

    return run


def _hits_of_large(contexts: DataFrame, size: int, long: bool, most: int) -> DataFrame:
    """Hits, in windows of `size` bytes, of contexts whose classes have more than `most` of them, which are all different. Parts
    are as long as their windows, so that those inside a passage that many texts share are equal, whatever follows it; only
    parts across its ends are cut again. Parts that occur again are hits as a whole; they are done, and go on as partners of
    others only, so that each window is a hit once."""
    hits = contexts.sparkSession.createDataFrame([], _HIT)
    parts = contexts.withColumn("n", F.least(F.col("n"), F.length("b") - size + 1)).where("n > 0")
    for step in STEPS:
        parts = written(parts.mapInPandas(_cut(step, size), _PART), "repeat-parts")
        counts = parts.groupBy("cls", "sub").agg(F.count(F.lit(1)).alias("k"), F.min_by(F.struct("a", "c", "off", "n", "done", "at", "b"), F.struct("a", "c", "off")).alias("one"))
        counts = written(counts, "repeat-classes")
        again = parts.where("NOT done").join(counts.where("k > 1").select("cls", "sub"), ["cls", "sub"], "left_semi")
        hits = hits.unionByName(again.select("a", "c", "off", "n", F.lit(long).alias("long")))
        sizes = counts.groupBy("cls").agg(F.count(F.lit(1)).alias("m")).where("m > 1")
        found = counts.join(sizes, "cls").select("cls", "sub", "m", "one.*", (F.col("one.done") | (F.col("k") > 1)).alias("_done")).drop("done").withColumnRenamed("_done", "done")
        few = _grouped(found.where(F.col("m") <= most).select("cls", "a", "c", "off", "n", "done", "at", "b"), "cls", _sorted_hits(size, size), _HIT)
        hits = hits.unionByName(few.where("long").withColumn("long", F.lit(long)))
        parts = written(found.where(F.col("m") > most), "repeat-large")
        if parts.isEmpty():
            break
    return hits  # single windows of a class are all equal


def _merged(name: str) -> Column:
    """Spans (s, e) in order, with the overlapping and touching ones made one; as no span lies inside another one, ends are in order
    too. `name` is a column, since an expression would be evaluated again for each span."""
    spans = F.col(name)
    fresh = F.filter(spans, lambda x, i: (i == 0) | (x["s"] > F.get(spans, i - 1)["e"]))
    final = F.filter(spans, lambda x, i: (i == F.size(spans) - 1) | (x["e"] < F.get(spans, i + 1)["s"]))
    return F.zip_with(fresh, final, lambda a, b: F.struct(a["s"].alias("s"), b["e"].alias("e")))


def remove_repeats(docs: DataFrame, length: int = LENGTH, short: int | None = None, key: str = "doc_id", text: str = "text", most: int = CLASS) -> DataFrame:
    """doc_id, n_bytes, spans (byte ranges removed), kept (the remaining bytes) and shared (byte ranges covered by strings of
    `short` bytes, three fifths of `length` by default, that also start elsewhere) of each row of docs.

    Matches never cross documents and are judged on the input. Null text counts as empty; texts of fewer than
    `length` bytes lose nothing. A row repeated whole repeats its text, so both rows lose it. Other columns are
    dropped. Hashes of 128 bits (64 of the anchor and 64 of the context) stand for the contexts, two of 64 bits for a row.
    """
    short = 3 * length // 5 if short is None else short
    if not 2 <= short <= length:
        raise ValueError("short must be between 2 and length")
    small_batches(docs.sparkSession)
    body = F.coalesce(F.col(text), F.lit(""))
    docs = docs.select(F.col(key).alias("doc_id"), body.alias("text"), F.xxhash64(F.col(key), body).alias("o"), F.xxhash64(F.lit(1), F.col(key), body).alias("p"))

    def anchor(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            found, numbers, sizes = [], [], []
            for i, t in enumerate(pdf["text"]):
                raw = t.encode("utf-8", "surrogatepass")
                if len(raw) >= short:
                    found.append(contexts(raw, length, short))
                    numbers.append(i)
                    sizes.append(len(raw))
            if found:
                times = [len(f[0]) for f in found]
                start, stop, anchors, ctx = (np.concatenate(x) for x in zip(*found))
                yield pd.DataFrame({
                    **{c: np.repeat(pdf[c].to_numpy()[numbers], times) for c in ("o", "p")}, "size": np.repeat(np.array(sizes, np.int32), times),
                    "start": start.astype(np.int32), "stop": stop.astype(np.int32), "anchor": anchors, "ctx": ctx,
                })

    rows = written(docs.select("o", "p", "text").mapInPandas(anchor, "o bigint, p bigint, size int, start int, stop int, anchor bigint, ctx bigint"), "repeat-anchors")
    shared = rows.groupBy("anchor").agg(F.count(F.lit(1)).alias("of")).where("of > 1").select("anchor")
    shared = written(shared, "repeat-shared")  # a table of its own, so that the join can split a hot anchor
    rows = written(rows.join(shared, "anchor", "left_semi"), "repeat-contexts")
    folded = written(rows.groupBy("anchor", "ctx").agg(F.count(F.lit(1)).alias("k"), F.min(F.struct("o", "p", "start", "stop")).alias("one")), "repeat-folded")
    several = folded.groupBy("anchor").agg(F.count(F.lit(1)).alias("m")).where("m > 1")
    wanted = folded.join(several, "anchor").groupBy("one.o", "one.p").agg(F.collect_list(F.struct("anchor", "ctx", "one.start", "one.stop", "m")).alias("cuts"))
    wanted = wanted.select("o", "p", *[F.col(f"cuts.{c}").alias(c) for c in ("anchor", "ctx", "start", "stop", "m")])

    def fetch(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: set[tuple[int, int]] = set()  # rows repeated whole
        names = ["a", "c", "off", "n", "cls", "sub", "done", "at", "b", "m"]
        for pdf in batches:
            rows = []
            for o, p, t, *cuts in zip(pdf["o"], pdf["p"], pdf["text"], *(pdf[c] for c in ("anchor", "ctx", "start", "stop", "m"))):
                if (o, p) in seen:
                    continue
                seen.add((o, p))
                raw = t.encode("utf-8", "surrogatepass")
                for a, c, i, j, m in zip(*(x.tolist() for x in cuts)):
                    rows.append((a, c, 0, j - i + 1, a, c, False, _anchor_at(raw[j : i + short], a, short) + j - i, raw[i : j + length], m))
                if len(rows) > 20000:
                    yield pd.DataFrame(rows, columns=names)
                    rows = []
            yield pd.DataFrame(rows, columns=names)

    # a document's contexts are few beside its text, so that the side that is held in memory is small
    parts = written(docs.select("o", "p", "text").join(wanted.hint("shuffle_hash"), ["o", "p"]).mapInPandas(fetch, f"{_PART}, m bigint"), "repeat-parts")
    hits = _grouped(parts.where(F.col("m") <= most).select("cls", "a", "c", "off", "n", "done", "at", "b"), "cls", _sorted_hits(length, short), _HIT)
    large = parts.where(F.col("m") > most)
    if not several.where(F.col("m") > most).isEmpty():
        large = written(large.drop("m").dropDuplicates(["a", "c"]), "repeat-large")
        for size, long in ((short, False), (length, True)):
            hits = hits.unionByName(_hits_of_large(large, size, long, most))
    whole = folded.where("k > 1").select(F.col("anchor").alias("a"), F.col("ctx").alias("c"), F.lit(0).alias("off"), F.lit(0).alias("n"), F.lit(True).alias("long"))
    run = F.struct("off", "n")
    marks = hits.unionByName(whole).groupBy(F.col("a").alias("anchor"), F.col("c").alias("ctx")).agg(
        F.bool_or(F.col("n") == 0).alias("whole"), F.collect_list(F.when((F.col("n") > 0) & F.col("long"), run)).alias("removed"), F.collect_list(F.when((F.col("n") > 0) & ~F.col("long"), run)).alias("shared"))
    marks = written(marks, "repeat-hits")  # again a table, so that the join can split a hot context

    def spans(runs: str, size: int) -> Column:
        last = F.least(F.col("stop"), F.col("size") - size)
        every = F.when(last >= F.col("start"), F.array(F.struct(F.col("start").alias("s"), (last + size).alias("e")))).otherwise(F.expr("cast(array() as array<struct<s:int,e:int>>)"))
        some = F.transform(runs, lambda r: F.struct((F.col("start") + r["off"]).alias("s"), (F.col("start") + r["off"] + r["n"] - 1 + size).alias("e")))
        return F.when(F.col("whole"), every).otherwise(some)

    found = rows.join(marks, ["anchor", "ctx"]).select("o", "p", spans("removed", length).alias("removed"), spans("shared", short).alias("shared"))
    found = found.groupBy("o", "p").agg(*[F.sort_array(F.flatten(F.collect_list(c))).alias(c) for c in ("removed", "shared")])
    none = F.expr("cast(array() as array<struct<s:int,e:int>>)")
    out = docs.join(found.hint("shuffle_hash"), ["o", "p"], "left").select("doc_id", F.col("text").cast("binary").alias("raw"), *[F.coalesce(_merged(c), none).alias(c) for c in ("removed", "shared")])
    n = F.length("raw")
    pieces = F.zip_with(F.concat(F.array(F.lit(0)), F.col("removed.e")), F.concat(F.col("removed.s"), F.array(n)), lambda a, b: F.hex(F.substring(F.col("raw"), a + 1, b - a)))
    kept = F.when(F.size("removed") == 0, F.col("raw")).otherwise(F.unhex(F.array_join(pieces, "")))
    return out.select("doc_id", n.cast("long").alias("n_bytes"), F.col("removed").alias("spans"), kept.alias("kept"), "shared")


def _anchor_at(core: bytes, anchor: int, short: int) -> int:
    """Place of the anchor in the bytes that all windows of a context share: the first with the anchor's hash that is the least of a window."""
    out = _gram_hashes(np.frombuffer(core, np.uint8), min(GRAM, short // 2))
    return int(np.flatnonzero(out.view(np.int64) == anchor)[0])


def op5_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = remove_repeats(table(spark, sf_dir, "documents"))
    covered = lambda spans: F.aggregate(spans, F.lit(0).cast("long"), lambda a, s: a + s["e"] - s["s"])
    return found.select("doc_id", "n_bytes", covered("spans").alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"), covered("shared").alias("n_shared"))


def _sql_runs(length: int) -> str:
    """CTE rows (r, first, last) of the byte runs covered by repeated strings of this length."""
    n = length
    return f"""w{n} AS (SELECT r, i, md5_number(b[i:i + {n - 1}]) AS m FROM (SELECT r, b, unnest(range(1, octet_length(b) - {n - 2})) AS i FROM d WHERE octet_length(b) >= {n})),
h{n} AS (SELECT r, i FROM w{n} WHERE m IN (SELECT m FROM w{n} GROUP BY m HAVING count(*) > 1)),
g{n} AS (SELECT r, i, CASE WHEN i <= lag(i) OVER (PARTITION BY r ORDER BY i) + {n} THEN 0 ELSE 1 END AS fresh FROM h{n}),
s{n} AS (SELECT r, min(i) AS first, max(i) + {n - 1} AS last FROM (SELECT r, i, sum(fresh) OVER (PARTITION BY r ORDER BY i) AS run FROM g{n}) GROUP BY r, run)"""


OP5_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, encode(coalesce(text, '')) AS b FROM documents),
{_sql_runs(LENGTH)},
{_sql_runs(SHORT)},
s AS (SELECT * FROM s{LENGTH}),
p AS (SELECT r, coalesce(lag(last) OVER (PARTITION BY r ORDER BY first), 0) + 1 AS f, first - 1 AS t FROM s
    UNION ALL SELECT d.r, coalesce(max(last), 0) + 1, max(octet_length(b)) FROM d LEFT JOIN s ON s.r = d.r GROUP BY d.r),
k AS (SELECT r, string_agg(CASE WHEN t >= f THEN hex(b[f:t]) ELSE '' END, '' ORDER BY f) AS kept FROM p JOIN d USING (r) GROUP BY r),
n AS (SELECT r, sum(last - first + 1) AS n_removed, count(*) AS n_spans FROM s GROUP BY r),
o AS (SELECT r, sum(last - first + 1) AS n_shared FROM s{SHORT} GROUP BY r)
SELECT doc_id, CAST(octet_length(b) AS BIGINT) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(kept)) AS kept_sha256,
    CAST(coalesce(n_shared, 0) AS BIGINT) AS n_shared
FROM d JOIN k USING (r) LEFT JOIN n USING (r) LEFT JOIN o USING (r)
"""
