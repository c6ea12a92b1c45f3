"""Operator 13: byte-level BPE by replaying the merges over the corpus's distinct words.

Texts are packed into chunks: the chunk's distinct words, and its texts as their numbers. Words of all chunks that are no
token of the vocabulary meet once, and are dealt by hash into blocks of bounded bytes. In a block, an inverted index leads
from a rank, that is from the token pairs whose bytes have it, to the places of these pairs in the words. The lowest rank of
all is applied at all its places at once, from the left; only the pairs that touch a merged one change, and enter the
index anew. The words' ids then go back to the chunks that asked, and texts are put together from them.

A merge can make a pair of a lower rank than its own only with a vocabulary that no merges gave; such words are encoded
one by one, always at their lowest rank, so that the ids are those of the library for any rank file.
"""

from __future__ import annotations

import base64
import functools
import heapq
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import public_tokenizers
import pyarrow as pa
import regex
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tijolo.llm.common import bucketed, partitions, small_batches, table
from tijolo.llm.language_model import pack, unpack
from tijolo.llm.near_duplicates import _grouped

#: Segments or characters that a chunk holds before it is closed; words asked for in one slot; bytes of the words of a block.
CHUNK, CHARACTERS, SLOT, BLOCK = 1_000_000, 16_000_000, 500_000, 4_000_000
_NONE = np.int64(1 << 40)


class Vocabulary:
    """Tokens and their ranks, which are their ids, and the ranks of all pairs of tokens that make a token."""

    def __init__(self, raw: bytes):
        self.ranks = {base64.b64decode(t): int(r) for t, r in map(bytes.split, raw.splitlines()) if t}
        self.bytes = np.array([self.ranks[bytes([b])] for b in range(256)], np.int64)

    @functools.cached_property
    def tokens(self) -> list[bytes]:
        out = [b""] * (max(self.ranks.values()) + 1)
        for token, rank in self.ranks.items():
            out[rank] = token
        return out

    @functools.cached_property
    def pairs(self) -> tuple[np.ndarray, np.ndarray]:
        """(codes of the pairs in order, their ranks), with one that no pair has at the end."""
        found = []
        for token, rank in self.ranks.items():
            for i in range(1, len(token)):
                a, b = self.ranks.get(token[:i]), self.ranks.get(token[i:])
                if a is not None and b is not None:
                    found.append((a << 32 | b, rank))
        codes, ranks = np.array([*sorted(found), (1 << 62, _NONE)], np.int64).T
        return codes.copy(), ranks.copy()

    def pair_rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Ranks of the pairs, _NONE where two symbols make no token; a negative symbol makes none."""
        code = np.where(b < 0, np.int64(-1), a << np.int64(32) | b)
        codes, ranks = self.pairs
        at = np.searchsorted(codes, code)
        return np.where(codes[at] == code, ranks[at], _NONE)

    def one_by_one(self, word: bytes) -> list[int]:
        """The ids of a word, merging the leftmost pair of the lowest rank until none is left."""
        parts = [bytes([b]) for b in word]
        while len(parts) > 1:
            rank, i = min((self.ranks.get(x + y, _NONE), i) for i, (x, y) in enumerate(zip(parts, parts[1:])))
            if rank == _NONE:
                break
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        return [self.ranks[p] for p in parts]


@functools.lru_cache(maxsize=4)
def vocabulary(raw: bytes) -> Vocabulary:
    return Vocabulary(raw)


# --- words of a block


class _Index:
    """Rank to places, and which rank is the lowest."""

    def __init__(self):
        self.places: dict[int, list[np.ndarray]] = {}
        self.lowest: list[int] = []

    def add(self, ranks: np.ndarray, places: np.ndarray) -> None:
        order = np.argsort(ranks, kind="stable")
        ranks, places = ranks[order], places[order]
        edges = [0, *(np.flatnonzero(ranks[1:] != ranks[:-1]) + 1).tolist(), len(ranks)]
        for a, b in zip(edges[:-1], edges[1:]):
            if b > a:
                rank = int(ranks[a])
                if rank not in self.places:
                    self.places[rank] = []
                    heapq.heappush(self.lowest, rank)
                self.places[rank].append(places[a:b])

    def pop(self) -> tuple[int, np.ndarray]:
        rank = heapq.heappop(self.lowest)
        found = self.places.pop(rank)
        return rank, np.unique(np.concatenate(found)) if len(found) > 1 else found[0]


def replay(words: list[bytes], v: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    """(ids of all words one after another, number of ids of each word); words are not empty."""
    lengths = np.array([len(w) for w in words], np.int64)
    n = int(lengths.sum())
    if not n:
        return np.zeros(0, np.int64), lengths
    word = np.repeat(np.arange(len(words)), lengths)
    ends = np.cumsum(lengths)
    # place n stands before the first and after the last symbol of each word
    symbol = np.append(v.bytes[np.frombuffer(b"".join(words), np.uint8)], -1)
    following, before = np.arange(1, n + 2), np.arange(-1, n)
    following[ends - 1] = n
    before[ends - lengths] = n
    rank = np.append(v.pair_rank(symbol[:n], symbol[following[:n]]), _NONE)
    index, odd = _Index(), np.zeros(len(words), bool)
    some = np.flatnonzero(rank < _NONE)
    index.add(rank[some], some)
    while index.lowest:
        r, at = index.pop()
        at = at[rank[at] == r]  # others have changed since they were entered
        if not len(at):
            continue
        right = following[at]
        chained = right[:-1] == at[1:]
        if chained.any():  # of pairs that share symbols every other one counts, from the left
            i = np.arange(len(at))
            first = np.maximum.accumulate(np.where(np.concatenate([[True], ~chained]), i, 0))
            at, right = at[(i - first) % 2 == 0], right[(i - first) % 2 == 0]
        after = following[right]
        close = at[1:][after[:-1] == at[1:]]  # one by one, each would meet the merged symbol before it
        odd[word[close[v.pair_rank(np.full(len(close), r), symbol[close]) < r]]] = True
        symbol[at], symbol[right], rank[right] = r, -1, _NONE
        following[at], before[after] = after, at
        touched = np.concatenate([at, before[at]])
        touched = np.unique(touched[touched < n])
        now = v.pair_rank(symbol[touched], symbol[following[touched]])
        rank[touched] = now
        some = now < _NONE
        touched, now = touched[some], now[some]
        if len(now):
            odd[word[touched[now < r]]] = True
            index.add(now, touched)
    kept = symbol[:n] >= 0
    ids, counts = symbol[:n][kept], np.bincount(word[kept], minlength=len(words))
    if odd.any():
        cut = np.split(ids, np.cumsum(counts)[:-1])
        for i in np.flatnonzero(odd):
            cut[i] = np.array(v.one_by_one(words[i]), np.int64)
        ids, counts = np.concatenate(cut), np.array([len(c) for c in cut])
    return ids, counts


# --- words asked for


def pack_words(words: list[bytes]) -> bytes:
    lengths = pack(np.array([len(w) for w in words], np.int32))
    return len(lengths).to_bytes(4, "little") + lengths + zstandard.compress(b"".join(words), 3)


def unpack_words(packed: bytes) -> list[bytes]:
    n = 4 + int.from_bytes(packed[:4], "little")
    at = np.concatenate([[0], np.cumsum(unpack(packed[4:n], np.int32), dtype=np.int64)]).tolist()
    data = zstandard.decompress(packed[n:])
    return [data[a:b] for a, b in zip(at[:-1], at[1:])]


def _slots(words: list[bytes], slots: int) -> np.ndarray:
    hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    return ((hashes >> np.uint64(32)) * np.uint64(slots) >> np.uint64(32)).astype(np.int64)


def _ask(chunks: DataFrame, slots: int) -> DataFrame:
    """(slot, chunk, words): a chunk's words dealt by hash, in their order."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for chunk, packed in zip(pdf["chunk"], pdf["asked"]):
                words = unpack_words(packed)
                slot = _slots(words, slots)
                order = np.argsort(slot, kind="stable")
                edges = np.flatnonzero(np.diff(slot[order], prepend=-1, append=-1)) if len(words) else np.zeros(1, np.int64)
                out = [(int(slot[order[a]]), chunk, pack_words([words[i] for i in order[a:b].tolist()])) for a, b in zip(edges[:-1], edges[1:])]
                yield pd.DataFrame(out, columns=["slot", "chunk", "words"])

    return chunks.select("chunk", "asked").mapInPandas(run, "slot bigint, chunk bigint, words binary")


def _answer(raw: bytes, block: int):
    """The words of a slot, each encoded once, and what each chunk gets: sizes and ids of its words, in the order asked."""
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        v, out = vocabulary(raw), []
        for slot, rows in pdf.groupby("slot", sort=False):
            places: dict[bytes, int] = {}
            asked = []
            for packed in rows["words"]:
                words = unpack_words(packed)
                asked.append(np.fromiter((places.setdefault(w, len(places)) for w in words), np.int64, len(words)))
            distinct, flat, sizes = list(places), [], []
            ends = np.cumsum([len(w) for w in distinct]) // block
            cuts = [0, *(np.flatnonzero(np.diff(ends)) + 1).tolist(), len(distinct)]
            for a, b in zip(cuts[:-1], cuts[1:]):
                ids, counts = replay(distinct[a:b], v)
                flat.append(ids), sizes.append(counts)
            flat, sizes = np.concatenate(flat), np.concatenate(sizes)
            for chunk, at in zip(rows["chunk"], asked):
                ids, counts = _ragged(flat, sizes, at)
                out.append((chunk, slot, pack(counts.astype(np.int32)), pack(ids.astype(np.uint32))))
        return pd.DataFrame(out, columns=["chunk", "slot", "counts", "ids"])

    return run


# --- chunks of texts


class _Segments(dict):
    """A text's segment to its number. No word of the pattern reaches over a blank before another character than white
    space, so that a segment, which begins there, has the same words wherever it stands."""

    def __init__(self, pattern: regex.Pattern, ranks: dict[bytes, int]):
        self.find, self.ranks, self.words = pattern.findall, ranks, {}
        self.asked: list[bytes] = []
        self.known: list[int] = []
        self.parts: list[int] = []
        self.sizes: list[int] = []
        self.after_blank = _AfterBlank(self)

    def add(self, segment: str) -> int:
        found = self.find(segment)
        for w in found:
            if (i := self.words.get(w)) is None:
                i = self.words[w] = len(self.known)
                coded = w.encode("utf-8", "surrogatepass")
                token = self.ranks.get(coded, -1)
                self.known.append(token)
                if token < 0:
                    self.asked.append(coded)
            self.parts.append(i)
        self.sizes.append(len(found))
        return len(self.sizes) - 1

    def __missing__(self, segment: str) -> int:
        value = self[segment] = self.add(segment)
        return value


class _AfterBlank(dict):
    """A segment without the blank that it begins with to its number."""

    def __init__(self, segments: _Segments):
        self.segments = segments

    def __missing__(self, rest: str) -> int:
        value = self[rest] = self.segments.add(" " + rest)
        return value


_GLUED = re.compile(r" (?=\s|\Z)")


def _numbers(text: str, segments: _Segments) -> list[int]:
    parts = text.split(" ")
    if not _GLUED.search(text):
        first = [segments[parts[0]]] if parts[0] else []
        return first + list(map(segments.after_blank.__getitem__, parts[1:]))
    out, held = [], [parts[0]]
    for p in parts[1:]:
        if not p or p[0].isspace():
            held.append(p)
        else:
            if whole := " ".join(held):
                out.append(segments[whole])
            held = ["", p]
    if whole := " ".join(held):
        out.append(segments[whole])
    return out


def _chunks(docs: DataFrame, raw: bytes, pattern: str, chunk: int) -> DataFrame:
    """chunk, docs, counts (segments of each text), segments (of all texts), sizes (words of each distinct segment), parts (its
    words), known (ids of the words that are tokens, else -1), asked (the other words) and their number n_asked."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ranks, find = vocabulary(raw).ranks, regex.compile(pattern)
        first, number = TaskContext.get().partitionId() << 32, 0
        segments, names, seqs, size, characters = _Segments(find, ranks), [], [], 0, 0

        def close() -> pd.DataFrame:
            ints = lambda x: pack(np.array(x, np.int32))
            return pd.DataFrame({
                "chunk": [first + number], "docs": [names], "counts": [[len(s) for s in seqs]], "segments": [pack(np.concatenate(seqs))],
                "sizes": [ints(segments.sizes)], "parts": [ints(segments.parts)], "known": [ints(segments.known)], "asked": [pack_words(segments.asked)], "n_asked": [len(segments.asked)]})

        for pdf in batches:
            for name, text in zip(pdf["doc_id"].astype(object), pdf["text"]):
                seqs.append(np.array(_numbers(text, segments) if text else [], np.int32))
                names.append(None if pd.isna(name) else name)
                size, characters = size + len(seqs[-1]) + 1, characters + len(text or "")
                if size >= chunk or characters >= CHARACTERS:
                    yield close()
                    number += 1
                    segments, names, seqs, size, characters = _Segments(find, ranks), [], [], 0, 0
        if names:
            yield close()

    return docs.mapInPandas(run, f"chunk bigint, docs array<{kind}>, counts array<int>, segments binary, sizes binary, parts binary, known binary, asked binary, n_asked bigint")


def _ragged(flat: np.ndarray, sizes: np.ndarray, chosen: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(the chosen rows of a ragged array one after another, their sizes)."""
    starts, size = np.cumsum(sizes) - sizes, sizes[chosen]
    shift = np.repeat(starts[chosen] - (np.cumsum(size) - size), size)
    return flat[shift + np.arange(len(shift))], size


def _together(row, slots: int) -> tuple[np.ndarray, np.ndarray]:
    """(ids of all texts of a chunk, number of ids of each text)."""
    known, words = unpack(row["known"], np.int32), unpack_words(row["asked"])
    answers = {a["slot"]: (unpack(a["counts"], np.int32), unpack(a["ids"], np.uint32)) for a in (row["answers"] if row["answers"] is not None else ())}
    slot = _slots(words, slots)
    order = np.argsort(slot, kind="stable")
    got = [answers[k] for k in np.unique(slot).tolist()]
    counts = np.concatenate([c for c, _ in got]).astype(np.int64) if got else np.zeros(0, np.int64)
    back = np.empty(len(order), np.int64)
    back[order] = np.arange(len(order))
    asked, of_asked = _ragged(np.concatenate([i for _, i in got]) if got else np.zeros(0, np.uint32), counts, back)
    sizes = np.ones(len(known), np.int64)
    sizes[known < 0] = of_asked
    flat = np.zeros(int(sizes.sum()), np.uint32)
    starts = np.cumsum(sizes) - sizes
    flat[starts[known >= 0]] = known[known >= 0]
    own = np.ones(len(flat), bool)
    own[starts[known >= 0]] = False
    flat[own] = asked
    of_segment, got = _ragged(flat, sizes, unpack(row["parts"], np.int32))
    parts = unpack(row["sizes"], np.int32)
    per_segment = np.add.reduceat(got, np.cumsum(parts) - parts) if len(parts) else parts.astype(np.int64)
    ids, size = _ragged(of_segment, per_segment, unpack(row["segments"], np.int32))
    ends = np.concatenate([[0], np.cumsum(size)])[np.cumsum(np.asarray(row["counts"], np.int64))]
    return ids, np.diff(ends, prepend=0)


# --- the operator


def encode(
    docs: DataFrame, ranks: str, pattern: str = public_tokenizers.PATTERN, key: str = "doc_id", text: str = "text", decoded: bool = False, chunk: int = CHUNK, block: int = BLOCK,
) -> DataFrame:
    """doc_id, n_tokens and ids of each row: ids are 32-bit little-endian integers one after another, as token files hold them.
    With `decoded`, also the bytes that the ids stand for.

    ranks: path of a rank file, which the driver reads. Each match of the pattern is encoded by itself, without special
    tokens; what no match covers is left out, which the public pattern never does. A null or empty text has no ids.
    Repeated rows and null ids are rows like others; an empty table gives an empty result. Other columns are dropped.
    """
    small_batches(docs.sparkSession)
    with open(ranks, "rb") as f:
        raw = f.read()
    rows = docs.select(F.col(key).alias("doc_id"), F.col(text).alias("text"))
    chunks = bucketed(_chunks(rows, raw, pattern, chunk), "chunk", "bpe-chunks")
    n = chunks.agg(F.sum("n_asked")).first()[0] or 0
    slots = max(partitions(docs.sparkSession), -(-n // SLOT))
    answered = _grouped(_ask(chunks, slots), "slot", _answer(raw, block), "chunk bigint, slot bigint, counts binary, ids binary")
    answers = answered.groupBy("chunk").agg(F.collect_list(F.struct("slot", "counts", "ids")).alias("answers"))
    kind = rows.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        v = vocabulary(raw)
        for pdf in batches:
            for _, row in pdf.iterrows():
                ids, counts = _together(row, slots)
                data, at = ids.astype("<u4").tobytes(), np.concatenate([[0], np.cumsum(counts) * 4]).tolist()
                out = pd.DataFrame({"doc_id": pd.Series(list(row["docs"]), dtype=object), "n_tokens": counts, "ids": [data[a:b] for a, b in zip(at[:-1], at[1:])]})
                yield out.assign(decoded=[text_of(b, v) for b in out["ids"]]) if decoded else out

    joined = chunks.join(answers.hint("shuffle_merge"), "chunk", "left")
    return joined.mapInPandas(run, f"doc_id {kind}, n_tokens bigint, ids binary" + ", decoded binary" * decoded)


def text_of(ids: bytes, v: Vocabulary) -> bytes:
    tokens = v.tokens
    return b"".join([tokens[i] for i in np.frombuffer(ids, "<u4").tolist()])


def decode(encoded: DataFrame, ranks: str, ids: str = "ids") -> DataFrame:
    """encoded with `decoded`, the bytes that its ids stand for; null ids give null. Other columns are kept; one of that name is replaced."""
    with open(ranks, "rb") as f:
        raw = f.read()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary(raw)
        for batch in batches:
            texts = [None if b is None else text_of(b, v) for b in batch.column(ids).to_pylist()]
            kept = [c for c in batch.schema.names if c != "decoded"]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.array(texts, pa.binary())], names=[*kept, "decoded"])

    schema = T.StructType([f for f in encoded.schema if f.name != "decoded"]).add("decoded", "binary")
    return encoded.mapInArrow(run, schema)


def op13_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = encode(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), decoded=True)
    return out.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
