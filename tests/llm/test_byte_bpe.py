"""Operator 13 against the tokenizer library: whole tables, odd texts, every code point, and rank files that no merges gave."""

import base64
import random
from hashlib import sha256

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

from tests.conftest import DATA
from tijolo.llm import byte_bpe as B

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
ODD = [None, "", " ", "  a", "a  ", " a b  c\n d", "\n\n x", "a" * 5000, "ab" * 3000, "aba" * 1000, "é" * 999, "  \n  y", "<|endoftext|>", "a\x1c b\x85 c\xa0", "I'll don't 1234é漢字", "\x00 \x00", "word " * 300_000]


@pytest.fixture(scope="module")
def library():
    with open(RANKS, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def digests(text, library):
    ids = library.encode_ordinary(text or "")
    return len(ids), sha256(np.array(ids, "<u4").tobytes()).hexdigest(), sha256((text or "").encode()).hexdigest()


def test_whole_table_equals_the_library(spark, library):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}
    got = B.op13_byte_bpe(spark, DATA).collect()
    assert len(got) == len(texts)
    for r in got:
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == digests(texts[r.doc_id], library)


@pytest.mark.parametrize(("chunk", "block"), [(B.CHUNK, B.BLOCK), (3, 5)])
def test_odd_texts_in_chunks_and_blocks_of_any_size(spark, library, chunk, block):
    texts = [*ODD, *ODD[:4]]
    if block > 5:  # else a replay for each of a million words
        texts.append("".join(chr(c) + ("x1" if c % 3 else " ") for c in range(0x110000) if not 0xD800 <= c < 0xE000))
    docs = spark.createDataFrame([(None if i == 3 else i // 2, t) for i, t in enumerate(texts)], "doc_id bigint, text string")
    docs = docs.withColumns({c: F.lit(1) for c in ("ids", "word", "chunk", "decoded", "n_tokens")})
    out = B.decode(B.encode(docs, RANKS, chunk=chunk, block=block), RANKS).collect()
    want = sorted((str(None if i == 3 else i // 2), *digests(t, library)) for i, t in enumerate(texts))
    assert sorted((str(r.doc_id), r.n_tokens, sha256(r.ids).hexdigest(), sha256(r.decoded).hexdigest()) for r in out) == want
    assert B.encode(docs.limit(0), RANKS).collect() == []


def test_replay_equals_the_library_for_rank_files_that_no_merges_gave():
    rng = random.Random(3)
    for _ in range(100):
        tokens = sorted({bytes([b]) for b in range(256)} | {bytes(rng.choice(b"abc") for _ in range(rng.randint(2, 5))) for _ in range(40)})
        rng.shuffle(tokens)
        ranks = {t: i for i, t in enumerate(tokens)}
        v = B.Vocabulary(b"\n".join(base64.b64encode(t) + b" %d" % i for t, i in ranks.items()))
        library = tiktoken.Encoding("own", pat_str="[^ ]+", mergeable_ranks=ranks, special_tokens={})
        words = sorted({bytes(rng.choice(b"abc") for _ in range(rng.randint(1, 12))) for _ in range(30)} - set(tokens))
        ids, counts = B.replay(words, v)
        assert [x.tolist() for x in np.split(ids, np.cumsum(counts)[:-1])] == [library.encode_ordinary(w.decode()) for w in words]


def test_replay_enters_only_touched_pairs(monkeypatch):
    with open(RANKS, "rb") as f:
        v = B.vocabulary(f.read())
    entered = []
    add = B._Index.add
    monkeypatch.setattr(B._Index, "add", lambda self, ranks, places: (entered.append(len(places)), add(self, ranks, places)))
    words = [b"collocation%d" % i for i in range(50)]
    _, counts = B.replay(words, v)
    merges = sum(map(len, words)) - counts.sum()
    assert sum(entered[1:]) <= 2 * merges
