"""Operator 11: a Merkle manifest of a data set, a content-addressed DAG that is stored as digest-to-children records.

A row's digest is a leaf. Leaves of a source ascend by id, and every ARITY consecutive nodes become their digest until
one is left, the source's subroot; subroots become the root in the same way. A node's record is named by its digest, and
equal subtrees share it. SPAN levels of records are stored together as a segment, named by the digest on top, so that a
tree over n leaves takes log(n) / log(ARITY ** SPAN) joins, up or down.

A leaf's proof is found from the root. The requests of all leaves below a node travel as one: they meet the record of its
digest, and at each level the digit of their rank selects a child, and the siblings, the children not selected, join the path. The
path is reversed at the end, so that it leads from the leaf up. No request, segment or run holds more than
ARITY ** SPAN digests, so no group grows with a source.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tijolo.llm.common import numbered, small_batches, table, written

ARITY, SPAN = 3, 6
FIELDS = ["doc_id", "source", "lang", "n_chars", "text"]
_RECORDS = "array<struct<digest:binary,children:array<binary>>>"


# --- digests


def _encoded(value: Column) -> Column:
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_digest(values: list[Column]) -> Column:
    """Digest of a row: each value is `-` if null, else its UTF-8 length, a colon and the value."""
    return F.unhex(F.sha2(F.concat(*[_encoded(v) for v in values]), 256))


def digest_of(children: list[bytes]) -> bytes:
    """A node's digest: of its children's digests as hexadecimal text."""
    return sha256("".join(c.hex() for c in children).encode()).digest()


def fold(leaf: bytes, path: list[list[bytes]], digits: list[int]) -> bytes:
    """The root that a leaf, the siblings of each level from the leaf up and the leaf's places among them lead to."""
    for siblings, digit in zip(path, digits):
        leaf = digest_of([*siblings[:digit], leaf, *siblings[digit:]])
    return leaf


# --- up: from nodes to the store


def _rise(nodes: list[bytes], alone: bool, span: int) -> tuple[bytes, list[tuple[bytes, list[bytes]]]]:
    """Top digest and records of a segment. Nodes that are alone in their tree rise until one is left, others by `span` levels."""
    records: dict[bytes, list[bytes]] = {}
    level = 0
    while len(nodes) > 1 if alone else level < span:
        runs = [nodes[i : i + ARITY] for i in range(0, len(nodes), ARITY)]
        nodes = [digest_of(r) for r in runs]
        records.update(zip(nodes, runs))
        level += 1
    return nodes[0], list(records.items())


def build(nodes: DataFrame, span: int = SPAN) -> tuple[DataFrame, list[DataFrame], DataFrame]:
    """(store, levels, tops) of trees over nodes (tree, nth, of, digest): `of` nodes a tree, numbered from 0.

    store: digest and records, a segment a row, and each once. levels: from the bottom up, (tree, nth, of, digest) of the
    segments. tops: (tree, digest), one a tree. No nodes make empty tables.
    """
    per, levels, segments = ARITY**span, [], []
    largest = nodes.agg(F.max("of")).first()[0] or 0

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = [(t, k, -(-of // per), *_rise(list(d), of <= per, span)) for t, k, of, d in zip(pdf["tree"], pdf["nth"], pdf["of"], pdf["digests"])]
            yield pd.DataFrame(out, columns=["tree", "nth", "of", "digest", "records"])

    while True:
        runs = nodes.groupBy("tree", F.floor(F.col("nth") / per).alias("nth"), "of").agg(F.array_sort(F.collect_list(F.struct("nth", "digest"))).alias("d"))
        risen = runs.select("tree", "nth", "of", F.col("d.digest").alias("digests")).mapInPandas(run, f"tree bigint, nth bigint, of bigint, digest binary, records {_RECORDS}")
        risen = written(risen, "segments")
        segments.append(risen.select("digest", "records"))
        levels.append(risen.select("tree", "nth", "of", "digest"))
        if largest <= per:
            break
        largest = -(-largest // per)
        nodes = levels[-1].where("of > 1")
    store = segments[0]
    for s in segments[1:]:
        store = store.unionByName(s)
    tops = levels[0].where("of = 1").select("tree", "digest")
    for level in levels[1:]:
        tops = tops.unionByName(level.where("of = 1").select("tree", "digest"))
    return written(store.dropDuplicates(["digest"]), "store"), levels, tops


# --- down: from the root to requests


def _descend(top: bytes, records: dict[bytes, list[bytes]]) -> list[tuple[bytes, list[bytes]]]:
    """(digest, path) of each node at the bottom of a segment, by rank: the path has the siblings of each level from the top."""
    here: list[tuple[bytes, list[bytes]]] = [(top, [])]
    while here[0][0] in records:  # all of a tree's leaves are equally deep
        here = [(kid, [*path, b"".join(kids[:i] + kids[i + 1 :])]) for d, path in here for kids in (records[d],) for i, kid in enumerate(kids)]
    return here


def _split(siblings: bytes) -> list[bytes]:
    return [siblings[i : i + 32] for i in range(0, len(siblings), 32)]


def _digits(nth: int, of: int) -> list[int]:
    """Places among the children, from the leaf up, of node nth in a tree of so many leaves."""
    out = []
    while of > 1:
        out.append(nth % ARITY)
        nth, of = nth // ARITY, -(-of // ARITY)
    return out


def _lookup(records) -> dict[bytes, list[bytes]]:
    return {r["digest"]: list(r["children"]) for r in records}


def requests_down(store: DataFrame, requests: DataFrame, span: int = SPAN) -> DataFrame:
    """(tree, nth, of, digest, path) of the nodes one segment below requests of the same columns; path leads from the root down."""
    per = ARITY**span

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for t, k, top, path, records in zip(pdf["tree"], pdf["nth"], pdf["digest"], pdf["path"], pdf["records"]):
                found = _descend(top, _lookup(records))
                yield pd.DataFrame({"tree": t, "nth": [k * per + i for i in range(len(found))], "digest": [d for d, _ in found], "path": [[*path, *p] for _, p in found]})

    return requests.join(store, "digest").select("tree", "nth", "digest", "path", "records").mapInPandas(run, "tree bigint, nth bigint, digest binary, path array<binary>")


def _to_bottom(store: DataFrame, levels: list[DataFrame], tops: DataFrame, span: int) -> DataFrame:
    """Requests (tree, nth, digest, path) at the lowest segments. tops: (tree, digest, path), where each tree's descent begins."""
    requests = None
    for level in reversed(levels):
        # a tree is entered at the segment that its top names
        entered = level.where("of = 1").select("tree", "nth").join(tops, "tree").select("tree", "nth", "digest", "path")
        requests = entered if requests is None else entered.unionByName(written(requests_down(store, requests, span), "requests"))
    return requests


# --- the operator


def manifest(docs: DataFrame, fields: list[str] = FIELDS, key: str = "doc_id", by: str = "source", text: str = "text", span: int = SPAN) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root, verified of each row: its proof from the root of docs' manifest,
    and what root the proof gives for the row as it was received.

    Rows whose id has an even checksum are received without the line feeds of their text. Equal rows are leaves of their own, next to
    each other. Rows of a source with equal ids follow each other by digest. A null source is a source of its own, the
    first; null ids come first, and are received unharmed. A single row is subroot and root, and its proof is of nothing.
    An empty table gives an empty result. Other columns are dropped.
    """
    small_batches(docs.sparkSession)
    doc_id = F.col(key)
    received = [F.replace(F.col(c), F.lit("\n"), F.lit("")) if c == text else F.col(c) for c in fields]
    tampered = F.crc32(doc_id.cast("string").cast("binary")) % 2 == 0
    rows = docs.select(
        doc_id.alias("doc_id"), F.col(by).alias("source"), leaf_digest([F.col(c) for c in fields]).alias("leaf"),
        F.when(tampered, leaf_digest(received)).alias("received"))
    leaves = numbered(written(rows, "leaves"), ["source"], ["doc_id", "leaf"], "ranked")
    trees = numbered(leaves.select("source").distinct(), [], ["source"], "sources").select(F.col("source").alias("_source"), F.col("nth").alias("tree"), F.col("of").alias("trees"))
    leaves = written(leaves.join(trees, F.col("source").eqNullSafe(F.col("_source"))).select("tree", "trees", "nth", "of", "doc_id", "leaf", "received"), "leaves")

    store, levels, subroots = build(leaves.select("tree", "nth", "of", F.col("leaf").alias("digest")), span)
    n_trees = trees.agg(F.max("trees")).first()[0] or 0
    top_store, top_levels, roots = build(subroots.select(F.lit(-1).cast("long").alias("tree"), F.col("tree").alias("nth"), F.lit(n_trees).cast("long").alias("of"), "digest"), span)
    root = (roots.select("digest").first() or [None])[0]
    from_root = roots.select("tree", "digest", F.expr("CAST(array() AS array<binary>)").alias("path"))
    down = requests_down(top_store, _to_bottom(top_store, top_levels, from_root, span), span)
    starts = written(down.select(F.col("nth").alias("tree"), "digest", "path"), "starts")
    last = _to_bottom(store, levels, starts, span)
    asked = last.join(store, "digest").join(starts.select("tree", F.col("digest").alias("subroot")), "tree")
    # the members of a segment, at most ARITY ** span, wait for its request
    per = ARITY**span
    member = F.struct("nth", "doc_id", "leaf", "received")
    members = leaves.groupBy("tree", F.floor(F.col("nth") / per).alias("nth"), "of").agg(F.array_sort(F.collect_list(member)).alias("members"))
    kind = docs.select(doc_id.alias("doc_id")).schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for tree, of, top, above, records, subroot, rows in zip(*[pdf[c] for c in ("tree", "of", "digest", "path", "records", "subroot", "members")]):
                upper = _digits(tree, n_trees)
                out = []
                for (_, below), row in zip(_descend(top, _lookup(records)), rows, strict=True):
                    path = [_split(p) for p in reversed([*above, *below])]
                    siblings = "".join(d.hex() for level in path for d in level)
                    received = row["leaf"] if row["received"] is None else row["received"]
                    folded = fold(received, path, [*_digits(row["nth"], of), *upper])
                    out.append((row["doc_id"], row["leaf"].hex(), subroot.hex(), root.hex(), sha256(siblings.encode()).hexdigest(), folded.hex(), folded == root))
                yield pd.DataFrame(out, columns=["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]).astype({"doc_id": object})

    return asked.join(members, ["tree", "nth"]).select("tree", "of", "digest", "path", "records", "subroot", "members").mapInPandas(
        run, f"doc_id {kind}, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean")


def op11_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return manifest(table(spark, sf_dir, "documents"))


_ENC = "CASE WHEN {0} IS NULL THEN '-' ELSE octet_length(encode(CAST({0} AS VARCHAR))) || ':' || CAST({0} AS VARCHAR) END"
_LEAF = "sha256(" + " || ".join(_ENC.format("{text}" if c == "text" else c) for c in FIELDS) + ")"
_CRC = """list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda x: ascii(x)::BIGINT)),
  lambda c, b: list_reduce(list_prepend(xor(c, b), range(8)), lambda x, k: CASE WHEN x % 2 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END))"""
_UP = "list_transform(range((len(l) + 2) // 3), lambda i: sha256(array_to_string(l[3 * i + 1:3 * i + 3], '')))"
OP11_SQL = f"""
WITH RECURSIVE leaves AS (SELECT doc_id, source, {_LEAF.format(text="text")} AS leaf, CASE WHEN xor({_CRC}, 4294967295) % 2 = 0 THEN {_LEAF.format(text="replace(text, chr(10), '')")} END AS received FROM documents),
ranked AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS nth FROM leaves),
tree AS (SELECT source, 0 AS level, list(leaf ORDER BY nth) AS l FROM ranked GROUP BY source UNION ALL SELECT source, level + 1, {_UP} FROM tree WHERE len(l) > 1),
subroots AS (SELECT source, l[1] AS subroot, row_number() OVER (ORDER BY encode(source) NULLS FIRST) - 1 AS place, level AS height FROM tree WHERE len(l) = 1),
top AS (SELECT 0 AS level, list(subroot ORDER BY place) AS l FROM subroots UNION ALL SELECT level + 1, {_UP} FROM top WHERE len(l) > 1),
root AS (SELECT l[1] AS root, level AS above FROM top WHERE len(l) = 1),
steps AS (SELECT source, level, l FROM tree WHERE len(l) > 1),
rise AS (SELECT r.*, subroot, place, height, root, above, 0 AS level, CAST(coalesce(nth, 0) AS BIGINT) AS pos, '' AS proof, coalesce(received, leaf) AS folded
    FROM ranked r JOIN subroots s ON r.source IS NOT DISTINCT FROM s.source, root
  UNION ALL SELECT doc_id, source, leaf, received, nth, subroot, place, height, root, above, level + 1, CASE WHEN level + 1 = height THEN place ELSE pos // 3 END,
    proof || array_to_string(list_concat(run[1:pos % 3], run[pos % 3 + 2:]), ''), sha256(array_to_string(list_concat(run[1:pos % 3], [folded], run[pos % 3 + 2:]), ''))
  FROM (SELECT r.* REPLACE (CASE WHEN r.height = 0 AND r.level = 0 THEN r.place ELSE r.pos END AS pos), coalesce(s.l, t.l)[3 * (CASE WHEN r.height = 0 AND r.level = 0 THEN r.place ELSE r.pos END // 3) + 1 : 3 * (CASE WHEN r.height = 0 AND r.level = 0 THEN r.place ELSE r.pos END // 3) + 3] AS run
    FROM rise r LEFT JOIN steps s ON r.level < r.height AND s.level = r.level AND s.source IS NOT DISTINCT FROM r.source
    LEFT JOIN top t ON r.level >= r.height AND t.level = r.level - r.height WHERE r.level < r.height + r.above))
SELECT doc_id, leaf, subroot, root, sha256(proof) AS proof_sha256, folded AS folded_root, folded = root AS verified FROM rise WHERE level = height + above
"""
