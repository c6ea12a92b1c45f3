"""Operator 6: near-duplicate documents by a chosen-path similarity join.

Documents are sets of word shingles; equal sets are first folded into one. Each set has SKETCH minwise
values. Each of TREES trees sends a set to one root node, named by its value at a coordinate that no other tree
has. Nodes over NODE sets choose coordinates at random and send a set to one node for each (up to DEPTH times): a
root chooses one, which is enough where unlike sets share a line, the nodes below it each with probability
BRANCHES / SKETCH and one at least. What is still over NODE is compared block by block. Small nodes are compared exhaustively by sketch and yield a spanning forest of likely links, not all pairs.
A link at the threshold is missed with a probability of 8e-7 if its nodes branch on all DEPTH levels, else less.

Likely links join sets into groups; a link is confirmed on full sets. A group of at most NODE sets meets in
one task and all its pairs are tried; of a larger group, each tree node that it has is tried so, and sets of more
than SHINGLES_MET shingles in all meet in blocks, two at a time. Confirmed links, again a spanning forest, give the components.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tijolo.llm.common import LOWER, UPPER, partitions, small_batches, table, written

WORDS, PERCENT = 5, 80
SKETCH, TREES, DEPTH, NODE = 64, 42, 6, 2048
#: Coordinates that a node below a root chooses, about. More of them make up for the single one of a root.
BRANCHES = 1.65
#: Share of sketch values in which likely links agree: a pair at 0.8 falls below with probability under 1e-8.
LIKELY = 0.5
#: Shingles of the sets that meet in one task to be confirmed, about; two sets meet however large they are.
SHINGLES_MET = 8_000_000

_MAP = bytes(b + 32 if 0x41 <= b <= 0x5A else 0x20 if 0x09 <= b <= 0x0D else b for b in range(256))
_ODD = np.array([int.from_bytes(xxhash.xxh3_64_digest(f"odd{i}"), "big") | 1 for i in range(SKETCH)], np.uint64)
_ADD = np.array([int.from_bytes(xxhash.xxh3_64_digest(f"add{i}"), "big") for i in range(SKETCH)], np.uint64)
_EMPTY = np.zeros(0, np.uint64)


class _Words(dict):
    """64-bit hashes of words; forgets all when it is full."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 100_000:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


def shingles(text: str | None, n: int, hashes: _Words) -> np.ndarray:
    """Distinct 64-bit hashes of n-word shingles, sorted; fewer words are one shingle, none gives none."""
    words = [w for w in (text or "").encode("utf-8", "surrogatepass").translate(_MAP).split(b" ") if w]
    if not words:
        return _EMPTY
    h = np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words))
    n = min(n, len(h))
    out = np.full(len(h) - n + 1, n, np.uint64)
    for k in range(n):
        out = (out ^ h[k : len(h) - n + 1 + k]) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(31)
    return np.unique(out)


#: The coordinate at the root of each tree; no two trees have the same.
_ROOTS = list(enumerate(np.random.default_rng(7).permutation(SKETCH)[:TREES].tolist()))
_ROOT_AT = np.array([c for _, c in _ROOTS])
_ROOT_MIX = np.array([xxhash.xxh3_64_intdigest(f"root {t} {c}") for t, c in _ROOTS], np.uint64)


def sketch(s: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """SKETCH minwise values, of which 16 bits are kept, and the root nodes, named by whole values."""
    out = np.full(SKETCH, np.uint64(2**64 - 1))
    for lo in range(0, len(s), 4096):
        part = s[lo : lo + 4096, None] * _ODD + _ADD
        part ^= part >> np.uint64(32)
        part *= np.uint64(0xD6E8FEB86659FD93)
        out = np.minimum(out, part.min(axis=0))
    nodes = (out[_ROOT_AT] ^ _ROOT_MIX) * np.uint64(0x9E3779B97F4A7C15)
    nodes = (nodes ^ nodes >> np.uint64(31)) * np.uint64(0xD6E8FEB86659FD93)
    return ((out * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(48)).astype(np.uint16), nodes.view(np.int64)


def _sets(docs: DataFrame, words: int) -> DataFrame:
    """doc_id, n_shingles, digest of the set, its sketch and its root nodes."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hashes = _Words()
        for pdf in batches:
            found = [shingles(t, words, hashes) for t in pdf["text"]]
            drawn = [sketch(s) if len(s) else None for s in found]
            yield pd.DataFrame({
                "doc_id": pdf["doc_id"], "n_shingles": [len(s) for s in found],
                "digest": [xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in found],
                "sketch": [d and d[0].tobytes() for d in drawn], "roots": [d and d[1].tobytes() for d in drawn],
            })

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInPandas(run, f"doc_id {kind}, n_shingles bigint, digest binary, sketch binary, roots binary")


# --- grouped rows in blocks of bounded memory


def _groups(batches: Iterator[pd.DataFrame], key: str) -> Iterator[pd.DataFrame]:
    """Whole groups of rows that are sorted by key, several small ones at a time."""
    rest: list[pd.DataFrame] = []
    for pdf in batches:
        if not len(pdf):
            continue
        k = pdf[key].to_numpy()
        cut = len(k) - int(np.searchsorted((k[::-1] != k[-1]).astype(np.int8), 1))
        head, tail = pdf.iloc[:cut], pdf.iloc[cut:]
        if len(head):
            if rest and rest[-1][key].iat[-1] != k[0]:
                yield pd.concat(rest, ignore_index=True)
                rest = []
            yield pd.concat([*rest, head], ignore_index=True)
            rest = [tail]
        else:
            if rest and rest[-1][key].iat[-1] != k[0]:
                yield pd.concat(rest, ignore_index=True)
                rest = []
            rest.append(tail)
    if rest:
        yield pd.concat(rest, ignore_index=True)


def _find(parent: list[int], i: int) -> int:
    while parent[i] != i:
        parent[i] = parent[parent[i]]
        i = parent[i]
    return i


def _grouped(df: DataFrame, key: str, run, schema: str) -> DataFrame:
    """run over frames of whole groups; groups of a task are streamed, none is a Spark group of its own."""
    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in _groups(batches, key):
            out = run(pdf)
            if len(out):
                yield out

    return df.repartition(partitions(df.sparkSession), key).sortWithinPartitions(key).mapInPandas(each, schema)


def _spans(keys: np.ndarray) -> Iterator[tuple[int, int]]:
    edges = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1], [True]]))
    for a, b in zip(edges[:-1], edges[1:]):
        if b - a > 1:
            yield int(a), int(b)


# --- trees


def _roots(sets: DataFrame) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            nodes = [np.frombuffer(r, np.int64) for r in pdf["roots"]]
            yield pd.DataFrame({"node": np.concatenate([*nodes, np.zeros(0, np.int64)]), "rep": pdf["rep"].repeat([len(n) for n in nodes]).to_numpy()})

    return sets.select("rep", "roots").mapInPandas(run, f"node bigint, rep {sets.schema['rep'].dataType.simpleString()}")


def chosen(node: int, root: bool = False) -> np.ndarray:
    """Coordinates that a node chooses; they depend on the node alone. There is one at least, as it must shrink."""
    dice = np.random.default_rng([node & 0xFFFFFFFF, node >> 32 & 0xFFFFFFFF, 7]).random(SKETCH)
    at = np.flatnonzero(dice < BRANCHES / SKETCH)
    return at if len(at) and not root else np.array([int(dice.argmin())])


def child(node: int, coordinate: int, value: int) -> int:
    return xxhash.xxh3_64_intdigest(b"%d %d %d" % (node, coordinate, value)) - 2**63


def _children(members: DataFrame, root: bool = False) -> DataFrame:
    """(node, rep) of the next level."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known: dict[int, np.ndarray] = {}
        for pdf in batches:
            nodes, reps = [], []
            for i, (node, s) in enumerate(zip(pdf["node"].tolist(), pdf["sketch"])):
                if (at := known.get(node)) is None:
                    at = known[node] = chosen(node, root)
                v = np.frombuffer(s, np.uint16)
                for c in at:
                    nodes.append(child(node, c, v[c]))
                    reps.append(i)
            yield pd.DataFrame({"node": np.array(nodes, np.int64), "rep": pdf["rep"].to_numpy()[reps] if reps else pdf["rep"].iloc[:0]})

    return members.mapInPandas(run, f"node bigint, rep {members.schema['rep'].dataType.simpleString()}")


def tree_nodes(sets: DataFrame, node: int = NODE, depth: int = DEPTH) -> DataFrame:
    """(node, rep) with 2 to `node` sets in each node; sets: rep, sketch and roots."""
    members, small = _roots(sets), None
    for level in range(depth + 1):
        members = written(members.distinct(), "nodes") if level else members
        sizes = members.groupBy("node").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
        sized = written(members.join(sizes, "node"), "nodes")
        fit = sized.where(F.col("n") <= node).select("node", "rep")
        small = fit if small is None else small.unionByName(fit)
        large = sized.where(F.col("n") > node)
        if large.isEmpty():
            return small
        if level < depth:
            members = _children(large.join(sets, "rep").select("node", "rep", "sketch"), root=level == 0)
    # What does not shrink is cut.
    return small.unionByName(_cut(large, "node", "n", node))


def _cut(members: DataFrame, group: str, size: str, most: int) -> DataFrame:
    """(group, rep) of groups of a size over `most`, cut into blocks of about half of it; every two blocks are a group, so that every two members meet."""
    blocks = F.ceil(2 * F.col(size) / most).cast("int")
    cut = members.withColumn("blocks", blocks).withColumn("b", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int"))
    pairs = cut.withColumn("o", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    return pairs.select(F.xxhash64(group, F.least("b", "o"), F.greatest("b", "o")).alias(group), "rep")


def _likely(pdf: pd.DataFrame) -> pd.DataFrame:
    """Spanning forest, in each node, of the sets whose sketches agree in a share LIKELY."""
    values, reps = np.array([np.frombuffer(s, np.uint16) for s in pdf["sketch"]]), pdf["rep"].to_numpy()
    out = []
    for a, b in _spans(pdf["node"].to_numpy()):
        v = values[a:b]
        if len(v) == 2:
            if (v[0] == v[1]).mean() >= LIKELY:
                out.append((a, a + 1))
            continue
        left = np.arange(len(v))
        while len(left) > 1:  # grow one tree after another from the sets not yet reached
            queue, left = [left[0]], left[1:]
            while queue and len(left):
                i = queue.pop()
                near = (v[left] == v[i]).mean(axis=1) >= LIKELY
                out.extend((a + int(i), a + int(j)) for j in left[near])
                queue.extend(left[near])
                left = left[~near]
    return pd.DataFrame({"a": reps[[x for x, _ in out]], "b": reps[[y for _, y in out]]}) if out else pd.DataFrame()


# --- components


def components(edges: DataFrame) -> DataFrame:
    """(rep, component): component is the least rep that edges (a, b) reach. Alternating large-star and small-star
    steps, each written to the shared folder; a step's stars have one row an edge, and minima are taken on the map side."""
    edges = written(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.where(F.col("b") > F.col("a")).join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.when(F.col("b") == F.col("m"), F.col("a")).otherwise(F.col("b")).alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        after = written(small, "edges")
        # done when every rep has one edge and no target has one: all stars
        more = after.groupBy("a").agg(F.count(F.lit(1)).alias("n"))
        if more.where("n > 1").isEmpty() and after.join(more.select(F.col("a").alias("b")), "b", "left_semi").isEmpty():
            return after.select(F.col("a").alias("rep"), F.col("b").alias("component")).unionByName(after.select(F.col("b").alias("rep"), F.col("b").alias("component")).distinct())
        edges = after


def _confirmed(pdf: pd.DataFrame) -> pd.DataFrame:
    """Spanning forest of the links on full sets in each group. Sorted by size, a set meets only those that are
    large enough; sets of one component already are not met again."""
    reps, packed, out = pdf["rep"].to_numpy(), pdf["s"].to_numpy(), []
    for a, b in _spans(pdf["grp"].to_numpy()):
        sets = [np.frombuffer(x, np.uint64) for x in packed[a:b]]
        order = sorted(range(len(sets)), key=lambda i: len(sets[i]))
        sets = [sets[i] for i in order]
        n = np.array([len(s) for s in sets])
        names, ids = np.unique(np.concatenate(sets), return_inverse=True)
        at = np.concatenate([[0], np.cumsum(n)])
        mark, parent = np.zeros(len(names), np.int32), list(range(len(sets)))
        for i in range(len(sets) - 1):
            end = int(np.searchsorted(n, n[i] * 100 // PERCENT, side="right"))
            if end <= i + 1:
                continue
            own = ids[at[i] : at[i + 1]]
            mark[own] = 1
            inter = np.add.reduceat(mark[ids[at[i + 1] : at[end]]], at[i + 1 : end] - at[i + 1])
            mark[own] = 0
            for j in np.flatnonzero(100 * inter >= PERCENT * (n[i] + n[i + 1 : end] - inter)) + i + 1:
                x, y = _find(parent, i), _find(parent, int(j))
                if x != y:
                    parent[x] = y
                    out.append((a + order[i], a + order[j]))
    return pd.DataFrame({"a": reps[[x for x, _ in out]], "b": reps[[y for _, y in out]]}) if out else pd.DataFrame()


def near_duplicates(docs: DataFrame, words: int = WORDS, key: str = "doc_id", text: str = "text", shingles_met: int = SHINGLES_MET) -> DataFrame:
    """doc_id, n_shingles, component_id, kept of each row of docs; a link is a similarity of PERCENT or more.

    A null, empty or blank text has no shingles and is linked with nothing; its component is its own id. Rows of
    equal sets are one component, so repeated rows are too: rows that repeat an id have one result each, all alike.
    A row with a null id has n_shingles, a null component and is kept; it links nothing. Other columns are dropped.
    """
    small_batches(docs.sparkSession)
    docs = docs.select(F.col(key).alias("doc_id"), F.col(text).alias("text"))
    every = written(_sets(docs, words), "sets")
    kind = every.schema["doc_id"].dataType.simpleString()
    known = every.where(F.col("digest").isNotNull() & F.col("doc_id").isNotNull())
    sets = written(known.groupBy("digest").agg(F.min("doc_id").alias("rep"), F.first("sketch").alias("sketch"), F.first("roots").alias("roots"), F.first("n_shingles").alias("n")), "reps")
    nodes = written(tree_nodes(sets.select("rep", "sketch", "roots")), "nodes")
    likely = _grouped(nodes.join(sets.select("rep", "sketch"), "rep"), "node", _likely, f"a {kind}, b {kind}")
    groups = components(likely)
    sizes = groups.groupBy("component").agg(F.count(F.lit(1)).alias("size"))
    groups = written(groups.join(sizes, "component"), "groups")
    # a group that meets in one task, or the tree nodes of a larger one
    met = groups.where(F.col("size") <= NODE).select(F.xxhash64("component").alias("grp"), "rep")
    inside = groups.where(F.col("size") > NODE).select("rep", "component")
    met = met.unionByName(nodes.join(inside, "rep").select(F.xxhash64("node", "component").alias("grp"), "rep"))
    # a group is bounded by its shingles too, as a few sets may be very large
    sized = met.distinct().join(sets.select("rep", "n"), "rep")
    totals = written(sized.groupBy("grp").agg(F.sum("n").alias("total")), "met")
    if not totals.where(F.col("total") > shingles_met).isEmpty():
        fit = sized.join(totals.where(F.col("total") <= shingles_met), "grp", "left_semi").select("grp", "rep")
        met = fit.unionByName(_cut(sized.join(totals.where(F.col("total") > shingles_met), "grp"), "grp", "total", shingles_met))
    met = met.distinct()

    def full(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hashes = _Words()
        for pdf in batches:
            yield pdf[["rep"]].assign(s=[shingles(t, words, hashes).tobytes() for t in pdf["text"]])

    wanted = groups.select("rep").distinct()
    chosen = docs.join(wanted, F.col("doc_id") == F.col("rep"), "left_semi").select(F.col("doc_id").alias("rep"), "text")
    packed = chosen.mapInPandas(full, f"rep {kind}, s binary")
    # rows that repeat an id may have other texts; the representative is the one with the set's size
    packed = packed.join(sets.select("rep", "n"), "rep").where(F.length("s") == 8 * F.col("n")).drop("n")
    links = _grouped(packed.join(met, "rep"), "grp", _confirmed, f"a {kind}, b {kind}")
    found = components(links)
    folded = sets.select("digest", "rep").join(found, "rep", "left").select("digest", F.coalesce("component", "rep").alias("component"))
    out = every.drop("sketch", "roots").join(folded, "digest", "left").withColumn("component_id", F.coalesce("component", "doc_id"))
    return out.select("doc_id", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"))


def op6_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), words=4)


OP6_SQL = f"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + least(len(w), 4) - 1], ' ') AS g
    FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 1) + 1)) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS k FROM s x JOIN s y ON x.g = y.g AND x.doc_id < y.doc_id GROUP BY x.doc_id, y.doc_id),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 80 * (x.n + y.n - k)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
c(doc_id, low) AS (SELECT doc_id, doc_id FROM d UNION SELECT e.b, c.low FROM c JOIN e ON e.a = c.doc_id WHERE c.low < e.b)
SELECT d.doc_id, coalesce(max(n), 0) AS n_shingles, min(low) AS component_id, d.doc_id = min(low) AS kept
FROM d LEFT JOIN n ON n.doc_id = d.doc_id JOIN c ON c.doc_id = d.doc_id GROUP BY d.doc_id
"""
