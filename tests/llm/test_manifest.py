"""Operator 11 against a plain version of the tree, the proofs and their folding, and against its SQL."""

from collections import defaultdict
from hashlib import sha256
from zlib import crc32

import duckdb
import pytest
from pyspark.sql import functions as F

from tests.conftest import DATA
from tijolo.llm import manifest as M
from tijolo.llm.common import numbered

SCHEMA = "doc_id bigint, source string, lang string, text string, n_chars bigint"


def digest(parts):
    return sha256("".join(parts).encode()).hexdigest()


def leaf(row):
    return digest("-" if row[c] is None else f"{len(str(row[c]).encode())}:{row[c]}" for c in M.FIELDS)


def levels(nodes):
    out = [nodes]
    while len(nodes) > 1:
        nodes = [digest(nodes[i : i + 3]) for i in range(0, len(nodes), 3)]
        out.append(nodes)
    return out


def brute(rows):
    groups, out = defaultdict(list), []
    for r in rows:
        groups[r["source"]].append(r)
    sources = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    for s in sources:
        groups[s].sort(key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, leaf(r)))
    trees = {s: levels([leaf(r) for r in groups[s]]) for s in sources}
    top = levels([trees[s][-1][0] for s in sources])
    for place, s in enumerate(sources):
        for nth, r in enumerate(groups[s]):
            t, siblings = dict(r), []
            if t["doc_id"] is not None and crc32(str(t["doc_id"]).encode()) % 2 == 0 and t["text"] is not None:
                t["text"] = t["text"].replace("\n", "")
            folded = leaf(t)
            for tree, k in ((trees[s], nth), (top, place)):
                for level in tree[:-1]:
                    run, i = level[k // 3 * 3 : k // 3 * 3 + 3], k % 3
                    siblings += run[:i] + run[i + 1 :]
                    folded = digest([*run[:i], folded, *run[i + 1 :]])
                    k //= 3
            out.append((r["doc_id"], leaf(r), trees[s][-1][0], top[-1][0], digest(siblings), folded, folded == top[-1][0]))
    return sorted(out, key=str)


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_manifest_equals_brute_force_and_sql(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    want = brute([r.asDict() for r in docs.collect()])
    assert rows_of(M.op11_manifest(spark, DATA)) == want
    con = duckdb.connect()
    con.sql(f"create view documents as select * from '{DATA}/documents.parquet'")
    assert sorted(con.sql(M.OP11_SQL).fetchall(), key=str) == want
    assert any(r[-1] for r in want) and not all(r[-1] for r in want)


@pytest.mark.parametrize("span", [1, 2, 6])
def test_odd_rows(spark, span):
    """Nulls everywhere, whole rows repeated, equal ids, an empty text, clashing names, a source of one row, trees of several segments."""
    rows = [(1, "a", "en", "b\n", 2), (1, "a", "en", "b\n", 2), (None, None, None, None, None), (3, None, "x", "é\n\n", None), (1, None, None, None, None), (4, "", "", "", 0)]
    rows += [(i % 7, "z", "l", f"t{i % 3}\n", i) for i in range(40)] + [(5, "z", "l", "long word " * 200_000 + "\n", 1)]
    docs = spark.createDataFrame(rows, SCHEMA).withColumns({c: F.lit(1) for c in ("nth", "of", "digest", "tree", "records")})
    assert rows_of(M.manifest(docs, span=span)) == brute([r.asDict() for r in docs.collect()])


def test_no_rows_and_one_row(spark):
    docs = spark.createDataFrame([(7, "s", "en", "text", 4)], SCHEMA)
    assert M.manifest(docs.limit(0)).collect() == []
    (row,) = M.manifest(docs).collect()
    assert row.leaf == row.subroot == row.root == row.folded_root and row.proof_sha256 == digest([]) and row.verified


def test_store_names_equal_subtrees_once(spark):
    nodes = spark.createDataFrame([(t, i, 9, bytes([i % 3]) * 32) for t in (0, 1) for i in range(9)], "tree bigint, nth bigint, of bigint, digest binary")
    store, _, tops = M.build(nodes, span=1)
    assert tops.select("digest").distinct().count() == 1 and store.count() == 2  # one run of leaves, one of runs


def test_a_harmed_sibling_or_leaf_leads_to_another_root():
    path, digits = [[b"a" * 32, b"b" * 32], [], [b"c" * 32]], [1, 0, 0]
    root = M.fold(b"x" * 32, path, digits)
    assert M.fold(b"y" * 32, path, digits) != root and M.fold(b"x" * 32, path, [0, 0, 0]) != root


def test_places_are_gapless_in_groups_that_span_ranges(spark):
    df = spark.createDataFrame([("big" if i % 5 else None, -i) for i in range(500)], "g string, v int")
    got = numbered(df, ["g"], ["v"], "t").collect()
    for g in ("big", None):
        mine = sorted((r for r in got if r.g == g), key=lambda r: r.nth)
        assert [r.nth for r in mine] == list(range(len(mine))) and {r.of for r in mine} == {len(mine)}
        assert [r.v for r in mine] == sorted(r.v for r in mine)
