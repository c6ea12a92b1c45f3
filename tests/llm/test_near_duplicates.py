"""The trees' recall where all nodes of a pair branch down to the last level."""

import numpy as np

from tests.conftest import DATA
from tijolo.llm import near_duplicates as N


def missed(pairs: int, seed: int) -> int:
    """Pairs at the threshold, drawn as sketches, that no node of the last level holds together."""
    rng, out = np.random.default_rng(seed), 0
    for _ in range(pairs):
        same, values = rng.random(N.SKETCH) < N.PERCENT / 100, rng.integers(0, 2**16, N.SKETCH).tolist()
        open_ = [(N.child(t, c, values[c]), 0) for t, c in N._ROOTS if same[c]]
        while open_:
            node, level = open_.pop()
            if level == N.DEPTH:
                break
            open_.extend((N.child(node, c, values[c]), level + 1) for c in N.chosen(node).tolist() if same[c])
        else:
            out += 1
    return out


def test_every_tree_has_a_root_of_its_own():
    assert {t for t, _ in N._ROOTS} == set(range(N.TREES)) and len({c for _, c in N._ROOTS}) == len(N._ROOTS)


def test_no_link_is_missed_where_all_nodes_branch():
    assert missed(5000, 1) == 0


def test_sets_meet_in_blocks_of_bounded_shingles(spark):
    """However small a group's part of a task is, the components are the same."""
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    whole = sorted(map(tuple, N.near_duplicates(docs, words=4).collect()))
    assert sorted(map(tuple, N.near_duplicates(docs, words=4, shingles_met=300).collect())) == whole
    assert any(r[0] != r[2] for r in whole)


def missed_below_roots(pairs: int, seed: int, similarity: float) -> int:
    """As `missed`, at any similarity and with the roots' single choice."""
    rng, out = np.random.default_rng(seed), 0
    for _ in range(pairs):
        same, values = rng.random(N.SKETCH) < similarity, rng.integers(0, 2**16, N.SKETCH).tolist()
        open_ = [(N.child(t, c, values[c]), 0) for t, c in N._ROOTS if same[c]]
        while open_:
            node, level = open_.pop()
            if level == N.DEPTH:
                break
            open_.extend((N.child(node, c, values[c]), level + 1) for c in N.chosen(node, level == 0).tolist() if same[c])
        else:
            out += 1
    return out


def test_no_link_is_missed_with_the_single_choice_of_roots():
    assert missed_below_roots(3000, 2, N.PERCENT / 100) == 0


def test_a_large_root_makes_one_row_for_each_of_its_sets(spark):
    """Rows grow with the sets of large roots, one for each, however large the roots are."""
    for n in (100, 400):
        sets = [(node, rep, np.random.default_rng(rep).integers(0, 2**16, N.SKETCH, np.uint16).tobytes()) for node in range(1, 21) for rep in range(n)]
        members = spark.createDataFrame(sets, "node bigint, rep bigint, sketch binary")
        assert N._children(members, root=True).count() == len(sets)
