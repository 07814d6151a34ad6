"""Groups of pairwise matches: brute force on random graphs, long chains, hubs and dirty ends."""

from __future__ import annotations

import random

import pytest

from mnemospark.llm import groups as G


def find(pairs):
    root = {}

    def top(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for a, b in pairs:
        if a != b:
            low, high = sorted((top(a), top(b)))
            root[high] = low
    return {(x, top(x)) for x in root}


def labels(spark, pairs):
    df = spark.createDataFrame(pairs, "a string, b string")
    return {tuple(r) for r in G.group_labels(df).collect()}


@pytest.mark.parametrize("seed", [1, 2])
def test_random_graphs(spark, seed):
    random.seed(seed)
    ids = [f"n{i:03d}" for i in range(150)]
    pairs = [(random.choice(ids), random.choice(ids)) for _ in range(110)]
    assert labels(spark, pairs + pairs[:20] + [(b, a) for a, b in pairs[:20]]) == find(pairs)


def test_sorted_and_mixed_chains_and_a_hub(spark):
    chain = [(f"c{i:04d}", f"c{i + 1:04d}") for i in range(300)]
    ids = list(range(200))
    random.Random(5).shuffle(ids)
    mixed = [(f"m{a:04d}", f"m{b:04d}") for a, b in zip(ids, ids[1:], strict=False)]
    hub = [("z-hub", f"y{i:04d}") for i in range(500)]
    assert labels(spark, chain + mixed + hub) == find(chain + mixed + hub)


def test_nothing_and_nulls(spark):
    assert labels(spark, []) == set()
    assert labels(spark, [("a", None), (None, "b"), ("a", "a")]) == set()


def test_edges_with_notations_and_extra_columns(spark):
    rows = [
        ("B ", "\ta", "duplicates"), ("c", "b", '["topical", "duplicate_of"]'), ("c", "d", "not_duplicates"), ("d", "e", '{"relation": "Duplicates", "since": 1}'),
        ("f", "f", "duplicates"), ("g", " ", "duplicates"), ("h", None, "duplicates"), ("i", "j", None), ("i", "j", "topical"), ("k", "l", "EdgeType.DUPLICATES"), ("k", "l", "EdgeType.DUPLICATES"),
    ]
    df = spark.createDataFrame([(*r, 1, 1) for r in rows], "source string, target string, edge_type string, a int, root int")
    got = {tuple(r) for r in G.duplicate_groups(df).collect()}
    assert got == {("a", "a"), ("b", "a"), ("c", "a"), ("d", "d"), ("e", "d"), ("k", "k"), ("l", "k")}


def test_wordings_of_duplicates(spark):
    yes = ["Duplicate", "dup-of", '["topical", "same_as"]', "EdgeType.IDENTICAL_TO", '{"relation": "copy of"}', "is duplicate of"]
    no = ["same_project", "not_duplicates", "same_user_goal", None, "", '["same"]']
    rows = [(i, f"a{i}", f"b{i}", t) for i, t in enumerate(yes + no)]
    got = G.duplicate_pairs(spark.createDataFrame(rows, "edge_id bigint, source string, target string, edge_type string")).collect()
    assert sorted(r.a for r in got) == [f"a{i}" for i in range(len(yes))]
