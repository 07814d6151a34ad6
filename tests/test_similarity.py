"""Exact similarity joins whose blocks hold no pairs, by group, and as groups of alike vectors."""

from __future__ import annotations

import numpy as np

from mnemospark.operators import search, similarity


def strings(spark, n=40, seed=3):
    """Vectors with strings as ids, of which only two are alike."""
    v = np.eye(64)[:n] + np.random.default_rng(seed).normal(0, 1e-3, (n, 64))
    v[1] = v[0]
    return spark.createDataFrame([(f"m{i:02d}", [float(x) for x in r]) for i, r in enumerate(v)], "id string, embedding array<float>")


def test_tiles_of_strings_without_pairs(spark, monkeypatch):
    monkeypatch.setattr(similarity, "_TILE", 4)  # many tiles in a task, one of them with a pair
    df = strings(spark)
    for blocks in (1, 4):
        assert [(r.a, r.b) for r in similarity.similar_pairs(df, 0.85, blocks).collect()] == [("m00", "m01")]
    assert similarity.similar_pairs(df.filter("id > 'm00'"), 0.85, 3).count() == 0
    assert {(r.id, r.other) for r in similarity.knn(df.limit(1).union(df.filter("id = 'm01'")), 1, 3).collect()} == {("m00", "m01"), ("m01", "m00")}


def test_vectors_of_any_length_meet_the_threshold(spark):
    rng = np.random.default_rng(4)
    v = rng.normal(0, 1, (120, 8)) * 10.0 ** rng.integers(-6, 4, (120, 1))
    v[7] = 0
    df = spark.createDataFrame([(i, [float(x) for x in r]) for i, r in enumerate(v)], "id bigint, embedding array<double>")
    for over in (-0.2, 0.3, 0.7):
        cos = (v @ v.T) / (np.linalg.norm(v, axis=1)[:, None] * np.linalg.norm(v, axis=1) + 1e-8)
        want = {(a, b) for a in range(120) for b in range(a + 1, 120) if cos[a, b] > over}
        assert {(r.a, r.b) for r in similarity.similar_pairs(df, over, 3).collect()} == want


def test_alike_within_groups_joins_what_all_pairs_join(spark, monkeypatch):
    monkeypatch.setattr(similarity, "_TILE", 4)
    rng = np.random.default_rng(5)
    v = rng.normal(0, 1, (300, 5))
    group = [None if i % 50 == 0 else "hot" if i % 2 else f"s{i % 7}" for i in range(300)]
    rows = [(f"m{i:03d}", group[i], [float(x) for x in v[i]]) for i in range(300)]
    df = spark.createDataFrame(rows, "id string, session string, embedding array<double>")
    unit = v / np.linalg.norm(v, axis=1, keepdims=True)
    cos = unit @ unit.T

    def joined(pairs):
        root = list(range(300))
        for a, b in pairs:
            x, y = root[a], root[b]
            root = [min(x, y) if r in (x, y) else r for r in root]
        return root

    want = joined((a, b) for a in range(300) for b in range(a + 1, 300) if group[a] and group[a] == group[b] and cos[a, b] > 0.9)
    for rows_of_block in (40, 1000):
        got = [(int(r.a[1:]), int(r.b[1:])) for r in similarity.alike_within(df, "session", 0.9, rows_of_block).collect()]
        assert joined(got) == want and all(cos[a, b] > 0.9 and group[a] == group[b] for a, b in got)
        assert rows_of_block == 40 or len(got) == sum(r != i for i, r in enumerate(want))


def test_words_of_templates_in_blocks(spark):
    """Every text has the word that every template has; blocks of any size find the pairs of brute force."""
    rng = np.random.default_rng(6)
    bag = lambda k: ["the", *(f"w{x}" for x in sorted(set(rng.integers(0, 12, k).tolist())))]
    a, t = [(f"a{i}", bag(5)) for i in range(40)] + [("none", [])], [(f"t{i}", bag(6)) for i in range(30)] + [("alone", ["x"])]
    want = {(i, j, len(set(x) & set(y)) / len(y)) for i, x in a for j, y in t if len(set(x) & set(y)) / len(y) >= 0.5}
    texts, templates = spark.createDataFrame(a, "anchor string, words array<string>"), spark.createDataFrame(t, "schema string, words array<string>")
    for rows in (7, 1000):
        got = search.word_matches(texts, templates, 0.5, rows)
        assert {(r.anchor, r["schema"], r.m) for r in got.collect()} == want and got.count() == len(want)
