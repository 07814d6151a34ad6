"""Tags that appear together: brute force, notations, flushes and hot items."""

from __future__ import annotations

import json
import math
import random
from collections import Counter
from itertools import combinations

from pyspark.sql import functions as F

from mnemospark.llm import cooccur as C


def anchors(spark, rows):
    return spark.createDataFrame([(i, t, 0, 0) for i, t in rows], "id string, tags_json string, items int, item string")


def brute(baskets):
    n, ab = Counter(), Counter()
    for b in baskets:
        n.update(b)
        ab.update(combinations(sorted(b), 2))
    return n, ab


def g2(k11, a, b, n):
    cells = [k11, a - k11, b - k11, n - a - b + k11]
    h = lambda xs: sum(x * math.log(x) for x in xs if x)
    return 2 * (h(cells) - h([a, n - a]) - h([b, n - b]) + h([n]))


def test_pairs_equal_brute_force_with_any_flush(spark):
    random.seed(3)
    names = [f"t{i}" for i in range(30)]
    sets = {f"id{i}": {"hot", *random.sample(names, random.randint(0, 6))} for i in range(400)}
    df = anchors(spark, [(i, json.dumps(sorted(s))) for i, s in sets.items()] * 2)
    n, ab = brute(sets.values())
    for flush in (10, 10**6):
        got = {(r.item_a, r.item_b): r for r in C.pair_counts(C.baskets(df), buckets=3, flush_at=flush).collect()}
        assert {k: r.n_ab for k, r in got.items()} == dict(ab)
        for (a, b), r in got.items():
            assert (r.n_a, r.n_b, r.n) == (n[a], n[b], len(sets))
            assert math.isclose(r.llr, max(0, g2(r.n_ab, n[a], n[b], len(sets))), abs_tol=1e-6)
            assert math.isclose(r.lift, r.n_ab * len(sets) / (n[a] * n[b]))


def test_dirty_rows(spark):
    rows = [("A ", '["x", "X ", "#y"]'), ("a", "x, y"), (None, '["x", "y"]'), ("", "x,y"), ("b", None), ("c", " "), ("d", "[]"), ("e", '["cut'), ("f", "['x']")]
    b = {r.id: r["items"] for r in C.baskets(anchors(spark, rows)).collect()}
    assert b == {"a": ["x", "y"], "f": ["x"]}
    p = C.pair_counts(C.baskets(anchors(spark, rows))).collect()
    assert [(r.item_a, r.item_b, r.n_ab, r.n) for r in p] == [("x", "y", 1, 2)]


def test_threshold_is_inclusive(spark):
    # n = 48, n(a) = n(b) = 16 = 2 * 8: 8 * 48 = 384 < 3 * 256; with n = 96 it is equal
    rows = [(f"p{i}", "a,b") for i in range(8)] + [(f"q{i}", "a") for i in range(8)] + [(f"r{i}", "b") for i in range(8)]
    fill = lambda m: [(f"z{i}", "other") for i in range(m - 24)]
    assert C.associated_tags(anchors(spark, rows + fill(95))).count() == 0
    assert C.associated_tags(anchors(spark, rows + fill(96))).count() == 1


def test_empty(spark):
    assert C.pair_counts(C.baskets(anchors(spark, []))).count() == 0


def test_a_record_of_many_tags(spark):
    tags = [f"t{i}" for i in range(300)]
    got = C.pair_counts(C.baskets(anchors(spark, [("a", ",".join(tags))]))).agg(F.count("*"), F.max("n_ab")).first()
    assert tuple(got) == (300 * 299 // 2, 1)
