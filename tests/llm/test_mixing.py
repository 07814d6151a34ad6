"""Mixtures: shares, repeats, budget, order and odd tables."""

from __future__ import annotations

import os
import random

import pytest
from pyspark.sql import functions as F

from mnemospark.llm import mixing as M
from mnemospark.llm import tokens as T
from mnemospark.store import Scratch

pytestmark = pytest.mark.skipif(not os.path.exists(f"{T.TOKENIZERS}/{T.VOCABULARY}.json"), reason="no vocabulary files")


def docs(spark, sizes):
    rng = random.Random(2)
    rows, n = [], 0
    for source, count in sizes.items():
        for _ in range(count):
            rows.append((n, " ".join(["word"] * rng.randint(1, 12)), source, 1))
            n += 1
    return spark.createDataFrame(rows, "doc_id bigint, text string, source string, total int")


def targets(spark, rows):
    return spark.createDataFrame(rows, "source string, target_share double, max_repeats int")


def test_running_sums_over_partitions(spark):
    rng = random.Random(4)
    rows = [(rng.choice(["a", "a", "a", "b", "c"]), i, rng.randint(0, 9)) for i in range(500)]
    df = spark.createDataFrame(rows, "g string, k bigint, v bigint")
    got = {(r.g, r.k): r.s for r in M.running_sum(df, Scratch(spark, "t"), ["g"], ["k"], "v", "s").collect()}
    total = {}
    for g, k, v in sorted(rows):
        total[g] = total.get(g, 0) + v
        assert got[g, k] == total[g]
    whole = {r.k: r.s for r in M.running_sum(df, Scratch(spark, "t"), [], ["k"], "v", "s").collect()}
    acc = 0
    for _, k, v in sorted(rows, key=lambda r: r[1]):
        acc += v
        assert whole[k] == acc
    assert M.running_sum(df.limit(0), Scratch(spark, "t"), ["g"], ["k"], "v", "s").count() == 0


def test_shares_repeats_and_budget(spark):
    df = docs(spark, {"Big ": 600, "small": 40, "tiny": 5, "other": 50})
    t = targets(spark, [("big", 0.5, 1), ("small", 0.3, 4), ("tiny", 0.2, 2), ("none", 0.1, 3)])
    mix = M.mixture(df, t, budget=1200).cache()
    rows = mix.collect()
    assert max(r.sent for r in rows) <= 1200 == pytest.approx(max(r.sent for r in rows), abs=13)
    assert sum(r.n_tokens for r in rows) == max(r.sent for r in rows)
    assert len({(r.doc_id, r.copy) for r in rows}) == len(rows)
    s = {r.source: r for r in M.shares(mix, t).collect()}
    assert s["none"].n_tokens == 0 and s["none"].actual_share == 0
    # tiny runs out after two rounds; big and small keep the proportion of their weights
    assert s["tiny"].copies == 10
    assert s["big"].n_tokens / s["small"].n_tokens == pytest.approx(5 / 3, rel=0.05)
    assert sum(r.actual_share for r in s.values()) == pytest.approx(1)
    # every prefix of the order has the shares
    half = mix.filter(F.col("finish") <= mix.agg(F.max("finish")).first()[0] / 8).groupBy("source").agg(F.sum("n_tokens").alias("n")).collect()
    n = {r.source: r.n for r in half}
    assert n["big"] / n["small"] == pytest.approx(5 / 3, rel=0.2)


def test_repeatable_and_free_of_other_sources(spark):
    df = docs(spark, {"a": 50, "b": 50})
    t = targets(spark, [("a", 1.0, 1)])
    one = sorted(map(tuple, M.mixture(df, t).collect()))
    assert one == sorted(map(tuple, M.mixture(df.repartition(7), t).collect()))
    assert {r[1] for r in one} == {"a"} and len(one) == 50


def test_odd_rows(spark):
    df = spark.createDataFrame([(1, None, "a"), (2, "", "a"), (3, "x", None), (4, "y", " A"), (5, "z", "")], "doc_id bigint, text string, source string")
    t = targets(spark, [("a", 0.5, None), (None, 0.2, 1), ("b", None, 1), ("c", -1.0, 1), ("A ", 0.9, 3)])
    assert [(r.doc_id, r.copy) for r in M.mixture(df, t).collect()] == [(4, 1)]
    assert M.mixture(df.limit(0), t).count() == 0
    assert M.mixture(df, t.limit(0)).count() == 0


def test_exact_budget_gives_every_source_its_share(spark):
    df = docs(spark, {"big": 600, "small": 60, "tiny": 20})
    t = targets(spark, [("big", 0.5, 1), ("small", 0.3, 4), ("tiny", 0.1, 2), ("none", 0.1, 3)])
    s = {r.source: r.actual_share for r in M.shares(M.mixture(df, t, "exact"), t).collect()}
    assert s["big"] == pytest.approx(5 / 9, abs=0.01) and s["small"] == pytest.approx(3 / 9, abs=0.01) and s["tiny"] == pytest.approx(1 / 9, abs=0.01)
