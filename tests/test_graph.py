"""Graph operators on small hand-made graphs."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from mnemospark.operators import graph as G
from mnemospark.sources import memory
from mnemospark.store import Scratch

EDGES = [("a", "b", "causes", 0.7), ("a", "c", "causes", 0.6), ("b", "d", "topical", 0.5), ("c", "e", "contradicts", 0.5), ("d", "f", "preference", 0.4)]


def pairs(spark, rows):
    return spark.createDataFrame([(a, b, t, w, 1, 0.0, 0.0, 1) for a, b, t, w in rows], "lo string, hi string, edge_type string, weight double, co_count bigint, last_at double, created_at double, n_edges bigint")


def seeds(spark, *ids):
    return spark.createDataFrame([(i,) for i in ids], "node string")


def test_spread_waves(spark):
    both = memory.both_ways(pairs(spark, EDGES))
    got = {r.node: r.activation for r in G.spread(both, seeds(spark, "a"), steps=2).collect()}
    assert got == pytest.approx({"a": 1.0, "b": 0.63, "c": 0.54, "d": 0.63 * 0.5 * 0.6, "e": 0.54 * 0.25 * 0.6})
    assert {r.node for r in G.spread(both, seeds(spark, "unknown")).collect()} == {"unknown"}


def test_paths_and_depths(spark):
    both = memory.both_ways(pairs(spark, EDGES))
    got = {r.node: r.depth for r in G.best_paths(both, seeds(spark, "a"), 3, 0.0).collect()}
    assert got == {"a": 0, "b": 1, "c": 1, "d": 2, "e": 2, "f": 3}


def test_components(spark):
    rng = random.Random(3)
    rows = [(a, b, "topical", 0.5) for a, b in ((f"n{rng.randrange(60):02d}", f"n{rng.randrange(60):02d}") for _ in range(45)) if a != b]
    rows += [(f"c{i:03d}", f"c{i + 1:03d}", "topical", 0.5) for i in range(120)]
    root = {}

    def top(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for a, b, *_ in rows:
        low, high = sorted((top(a), top(b)))
        root[high] = low
    got = {r.node: r.component for r in G.components(pairs(spark, rows)).collect()}
    assert got == {x: top(x) for x in root}
    assert G.components(pairs(spark, [])).count() == 0


def test_labels_and_modularity(spark):
    clique = lambda p: [(f"{p}{i}", f"{p}{j}", "topical", 1.0) for i in range(4) for j in range(i + 1, 4)]
    p = pairs(spark, [*clique("a"), *clique("b"), ("a0", "b0", "bridge", 0.1)])
    labels = G.label_propagation(memory.both_ways(p), 6)
    got = {r.node: r.label for r in labels.collect()}
    assert len({got[f"a{i}"] for i in range(4)}) == 1 and got["a0"] != got["b0"]
    q = G.modularity(p, labels).first()
    # twelve edges of weight 1 within, of 12.1 in all; the ends of the bridge have degree 3.1
    m, inner = 12.1, [3.0 * 3.0] * 6 + [3.1 * 3.0] * 6
    assert q.modularity == pytest.approx(sum((1 - k / (2 * m)) / (2 * m) for k in inner)) and q.communities == 2


def test_pagerank_mass(spark):
    r = G.pagerank(memory.both_ways(pairs(spark, EDGES)), seeds(spark, "a"), 20)
    assert 0 < r.agg(F.sum("rank")).first()[0] <= 1 + 1e-9
    assert r.orderBy(F.desc("rank")).first().node == "a"


def test_labels_go_by_one_shuffle_of_the_votes_a_round(spark, monkeypatch):
    plans, keep = [], G.Scratch.keep
    monkeypatch.setattr(G.Scratch, "keep", lambda self, df, *by: plans.append(df._jdf.queryExecution().optimizedPlan().toString()) or keep(self, df, *by))
    rng = random.Random(8)
    rows = [(f"n{a:02d}", f"n{b:02d}", rng.choice([0.2, 0.4, None, float("nan")] if a == 3 else [0.2, 0.4])) for a in range(20) for b in range(20) if a != b and rng.random() < 0.2]
    rows += [("lone", "n00", None)]  # without a weight it has no votes, and its label goes
    both = spark.createDataFrame(rows, "node string, other string, weight double")
    heavy = lambda w: (1, 0) if w != w else (0, w)
    for rounds in (1, 2, 3):
        labels = {a: a for a, _, _ in rows}
        for _ in range(rounds):
            votes: dict[str, dict[str, float]] = {}
            for a, b, w in rows:
                if w is not None and a in labels and b in labels:
                    votes.setdefault(a, {})[labels[b]] = votes.get(a, {}).get(labels[b], 0.0) + w
            sums = {a: {t: heavy(round(w, 9)) for t, w in v.items()} for a, v in votes.items()}
            labels = {a: min(v, key=lambda t, v=v, a=a: ((-v[t][0], -v[t][1]), t != labels[a], t)) for a, v in sums.items()}
        assert {r.node: r.label for r in G.label_propagation(both, rounds).collect()} == labels
    assert plans[1].count("Join ") == 1 and plans[1].count("RepartitionByExpression") == 1


def test_transitive_is_bounded_at_hubs(spark):
    p = pairs(spark, [("hub", f"s{i:03d}", "topical", 0.9) for i in range(200)])
    assert G.transitive(p).count() == 32 * 31 // 2
    assert [(r.lo, r.hi) for r in G.transitive(pairs(spark, [("a", "b", "x", 0.9), ("b", "c", "x", 0.8), ("c", "d", "x", 0.1)])).collect()] == [("a", "c")]


def test_transitive_all_takes_every_neighbour_of_a_hub(spark):
    rng = random.Random(5)
    weight = {("hub", f"s{i:03d}"): rng.choice([0.6, 0.7, 0.9]) for i in range(120)} | {("other", f"s{i:03d}"): 0.8 for i in range(0, 120, 7)}
    weight |= {("s000", "s001"): 0.1, ("s002", "s003"): 0.9, ("s004", "z"): 0.5}
    near: dict[str, dict[str, float]] = {}
    for (a, b), w in weight.items():
        if w >= 0.6:
            near.setdefault(a, {})[b] = near.setdefault(b, {})[a] = w
    want: dict[tuple[str, str], float] = {}
    for of in near.values():
        for a in of:
            for b in of:
                if a < b and (a, b) not in weight:
                    want[a, b] = max(want.get((a, b), 0), of[a] * of[b] * 0.7)
    p = pairs(spark, [(a, b, "topical", w) for (a, b), w in weight.items()])
    for rows in (16, 1024):
        got = [((r.lo, r.hi), r.weight) for r in G.transitive_all(p, rows=rows).collect()]
        assert len(got) == len(want) and dict(got) == pytest.approx(want)


def test_transitive_all_shuffles_edges_and_no_pairs(spark, monkeypatch):
    monkeypatch.setattr(G, "PATH_ROWS", 50)  # several portions in a task
    monkeypatch.setattr(G, "BATCH_ROWS", 7)
    rng = random.Random(6)
    weight = {("a hub", f"s{i:03d}"): rng.choice([0.6, 0.7, 0.9]) for i in range(60)} | {(f"s{i:03d}", "z"): rng.choice([0.6, 0.8, float("nan")]) for i in range(0, 60, 3)}
    weight |= {("s000", "s001"): None, ("s002", "s003"): 0.1, ("s004", "\U0001f300"): 0.9, ("s005", "\uff5e"): 0.9, ("a hub", "\U0001f300"): 0.9, ("a hub", "\uff5e"): 0.9}
    p = pairs(spark, [(a, b, "topical", w) for (a, b), w in weight.items()])
    p.createOrReplaceTempView("weighted")
    want = spark.sql("""with sd as (select lo via, hi e, weight w from weighted where weight >= 0.6 union all select hi, lo, weight from weighted where weight >= 0.6)
        select a.e lo, b.e hi, max(a.w * b.w * 0.7D) weight from sd a join sd b on a.via = b.via and a.e < b.e left anti join weighted p on p.lo = a.e and p.hi = b.e group by 1, 2""")
    want = sorted((r.lo, r.hi, str(r.weight)) for r in want.collect())
    for rows in (16, 1024):
        got = G.transitive_all(p, rows=rows)
        assert sorted((r.lo, r.hi, str(r.weight)) for r in got.collect()) == want
        plan = got._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("RepartitionByExpression") <= 1 and "Join" not in plan and "Aggregate" not in plan


def test_transitive_all_sends_edges_only_where_they_meet_others(spark):
    sides = [("hub", f"s{i:03d}", 0.9, i % 8) for i in range(64)] + [(f"s{i:03d}", "hub", 0.9, 0) for i in range(64)]
    sides += [("a", "p", 0.9, 1), ("a", "q", 0.9, 6), ("b", "p", 0.9, 1), ("b", "r", 0.9, 1)]
    sent = G._sent_sides(spark.createDataFrame(sides, "u string, v string, weight double, x int"), Scratch(spark, "sent")).collect()
    # all edges of the hub go everywhere, those to a node's only neighbour nowhere
    assert sum(r.u == "hub" for r in sent) == 64 * 8
    assert sorted((r.u, r.v, r.x, r.y) for r in sent if r.u != "hub") == [("a", "p", 1, 6), ("a", "q", 6, 1), ("b", "p", 1, 1), ("b", "r", 1, 1)]


def test_causal_chains_do_not_turn_back(spark):
    e = spark.createDataFrame([("a", "b", "causes", 0.9), ("b", "c", "fixes", 0.9), ("c", "a", "causes", 0.9), ("c", "d", "topical", 0.9)], "src string, dst string, edge_type string, weight double")
    got = {(r.path, r.depth) for r in G.causal_chains(e, seeds(spark, "a")).collect()}
    assert got == {("a>b", 1), ("a>b>c", 2)}
