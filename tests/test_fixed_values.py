"""Fixed values spelled out, so that a wrong one does not pass on both sides of a comparison; personalised rank by brute force."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from mnemospark.functions import decay, links, notation
from mnemospark.functions import text as T
from mnemospark.operators import graph
from mnemospark.plans import recall


def test_edges():
    assert [links.TRAVERSAL[t] for t in ("causes", "fixes", "depends_on", "contradicts", "superseded_by", "topical", "bridge", "ownership")] == [1.5, 1.4, 1.3, 0.5, 0.4, 1.0, 0.8, 1.1]
    assert [links.PRIORITY[t] for t in ("causes", "fixes", "depends_on", "topical", "contradicts")] == [10, 9, 8, 3, 1]
    assert [links.FADE[t] for t in ("causes", "depends_on", "summarizes", "before", "topical", "related")] == [0.0003, 0.0005, 0.001, 0.002, 0.005, 0.008]
    assert links.EXTEND == {"causes": 720.0, "fixes": 720.0, "depends_on": 360.0, "topical": 24.0, "related": 12.0}
    assert "causes" in links.STRONG and "topical" not in links.STRONG and "semantic" in links.LEGACY and "ownership" not in links.EXPLICABLE


def test_states_and_levels():
    assert notation.STATE_CODES == ("active", "rehearsing", "consolidating", "dormant", "ghost", "reactivated")
    assert decay.TRANSITIONS["ghost", "revive"] == "reactivated"
    assert recall.CORTICES["reflection"][:2] == (0, 1.5) and recall.CORTICES["episodic"][:2] == (3, 1.0) and recall.HALF_LIFE_DAYS == (365.0, 180.0, 90.0, 30.0, 1.0)


def test_wordings(spark):
    texts = {"ok": 0.95, "thanks!": 0.9, "haa": 0.95, "yes": 0.8, "ab": 0.85, "hello": 0.7, "/start": 0.6, "😀👍": 0.98, "☀☀": 0.98}
    got = {r.t: r.n for r in spark.createDataFrame([(t,) for t in texts], "t string").select("t", T.noise(F.col("t")).alias("n")).collect()}
    assert got == texts


def plain_rank(edges, seeds, rounds, tolerance=None, damping=0.85):
    out = {}
    for a, b, w in edges:
        out.setdefault(a, {})[b] = w
        out.setdefault(b, {})[a] = w
    work = set(seeds) | {n for s in seeds for n in out.get(s, {})}
    start = {n: (1 / len(seeds) if n in seeds else 0.0) for n in work}
    rank = dict(start)
    for _ in range(rounds):
        new = {n: (1 - damping) * start[n] for n in work}
        for n in work:
            total = sum(out.get(n, {}).values())
            if not total:
                for m in work:
                    new[m] += damping * rank[n] / len(work)
            for m, w in out.get(n, {}).items():
                if m in work:
                    new[m] += damping * rank[n] * w / total
        change = sum(abs(new[n] - rank[n]) for n in work)
        rank = new
        if tolerance is not None and change < tolerance:
            break
    return rank


@pytest.mark.parametrize("rounds,tolerance", [(10, None), (60, 1e-9)])
def test_personalised_rank_with_a_seed_without_edges(spark, rounds, tolerance):
    edges = [("a", "b", 0.5), ("a", "c", 0.25), ("b", "c", 0.5), ("c", "d", 1.0), ("d", "e", 0.5)]
    both = spark.createDataFrame([(x, y, w, "topical") for a, b, w in edges for x, y in ((a, b), (b, a))], "node string, other string, weight double, edge_type string")
    for seeds in (["a", "c"], ["a", "lonely"]):
        got = {r.node: r["rank"] for r in graph.pagerank(both, spark.createDataFrame([(s,) for s in seeds], "node string"), rounds, tolerance=tolerance).collect()}
        want = plain_rank(edges, seeds, rounds, tolerance)
        assert got.keys() == want.keys() and all(abs(got[n] - want[n]) < 1e-7 for n in want)
