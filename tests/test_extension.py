"""Retrievers, flags and traces; the posting index; stages that go on; upkeep expressions; recall in levels."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from mnemospark import extension as X
from mnemospark.functions import upkeep as U
from mnemospark.operators import rebuild, recall, search
from mnemospark.operators.stages import Stages
from mnemospark.sources import encoders


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([("1", "Redis connection timeout is 30 seconds"), ("2", "MySQL query timeout is 60 seconds"), ("3", "HTTP request timeout is 10 seconds"), ("4", None), ("5", "")], "id string, text string")


def scores(df):
    return {r.id: round(r.score, 9) for r in df.collect()}


def test_posting_index_scores_like_a_scan(spark, docs, tmp_path):
    index = search.PostingIndex(spark, f"file://{tmp_path}/p")
    assert index.search("redis").count() == 0
    index.add(docs)
    assert scores(index.search("redis timeout timeout")) == scores(search.bm25(docs, "redis timeout timeout"))
    index.add(spark.createDataFrame([("2", "redis"), ("6", "timeout timeout")], "id string, text string"))
    index.remove(spark.createDataFrame([("3",)], "id string"))
    now = spark.createDataFrame([("1", "Redis connection timeout is 30 seconds"), ("2", "redis"), ("6", "timeout timeout")], "id string, text string")
    assert scores(index.search("redis timeout")) == scores(search.bm25(now, "redis timeout"))
    assert index.search("?").count() == 0
    index.clear()
    assert index.parts() == []


def test_retrievers_are_compared(spark, docs):
    memories = docs.withColumn("embedding", encoders.hashed("text", 16))
    both = [X.KeywordRetriever(), X.VectorRetriever(lambda c: encoders.hashed(c, 16))]
    assert all(isinstance(r, X.Retriever) for r in both)
    got = {(r.retriever, r.query): r.recall for r in X.compared(both, memories, {"redis": ["1"], "MySQL query timeout is 60 seconds": ["2"]}, k=1).collect()}
    assert got["keywords", "redis"] == 1.0 and got["vectors", "MySQL query timeout is 60 seconds"] == 1.0


def test_flags_and_traces(spark):
    assert X.Flags(write_gate=True).enabled("write_gate") and not X.Flags().enabled("write_gate")
    with pytest.raises(KeyError):
        X.Flags().enabled("other")
    heard = []
    t = X.Tracer(listeners=[heard.append])
    span = t.traced("made", spark.range(5), lambda df: df.write.format("noop").mode("overwrite").save(), total=F.sum("id"))
    assert (span["rows"], span["total"]) == (5, 10) and heard == t.spans == [span]


def test_stages_go_on(spark, tmp_path):
    ran = []

    def stage(name):
        def make():
            ran.append(name)
            return spark.range(len(ran))

        return make

    for most, names in ((1, ["a"]), (None, ["a", "b", "c"])):
        s = Stages(spark, f"file://{tmp_path}/s")
        for n in "abc":
            s.add(n, stage(n))
        assert list(s.run(most)) == names
    assert ran == ["a", "b", "c"]


def test_upkeep_expressions(spark):
    one = spark.range(1)
    kind = "array<struct<old:double,new:double,action:string,at:double>>"
    df = one.select(F.lit(0.5).alias("w"), F.array().cast(kind).alias("v"))
    for i in range(30):
        w, v = U.reweighted(F.col("w"), F.col("v"), F.lit(0.3), "strengthen" if i % 2 == 0 else "weaken", F.lit(float(i)))
        df = df.select(w.alias("w"), v.alias("v"))
        if i % 5 == 4:
            df = spark.createDataFrame(df.collect(), df.schema)
    r = df.first()
    assert len(r.v) == U.VERSIONS_KEPT and r.v[-1].at == 29.0 and r.v[-1].action == "weaken" and abs(r.w - 0.5) < 1e-9
    levels = one.select(U.compressed(F.array(*[F.lit(n).cast("bigint") for n in (40, 50, 10, 5, 5)]), 100).alias("l")).first().l
    # 40 whole; 50 would pass 80, so 30; 10 whole (80); then nothing fits
    assert levels == [0, 1, 0, 2, 2]
    assert one.select(U.compressed(F.array().cast("array<bigint>"), 9).alias("l")).first().l == []
    assert U.presets(spark).count() == 9


def pairs(spark, rows):
    return spark.createDataFrame(rows, "lo string, hi string, weight double")


def test_merge_moves_edges_to_the_oldest(spark):
    anchors = spark.createDataFrame([("a", 3.0, ["x"]), ("b", 1.0, ["x", "y"]), ("c", 2.0, ["y"]), ("d", 0.0, ["z"])], "id string, created_at double, tags array<string>")
    alike = spark.createDataFrame([("a", "b", 0.9), ("b", "c", 0.9), ("c", "d", 0.99)], "a string, b string, cosine double")
    cores = rebuild.cores(alike, anchors, shared_tag=True)
    # a and c meet over b; d has no tag in common
    assert {r.id: r.core for r in cores.collect()} == {"a": "b", "b": "b", "c": "b"}
    moved = rebuild.rewired(pairs(spark, [("a", "c", 0.9), ("a", "d", 0.2), ("c", "d", 0.4), ("d", "e", 0.1)]), cores)
    assert {(r.lo, r.hi): (round(r.weight, 9), r.n) for r in moved.collect()} == {("b", "d"): (0.4, 2), ("d", "e"): (0.1, 1)}
    none = alike.limit(0)
    assert rebuild.cores(none, anchors).count() == 0 and rebuild.rewired(pairs(spark, [("a", "c", 0.9)]), rebuild.cores(none, anchors)).count() == 1


def test_communities_are_split_and_small_ones_moved(spark):
    ring = [(f"{g}{i}", f"{g}{j}", 1.0) for g in "pq" for i in range(4) for j in range(4) if i < j] + [("p0", "q0", 0.1)]
    both = spark.createDataFrame([(a, b, w) for a, b, w in ring] + [(b, a, w) for a, b, w in ring] + [("s", "p0", 0.5), ("p0", "s", 0.5)], "node string, other string, weight double")
    labels = spark.createDataFrame([(f"{g}{i}", "all") for g in "pq" for i in range(4)] + [("s", "s"), ("t", "t")], "node string, label string")
    split = rebuild.split_oversized(both, labels, 6, 4)
    got = {r.node: r.label for r in split.collect()}
    assert len({got[f"p{i}"] for i in range(4)}) == 1 and len({got[f"q{i}"] for i in range(4)}) == 1 and got["p0"] != got["q0"]
    small = {r.node: r.label for r in rebuild.filtered_small(both, split, 3).collect()}
    assert small["s"] == got["p0"] and small["t"] in {got["p0"], got["q0"]}


def test_write_gate_by_similarity(spark):
    rows = [("old", 1.0), ("new", 5.0), ("same", 6.0), ("far", 7.0)]
    stored = spark.createDataFrame(rows, "id string, created_at double")
    alike = spark.createDataFrame([("new", "old", 0.8), ("old", "same", 0.95), ("new", "same", 0.8)], "a string, b string, cosine double")
    got = {r.id: (r.decision, r.target) for r in rebuild.similarity_gate(stored.filter("created_at > 4"), stored, alike, 0.92, 0.75).collect()}
    assert got == {"new": ("merge:similar_exists", "old"), "same": ("reject:duplicate", "old"), "far": ("accept:passed", None)}


def test_levels_and_descent(spark):
    directed = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("c", "d")], "node string, other string")
    got = {r.node: r.depth for r in recall.levels(directed, spark.createDataFrame([("a",)], "node string"), 4).collect()}
    assert got == {"a": 0, "b": 1, "c": 2, "d": 3}
    level = lambda rows: spark.createDataFrame(rows, "id string, score double")
    rows = recall.descent([level([("x", 0.1)]), level([("y", 0.9), ("x", 1.0)]), level([])], 2).collect()
    assert [(r.id, r.level) for r in rows] == [("x", 0), ("y", 1)]
