"""Scalar twins of the formulas, and invariants."""

from __future__ import annotations

import math

import pytest
from pyspark.sql import functions as F

from mnemospark.functions import decay, links
from mnemospark.functions import text as T
from mnemospark.functions import vectors as V
from mnemospark.sources import memory

NOW = 1_000_000_000.0
BASE = dict(importance=0.6, frequency=0.2, recency=0.8, emotional_valence=-0.4, stability=0.3, surprise=0.5, hippocampal_dependency=0.7, success_feedback=0.5, confidence=0.9, decay_rate=0.01)


def row(spark, state="active", idle=48.0, **over):
    v = BASE | over
    return spark.createDataFrame([(state, NOW - idle * 3600, NOW - 100 * 3600, *v.values(), ["style", "x"], "s")], f"state string, last_at double, created_at double, {', '.join(f'{k} double' for k in v)}, tags array<string>, schema_ref string")


def value(df, c):
    return df.select(c.alias("o")).first()[0]


@pytest.mark.parametrize(("state", "factor"), [("active", 1.0), ("rehearsing", 1.3), ("ghost", 0.3), ("reactivated", 0.7)])
def test_retention_twin(spark, state, factor):
    s = 0.6 * 0.3 + 0.3 * 0.25 + 0.4 * 0.2 + 0.2 * 0.15 + 0.9 * 0.1
    d = math.exp(-48 / (1 + s * 335))
    d = d + (1 - d) * 0.3 * 0.5
    rel = 0.6 * 0.5 * (1 + 0.4 * 0.2)
    want = (rel * 0.8 * 0.21 * 0.5 * 0.9) ** 0.2 * factor * d * (1 + 0.3 * (0.6 * 0.5 + 0.4 * 0.25 + 0.5 * 0.25))
    assert value(row(spark, state), decay.retention(NOW)) == pytest.approx(min(1, want))


@pytest.mark.parametrize("name", sorted(decay.CURVES))
def test_survival_falls_with_time_and_rises_with_strength(spark, name):
    grid = spark.createDataFrame([(float(t), s) for t in (0, 0.5, 1, 24, 100, 500) for s in (0.0, 0.5, 1.0)], "t double, s double")
    got = {(r.t, r.s): r.o for r in grid.select("t", "s", decay.CURVES[name](F.col("t"), F.col("s")).alias("o")).collect()}
    assert all(got[0.0, s] == 1.0 for s in (0.0, 0.5, 1.0))
    for s in (0.0, 0.5, 1.0):
        assert all(got[a, s] >= got[b, s] for a, b in ((0.0, 0.5), (0.5, 1.0), (1.0, 24.0), (24.0, 100.0), (100.0, 500.0)))
    assert all(got[24.0, a] <= got[24.0, b] for a, b in ((0.0, 0.5), (0.5, 1.0)))
    half = grid.filter("t = 0").select("s", decay.half_life(name, F.col("s")).alias("h")).select(decay.CURVES[name](F.col("h"), F.col("s")).alias("o"))
    assert all(r.o == pytest.approx(0.5) for r in half.collect())


def test_custom_curve_is_clipped(spark):
    assert value(row(spark), decay.custom(lambda t, s: t)(F.lit(5.0), F.lit(0.1))) == 1.0


def test_density_thermal_and_transitions(spark):
    df = row(spark)
    assert value(df, decay.semantic_density()) == pytest.approx(0.7)
    assert value(df.withColumn("schema_ref", F.lit(None).cast("string")), decay.semantic_density()) == pytest.approx(0.6)
    assert value(df, decay.thermal()) == "hot" and value(row(spark, "ghost"), decay.thermal()) == "dead"
    assert value(df, decay.transition(F.lit("ghost"), F.lit("revive"))) == "reactivated"
    assert value(df, decay.transition(F.lit("ghost"), F.lit("replay"))) == "ghost"


def test_state_vectors(spark):
    df = spark.createDataFrame([("[0.1, 0.2]",), ("[" + ", ".join(["0.3"] * 9 + ["0.9", "0.8", "0.1", "0.02"]) + "]",), ("[]",), (None,), ("[0.1,",)], "v string")
    got = df.select(*[c.alias(n) for n, c in memory.state_vector("v").items()]).collect()
    assert (got[0].importance, got[0].frequency, got[0].recency) == (0.1, 0.2, 1.0)
    assert (got[1].importance, got[1].surprise) == (0.8, 0.9)
    assert all((r.importance, r.confidence) == (0.5, 0.5) for r in got[2:])


def edge(spark, kind, weight=0.5, co=3, idle=24.0, age=240.0):
    return spark.createDataFrame([(kind, weight, co, NOW - idle * 3600, NOW - age * 3600)], "edge_type string, weight double, co_count bigint, last_at double, created_at double")


@pytest.mark.parametrize(("kind", "want"), [("causes", 0.55), ("topical", 0.15), ("unheard_of", 0.075), ("temporal", 0.5)])
def test_gate_weights(spark, kind, want):
    assert value(edge(spark, kind), links.gated_weight()) == pytest.approx(want)


def test_edge_scores(spark):
    assert value(edge(spark, "causes"), links.traversal_weight()) == pytest.approx(0.75)
    assert value(edge(spark, "causes", age=24 * 91), links.retrieval_score(NOW)) == 0.0
    assert value(edge(spark, "topical"), links.faded_weight(NOW)) == pytest.approx(0.5 * math.exp(-0.005 * 24))
    assert value(edge(spark, "topical", idle=1), links.hebbian_weight(NOW)) == pytest.approx(0.53)
    assert value(edge(spark, "topical", weight=0.001, idle=9999), links.faded_weight(NOW)) == links.LEAST_WEIGHT


def test_vectors(spark):
    df = spark.createDataFrame([([3.0, 4.0], [4.0, 3.0])], "a array<double>, b array<double>")
    assert value(df, V.cosine(F.col("a"), F.col("b"))) == pytest.approx(0.96)
    assert value(df, V.cosine(F.col("a"), V.literal([0.0, 0.0]))) == 0.0
    assert value(df, V.strided(F.array(*map(F.lit, range(64))), 16)) == list(range(0, 64, 4))


def test_gate_decisions(spark):
    cases = [("", "reject:empty_text"), ("short", "reject:too_short"), ("okay....", "reject:noise_pattern"), ("12345678 90", "reject:noise_pattern")]
    for text, want in cases:
        df = spark.createDataFrame([(text, [])], "t string, g array<string>")
        assert value(df, T.gate(F.col("t"), F.lit(0.5), F.lit(0.0), F.col("g"))) == want
    df = spark.createDataFrame([("The deployment failed because of a config error today", ["error"])], "t string, g array<string>")
    assert value(df, T.gate(F.col("t"), F.lit(0.5), F.lit(0.0), F.col("g"))) == "accept:passed"
    assert value(df, T.gate(F.col("t"), F.lit(0.05), F.lit(0.0), F.col("g"))).startswith("defer")
    assert value(df, T.causal_vote(F.col("t"))[0]) == "causes"
