"""Single updates of anchors, edges and narratives as Catalyst expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from mnemospark.functions.decay import clip

# What an edge is made with by the way it came about: weight, relation, confidence, source, type.
EDGE_PRESETS = {
    "explicit": (0.7, None, 0.95, "explicit", "topical"), "implicit": (0.4, None, 0.42, "implicit", "topical"), "inferred": (0.4, None, 0.42, "inferred", "topical"),
    "temporal": (0.6, "before", 0.85, "explicit", "temporal"), "causal": (0.7, "causes", 0.8, "inferred", "causal"), "supersedes": (0.6, "supersedes", 0.7, "explicit", "superseded_by"),
    "contradicts": (0.5, "contradicts", 0.6, "inferred", "contradicts"), "derived_from": (0.4, "derived_from", 0.6, "inferred", "derived_from"), "from_edge": (None, None, 0.5, "implicit", None),
}
VERSIONS_KEPT = 20


def presets(spark: SparkSession) -> DataFrame:
    """The dimension of edge presets: (preset, weight, relation, confidence, source_type, edge_type)."""
    return spark.createDataFrame([(k, *v) for k, v in EDGE_PRESETS.items()], "preset string, weight double, relation string, confidence double, source_type string, edge_type string")


def made_edges(pairs: DataFrame, preset: str) -> DataFrame:
    """Edges of a preset over (source, target); ``from_edge`` takes weight and type of the pairs."""
    weight, relation, confidence, source, kind = EDGE_PRESETS[preset]
    return pairs.select(
        "source", "target", (F.lit(weight) if weight is not None else F.col("weight")).alias("weight"), F.lit(relation).cast("string").alias("relation"),
        F.lit(confidence).alias("confidence"), F.lit(source).alias("source_type"), (F.lit(kind) if kind else F.col("edge_type")).alias("edge_type"),
    )


def thawed(c: dict[str, Column], thermal: Column, as_of: float) -> dict[str, Column]:
    """State, recency, frequency and time of an anchor after a thaw: cold ghosts revive, other cold ones are raised, dead ones stay."""
    cold = thermal == "cold"
    ghost = c["state"] == "ghost"
    raised = cold & ~ghost
    return {
        "state": F.when(cold & ghost, "reactivated").otherwise(c["state"]), "recency": F.when(raised, 1.0).otherwise(c["recency"]),
        "frequency": F.when(raised, F.greatest(c["frequency"], F.lit(0.05))).otherwise(c["frequency"]), "last_at": F.when(raised, F.lit(as_of)).otherwise(c["last_at"]),
    }


def reweighted(weight: Column, versions: Column, delta: Column, action: str, at: Column) -> tuple[Column, Column]:
    """A weight raised or lowered within 0 and 1, and the log of its last twenty changes (old, new, action, at)."""
    new = clip(weight + (delta if action == "strengthen" else -delta), 0.0, 1.0)
    entry = F.struct(weight.alias("old"), new.alias("new"), F.lit(action).alias("action"), at.alias("at"))
    return new, F.slice(F.concat(versions, F.array(entry)), -F.least(F.lit(VERSIONS_KEPT), F.size(versions) + 1), F.lit(VERSIONS_KEPT))


def prediction_error(topic: Column, actual_topic: Column, tone: Column, actual_tone: Column) -> Column:
    """The mean of the topic's distance, where both topics are known, and the gap of tones."""
    gap = F.abs(tone - actual_tone)
    return F.when(topic.isNotNull() & actual_topic.isNotNull(), ((1.0 - _cosine(topic, actual_topic)) + gap) / 2.0).otherwise(gap)


def _cosine(a: Column, b: Column) -> Column:
    from mnemospark.functions.vectors import cosine

    return cosine(a, b)


def compressed(words: Column, budget: int) -> Column:
    """The level of detail of each text of a list, in order, by the words used so far: 0 whole, 1 first sentence (30), 2 reference (10).

    ``words`` is an array of word counts; what a text costs depends on the levels before it, so
    the list is folded.
    """
    start = F.struct(F.lit(0).cast("bigint").alias("used"), F.array().cast("array<int>").alias("levels"))

    def step(acc: Column, n: Column) -> Column:
        whole, short = acc["used"] + n <= budget * 0.8, acc["used"] + 30 <= budget * 0.9
        cost = F.when(whole, n).when(short, 30).otherwise(10).cast("bigint")
        level = F.when(whole, 0).when(short, 1).otherwise(2)
        return F.struct((acc["used"] + cost).alias("used"), F.concat(acc["levels"], F.array(level)).alias("levels"))

    return F.aggregate(words, start, step, lambda acc: acc["levels"])


def clipped_sum(steps: Column, start: float) -> Column:
    """The fold of ordered steps onto a start value, kept within 0 and 1 after each step."""
    return F.aggregate(steps, F.lit(start), lambda s, x: clip(s + x, 0.0, 1.0))
