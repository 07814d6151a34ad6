"""Merging, rewiring and resizing of the graph, and ordered folds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mnemospark.operators import graph, ordered
from mnemospark.store import Scratch


def cores(pairs: DataFrame, anchors: DataFrame, shared_tag: bool = False) -> DataFrame:
    """(id, core): members of the groups that pairs (a, b) link directly or over others, with the oldest of the group.

    ``anchors`` has id, created_at and tags; with ``shared_tag`` only pairs with a tag in
    common link.  Of equally old ones the least id is the core.
    """
    scratch = Scratch(pairs.sparkSession, "cores")
    a = anchors.select("id", "created_at", "tags")
    if shared_tag:
        tags = a.select("id", "tags")
        pairs = pairs.join(tags.toDF("a", "ta"), "a").join(tags.toDF("b", "tb"), "b").filter(F.arrays_overlap("ta", "tb"))
    groups = scratch.keep(graph.components(pairs.select(F.col("a").alias("lo"), F.col("b").alias("hi"))).toDF("id", "grp"))
    aged = groups.join(a.select("id", "created_at"), "id")
    oldest = aged.groupBy("grp").agg(F.min(F.struct("created_at", "id"))["id"].alias("core"))
    return aged.join(oldest, "grp").select("id", "core")


def rewired(pairs: DataFrame, cores: DataFrame) -> DataFrame:
    """(lo, hi, weight, n): edges with their ends moved to the cores; links to itself go, of several the heaviest counts."""
    to = lambda end: cores.select(F.col("id").alias(end), F.col("core").alias(f"{end}_core"))
    moved = pairs.select("lo", "hi", "weight").join(to("lo"), "lo", "left").join(to("hi"), "hi", "left")
    s, t = F.coalesce("lo_core", "lo"), F.coalesce("hi_core", "hi")
    return moved.filter(s != t).groupBy(F.least(s, t).alias("lo"), F.greatest(s, t).alias("hi")).agg(F.max("weight").alias("weight"), F.count("*").alias("n"))


def reinforced(pairs: DataFrame) -> DataFrame:
    """Edges with ``ok`` successes and ``bad`` failures after learning from them: action, weight, successes left, cluster."""
    trials = F.col("ok") + F.col("bad")
    rate = F.when(trials > 0, F.col("ok") / trials).otherwise(0.5)
    up, down = (trials >= 3) & (rate >= 0.7) & (F.col("ok") >= 2), (trials >= 5) & (rate < 0.3)
    w = (
        F.when(up, F.least(F.lit(1.0), F.col("weight") + F.least(F.lit(0.1), F.col("ok") * 0.015)))
        .when(down, F.greatest(F.lit(0.0), F.col("weight") - F.least(F.lit(0.1), F.col("bad") * 0.01))).otherwise(F.col("weight"))
    )
    action = F.when(up, "boost").when(down, "weaken").otherwise("keep")
    return pairs.select("lo", "hi", action.alias("action"), w.alias("weight"), F.greatest(F.lit(0), F.col("ok") - 1).alias("successes"), (F.col("co_count") >= 5).alias("cluster"))


def split_oversized(both: DataFrame, labels: DataFrame, most: int, rounds: int, least: int = 3) -> DataFrame:
    """(node, label): communities of more than ``most`` split by label propagation within them.

    The largest part keeps the label, parts under ``least`` stay with it.
    """
    scratch = Scratch(both.sparkSession, "split")
    large = labels.groupBy("label").agg(F.count("*").alias("n")).filter(F.col("n") > most).select("label")
    inside = labels.join(large, "label", "left_semi").select("node", "label")
    x, y = inside.toDF("node", "lx"), inside.toDF("other", "ly")
    edges = scratch.keep(both.select("node", "other", "weight").join(x, "node").join(y, "other").filter("lx = ly").select("node", "other", "weight"))
    parts = graph.label_propagation(edges, rounds).toDF("node", "part").join(labels, "node")
    sizes = scratch.keep(parts).groupBy("label", "part").agg(F.count("*").alias("n"))
    keeps = sizes.groupBy("label").agg(F.min(F.struct((-F.col("n")).alias("least"), "part"))["part"].alias("kept"))
    own = sizes.join(keeps, "label").filter((F.col("part") != F.col("kept")) & (F.col("n") >= least))
    moved = parts.join(own.select("label", "part"), ["label", "part"]).select("node", F.concat_ws("/", "label", "part").alias("new"))
    return labels.join(moved, "node", "left").select("node", F.coalesce("new", "label").alias("label"))


def filtered_small(both: DataFrame, labels: DataFrame, least: int) -> DataFrame:
    """(node, label): members of communities under ``least`` moved to the label of their heaviest neighbours outside, else to the largest."""
    labels = Scratch(both.sparkSession, "small").keep(labels)
    sizes = labels.groupBy("label").agg(F.count("*").alias("n"))
    largest = sizes.orderBy(F.desc("n"), "label").select("label").first()
    small = labels.join(sizes.filter(F.col("n") < least), "label").select("node", "label")
    votes = (
        both.join(small, "node").join(labels.toDF("other", "theirs"), "other").filter("theirs <> label")
        .groupBy("node", "theirs").agg(F.round(F.sum("weight"), 9).alias("w"))
    )
    best = votes.groupBy("node").agg(F.min(F.struct((-F.col("w")).alias("least"), "theirs"))["theirs"].alias("theirs"))
    moved = small.select("node").join(best, "node", "left").select("node", F.coalesce("theirs", F.lit(largest[0] if largest else None)).alias("new"))
    return labels.join(moved, "node", "left").select("node", F.coalesce("new", "label").alias("label"))


def similarity_gate(incoming: DataFrame, stored: DataFrame, pairs: DataFrame, duplicate: float, similar: float) -> DataFrame:
    """(id, decision, target, cosine): incoming memories against the most similar older one of all stored.

    ``pairs`` (a, b, cosine) holds all similar pairs; both tables have id and created_at.
    """
    pairs = Scratch(pairs.sparkSession, "gate").keep(pairs)  # read from either end
    both = pairs.select(F.col("a").alias("id"), F.col("b").alias("other"), "cosine").unionByName(pairs.select(F.col("b").alias("id"), F.col("a").alias("other"), "cosine"))
    older = both.join(incoming.select("id", "created_at"), "id").join(stored.select(F.col("id").alias("other"), F.col("created_at").alias("then")), "other")
    older = older.filter(F.struct("then", F.col("other").alias("id")) < F.struct("created_at", "id"))
    best = older.groupBy("id").agg(F.min(F.struct((-F.round("cosine", 9)).alias("least"), "other", "cosine")).alias("b"))
    decision = F.when(F.col("b.cosine") >= duplicate, "reject:duplicate").when(F.col("b.cosine") >= similar, "merge:similar_exists").otherwise("accept:passed")
    return incoming.select("id").join(best, "id", "left").select("id", decision.alias("decision"), F.col("b.other").alias("target"), F.col("b.cosine").alias("cosine"))


def clipped_folds(steps: DataFrame, by: str, order: list[str], value: str, start: float) -> DataFrame:
    """(by, n, value): for each key the steps added up in order, kept within 0 and 1 after each.

    A run of such steps is itself a step of the form clip(x + shift, low, high), and two of
    them compose into one, so range partitions are folded as they pass and only one row for
    each partition and key is brought together.
    """
    parts = ordered.ranged(steps, [by], order)
    return ordered.folded(parts, by, value, start)
