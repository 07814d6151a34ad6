"""Recall over the graph in levels, shared by the retrieval queries.

Hops are joins of a bounded number; what a hop starts from is stored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from mnemospark.operators.graph import with_traversal
from mnemospark.store import Scratch

# The kinds of memory that each kind of task looks at.
TASK_TYPES = {
    "coding": ("procedural", "semantic", "episodic"), "debugging": ("episodic", "semantic"), "planning": ("semantic", "procedural"),
    "reflection": ("episodic", "semantic"), "conversation": ("working", "episodic", "semantic"),
}


def walk(both: DataFrame, seeds: DataFrame, hops: int, fade: float = 0.6) -> DataFrame:
    """(node, score, depth): the best score that reaches each node from seeds (node, score), and the least depth of it.

    A hop multiplies by the edge's traversal weight and ``fade`` to the power of its depth;
    nodes met before are walked on from again.
    """
    scratch = Scratch(both.sparkSession, "walk")
    step = with_traversal(both).select("node", "other", "tw")
    level = scratch.keep(seeds.select("node", "score"))
    met = level.withColumn("depth", F.lit(0))
    for d in range(1, hops + 1):
        sent = level.join(step, "node").groupBy(F.col("other").alias("node")).agg(F.max(F.col("score") * F.col("tw") * fade ** (d - 1)).alias("score"))
        level = scratch.keep(sent)
        met = met.unionByName(level.withColumn("depth", F.lit(d)))
    best = F.min(F.struct((-F.round("score", 9)).alias("least"), "depth", "score"))
    return met.groupBy("node").agg(best.alias("b")).select("node", "b.score", "b.depth")


def levels(directed: DataFrame, roots: DataFrame, depth: int) -> DataFrame:
    """(node, depth): the nodes that edges (node, other) lead to from the roots, with the least number of steps."""
    scratch = Scratch(directed.sparkSession, "levels")
    seen = front = scratch.keep(roots.select("node", F.lit(0).alias("depth")))
    for d in range(1, depth + 1):
        nxt = front.join(directed, "node").select(F.col("other").alias("node")).distinct().join(seen.select("node"), "node", "left_anti")
        front = scratch.keep(nxt.withColumn("depth", F.lit(d)))
        seen = seen.unionByName(front)
    return seen


def reached(both: DataFrame, starts: DataFrame, hops: int) -> DataFrame:
    """The nodes that an edge or a path of up to ``hops`` edges leads to; a start counts if one leads back to it."""
    scratch = Scratch(both.sparkSession, "reached")
    front, out = starts.select("node"), None
    for _ in range(hops):
        front = scratch.keep(front.join(both.select("node", "other"), "node").select(F.col("other").alias("node")).distinct())
        out = front if out is None else out.unionByName(front)
    return out.distinct()


def constellation(both: DataFrame, seeds: DataFrame, depth: int, size: int, least: float = 0.1) -> DataFrame:
    """(node, depth, tw): the ``size`` nodes met first around the seeds over edges of at least ``least``, the strongest of a level first."""
    scratch = Scratch(both.sparkSession, "constellation")
    step = with_traversal(both).filter(F.col("tw") >= least).select("node", "other", F.col("tw").alias("t"))
    seen = front = scratch.keep(seeds.select("node", F.lit(0).alias("depth"), F.lit(9.0).alias("tw")))
    for d in range(1, depth + 1):
        nxt = front.join(step, "node").groupBy(F.col("other").alias("node")).agg(F.max("t").alias("tw")).join(seen.select("node"), "node", "left_anti")
        front = scratch.keep(nxt.select("node", F.lit(d).alias("depth"), "tw"))
        seen = seen.unionByName(front)
    return seen.orderBy("depth", F.desc(F.round("tw", 9)), "node").limit(size)


def descent(results: list[DataFrame], k: int) -> DataFrame:
    """(id, level, score): the results (id, score) of one level after another; an id counts at its first level, and the k first are kept.

    Every level brings a bounded list, so the union is small.
    """
    rows = None
    for n, df in enumerate(results):
        own = df.select("id", "score", F.lit(n).alias("level"))
        rows = own if rows is None else rows.unionByName(own)
    first = rows.withColumn("rn", F.row_number().over(W.partitionBy("id").orderBy("level"))).filter("rn = 1")
    return first.orderBy("level", F.desc(F.round("score", 9)), "id").limit(k).select("id", "level", "score")
