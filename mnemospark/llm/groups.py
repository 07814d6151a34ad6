"""Consolidating pairwise matches into groups (problem 4).

Method: minimum labels propagate across edges, pointer jumping shortens the label
chains, and every round is written to the shared folder until no label changes.

A round takes the pairs between the current group labels.  Every label points to
the smallest label among itself and its neighbours; these pointers only ever lead
to smaller labels, so they form trees, and pointer jumping (each label takes its
target's target) brings every label to its root in as many steps as the logarithm
of the tree's depth.  The pairs are then rewritten to the roots, loops and repeats
dropped, and the next round starts on what is left.  A hub that holds a third of
all pairs shrinks in the first round, and the minimum over its neighbours is
aggregated before the shuffle, so it never meets in one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mnemospark.functions import notation
from mnemospark.store import Scratch

#: Relation names, as ``notation.edge_types`` writes them, that say that both ends are the same memory.
SAME = ("duplicates", "duplicate_of", "duplicate", "is_duplicate_of", "duplicated_by", "dup", "dup_of", "same_as", "identical_to", "copy_of")
#: What the text of each of them contains; read before a type is taken apart.
_STEMS = r"(?i)dup|same[\s_-]*as|identical|copy"

MAX_ROUNDS = 64


def duplicate_pairs(edges: DataFrame) -> DataFrame:
    """Distinct pairs (a < b) of ids whose edge says that they are duplicates.

    Ends are compared stripped and in lower case.  Edges with a null or blank end,
    and links of an id to itself, give no pair; negated names do not count.  Columns
    other than source, target and edge_type are not read.
    """
    kinds = notation.edge_types("edge_type")
    return (
        edges.filter(F.col("edge_type").rlike(_STEMS))
        .filter(F.arrays_overlap(kinds, F.array(*map(F.lit, SAME))))
        .select(notation.key("source").alias("s"), notation.key("target").alias("t"))
        .filter("s is not null and t is not null and s <> t")
        .select(F.least("s", "t").alias("a"), F.greatest("s", "t").alias("b"))
        .distinct()
    )


def _jump(pointers: DataFrame, scratch: Scratch) -> DataFrame:
    """Every label's root, by jumping until no pointer changes."""
    for _ in range(MAX_ROUNDS):
        target = pointers.select(F.col("node").alias("root"), F.col("root").alias("further"))
        moved = scratch.keep(
            pointers.join(target, "root", "left").select(
                "node",
                F.coalesce("further", "root").alias("root"),
                (F.col("further") < F.col("root")).alias("moved"),
            )
        )
        scratch.drop(pointers)
        pointers = moved.select("node", "root")
        pointers._scratch_path = moved._scratch_path
        if moved.filter("moved").isEmpty():
            return pointers
    raise RuntimeError("pointer jumping did not end")


def group_labels(pairs: DataFrame) -> DataFrame:
    """One row (node, root) for each id in ``pairs`` (a, b): root is the least id linked to it.

    Nulls and loops are ignored, repeated pairs and either direction count once; an
    empty input gives an empty result.
    """
    scratch = Scratch(pairs.sparkSession, "groups")
    left = scratch.keep(pairs.filter("a is not null and b is not null and a <> b").select("a", "b"))
    labels = None
    for _ in range(MAX_ROUNDS):
        if left.isEmpty():
            break
        both = left.select(F.col("a").alias("node"), F.col("b").alias("other")).union(left.select("b", "a"))
        pointers = scratch.keep(
            both.groupBy("node").agg(F.min("other").alias("least")).select("node", F.least("node", "least").alias("root"))
        )
        roots = _jump(pointers, scratch)
        to_a, to_b = roots.toDF("a", "ra"), roots.toDF("b", "rb")
        nxt = scratch.keep(
            left.join(to_a, "a").join(to_b, "b").filter("ra <> rb")
            .select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b")).distinct()
        )
        if labels is None:
            labels = roots
        else:
            further = roots.toDF("root", "further")
            grown = scratch.keep(labels.join(further, "root", "left").select("node", F.coalesce("further", "root").alias("root")))
            scratch.drop(labels)
            scratch.drop(roots)
            labels = grown
        scratch.drop(left)
        left = nxt
    else:
        raise RuntimeError("label propagation did not end")
    if labels is None:
        return left.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return labels


def duplicate_groups(edges: DataFrame) -> DataFrame:
    """(anchor_id, group_id) of every anchor id that edges call a duplicate of another."""
    return group_labels(duplicate_pairs(edges)).select(F.col("node").alias("anchor_id"), F.col("root").alias("group_id"))
