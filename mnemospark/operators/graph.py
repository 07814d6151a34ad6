"""Graph operators over ``memory.both_ways`` edges (node, other, edge_type, weight, ...).

Edges are read once for each hop or round, so callers pass a stored table.  Traversals
are unrolled joins of a bounded number of hops.  Loops that run until nothing changes
write every round to the shared folder.  Degrees may be skewed: each
join has one row per node on the other side, and sums are combined before the shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from mnemospark.functions import links
from mnemospark.store import Scratch, shuffles_freed

#: Relations that say that one memory follows from another.
CAUSAL = ("causes", "causal", "caused_by", "fixes", "resolves", "depends_on", "derived_from")

MAX_ROUNDS = 64
#: Rounds of a fixed-length loop between two written tables.
CUT_EVERY = 4

#: Nodes of a block of ``transitive_all``, and how many paths of two edges a task should have as long as
#: an edge is not sent more than ``MOST_SENT`` times for it; beyond the partitions several pairs of blocks share one.
NODE_ROWS, PATHS, MOST_SENT, MOST_PARTITIONS = 131_072, 1_000_000, 8, 20_000
#: Paths that a task holds at a time, and rows that it passes on at once.
PATH_ROWS, BATCH_ROWS = 1 << 19, 1 << 16


def with_traversal(both: DataFrame) -> DataFrame:
    return both.withColumn("tw", links.traversal_weight())


def neighbours(both: DataFrame, k: int, least: float = 0.0) -> DataFrame:
    """The k strongest neighbours of each node by traversal weight: (node, other, tw, rank)."""
    rank = F.row_number().over(W.partitionBy("node").orderBy(F.desc("tw"), "other"))
    return with_traversal(both).filter(F.col("tw") >= least).select("node", "other", "tw").withColumn("rank", rank).filter(F.col("rank") <= k)


def hubs(both: DataFrame, k: int) -> DataFrame:
    """The k nodes of most neighbours (a top-k report)."""
    return both.groupBy("node").agg(F.count("*").alias("degree")).orderBy(F.desc("degree"), "node").limit(k)


def spread(both: DataFrame, seeds: DataFrame, steps: int = 3, decay: float = 0.6, least: float = 0.05) -> DataFrame:
    """Activation (node, activation) that spreads from seeds (node) into nodes not reached before.

    A wave adds up what all nodes of the last wave send; the result is scaled to at
    most 1.  Seeds without edges keep their activation.
    """
    scratch = Scratch(both.sparkSession, "spread")
    step = with_traversal(both).filter(F.col("tw") >= least).select("node", "other", "tw")
    reached = wave = scratch.keep(seeds.select("node", F.lit(1.0).alias("activation")).distinct())
    for _ in range(steps):
        sent = wave.join(step, "node").groupBy(F.col("other").alias("node")).agg(F.sum(F.col("activation") * F.col("tw") * decay).alias("activation"))
        wave = scratch.keep(sent.join(reached.select("node"), "node", "left_anti"))
        reached = reached.unionByName(wave)
    most = reached.agg(F.max("activation")).first()[0] or 1.0
    return reached.select("node", (F.col("activation") / max(1.0, most)).alias("activation"))


def spread_accumulated(both: DataFrame, seeds: DataFrame, depth: int = 3, cap: int = 48) -> DataFrame:
    """Activation that also returns to nodes met before, level by level; the ``cap`` strongest nodes."""
    step = with_traversal(both).select("node", "other", "tw")
    level = seeds.select("node", F.lit(1.0).alias("a"))
    out = level
    for d in range(depth):
        level = level.join(step, "node").groupBy(F.col("other").alias("node")).agg(F.sum(F.col("a") * F.col("tw") * (0.6 ** (d + 1))).alias("a"))
        out = out.unionByName(level)
    return out.groupBy("node").agg(F.sum("a").alias("activation")).orderBy(F.desc(F.round("activation", 9)), "node").limit(cap)


def best_paths(both: DataFrame, seeds: DataFrame, hops: int = 3, least: float = 0.02) -> DataFrame:
    """(node, depth, score): the least depth at which each node is met and its best score there.

    A hop multiplies by the edge's traversal weight and 0.6 to the power of the depth.
    """
    scratch = Scratch(both.sparkSession, "paths")
    step = with_traversal(both).select("node", "other", "tw")
    seen = front = scratch.keep(seeds.select("node", F.lit(0).alias("depth"), F.lit(1.0).alias("score")))
    for d in range(1, hops + 1):
        nxt = front.join(step, "node").groupBy(F.col("other").alias("node")).agg(F.max(F.col("score") * F.col("tw") * (0.6**d)).alias("score"))
        front = scratch.keep(nxt.filter(F.col("score") >= least).join(seen.select("node"), "node", "left_anti").select("node", F.lit(d).alias("depth"), "score"))
        seen = seen.unionByName(front)
    return seen


def components(pairs: DataFrame) -> DataFrame:
    """(node, component): the least id of each node's connected component, by alternating stars.

    Every node hangs its greater neighbours onto its least one, then its lesser ones;
    the edge set is written after each round and the loop ends when it stays the same.
    """
    scratch = Scratch(pairs.sparkSession, "components")
    edges = scratch.keep(pairs.select(F.greatest("lo", "hi").alias("u"), F.least("lo", "hi").alias("v")).filter("u <> v").distinct())
    before = -1
    for _ in range(MAX_ROUNDS):
        # large star: neighbours greater than a node go to the least of its neighbourhood
        both = edges.union(edges.select("v", "u"))
        least = both.groupBy("u").agg(F.min("v").alias("m"))
        star = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.least("m", "u").alias("v")).distinct()
        # small star: the lesser neighbours of a node, and itself, go to the least of them
        least = star.groupBy("u").agg(F.min("v").alias("m"))
        joined = star.join(least, "u")
        small = joined.filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v"))).distinct()
        nxt = scratch.keep(small)
        check = nxt.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        scratch.drop(edges)
        edges = nxt
        if tuple(check) == before:
            break
        before = tuple(check)
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).union(edges.select("v", "v")).distinct()


def label_propagation(both: DataFrame, rounds: int) -> DataFrame:
    """(node, label) after a fixed number of synchronous rounds; ties go to the least label.

    A node takes the label of the greatest summed edge weight among its neighbours; it
    keeps its own where that is among the heaviest.
    """
    scratch = Scratch(both.sparkSession, "labels")
    labels = scratch.keep(both.select("node", F.col("node").alias("label")).distinct())
    sides, kind = both.select("node", "other", "weight"), dict(both.dtypes)["weight"]
    for r in range(1, rounds + 1):
        votes = sides.join(labels.toDF("other", "theirs"), "other").select("node", "theirs", "weight", F.lit(False).alias("own"))
        own = labels.select("node", F.col("label").alias("theirs"), F.lit(None).cast(kind).alias("weight"), F.lit(True).alias("own"))
        # one shuffle by node serves the sums and the choice
        summed = votes.union(own).repartition("node").groupBy("node", "theirs").agg(F.round(F.sum("weight"), 9).alias("w"), F.max("own").alias("mine"))
        # the heaviest first (NaN above all), then the own label, then the least one
        first = F.min(F.when(F.col("w").isNotNull(), F.struct(~F.isnan("w"), -F.col("w"), ~F.col("mine"), F.col("theirs").alias("label"))))
        best = summed.groupBy("node").agg(first.alias("b"), F.max("mine").alias("known")).filter("known and b is not null")
        nxt = best.select("node", "b.label")
        labels = scratch.keep(nxt) if r % 2 == 0 or r == rounds else nxt
    return labels


def modularity(pairs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row (modularity, communities): the weighted modularity summed over edges within a label."""
    m = pairs.agg(F.sum("weight")).first()[0] or 0.0
    degree = pairs.select(F.col("lo").alias("node"), "weight").union(pairs.select("hi", "weight")).groupBy("node").agg(F.sum("weight").alias("k"))
    side = degree.join(labels, "node")
    inside = (
        pairs.join(side.toDF("lo", "ka", "la"), "lo").join(side.toDF("hi", "kb", "lb"), "hi").filter("la = lb")
        .select(((F.col("weight") - F.col("ka") * F.col("kb") / (2.0 * m)) / (2.0 * m)).alias("q"))
    )
    n = labels.select("label").distinct().count()
    return inside.agg(F.coalesce(F.sum("q"), F.lit(0.0)).alias("modularity")).withColumn("communities", F.lit(n).cast("bigint"))


def topology(both: DataFrame, labels: DataFrame | None = None) -> DataFrame:
    """(node, degree, entropy, richness, causal, bridge, topology) of every node with edges.

    Entropy is that of the types of its edges, scaled by the logarithm of eight types;
    bridge is the share of distinct neighbour labels where there is more than one.
    """
    types = both.groupBy("node", "edge_type").agg(F.count("*").alias("n"), F.avg("weight").alias("w"))
    total = F.sum("n").over(W.partitionBy("node"))
    p = F.col("n") / total
    per = types.select("node", "n", "edge_type", p.alias("p")).groupBy("node").agg(
        F.sum("n").alias("degree"), (-F.sum(F.col("p") * F.log("p"))).alias("entropy"),
        F.sum(F.when(F.col("edge_type").isin(*CAUSAL), F.col("n")).otherwise(0)).alias("causal_n"),
        F.sum(F.col("n") * links.lookup(links.TRAVERSAL, F.col("edge_type"), 1.0)).alias("rich"),
    )
    if labels is not None:
        bridges = both.join(labels.toDF("other", "theirs"), "other").groupBy("node").agg(F.countDistinct("theirs").alias("labels"))
        per = per.join(bridges, "node", "left")
    else:
        per = per.withColumn("labels", F.lit(0).cast("bigint"))
    most = per.agg(F.max("degree")).first()[0] or 1
    c = F.col
    bridge = F.when((c("degree") < 2) | (F.coalesce("labels", F.lit(0)) <= 1), 0.0).otherwise(F.least(F.lit(1.0), c("labels") / c("degree")))
    entropy = F.least(F.lit(1.0), c("entropy") / F.log(F.lit(8.0)))
    richness = F.least(F.lit(1.0), c("rich") / c("degree") / 1.5)
    causal = F.least(F.lit(1.0), c("causal_n") / c("degree") * 2.0)
    parts = per.select("node", "degree", entropy.alias("entropy"), richness.alias("richness"), causal.alias("causal"), bridge.alias("bridge"))
    score = 0.20 * c("degree") / float(most) + 0.15 * c("entropy") + 0.25 * c("richness") + 0.15 * c("bridge") + 0.25 * c("causal")
    return parts.withColumn("topology", score)


def transitive(pairs: DataFrame, over: float = 0.6, least: float = 0.15, damping: float = 0.7, budget: int = 32) -> DataFrame:
    """(lo, hi, weight) of pairs that two strong edges connect and no edge does: the best product.

    Both edges must be heavier than ``over`` and within the memory model's edge budget,
    the ``budget`` heaviest of the node between, so a hub adds a bounded number of pairs.
    """
    strong = pairs.filter(F.col("weight") > over).select("lo", "hi", "weight")
    sides = strong.select(F.col("lo").alias("via"), F.col("hi").alias("end"), "weight").union(strong.select("hi", "lo", "weight"))
    rank = F.row_number().over(W.partitionBy("via").orderBy(F.desc("weight"), "end"))
    sides = sides.withColumn("r", rank).filter(F.col("r") <= budget).drop("r")
    a, b = sides.toDF("via", "lo", "wa"), sides.toDF("via", "hi", "wb")
    w = F.col("wa") * F.col("wb") * damping
    found = a.join(b, "via").filter(F.col("lo") < F.col("hi")).select("lo", "hi", w.alias("weight")).filter(F.col("weight") > least)
    return found.groupBy("lo", "hi").agg(F.max("weight").alias("weight")).join(pairs.select("lo", "hi"), ["lo", "hi"], "left_anti")


def _sent_sides(sides: DataFrame, scratch: Scratch) -> DataFrame:
    """Sides (u, v, weight, x) once for each block y, v's own x among them, where u has another neighbour than v."""
    blocks = sides.groupBy("u", "x").agg(F.count("*").alias("n")).groupBy("u").agg(F.collect_set("x").alias("at"), F.collect_set(F.when(F.col("n") > 1, F.col("x"))).alias("twice"))
    blocks = blocks.filter("size(at) > 1 or size(twice) > 0")
    to = F.filter("at", lambda y: (y != F.col("x")) | F.array_contains("twice", F.col("x")))
    with shuffles_freed(scratch.spark):
        kept = scratch.keep(sides.join(blocks, "u").select("u", "v", "weight", "x", to.alias("to")))
    return kept.select("u", "v", "weight", "x", F.explode("to").alias("y"))


def transitive_all(pairs: DataFrame, at_least: float = 0.6, least: float = 0.15, damping: float = 0.7, rows: int = NODE_ROWS) -> DataFrame:
    """(lo, hi, weight) of all pairs that two strong edges connect and no edge does: the best product.

    Every edge of ``at_least`` or more counts, whatever the degree of the node between.  Nodes
    are hashed into blocks of at most about ``rows``, and one task has all edges with an end in either
    of two blocks, so it finds each pair between them with its best product.  An edge is sent only to
    the blocks where its node between has another neighbour.  Only edges are shuffled; the pairs, whose number grows with the square of a hub's degree, are passed on as they are found.
    """
    strong = pairs.filter(F.col("weight") >= at_least).select("lo", "hi", "weight")
    sides = strong.select(F.col("lo").alias("u"), F.col("hi").alias("v"), "weight").union(strong.select("hi", "lo", "weight"))
    nodes, paths = sides.groupBy("u").agg(F.count("*").cast("double").alias("n")).agg(F.count("*"), F.sum(F.col("n") * (F.col("n") - 1) / 2)).first()
    blocks = max(1, ceil(nodes / rows), min(MOST_SENT, ceil((2 * (paths or 0) / PATHS) ** 0.5)))
    block = lambda c: F.pmod(F.xxhash64(c), F.lit(blocks)).cast("int")
    own = _sent_sides(sides.withColumn("x", block("v")), Scratch(pairs.sparkSession, "graph"))
    ends = own.select(F.least("x", "y").alias("i"), F.greatest("x", "y").alias("j"), F.when(F.col("x") <= F.col("y"), 0).otherwise(1).alias("side"), "u", "v", "weight")
    x, y = block("lo"), block("hi")
    known = pairs.select(F.least(x, y).alias("i"), F.greatest(x, y).alias("j"), F.lit(2).alias("side"), F.when(x <= y, F.col("lo")).otherwise(F.col("hi")).alias("u"), F.when(x <= y, F.col("hi")).otherwise(F.col("lo")).alias("v"), F.lit(0.0).alias("weight"))
    tasks = min(blocks * (blocks + 1) // 2, MOST_PARTITIONS)
    number = (F.col("i") * blocks - (F.col("i") * (F.col("i") - 1) / 2).cast("int") + F.col("j") - F.col("i")).cast("int")
    sent = ends.union(known).repartitionById(tasks, F.pmod(number, F.lit(tasks)))
    if blocks * (blocks + 1) // 2 > tasks:
        sent = sent.sortWithinPartitions("i", "j")
    kind = dict(pairs.dtypes)["lo"]
    arrow = to_arrow_type(pairs.schema["lo"].dataType)

    def found(i: int, j: int, t: pa.Table) -> Iterator[pa.RecordBatch]:
        of = lambda k: t.filter(pc.equal(t["side"], k))
        sides = [of(0), of(0 if i == j else 1)]
        names = pc.unique(pa.concat_tables(sides)["v"]).cast(arrow)
        names = names.take(pc.sort_indices(names))  # numbers have the order of the names
        n = max(1, len(names))
        numbers = lambda c, among: np.asarray(pc.fill_null(pc.index_in(c, among), -1).combine_chunks(), dtype=np.int64)
        between = pc.unique(sides[1]["u"])
        (via, a, wa), (own, b, wb) = ((numbers(s["u"], between), numbers(s["v"], names), np.asarray(s["weight"].combine_chunks())) for s in sides)
        order = np.lexsort((b, own))
        at, b, wb = own[order] * n + b[order], b[order], wb[order]
        # of two ends of one block the lesser comes first
        start, end = np.searchsorted(at, via * n + (a + 1 if i == j else 0)), np.searchsorted(at, via * n + n)
        use = np.flatnonzero((via >= 0) & (start < end))
        use = use[np.argsort(a[use], kind="stable")]
        a, wa, start, many = a[use], wa[use], start[use], (end - start)[use]
        p = of(2)
        p, q = numbers(p["u"], names), numbers(p["v"], names)
        linked = np.unique((p * n + q)[(p >= 0) & (q >= 0)])
        ends = np.cumsum(many)
        firsts = np.flatnonzero(np.r_[True, a[1:] != a[:-1]]) if len(a) else np.empty(0, dtype=np.int64)
        s = 0
        while s < len(firsts):
            # as many nodes at a time as have a number of paths, one at least
            r = firsts[s]
            before = ends[r] - many[r]
            s = max(s + 1, int(np.searchsorted(ends[np.r_[firsts[1:], len(a)] - 1], before + PATH_ROWS, side="right")))
            to = firsts[s] if s < len(firsts) else len(a)
            m = many[r:to]
            x = np.repeat(start[r:to] - (ends[r:to] - m - before), m) + np.arange(ends[to - 1] - before)
            w = np.repeat(wa[r:to], m) * wb[x] * damping
            pair = np.repeat(a[r:to] * n, m) + b[x]
            order = np.argsort(pair)
            pair, w = pair[order], w[order]
            first = np.flatnonzero(np.r_[True, pair[1:] != pair[:-1]])
            pair, w = pair[first], np.maximum.reduceat(w, first)
            keep = ~(w <= least)
            near = linked[np.searchsorted(linked, pair[0]) : np.searchsorted(linked, pair[-1], side="right")]
            place = np.searchsorted(pair, near)
            keep[place[pair[place] == near]] = False
            pair, w = pair[keep], w[keep]
            for k in range(0, len(pair), BATCH_ROWS):
                u, v = np.divmod(pair[k : k + BATCH_ROWS], n)
                yield pa.RecordBatch.from_arrays([names.take(pa.array(np.minimum(u, v))), names.take(pa.array(np.maximum(u, v))), pa.array(w[k : k + BATCH_ROWS])], names=["lo", "hi", "weight"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []
        for batch in batches:
            i, j = np.asarray(batch.column(0)), np.asarray(batch.column(1))
            cuts = [0, *(np.flatnonzero((i[1:] != i[:-1]) | (j[1:] != j[:-1])) + 1).tolist(), len(i)]
            for s, e in zip(cuts, cuts[1:], strict=False):
                if s < e and (i[s], j[s]) != now:
                    if now:
                        yield from found(*now, pa.Table.from_batches(held))
                    now, held = (i[s], j[s]), []
                if s < e:
                    held.append(batch.slice(s, e - s))
        if now:
            yield from found(*now, pa.Table.from_batches(held))

    return sent.mapInArrow(run, f"lo {kind}, hi {kind}, weight double")


def pagerank(both: DataFrame, seeds: DataFrame, rounds: int = 10, damping: float = 0.85, tolerance: float | None = None) -> DataFrame:
    """(node, rank): personalised rank of the seeds' working set after a number of rounds.

    The working set is the seeds and their neighbours; transition weights are shares of
    all edges of a node, so mass that would leave the set is lost.  What a seed without
    edges holds is spread evenly over the set.  With a ``tolerance`` the rounds end once
    the ranks change by less in all, looked at whenever they are written.
    """
    scratch = Scratch(both.sparkSession, "pagerank")
    seeds = scratch.keep(seeds.select("node").distinct())
    n_seeds = seeds.count()
    step = with_traversal(both).select("node", "other", "tw")
    near = step.join(seeds, "node").select(F.col("other").alias("node"))
    working = scratch.keep(seeds.union(near).distinct())
    total = step.groupBy("node").agg(F.sum("tw").alias("total"))
    flow = scratch.keep(
        step.join(working, "node").join(total, "node").join(working.toDF("other"), "other").select("node", "other", (F.col("tw") / F.col("total")).alias("share"))
    )
    start = working.join(seeds.withColumn("p", F.lit(1.0 / max(1, n_seeds))), "node", "left").select("node", F.coalesce("p", F.lit(0.0)).alias("p"))
    start = scratch.keep(start)
    stuck = scratch.keep(seeds.join(step.select("node"), "node", "left_anti"))
    n_stuck = stuck.count()
    size = start.count() if n_stuck else 0
    rank = start.select("node", F.col("p").alias("rank"))
    for r in range(1, rounds + 1):
        sent = rank.join(flow, "node").groupBy(F.col("other").alias("node")).agg(F.sum(F.col("rank") * F.col("share") * damping).alias("sent"))
        nxt = start.join(sent, "node", "left").select("node", (F.col("p") * (1 - damping) + F.coalesce("sent", F.lit(0.0))).alias("rank"))
        if n_stuck:
            spread = rank.join(stuck, "node", "left_semi").agg(F.coalesce(F.sum("rank"), F.lit(0.0)).alias("stuck"))
            nxt = nxt.join(spread, F.lit(True)).select("node", (F.col("rank") + F.col("stuck") * (damping / size)).alias("rank"))  # one row
        # the lineage is cut every few rounds
        if r % CUT_EVERY == 0 and r < rounds:
            nxt = scratch.keep(nxt)
            if tolerance is not None:
                change = nxt.join(rank.withColumnRenamed("rank", "before"), "node").agg(F.sum(F.abs(F.col("rank") - F.col("before")))).first()[0] or 0.0
                if change < tolerance:
                    return nxt
        rank = nxt
    return rank


def causal_chains(edges: DataFrame, starts: DataFrame, depth: int = 3, least: float = 0.2) -> DataFrame:
    """(start, end, depth, path, confidence) of the simple causal paths from each start, along edge direction.

    A path is followed while the product of its weights is at least ``least``.
    """
    step = edges.filter(F.col("edge_type").isin(*CAUSAL)).groupBy("src", "dst").agg(F.max("weight").alias("w"))
    starts = Scratch(edges.sparkSession, "chains").keep(starts.select("node"))
    path = starts.select(F.col("node").alias("start"), F.col("node").alias("end"), F.array("node").alias("path"), F.lit(1.0).alias("confidence"))
    out = None
    for d in range(1, depth + 1):
        path = (
            path.join(step.toDF("end", "nxt", "w"), "end").filter(~F.array_contains("path", F.col("nxt")))
            .select("start", F.col("nxt").alias("end"), F.concat("path", F.array("nxt")).alias("path"), (F.col("confidence") * F.col("w")).alias("confidence"))
            .filter(F.col("confidence") >= least)
        )
        level = path.withColumn("depth", F.lit(d))
        out = level if out is None else out.unionByName(level)
    return out.select("start", "end", "depth", F.array_join("path", ">").alias("path"), "confidence")


def rank_score(confidence: Column, depth: Column) -> Column:
    """Longer causal paths count a little more."""
    return confidence * (1.0 + 0.2 * depth)
